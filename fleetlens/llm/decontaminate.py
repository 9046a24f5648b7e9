"""Benchmark decontamination by pigeonhole edit matching.

Test items and documents are reduced to lower-case letters and digits with single blanks.  An
item of m characters may be off by k = m // ``chars_per_error`` edits (insert, delete, replace).
It is split into k + 1 pieces; a document part within k edits holds at least one piece exactly.
Pieces are found with an Aho-Corasick automaton over the whole document; the part around a hit
is verified with Myers' bit-parallel distance, in which the item may begin and end anywhere.
Hits of one item whose parts overlap are verified once, over their common part.

The items go to the tasks in blocks of at most ``block_chars`` characters; every block scans all
documents, so the memory of a task does not grow with the benchmark.

Items of fewer than ``least_chars`` characters match without errors and as whole words only.

Cases: null or empty texts hold nothing; items that are null or reduce to nothing match
nothing; repeated items match separately; a null doc_id is kept as null; extra columns are ignored; empty tables give an empty
result; ties in distance go to the earliest end.
"""

from __future__ import annotations

import re

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One edit is allowed per so many characters; it is the length of a piece, about.
CHARS_PER_ERROR = 16
#: Shorter items (after reduction) match exactly, between blanks.
LEAST_CHARS = 32
#: Characters of items in one automaton.
BLOCK_CHARS = 4_000_000

OTHER = re.compile(r"[\W_]+")
HITS = "array<struct<item:long,distance:int,end:int>>"


def reduced(text: str | None) -> str:
    """Lower-case letters and digits, anything else as one blank."""
    return OTHER.sub(" ", (text or "").lower()).strip()


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """The item in ``errors`` + 1 nearly equal pieces with their offsets."""
    n = errors + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern_masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any substring of ``text`` and the first end (exclusive) that has it."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for at, ch in enumerate(text, 1):
        eq = pattern_masks.get(ch, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & full
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        plus, minus = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, at
    return best, end


class Matcher:
    """Piece automaton and bit masks of a block of items."""

    def __init__(self, items: list[tuple[int, str]], chars_per_error: int = CHARS_PER_ERROR, least_chars: int = LEAST_CHARS):
        self.least_chars = least_chars
        self.items, self.masks = [], []
        owners: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            errors = 0 if len(text) < least_chars else len(text) // chars_per_error
            masks: dict[str, int] = {}
            for i, ch in enumerate(text):
                masks[ch] = masks.get(ch, 0) | 1 << i
            for at, piece in pieces(text, errors):
                owners.setdefault(piece, []).append((len(self.items), at))
            self.items.append((item_id, text, errors))
            self.masks.append(masks)
        self.automaton = ahocorasick.Automaton()
        for piece, who in owners.items():
            self.automaton.add_word(piece, (len(piece), who))
        if owners:
            self.automaton.make_automaton()

    def __call__(self, text: str | None) -> list[dict]:
        body = reduced(text)
        if not body or not self.items:
            return []
        around: dict[int, list[tuple[int, int]]] = {}
        words: dict[int, int] = {}
        for last, (size, who) in self.automaton.iter(body):
            for k, at in who:
                _, item, errors = self.items[k]
                begin = last + 1 - size - at
                if len(item) < self.least_chars:
                    if k not in words and body[begin - 1:begin] in ("", " ") and body[last + 1:last + 2] in ("", " "):
                        words[k] = last + 1
                    continue
                around.setdefault(k, []).append((max(0, begin - errors), begin + len(item) + errors))
        found = [{"item": self.items[k][0], "distance": 0, "end": end} for k, end in sorted(words.items())]
        for k, parts in sorted(around.items()):
            item_id, item, errors = self.items[k]
            best, end = errors + 1, 0
            parts.sort()
            joined = [list(parts[0])]
            for a, b in parts[1:]:
                if a <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], b)
                else:
                    joined.append([a, b])
            for a, b in joined:
                distance, stop = myers(self.masks[k], len(item), body[a:b])
                if distance < best:
                    best, end = distance, a + stop
            if best <= errors:
                found.append({"item": item_id, "distance": best, "end": end})
        return found


def leaks_of(text: Column, items: list[tuple[int, str]], chars_per_error: int = CHARS_PER_ERROR, least_chars: int = LEAST_CHARS) -> Column:
    """Array column of the items (id, distance, end in the reduced text) that a text holds."""
    built: list[Matcher] = []

    @F.pandas_udf(HITS)
    def run(texts: pd.Series) -> pd.Series:
        if not built:
            built.append(Matcher(items, chars_per_error, least_chars))
        return pd.Series([built[0](t) for t in texts], dtype=object)

    return run(text)


def item_blocks(items: DataFrame, item_id: str = "item_id", text: str = "text", block_chars: int = BLOCK_CHARS):
    """Reduced items, read in order and handed out in blocks of at most about ``block_chars`` characters."""
    block, size = [], 0
    for row in items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).toLocalIterator():
        item = reduced(row["text"])
        if not item:
            continue
        block.append((row["item_id"], item))
        size += len(item)
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
          chars_per_error: int = CHARS_PER_ERROR, least_chars: int = LEAST_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and item found in it: ``doc_id``, ``item_id``, ``distance``, ``end``."""
    out = None
    for block in item_blocks(items, block_chars=block_chars):
        part = (docs.select(F.col(doc_id).alias("doc_id"), F.explode(leaks_of(F.col(text), block, chars_per_error, least_chars)).alias("hit"))
                .select("doc_id", F.col("hit.item").alias("item_id"), F.col("hit.distance").alias("distance"), F.col("hit.end").alias("end")))
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, distance int, end int")
    return out


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text", chars_per_error: int = CHARS_PER_ERROR,
                  least_chars: int = LEAST_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Documents that hold no item, with all their columns."""
    for block in item_blocks(items, block_chars=block_chars):
        docs = docs.where(F.size(leaks_of(F.col(text), block, chars_per_error, least_chars)) == 0)
    return docs
