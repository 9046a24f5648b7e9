"""Removal of long repeated byte strings with a sparse suffix array.

A byte goes if some string of ``length`` bytes that covers it also starts anywhere else, in this
document or another.  Strings are judged on the input; matches never cross documents.

Every string is assigned to an anchor, the ``gram`` bytes inside it whose hash is smallest (the
first of equals).  Equal strings have the same anchor at the same place, so only suffixes that
begin at anchors are compared, one in about 75 bytes:

1. An anchor whose gram occurs once repeats nothing.  Where all occurrences of a gram stand in
   the same context (all bytes of all their strings), every string of theirs is repeated.
2. Within the other grams, occurrences in equal contexts are settled likewise; one of each
   context goes on with its bytes.
3. The suffixes are range-partitioned by their leading ``gram`` bytes at sampled splitters,
   sorted in their bucket by multikey quicksort, and adjacent ones are compared.  For every
   distance d of an anchor from the start of its string, suffixes that share ``length`` - d
   bytes are neighbours; of these, those with equal d bytes before the anchor repeat.
4. Equal leading bytes lie in one bucket.  A gram with more than ``most_contexts`` contexts is
   split over buckets by the bytes that follow, and its strings are compared across the
   boundaries by their digests.

Contexts and digests are 64 and 128 bits; longer texts than ``SEGMENT`` are worked on in
overlapping segments, so memory is bounded.

Cases: null texts are empty and shorter texts keep everything; repeated rows repeat each other
(also with a null id); empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import stored, tasks_for

LENGTH = 200
GRAM = 48
#: Contexts of one gram that one bucket may hold; about 350 bytes each.
MOST_CONTEXTS = 200_000
#: Suffixes in a bucket, about.
BUCKET = 20_000
#: Bytes worked on at once; positions take the lower bits of the keys that are compared.
SEGMENT_BITS = 20
SEGMENT = 1 << SEGMENT_BITS

ANCHORS = "k1 long, k2 long, gram long, context long, low long, high long, anchor long"


def _words(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


BYTE_WORDS = _words(1, 256)
BASE = int(_words(2, 1)[0])
INVERSE = pow(BASE, -1, 1 << 64)


class Powers:
    """Powers of the hash base and of its inverse, kept per Python worker and grown as needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            with np.errstate(over="ignore"):
                for name, base in (("up", BASE), ("down", INVERSE)):
                    steps = np.full(n, base, np.uint64)
                    steps[0] = 1
                    setattr(cls, name, np.multiply.accumulate(steps))
        return cls.up[:n], cls.down[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))


def sliding_least(keys: np.ndarray, w: int) -> np.ndarray:
    """Least of every ``w`` consecutive keys, by block-wise prefix and suffix minima."""
    n = len(keys)
    blocks = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = keys
    grid = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - w + 1], ahead[w - 1:n])


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """Anchors of all strings of the texts [starts, ends) in ``data`` (at most ``SEGMENT`` bytes).

    Returns arrays: text number, gram hash, context hash, first and last string start, anchor.
    """
    empty = np.zeros(0, np.int64)
    n = len(data)
    if n < length:
        return (empty,) * 6
    up, down = Powers.to(n + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE_WORDS[data] * up[:n], dtype=np.uint64)))
        grams = mixed((sums[gram:] - sums[:-gram]) * down[:n - gram + 1])
        low_bits = np.uint64(SEGMENT - 1)
        keys = (grams & ~low_bits) | np.arange(len(grams), dtype=np.uint64)
        chosen = (sliding_least(keys, length - gram + 1) & low_bits).astype(np.int64)
        # string starts that lie within one text
        counts = np.maximum(ends - starts - length + 1, 0)
        text = np.repeat(np.arange(len(starts)), counts)
        at = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
        if not len(at):
            return (empty,) * 6
        anchor = chosen[at]
        new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))))
        low, high, anchor, text = at[new], at[np.append(new[1:], len(at)) - 1], anchor[new], text[new]
        context = (sums[high + length] - sums[low]) * down[low]
        context = mixed(context + np.uint64(BASE) * (anchor - low).astype(np.uint64) + np.uint64(INVERSE) * (high - low).astype(np.uint64))
        return text, grams[anchor].view(np.int64), context.view(np.int64), low, high, anchor


def segments(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Groups of (row, offset, bytes) of at most ``SEGMENT`` bytes; a longer text comes in parts that overlap by ``length`` - 1."""
    rows, offsets, parts, size = [], [], [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), SEGMENT - length + 1):
            part = text[at:at + SEGMENT]
            if len(part) < length:
                continue
            if size + len(part) > SEGMENT:
                yield rows, offsets, parts
                rows, offsets, parts, size = [], [], [], 0
            rows.append(row)
            offsets.append(at)
            parts.append(part)
            size += len(part)
    if parts:
        yield rows, offsets, parts


def anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            k1, k2 = batch["k1"].to_numpy(), batch["k2"].to_numpy()
            for rows, offsets, parts in segments([t.encode() for t in batch["text"]], length):
                sizes = np.array([len(p) for p in parts])
                ends = np.cumsum(sizes)
                number, g, c, low, high, at = anchors(np.frombuffer(b"".join(parts), np.uint8), ends - sizes, ends, length, gram)
                row, shift = np.array(rows)[number], (np.array(offsets) - (ends - sizes))[number]
                yield pd.DataFrame({"k1": k1[row], "k2": k2[row], "gram": g, "context": c, "low": low + shift, "high": high + shift, "anchor": at + shift})

    return docs.select("k1", "k2", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, ANCHORS)


def multikey_sort(matrix: np.ndarray) -> np.ndarray:
    """Order of the rows of a matrix of unsigned words: three-way quicksort on one word after another."""
    order = np.arange(len(matrix))
    stack = [(0, len(matrix), 0)]
    while stack:
        low, high, depth = stack.pop()
        if high - low < 2 or depth == matrix.shape[1]:
            continue
        part = order[low:high]
        if high - low <= 64:
            order[low:high] = part[np.lexsort(matrix[part, depth:].T[::-1])]
            continue
        column = matrix[part, depth]
        pivot = np.partition(column, len(column) // 2)[len(column) // 2]
        less, equal = column < pivot, column == pivot
        order[low:high] = np.concatenate((part[less], part[equal], part[~(less | equal)]))
        a, b = low + int(less.sum()), low + int(less.sum() + equal.sum())
        stack += [(low, a, depth), (a, b, depth + 1), (b, high, depth)]
    return order


def repeated_starts(befores: list[bytes], suffixes: list[bytes], first: np.ndarray, last: np.ndarray, weight: np.ndarray, length: int) -> np.ndarray:
    """Which strings of a bucket repeat: rows x distances d of the anchor from the string's start.

    ``befores`` and ``suffixes`` are the bytes before and from the anchor on, [``first``,
    ``last``] the distances of a row's strings, ``weight`` how many places have its context.
    """
    n, most = len(suffixes), int(last.max()) + 1
    lengths = np.array([len(s) for s in suffixes])
    width = -(-(int(lengths.max()) + 1) // 8) * 8
    after = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in suffixes), np.uint8).reshape(n, width)
    words = np.concatenate((after.view(">u8").astype(np.uint64), lengths[:, None].astype(np.uint64)), axis=1)
    order = multikey_sort(words)
    a, b = after[order[:-1]], after[order[1:]]
    differ = a != b
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    shared = np.concatenate(([0], np.minimum(shared, np.minimum(lengths[order[:-1]], lengths[order[1:]]))))
    before = np.frombuffer(b"".join(s[-most:].rjust(most, b"\0") if most else b"" for s in befores), np.uint8).reshape(n, most)[order]
    first, last, weight = first[order], last[order], weight[order]
    hashes = np.zeros(n, np.uint64)
    up, _ = Powers.to(most + 1)
    found = np.zeros((n, most), bool)
    for d in range(most):
        with np.errstate(over="ignore"):
            if d:
                hashes = hashes + BYTE_WORDS[before[:, most - d]] * up[d]
            block = np.cumsum(shared < length - d).astype(np.uint64)
            active = np.flatnonzero((first <= d) & (last >= d))
            if not len(active):
                continue
            key = mixed(hashes[active] + block[active] * np.uint64(INVERSE))
        _, inverse = np.unique(key, return_inverse=True)
        found[active, d] = np.bincount(inverse, weights=weight[active])[inverse] > 1
    out = np.zeros_like(found)
    out[order] = found
    return out


def runs_of(starts: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs (first, last) of sorted distinct numbers."""
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) > 1) + 1
    return list(zip(starts[np.append(0, cuts)].tolist(), starts[np.append(cuts, len(starts)) - 1].tolist()))


SPANS = "k1 long, k2 long, low long, high long"


def sorted_buckets(suffixes: DataFrame, length: int, gram: int, bucket: int) -> DataFrame:
    """Repeated strings among suffixes (context bytes ``body``, ``low``, ``high``, ``anchor``, ``places``) of grams that fit one bucket."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        rows = pd.concat(held, ignore_index=True)
        low, high, anchor = (rows[c].to_numpy(np.int64) for c in ("low", "high", "anchor"))
        befores = [bytes(b[:a]) for b, a in zip(rows["body"], (anchor - low).tolist())]
        afters = [bytes(b[a:]) for b, a in zip(rows["body"], (anchor - low).tolist())]
        repeats = repeated_starts(befores, afters, anchor - high, anchor - low, rows["places"].to_numpy(np.int64), length)
        out = []
        for i in np.flatnonzero(repeats.any(axis=1) & (rows["places"].to_numpy() == 1)).tolist():
            starts = np.sort(anchor[i] - np.flatnonzero(repeats[i]))
            out += [(rows["k1"][i], rows["k2"][i], a, b) for a, b in runs_of(starts)]
        yield pd.DataFrame(out, columns=["k1", "k2", "low", "high"])

    spark = suffixes.sparkSession
    lead = F.substring("body", (F.col("anchor") - F.col("low") + 1).cast("int"), F.lit(gram))
    dealt = suffixes.withColumn("lead", lead).repartitionByRange(tasks_for(spark, suffixes.count(), bucket), "lead")
    return dealt.select("k1", "k2", "low", "high", "anchor", "places", "body").mapInPandas(run, SPANS)


def across_buckets(suffixes: DataFrame, length: int) -> DataFrame:
    """The same for grams too frequent for one bucket: their strings meet by digest."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k1, k2, low, high, places, body in zip(*(batch[c] for c in ("k1", "k2", "low", "high", "places", "body"))):
                n = high - low + 1
                yield pd.DataFrame({"k1": k1, "k2": k2, "low": range(low, high + 1), "places": places,
                                    "digest": [xxhash.xxh3_128_digest(body[i:i + length]) for i in range(n)]})

    strings = stored(suffixes.mapInPandas(run, "k1 long, k2 long, low long, places long, digest binary"), "strings")
    repeated = strings.groupBy("digest").agg(F.sum("places").alias("n")).where("n > 1").select("digest")
    return strings.where("places = 1").join(repeated, "digest").select("k1", "k2", "low", F.col("low").alias("high"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most_contexts: int = MOST_CONTEXTS, bucket: int = BUCKET) -> DataFrame:
    """Runs of string starts that repeat: ``k1``, ``k2`` (the row's key), ``low``, ``high``.  ``docs`` has ``k1``, ``k2``, ``text``."""
    if length < gram + 1:
        raise ValueError("strings must be longer than a gram")
    rows = anchor_rows(docs, length, gram)
    grams = stored(rows.groupBy("gram").agg(F.count("*").alias("n"), F.min("context").alias("a"), F.max("context").alias("b"))
                   .where("n > 1").select("gram", (F.col("a") != F.col("b")).alias("several")), "grams")
    members = stored(rows.join(grams, "gram"), "members")
    settled = members.where("not several").select("k1", "k2", "low", "high")

    open_ = members.where("several")
    place = F.struct("k1", "k2", "low", "high", "anchor")
    contexts = stored(open_.groupBy("gram", "context").agg(F.count("*").alias("places"), F.min(place).alias("p")), "contexts")
    equal = open_.join(contexts.where("places > 1").select("gram", "context"), ["gram", "context"]).select("k1", "k2", "low", "high")

    # a gram whose contexts all stand in several places is settled
    sizes = contexts.groupBy("gram").agg(F.count("*").alias("contexts"), F.min("places").alias("least")).where("least = 1 and contexts > 1")
    wanted = (contexts.join(sizes, "gram").select("p.*", "places", (F.col("contexts") > most_contexts).alias("heavy"))
              .groupBy("k1", "k2").agg(F.collect_list(F.struct("low", "high", "anchor", "places", "heavy")).alias("w")))
    cut = F.transform("w", lambda x: F.struct(
        x["low"].alias("low"), x["high"].alias("high"), x["anchor"].alias("anchor"), x["places"].alias("places"), x["heavy"].alias("heavy"),
        F.substring(F.col("bytes"), (x["low"] + 1).cast("int"), (x["high"] - x["low"] + length).cast("int")).alias("body")))
    suffixes = stored(docs.join(wanted, ["k1", "k2"]).select("k1", "k2", "w", F.col("text").cast("binary").alias("bytes"))
                      .select("k1", "k2", F.explode(cut).alias("s")).select("k1", "k2", "s.*"), "suffixes")
    return (settled.unionAll(equal)
            .unionAll(sorted_buckets(suffixes.where("not heavy"), length, gram, bucket))
            .unionAll(across_buckets(suffixes.where("heavy"), length)))


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows with a two-part key: the id, and a hash of the text; equal rows share it."""
    body = F.coalesce(F.col(text), F.lit(""))
    number = F.col(doc_id).cast("bigint")
    return docs.select(number.alias("doc_id"), F.coalesce(number, F.lit(-1)).alias("k1"), F.xxhash64(number.isNull(), body).alias("k2"), body.alias("text"))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM,
                    most_contexts: int = MOST_CONTEXTS, bucket: int = BUCKET) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_bytes``, ``spans`` (removed runs as start and end, exclusive) and ``kept`` (the remaining bytes)."""
    rows = keyed(docs, doc_id, text)
    spans = (repeated_spans(rows, length, gram, most_contexts, bucket)
             .groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("starts")))

    @F.pandas_udf("struct<spans:array<struct<start:long,end:long>>,kept:binary>")
    def cut(texts: pd.Series, starts: pd.Series) -> pd.DataFrame:
        out = []
        for t, s in zip(texts, starts):
            data, runs, parts, at = t.encode(), [], [], 0
            for x in [] if s is None else s:
                a, b = x["low"], x["high"] + length
                if runs and a <= runs[-1]["end"]:
                    runs[-1]["end"] = max(runs[-1]["end"], b)
                else:
                    runs.append({"start": a, "end": b})
            for r in runs:
                parts.append(data[at:r["start"]])
                at = r["end"]
            out.append((runs, b"".join([*parts, data[at:]])))
        return pd.DataFrame(out, columns=["spans", "kept"])

    return (rows.join(spans, ["k1", "k2"], "left").select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), cut("text", "starts").alias("c"))
            .select("doc_id", "n_bytes", "c.spans", "c.kept"))


def removed(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
