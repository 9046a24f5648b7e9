"""Byte-level BPE encoding and decoding of texts of any length.

A text is cut into chunks that overlap.  Every chunk is split into pre-tokens from its own start,
side by side with the others.  The pattern looks ahead only, so two runs over the same text agree
from the first place on at which both begin a pre-token: the smallest such place in the overlap of
two neighbours is their seam.  Neighbours whose overlap holds none (a pre-token longer than the
overlap) become one chunk and are split again, until every pair has a seam.  Between its two
seams a chunk's pre-tokens are those of the whole text; each is encoded by itself, by merging
the adjacent pair of the lowest rank, the leftmost of equals.  Decoding concatenates the bytes of the ids.

A text that is one chunk is encoded where it lies.  The chunks of longer ones are written to the
shared folder once and spread over all tasks; they come together again in order, as a stream.

Cases: null and empty texts have no ids; repeated rows and ids stay rows of their own; null ids
are kept; extra columns are ignored; an empty table gives an empty result; a pre-token of any
length is one unit of work, in O(n log n).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import stored

#: Characters of a chunk without its overlap, and of the overlap with the next one.
CHUNK_CHARS = 32_768
OVERLAP_CHARS = 2_048
#: Places so near to the end of what a chunk sees are not trusted: the pattern looks at most so far ahead.
LOOK_AHEAD = 4
#: Pre-tokens whose ids one Python worker remembers.
REMEMBERED = 500_000
#: From so many bytes on a pre-token is merged with a heap.
LONG_PIECE = 64
#: Characters of chunks handed to Spark at once.
BATCH_CHARS = 4_000_000

CHUNKS = "row bigint, doc_id bigint, chunk int, last boolean, start bigint, body string, ahead string"
IDS = "row bigint, doc_id bigint, chunk int, ids binary"
DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, n_bytes bigint, decoded_sha256 string"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_vocabulary(path: str | None = None) -> bytes:
    """Content of a rank file (about 1 MB), read on the driver and sent with the tasks."""
    with open(path or vocabulary_path(), "rb") as f:
        return f.read()


class Bpe:
    """Encoder and decoder over one rank file and one pattern."""

    def __init__(self, vocabulary: bytes, split: str):
        import regex
        import tiktoken

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.bytes_of = {i: piece for piece, i in self.ranks.items()}
        self.split = regex.compile(split)
        # given one pre-token alone it merges just that one
        self.library = tiktoken.Encoding("own", pat_str=split, mergeable_ranks=self.ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        return self.split.findall(text)

    def merged(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        if len(piece) >= LONG_PIECE:
            return self.merged_long(piece)
        return self.library.encode_ordinary(piece.decode("utf-8", "surrogatepass"))

    def merged_long(self, piece: bytes) -> list[int]:
        """The same for a long pre-token, with a heap of (rank, place) over a linked list of parts."""
        n = len(piece)
        end = list(range(1, n + 1))  # end of the part that begins here; 0 once it is merged away
        before = list(range(-1, n - 1))
        rank, heap = self.ranks.get, []

        def offer(a: int) -> None:
            b = end[a]
            if b < n:
                r = rank(piece[a:end[b]])
                if r is not None:
                    heapq.heappush(heap, (r, a, end[b]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, a, stop = heapq.heappop(heap)
            b = end[a]
            if not b or b >= n or end[b] != stop:
                continue
            end[a], end[b] = stop, 0
            if stop < n:
                before[stop] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        ids, a = [], 0
        while a < n:
            ids.append(self.ranks[piece[a:end[a]]])
            a = end[a]
        return ids

    def encode(self, pieces: list[str]) -> bytes:
        """Ids of pre-tokens as little-endian unsigned 32-bit integers."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for p in set(pieces).difference(known):
            known[p] = np.array(self.merged(p.encode("utf-8", "surrogatepass")), "<u4").tobytes()
        return b"".join(map(known.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def seams(self, text: str, low: int, high: int) -> np.ndarray:
        """Starts of pre-tokens of ``text`` in [low, high)."""
        ends = np.cumsum(np.fromiter(map(len, self.pieces(text)), np.int64)) if text else np.zeros(0, np.int64)
        return ends[(ends >= low) & (ends < high)]


@lru_cache(maxsize=2)
def coder(vocabulary: bytes, split: str) -> Bpe:
    return Bpe(vocabulary, split)


def cut(docs: DataFrame, chunk_chars: int, overlap: int) -> DataFrame:
    """Chunks of the texts, each with what follows it in its text; ``row`` tells equal rows apart."""
    rows = docs.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for row, doc, text in zip(batch["row"], batch["doc_id"], batch["text"]):
                for k, at in enumerate(range(0, len(text), chunk_chars)):
                    body = text[at:at + chunk_chars]
                    held.append((row, doc, k, at + chunk_chars >= len(text), at, body, text[at + chunk_chars:at + chunk_chars + overlap]))
                    size += len(body)
                    if size >= BATCH_CHARS:
                        yield pd.DataFrame(held, columns=[f.split()[0] for f in CHUNKS.split(", ")]).astype({"doc_id": "Int64"})
                        held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=[f.split()[0] for f in CHUNKS.split(", ")]).astype({"doc_id": "Int64"})

    return rows.mapInPandas(run, CHUNKS)


def with_edges(chunks: DataFrame, vocabulary: bytes, split: str, overlap: int) -> DataFrame:
    """Adds ``head`` and ``tail``: starts of pre-tokens in what a chunk shares with the one before and the one behind it, as places in the text."""
    @F.pandas_udf("head array<bigint>, tail array<bigint>")
    def edges(start: pd.Series, last: pd.Series, body: pd.Series, ahead: pd.Series) -> pd.DataFrame:
        bpe, heads, tails = coder(vocabulary, split), [], []
        for s, is_last, b, a in zip(start, last, body, ahead):
            seen = b + a
            sure = len(seen) if is_last else len(seen) - LOOK_AHEAD
            ends = bpe.seams(seen, 0, max(sure, 0))
            # the chunk's own start is a place at which this run begins a pre-token, too
            heads.append([s, *(ends[ends < overlap] + s).tolist()] if len(b) else [])
            tails.append((ends[ends >= len(b)] + s).tolist())
        return pd.DataFrame({"head": heads, "tail": tails})

    return chunks.withColumn("e", edges("start", "last", "body", "ahead")).select(*chunks.columns, "e.head", "e.tail")


def seamed(chunks: DataFrame, vocabulary: bytes, split: str, overlap: int) -> DataFrame:
    """Chunks with ``low`` and ``high``, the seams between which a chunk's pre-tokens are those of the text."""
    order = Window.partitionBy("row").orderBy("chunk")
    spread = chunks.repartition(F.col("row"), F.col("chunk"))
    done = stored(with_edges(spread, vocabulary, split, overlap), "edges")
    while True:
        # edges are a few hundred numbers a chunk; the texts stay out of the window
        seam = F.array_min(F.array_intersect("tail", F.lead("head").over(order)))
        marks = done.select("row", "chunk", "last", "head", "tail").withColumn("high", seam).select("row", "chunk", "last", "high")
        open_ends = marks.where("not last and high is null")
        if open_ends.isEmpty():
            low = F.coalesce(F.lag("high").over(order), F.lit(0).cast("bigint"))
            return done.drop("head", "tail", "last").join(marks.withColumn("low", low), ["row", "chunk"])
        joined = F.coalesce(F.lag(F.col("high").isNull() & ~F.col("last")).over(order), F.lit(False))
        first = F.last(F.when(~joined, F.col("chunk")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
        groups = marks.withColumn("joined", joined).withColumn("first", F.coalesce(first, F.col("chunk")))
        groups = groups.select("row", "chunk", "first", F.count("*").over(Window.partitionBy("row", "first")).alias("members"))
        both = done.join(groups, ["row", "chunk"])
        parts = F.sort_array(F.collect_list(F.struct("chunk", "start", "last", "body", "ahead")))
        made = (both.where("members > 1").groupBy("row", "doc_id", F.col("first").alias("chunk")).agg(parts.alias("p"))
                .select("row", "doc_id", "chunk", F.element_at("p", -1)["last"].alias("last"), F.col("p")[0]["start"].alias("start"),
                        F.array_join("p.body", "").alias("body"), F.element_at("p", -1)["ahead"].alias("ahead")))
        whole = both.where("members = 1").select(*done.columns)
        done = stored(whole.unionByName(with_edges(made, vocabulary, split, overlap)), "edges")


def encoded_long(docs: DataFrame, vocabulary: bytes, split: str, chunk_chars: int, overlap: int) -> DataFrame:
    chunks = stored(cut(docs, chunk_chars, overlap), "chunks")

    @F.pandas_udf("binary")
    def ids(start: pd.Series, low: pd.Series, high: pd.Series, body: pd.Series, ahead: pd.Series) -> pd.Series:
        bpe, out = coder(vocabulary, split), []
        for s, a, b, text, more in zip(start, low, high, body, ahead):
            seen = text + more
            seen = seen[int(a) - s:]  # a seam: from here on the run is the text's own
            pieces = bpe.pieces(seen)
            if not pd.isna(b):
                ends = np.cumsum(np.fromiter(map(len, pieces), np.int64))
                pieces = pieces[:int(np.searchsorted(ends, int(b) - int(a), side="right"))]
            out.append(bpe.encode(pieces))
        return pd.Series(out, dtype=object)

    known = seamed(chunks, vocabulary, split, overlap)
    return known.select("row", "doc_id", "chunk", ids("start", "low", "high", "body", "ahead").alias("ids"))


def encoded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, split: str | None = None,
            chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> tuple[DataFrame, DataFrame]:
    """Ids of the texts, as little-endian unsigned 32-bit integers.

    Returns two frames: ``doc_id``, ``ids`` of the texts that are one chunk, one row each; and
    ``row``, ``doc_id``, ``chunk``, ``ids`` of the longer ones, to be concatenated by chunk within a row.
    """
    if overlap <= LOOK_AHEAD or chunk_chars <= overlap:
        raise ValueError("the overlap must be longer than the look-ahead and shorter than a chunk")
    ranks, split = read_vocabulary(vocabulary), split or pattern()
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    @F.pandas_udf("binary")
    def whole(texts: pd.Series) -> pd.Series:
        bpe = coder(ranks, split)
        return pd.Series([bpe.encode(bpe.pieces(t)) for t in texts], dtype=object)

    short = rows.where(F.length("text") <= chunk_chars).select("doc_id", whole("text").alias("ids"))
    return short, encoded_long(rows.where(F.length("text") > chunk_chars), ranks, split, chunk_chars, overlap)


def decoded(ids: Column, vocabulary: str | None = None) -> Column:
    """Bytes of an ``ids`` column."""
    ranks, split = read_vocabulary(vocabulary), pattern()

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        bpe = coder(ranks, split)
        return pd.Series([bpe.decode(v) for v in values], dtype=object)

    return run(ids)


def digests(short: DataFrame, long: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per text: ``doc_id``, ``n_tokens``, ``ids_sha256``, ``n_bytes`` and ``decoded_sha256`` of what the ids decode to."""
    ranks, split = read_vocabulary(vocabulary), pattern()
    names = [f.split()[0] for f in DIGESTS.split(", ")]

    @F.pandas_udf("n_tokens bigint, ids_sha256 string, n_bytes bigint, decoded_sha256 string")
    def of_whole(values: pd.Series) -> pd.DataFrame:
        bpe, out = coder(ranks, split), []
        for ids in values:
            back = bpe.decode(ids)
            out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), len(back), hashlib.sha256(back).hexdigest()))
        return pd.DataFrame(out, columns=names[1:])

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, now, state = coder(ranks, split), None, None

        def row() -> tuple:
            return (state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest())

        for batch in batches:
            done = []
            for r, doc, ids in zip(batch["row"], batch["doc_id"], batch["ids"]):
                if r != now:
                    if state:
                        done.append(row())
                    now, state = r, [None if pd.isna(doc) else int(doc), 0, hashlib.sha256(), 0, hashlib.sha256()]
                back = bpe.decode(ids)
                state[1] += len(ids) // 4
                state[2].update(ids)
                state[3] += len(back)
                state[4].update(back)
            yield pd.DataFrame(done, columns=names).astype({"doc_id": "Int64"})
        if state:
            yield pd.DataFrame([row()], columns=names).astype({"doc_id": "Int64"})

    one = short.select("doc_id", of_whole("ids").alias("d")).select("doc_id", "d.*")
    return one.unionByName(long.repartition("row").sortWithinPartitions("row", "chunk").mapInPandas(stream, DIGESTS))
