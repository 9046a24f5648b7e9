"""Best-fit packing into sequences of several permitted lengths.

Texts are cut into pieces of at most the largest permitted length, nothing is dropped.  Pieces
are dealt to shards of bounded size by a hash of their place in the table, each shard is packed by itself:
pieces in decreasing length go to the open bin with the least room that still takes them (ties:
the oldest bin); when none does, a bin is opened at the permitted size that promises the least
cost per token, judged by filling it from the lengths still to come; at the end every bin is
downsized to the smallest permitted size that holds its contents.  A bin of c tokens costs
``c * (1 + c / quadratic)``.

The default length is that of a byte-level tokenizer (one token per UTF-8 byte); any integer
column can be given instead.

Cases: null and empty texts have length 0, are kept as one piece of length 0, and lie in the
shard's first bin (of the smallest size, if the shard holds nothing else); equal lengths are
ordered by id, then piece; repeated ids are kept as separate rows; null ids are kept; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import stored

CAPACITIES = (2048, 4096, 8192)
#: Pieces in one shard, about; a shard leaves at most one badly filled bin of each size.
SHARD_PIECES = 20_000
QUADRATIC = 65_536

PLACED = "doc_id bigint, piece int, start bigint, n_tokens int, bin_id bigint, capacity int, offset int"


def cost(capacity: int, quadratic: int = QUADRATIC) -> float:
    return capacity * (1 + capacity / quadratic)


def promise(capacity: int, first: int, lengths: np.ndarray, left: np.ndarray, begin: int, quadratic: int) -> float:
    """Cost per token of a bin of ``capacity`` opened for a piece of length ``first``, filled greedily from the pieces still to come.

    ``lengths`` are the distinct lengths in decreasing order, ``left`` how many pieces of each remain, none before ``begin``.
    """
    room = capacity - first
    falling = -lengths
    at = max(begin, int(np.searchsorted(falling, -room)))
    while at < len(lengths) and room > 0:
        room -= min(int(left[at]), room // int(lengths[at])) * int(lengths[at])
        at = max(at + 1, int(np.searchsorted(falling, -room)))
    return cost(capacity, quadratic) / (capacity - room)


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, quadratic: int = QUADRATIC) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of every piece (in decreasing length), and the final size of every bin."""
    values, counts = np.unique(np.array([n for n in lengths if n], np.int64), return_counts=True)
    values, left = values[::-1], counts[::-1].copy()
    place = {int(v): i for i, v in enumerate(values)}
    rooms: list[tuple[int, int]] = []  # (room, bin), sorted
    used: list[int] = []
    bins, offsets = [], []
    for n in lengths:
        if n:
            left[place[n]] -= 1
        elif used:
            bins.append(0)
            offsets.append(used[0])
            continue
        at = bisect.bisect_left(rooms, (n, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            fitting = [c for c in capacities if c >= n]
            room = min(fitting, key=lambda c: (promise(c, n, values, left, place[n], quadratic), c)) if n else fitting[0]
            b = len(used)
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        if room > n:
            bisect.insort(rooms, (room - n, b))
    sizes = [min(c for c in capacities if c >= u) for u in used]
    return bins, offsets, sizes


def packed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: Column | None = None,
           capacities: tuple[int, ...] = CAPACITIES, shard_pieces: int = SHARD_PIECES, quadratic: int = QUADRATIC) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``start`` (token within the document), ``n_tokens``, ``bin_id``, ``capacity``, ``offset`` in the bin."""
    sizes = tuple(sorted(set(capacities)))
    most = sizes[-1]
    tokens = F.coalesce(F.octet_length(F.col(text)) if length is None else length, F.lit(0)).cast("bigint")
    lengths = stored(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), tokens.alias("total")), "lengths")
    pieces = (lengths.select("doc_id", "total", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("total") / most) - 1, F.lit(0)).cast("int"))).alias("piece"))
              .select("doc_id", "piece", (F.col("piece").cast("bigint") * most).alias("start"),
                      F.least(F.lit(most), F.col("total") - F.col("piece").cast("bigint") * most).cast("int").alias("n_tokens")))
    total = lengths.agg(F.sum(F.greatest(F.ceil(F.col("total") / most), F.lit(1)))).first()[0] or 0
    shards = max(1, -(-int(total) // shard_pieces))
    # dealt by the place in the stored table, so that repeated rows and ids spread over the shards
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("bigint"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets, final = pack(rows["n_tokens"].tolist(), sizes, quadratic)
        out = rows[["doc_id", "piece", "start", "n_tokens"]].copy()
        out["bin_id"] = np.array(bins, np.int64) * shards + int(key[0])
        out["capacity"] = np.array(final, np.int64)[bins]
        out["offset"] = offsets
        return out

    return dealt.groupBy("shard").applyInPandas(run, PLACED)
