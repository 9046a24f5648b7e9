"""SimHash near-duplicate groups by a self-join of binary tries.

Fingerprints are 64 bits over word shingles.  Distinct fingerprints form a binary trie; its
upper part is cut into nodes of bounded size, and every pair of nodes whose prefixes differ in
at most ``budget`` bits is one unit of work.  Inside, both sub-tries are walked together level
by level; a pair of nodes carries the bits that differ so far and is dropped as soon as they
exceed the budget.  Half the budget is tried first, and a pair of nodes that lies in one
group already is dropped as well, so a crowd of near copies is not compared pair by pair.  Each
unit returns a spanning forest of its links; the forests are joined into components.

Cases: a null, empty or blank text has fingerprint zero, which links like any other; equal
fingerprints are always linked; rows with a null id are fingerprinted, get the component of
their links, and never name a component unless every member's id is null (then it is null);
repeated rows are kept; extra columns are ignored by ``near_duplicates``; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import connected, few, stored, tasks_for

BITS = 64
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bits by which the cut of the trie grows between two counts; at most 2**STRIDE counts reach the driver per heavy node.
STRIDE = 10
#: Most distinct fingerprints under one node of the cut; small inputs are cut finer, for more tasks.
NODE_CAP = 250_000


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes, unsigned: the bits set in over half of them."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        piece = hashes[at:at + 65536]
        ones += np.unpackbits(piece.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_of(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The fingerprint of one text, unsigned."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = (starts[:-words + 1 or None], ends[words - 1:]) if len(parts) >= words else (starts[:1], ends[-1:])
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], seed) for s, e in zip(first.tolist(), last.tolist())], dtype="<u8")
    return majority(hashes)


def fingerprint(text: Column, words: int = 4, seed: int = 42) -> Column:
    """Fingerprint column as a signed bigint of the same bits."""
    @F.pandas_udf(T.LongType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(t, words, seed) for t in texts], dtype=np.uint64).view(np.int64))

    return run(text)


class Trie:
    """Levels of the binary trie over sorted distinct values: per level the nodes and their two children."""

    def __init__(self, values: np.ndarray, depth: int):
        self.values, self.depth = values, depth
        self.starts: dict[int, np.ndarray] = {}
        self.children: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.single: dict[int, np.ndarray] = {}
        self.level(depth)

    def level(self, d: int) -> np.ndarray:
        if d not in self.starts:
            keys = self.values >> np.uint64(BITS - d) if d else np.zeros(len(self.values), np.uint64)
            self.starts[d] = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            self.single[d] = np.diff(np.append(self.starts[d], len(self.values))) == 1
        return self.starts[d]

    def below(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the 0 child and the 1 child at level d + 1, -1 where there is none."""
        if d not in self.children:
            here, under = self.level(d), self.level(d + 1)
            bit = (self.values[under] >> np.uint64(BITS - d - 1)) & np.uint64(1)
            owner = np.searchsorted(here, under, side="right") - 1
            pair = np.full((2, len(here)), -1, np.int32)
            pair[bit.astype(np.int64), owner] = np.arange(len(under), dtype=np.int32)
            self.children[d] = (pair[0], pair[1])
        return self.children[d]

    def uniform(self, d: int, labels: np.ndarray) -> np.ndarray:
        """The label shared by all values under each node, or -1."""
        starts = self.level(d)
        low, high = np.minimum.reduceat(labels, starts), np.maximum.reduceat(labels, starts)
        return np.where(low == high, low, -1)


def merged(labels: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels after uniting the pairs (x, y): hook to the smaller label, then halve paths, until stable."""
    while True:
        a, b = labels[x], labels[y]
        apart = a != b
        if not apart.any():
            return labels
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            nearer = labels[labels]
            if np.array_equal(nearer, labels):
                break
            labels = nearer


def walk(left: Trie, right: Trie, same: bool, budget: int, labels: np.ndarray, chunk: int = 1 << 20) -> np.ndarray:
    """Labels over the values of both tries after linking all pairs within ``budget`` bits."""
    n = len(left.values)
    top = min(left.depth, right.depth)
    shift = np.uint64(BITS - top) if top else None
    gap = int(np.bitwise_count((left.values[0] ^ right.values[0]) >> shift)) if top else 0
    if gap > budget:
        return labels
    mine = lambda d: left.uniform(d, labels[:n])
    theirs = lambda d: right.uniform(d, labels[n:] if not same else labels)
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    zero = np.zeros(1, np.int32)
    stack = [(top, zero, zero, np.array([gap], np.int8))]
    while stack:
        d, a, b, errors = stack.pop()
        if len(a) > chunk:
            stack += [(d, a[i:i + chunk], b[i:i + chunk], errors[i:i + chunk]) for i in range(0, len(a), chunk)]
            continue
        if d not in known:
            known[d] = (mine(d), theirs(d))
        la, lb = known[d][0][a], known[d][1][b]
        open_ = (la < 0) | (la != lb)
        a, b, errors = a[open_], b[open_], errors[open_]
        leaf = left.single[d][a] & right.single[d][b] if d < BITS else np.ones(len(a), bool)
        if leaf.any():
            i, j = left.level(d)[a[leaf]], right.level(d)[b[leaf]]
            near = np.bitwise_count(left.values[i] ^ right.values[j]) <= budget
            if near.any():
                labels = merged(labels, i[near], j[near] + (0 if same else n))
                known.clear()
            a, b, errors = a[~leaf], b[~leaf], errors[~leaf]
        if not len(a):
            continue
        (a0, a1), (b0, b1) = left.below(d), right.below(d)
        parts = []
        less = errors < budget
        ca, cb, ce = a[less], b[less], errors[less] + np.int8(1)
        apart = ca != cb if same else slice(None)  # where both nodes are one, (1, 0) mirrors (0, 1)
        for x, y, pa, pb, pe in ((a0, b0, a, b, errors), (a1, b1, a, b, errors), (a0, b1, ca, cb, ce), (a1, b0, ca[apart], cb[apart], ce[apart])):
            na, nb = x[pa], y[pb]
            keep = (na >= 0) & (nb >= 0)
            parts.append((na[keep], nb[keep], pe[keep]))
        stack.append((d + 1, *(np.concatenate(p) for p in zip(*parts))))
    return labels


def forest(left: np.ndarray, left_depth: int, right: np.ndarray, right_depth: int, same: bool, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (value, other value) of all pairs within ``budget`` bits between two sorted value arrays."""
    a = Trie(left, left_depth)
    b = a if same else Trie(right, right_depth)
    values = left if same else np.concatenate((left, right))
    labels = np.arange(len(values))
    for allowed in sorted({budget // 2, budget}):
        labels = walk(a, b, same, allowed, labels)
    moved = np.flatnonzero(labels != np.arange(len(values)))
    return values[moved], values[labels[moved]]


def cut(prints: DataFrame, cap: int) -> list[tuple[int, int]]:
    """Trie nodes (prefix, depth) that hold all fingerprints, each at most ``cap`` of them where more than one remains."""
    nodes, heavy, depth = [], [0], 0
    while heavy:
        width = min(STRIDE, BITS - depth)
        under = prints.where(F.shiftrightunsigned("fp", BITS - depth).isin(heavy)) if depth else prints
        key = F.shiftrightunsigned("fp", BITS - depth - width)
        counts = {r[0] & (1 << BITS) - 1: r[1] for r in under.groupBy(key.alias("k")).count().collect()}
        level, counts_at = depth + width, {(k, depth + width): c for k, c in counts.items()}
        for d in range(level - 1, depth - 1, -1):
            for (k, at), c in list(counts_at.items()):
                if at == d + 1:
                    counts_at[(k >> 1, d)] = counts_at.get((k >> 1, d), 0) + c
        stack = [(p, depth) for p in heavy]
        heavy = []
        while stack:
            p, d = stack.pop()
            c = counts_at.get((p, d), 0)
            if not c:
                continue
            if c <= cap or d == BITS:
                nodes.append((p, d))
            elif d == level:
                heavy.append(p)
            else:
                stack += [(2 * p, d + 1), (2 * p + 1, d + 1)]
        depth = level
    return sorted(nodes, key=lambda n: n[0] << (BITS - n[1]))


def node_pairs(nodes: list[tuple[int, int]], budget: int) -> np.ndarray:
    """Index pairs (i <= j) of nodes whose common prefix bits differ in at most ``budget`` places."""
    starts = np.array([p << (BITS - d) for p, d in nodes], np.uint64)
    depths = np.array([d for _, d in nodes])
    masks = np.array([((1 << d) - 1) << (BITS - d) for d in range(BITS + 1)], np.uint64)
    found = []
    for i in range(len(nodes)):
        shared = masks[np.minimum(depths[i], depths[i:])]
        near = np.flatnonzero(np.bitwise_count((starts[i] ^ starts[i:]) & shared) <= budget)
        found.append(np.stack((np.full(len(near), i), near + i), axis=1))
    return np.concatenate(found)


def fingerprint_links(prints: DataFrame, budget: int = 4, node_cap: int = NODE_CAP) -> DataFrame:
    """Spanning links ``a``, ``b`` between distinct fingerprints (column ``fp``, bigint) within ``budget`` bits."""
    spark = prints.sparkSession
    total = prints.count()
    link = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    if not total:
        return spark.createDataFrame([], link)
    nodes = cut(prints, min(node_cap, max(node_cap // 64, total // 24)))
    starts = np.array([p << (BITS - d) for p, d in nodes], np.uint64)
    depths = [d for _, d in nodes]

    @F.pandas_udf(T.IntegerType())
    def node_of(fp: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(starts, fp.to_numpy(np.int64).view(np.uint64), side="right") - 1, dtype="int32")

    blocks = stored(few(prints.select(node_of("fp").alias("node"), "fp").groupBy("node").agg(F.collect_list("fp").alias("values")), len(nodes), 8), "trie")
    # an Arrow table is read by the JVM; rows of a pandas frame would go through Python workers of their own kind, which stay
    pairs = spark.createDataFrame(pa.table(dict(zip("ij", node_pairs(nodes, budget).T))))
    work = (pairs.join(blocks.select(F.col("node").alias("i"), F.col("values").alias("left")), "i")
            .join(blocks.select(F.col("node").alias("j"), F.col("values").alias("right")), "j")
            .repartition(tasks_for(spark, pairs.count(), 8)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, j, left, right in zip(batch["i"], batch["j"], batch["left"], batch["right"]):
                left, right = (np.sort(np.asarray(v, dtype=np.int64).view(np.uint64)) for v in (left, right))
                x, y = forest(left, depths[i], right, depths[j], i == j, budget)
                yield pd.DataFrame({"a": x.view(np.int64), "b": y.view(np.int64)})

    return work.select("i", "j", "left", "right").mapInPandas(run, link)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, seed: int = 42, budget: int = 4) -> DataFrame:
    """Per row of ``docs``: id, ``fp`` (bigint) and ``component_id`` (smallest id reachable over links)."""
    prints = stored(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), words, seed).alias("fp")), "prints")
    owners = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("owner")), "owners")
    groups = stored(connected(fingerprint_links(owners.select("fp"), budget)), "groups")
    labelled = owners.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "owner", F.coalesce("component", "fp").alias("component"))
    smallest = labelled.groupBy("component").agg(F.min("owner").alias("component_id"))
    final = labelled.join(smallest, "component").select("fp", "component_id")
    return prints.join(final, "fp").select("doc_id", "fp", "component_id")


def hex_print(fp: Column) -> Column:
    """Sixteen lowercase hex digits of a bigint fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
