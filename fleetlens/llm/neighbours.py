"""Approximate nearest neighbours on robust-pruned directed graphs.

Equal vectors are one node that keeps its smallest ids.  Nodes are dealt by hash to shards of
bounded size.  A shard's graph is built by inserting nodes in growing batches: a greedy beam
search from the entry proposes neighbours, robust pruning keeps a candidate only while no kept one
is closer to it than ``alpha`` times less than the node, and reverse edges are added and pruned in
the same way.  Every query is searched by beam in every shard of its dimension: a task holds the nodes
of one shard while the blocks of queries pass by; the shards' best are ranked together by exact
distances.

Cases: null, empty and zero vectors, vectors with null or non-finite components, and rows with a
null id take no part; vectors of different dimensions never meet; equal rows of one
id count once, and an id with several vectors has the best of its distances per vector; ties go to the smaller id; with
fewer than ``k`` candidates all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import stored

DEGREE = 32
BEAM = 80
ALPHA = 1.2
#: Nodes of a shard, about: at most ``MOST_SHARDS`` shards of at least ``SHARD`` nodes, and never more than ``LARGEST`` in one.
SHARD = 8192
MOST_SHARDS = 256
LARGEST = 300_000
#: Queries that travel together, and blocks of them that one task answers; a shard with more is searched by several tasks.
QUERY_BLOCK = 512
TASK_BLOCKS = 2048
EXPAND = 4


def distances(points: np.ndarray, nodes: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Squared distances of ``points[nodes]`` (B, C) to ``targets`` (B, dim)."""
    difference = points[nodes] - targets[:, None, :]
    return np.einsum("bcd,bcd->bc", difference, difference)


def beam_search(points: np.ndarray, graph: np.ndarray, entry: int, targets: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest ``beam`` nodes found per target, nearest first; missing ones are -1 at infinite distance."""
    count = len(targets)
    row = np.arange(count)[:, None]
    seen = np.zeros((count, len(points) + 1), bool)  # the last column stands for no node
    ids = np.full((count, beam), -1, np.int64)
    near = np.full((count, beam), np.inf, np.float32)
    done = np.ones((count, beam), bool)
    ids[:, 0], done[:, 0] = entry, False
    near[:, 0] = distances(points, np.full((count, 1), entry), targets)[:, 0]
    seen[:, [entry, -1]] = True
    active = np.arange(count)
    while len(active):
        closed = done[active]
        order = np.argsort(closed, axis=1, kind="stable")[:, :EXPAND]  # nearest that are not expanded come first
        take = ~np.take_along_axis(closed, order, 1)
        expand = np.where(take, np.take_along_axis(ids[active], order, 1), -1)
        np.put_along_axis(closed, order, True, 1)
        done[active] = closed
        new = np.where(expand[:, :, None] >= 0, graph[expand], -1).reshape(len(active), -1)
        new.sort(axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        new[seen[active[:, None], new]] = -1
        seen[active[:, None], new] = True
        new_near = np.where(new >= 0, distances(points, np.maximum(new, 0), targets[active]), np.inf).astype(np.float32)
        all_near = np.concatenate((near[active], new_near), axis=1)
        best = np.argsort(all_near, axis=1, kind="stable")[:, :beam]
        near[active] = np.take_along_axis(all_near, best, 1)
        ids[active] = np.take_along_axis(np.concatenate((ids[active], new), axis=1), best, 1)
        done[active] = np.take_along_axis(np.concatenate((done[active], new < 0), axis=1), best, 1)
        active = active[~done[active].all(axis=1)]
    return ids, near


def robust_prune(points: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, near: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` diverse neighbours per node out of its candidates (-1: none) at squared distances ``near``."""
    near = np.where((candidates < 0) | (candidates == nodes[:, None]), np.inf, near)
    order = np.argsort(near, axis=1, kind="stable")
    candidates, near = np.take_along_axis(candidates, order, 1), np.take_along_axis(near, order, 1)
    vectors = points[np.maximum(candidates, 0)]
    kept = np.full((len(nodes), degree), -1, np.int64)
    left = np.isfinite(near)
    row = np.arange(len(nodes))
    factor = alpha * alpha
    for place in range(degree):
        if not left.any():
            break
        first = left.argmax(axis=1)
        some = left[row, first]
        kept[some, place] = candidates[row, first][some]
        difference = vectors - vectors[row, first][:, None, :]
        between = np.einsum("bcd,bcd->bc", difference, difference)
        left &= ~(some[:, None] & (factor * between <= near))
        left[row, first] = False
    return kept


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, batch: int = 512) -> tuple[np.ndarray, int]:
    """Neighbour lists (n, degree; -1: none) and the entry node."""
    n = len(points)
    graph = np.full((n, degree), -1, np.int64)
    centre = points.mean(axis=0, dtype=np.float64).astype(np.float32)
    entry = int(distances(points, np.arange(n)[None, :], centre[None, :])[0].argmin())
    order = np.random.default_rng(0).permutation(n)
    order = np.concatenate(([entry], order[order != entry]))
    at = 1
    while at < n:
        nodes = order[at:at + min(batch, max(1, at))]
        at += len(nodes)
        found, near = beam_search(points, graph, entry, points[nodes], beam)
        graph[nodes] = robust_prune(points, nodes, found, near, degree, alpha)
        sources, targets = np.repeat(nodes, degree), graph[nodes].ravel()
        sources, targets = sources[targets >= 0], targets[targets >= 0]
        by = np.argsort(targets, kind="stable")
        sources, targets = sources[by], targets[by]
        who, start, many = np.unique(targets, return_index=True, return_counts=True)
        for a in range(0, len(who), batch):
            some, begin, count = who[a:a + batch], start[a:a + batch], many[a:a + batch]
            width = int(count.max())
            column = np.arange(width)
            back = np.where(column < count[:, None], sources[np.minimum(begin[:, None] + column, len(sources) - 1)], -1)
            merged = np.concatenate((graph[some], back), axis=1)
            lists = np.sort(np.where(merged < 0, n, merged), axis=1)[:, :degree]
            full = (merged >= 0).sum(axis=1) > degree
            graph[some[~full]] = np.where(lists[~full] == n, -1, lists[~full])
            if full.any():
                near = distances(points, np.maximum(merged[full], 0), points[some[full]])
                graph[some[full]] = robust_prune(points, some[full], merged[full], near, degree, alpha)
    return graph, entry


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 10,
            degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, shard: int = SHARD, task_blocks: int = TASK_BLOCKS) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the ``k`` nearest found of every row for which ``is_query`` holds."""
    rows = (vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.transform(F.col(vector).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("v"), is_query.alias("asks"))
            .where(F.col("vec_id").isNotNull() & usable(F.col("v"))))
    # a node keeps the k + 1 smallest ids, which is all that any query can need of equal vectors
    smallest = Window.partitionBy("v").orderBy("vec_id")
    nodes = stored(rows.select("v", "vec_id").distinct().withColumn("place", F.row_number().over(smallest)).where(F.col("place") <= k + 1)
                   .groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "nodes")
    total = nodes.count()
    shards = max(1, min(MOST_SHARDS, -(-total // shard)), -(-total // LARGEST))
    key = F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int")
    placed = nodes.select(F.size("v").alias("dim"), key.alias("shard"), "v", "ids")
    asked = rows.where("asks").select(F.size("v").alias("dim"), "vec_id", "v")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, some in batch.groupby("dim"):
                for at in range(0, len(some), QUERY_BLOCK):
                    part = some.iloc[at:at + QUERY_BLOCK]
                    yield pd.DataFrame({"dim": [dim], "q": [part["vec_id"].to_numpy(np.int64).tobytes()], "m": [np.stack(part["v"].to_numpy()).astype(np.float64).tobytes()]})

    blocks = stored(asked.mapInPandas(pack, "dim int, q binary, m binary"), "queries")
    parts = max(1, -(-blocks.count() // task_blocks))
    dealt = blocks.withColumn("part", F.pmod(F.xxhash64("q"), F.lit(parts)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    needed = placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    # every (shard, part) is one task: its nodes come first, the blocks of queries pass by behind them
    order = ["dim", "asking", "node"]
    work = (needed.select("shard", "part", "dim", F.lit(0).alias("asking"), F.col("ids")[0].alias("node"), "v", "ids")
            .unionByName(dealt.select("shard", "part", "dim", F.lit(1).alias("asking"), "q", "m"), allowMissingColumns=True)
            .repartitionById(shards * parts, (F.col("shard") * parts + F.col("part")).cast("int")).sortWithinPartitions(*order)
            .select("dim", "v", "ids", "q", "m"))

    def answers(exact: np.ndarray, points: np.ndarray, ids: list, graph: np.ndarray, entry: int, q: bytes, m: bytes) -> list:
        asking = np.frombuffer(q, np.int64)
        targets = np.frombuffer(m, np.float64).reshape(len(asking), -1)
        found, _ = beam_search(points, graph, entry, targets.astype(np.float32), beam)
        out = []
        for i, query in enumerate(asking.tolist()):
            hits = found[i][found[i] >= 0]
            score = np.sqrt(((exact[hits] - targets[i]) ** 2).sum(axis=1))
            pairs = [(s, v) for s, h in zip(score.tolist(), hits.tolist()) for v in ids[h] if v != query]
            out += [(query, v, s) for s, v in sorted(pairs)[:k]]
        return out

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, vectors, ids, built = None, [], [], None
        for batch in batches:
            for dim, v, names, q, m in batch.itertuples(index=False, name=None):
                if dim != here:
                    here, vectors, ids, built = dim, [], [], None
                if q is None:
                    vectors.append(np.asarray(v, dtype=np.float64))
                    ids.append(list(names))
                elif built or vectors:
                    if not built:
                        exact = np.stack(vectors)
                        vectors, points = [], exact.astype(np.float32)
                        built = (exact, points, ids, *build_graph(points, degree, beam, alpha))
                    made = answers(*built, q, m)
                    yield pd.DataFrame(made, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = work.mapInPandas(search, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.distinct().select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
