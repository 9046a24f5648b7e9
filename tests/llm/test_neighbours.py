import numpy as np
from pyspark.sql import functions as F

from fleetlens.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, score int"


def test_recall_and_order(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(10, 16))
    points = (centres[rng.integers(0, 10, 1500)] + rng.normal(size=(1500, 16)) * 0.3).astype(np.float32)
    points[100:140] = points[99]
    df = spark.createDataFrame([(i, p.tolist(), 0) for i, p in enumerate(points)], SCHEMA)
    rows = N.nearest(df, F.col("vec_id") % 50 == 0, shard=400).collect()
    found = {}
    for r in rows:
        found.setdefault(r["query_id"], []).append(r)
    assert set(found) == set(range(0, 1500, 50))
    exact, hits = points.astype(float), 0
    for q, got in found.items():
        got.sort(key=lambda r: r["rank"])
        d = np.sqrt(((exact - exact[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        assert [r["rank"] for r in got] == list(range(1, 11))
        assert all(abs(r["score"] - d[r["vec_id"]]) < 1e-12 for r in got)
        assert [(r["score"], r["vec_id"]) for r in got] == sorted((r["score"], r["vec_id"]) for r in got)
        hits += len({r["vec_id"] for r in got} & set(np.lexsort((np.arange(1500), d))[:10].tolist()))
    assert hits >= 0.9 * 10 * len(found)
    assert [r["vec_id"] for r in found[100]] == [99, *range(101, 110)]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, -0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    got = [tuple(r) for r in N.nearest(df, F.lit(True)).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 9, 0.0), (0, 2, 1, 1.0), (1, 1, 0, 1.0), (1, 2, 9, 1.0), (9, 1, 0, 0.0), (9, 2, 1, 1.0)]
    assert N.nearest(df.limit(0), F.lit(True)).count() == 0


def test_shards_searched_by_several_tasks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, p.tolist(), 0) for i, p in enumerate(rng.normal(size=(400, 8)).astype(np.float32))], SCHEMA).repartition(4)
    whole = {tuple(r) for r in N.nearest(df, F.lit(True), k=3, shard=150).collect()}
    monkeypatch.setattr(N, "QUERY_BLOCK", 20)
    split = {tuple(r) for r in N.nearest(df, F.lit(True), k=3, shard=150, task_blocks=3).collect()}
    assert split == whole and len(whole) == 1200
