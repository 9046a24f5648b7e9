"""Row numbers against a sort in Python, and the size of the ranges."""
import random

from pyspark.sql import functions as F

from fleetlens.operators import deltas
from fleetlens.operators.numbering import numbered, ranged

SCHEMA = "k string, at timestamp, seq long"


def rows_of(at, n, seed=1):
    rnd = random.Random(seed)
    rows = [(rnd.choice(["hot", "hot", "hot", "a", None]), None if i % 9 == 0 else at(rnd.randrange(3600)), i) for i in range(n)]
    rnd.shuffle(rows)
    return rows


def expected(rows, keyed):
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2]) if r[1] else (False, 0, r[2]))
    seen, out = {}, {}
    for r in order:
        k = r[0] if keyed else 0
        seen[k] = seen.get(k, 0) + 1
        out[r[2]] = seen[k]
    return out


def test_one_hour_without_and_with_keys(spark, at):
    rows = rows_of(at, 3000)
    df = spark.createDataFrame(rows, SCHEMA)
    for keys in ([], ["k"]):
        got = {r["seq"]: r["ordinal"] for r in deltas.with_ordinal(df, "at", "seq", keys).collect()}
        assert got == expected(rows, bool(keys))


def test_no_range_holds_a_whole_group(spark, at):
    df = spark.createDataFrame(rows_of(at, 4000), SCHEMA)
    placed = ranged(df, [F.col("k").asc_nulls_first(), F.col("at").asc_nulls_first(), F.col("seq").asc()], 16)
    sizes = [r["count"] for r in placed.groupBy("_range").count().collect()]
    assert len(sizes) == 16 and max(sizes) <= 2 * 4000 / 16
    assert placed.where("k = 'hot'").select("_range").distinct().count() > 5


def test_empty_and_ties(spark, at):
    df = spark.createDataFrame([("a", at(1), 1)] * 4, SCHEMA)
    assert sorted(r["ordinal"] for r in numbered(df, ["at"], ["k"]).collect()) == [1, 2, 3, 4]
    assert numbered(df.limit(0), ["at"], ["k"]).collect() == []
