"""Helpers shared by the operators: inputs, stored intermediates, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.session import scratch_dir

#: Rows per Arrow batch; texts can be long, so batches are kept far below Spark's default.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    df.write.parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read.scratch_path = path
    return read


def discard(df: DataFrame) -> None:
    """Delete the folder of a ``stored`` frame, once all that was derived from it is stored itself."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def tasks_for(spark: SparkSession, rows: int, per_task: int) -> int:
    """Partitions for ``rows``: at least the session's default parallelism, then by size."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // per_task))


def few(df: DataFrame, rows: int, per_task: int = 1_000_000) -> DataFrame:
    """``df`` of about ``rows`` rows in no more partitions than these need, so that small shuffle partitions do not become
    as many small files: on local disks each file costs an executor a process of its own, for its permissions.

    The rows are dealt anew: one task that made many partitions would keep the memory of all their sorts and joins until its end."""
    return df.repartition(tasks_for(df.sparkSession, rows, per_task))


@contextmanager
def held(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """``settings`` of the session hold inside, and those from before afterwards."""
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def smallest(df: DataFrame, group: str, order: list[str], n: int, parts: int = 64) -> DataFrame:
    """The ``n`` rows of every group that come first by ``order``: in parts of the group, then among the parts' rows."""
    part = F.pmod(F.xxhash64(*order), F.lit(parts))
    within = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order))
    among = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    few = df.withColumn("_part", part).withColumn("_place", within).where(F.col("_place") <= n)
    return few.withColumn("_place", among).where(F.col("_place") <= n).select(*df.columns)


def connected(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """Connected components of undirected links.

    ``edges`` has two bigint columns ``a`` and ``b``; nulls and self-links are ignored.  ``rows`` is about their number, if it is known.
    Returns ``node``, ``component`` (the smallest node reachable) for every linked node.
    Alternates large-star and small-star steps; each is one aggregation and one join, so
    a node with many links is pre-aggregated and skew-split, never gathered.
    """
    def stars(links: DataFrame) -> DataFrame:
        both = links.select("child", "parent").unionAll(links.select(F.col("parent").alias("child"), F.col("child").alias("parent")))
        lowest = both.groupBy("child").agg(F.min("parent").alias("low")).select("child", F.least("child", "low").alias("low"))
        large = (both.join(lowest, "child").where("parent > child")
                 .select(F.col("parent").alias("child"), F.col("low").alias("parent")).distinct())
        least = large.groupBy("child").agg(F.min("parent").alias("low"))
        joined = large.join(least, "child")
        return (joined.select("child", F.col("low").alias("parent"))
                .unionAll(joined.where("parent <> low").select(F.col("parent").alias("child"), F.col("low").alias("parent")))
                .distinct())

    def mark(links: DataFrame):
        return links.agg(F.count("*"), F.sum(F.xxhash64("child", "parent").cast("decimal(38,0)"))).first()

    links = edges.where("a <> b").select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent")).distinct()
    current = stored(links if rows is None else few(links, rows), "links")
    before = mark(current)
    while before[0]:
        current = stored(few(stars(current), before[0]), "links")
        after = mark(current)
        if tuple(after) == tuple(before):
            break
        before = after
    roots = current.select(F.col("parent").alias("node"), F.col("parent").alias("component")).distinct()
    return current.select(F.col("child").alias("node"), F.col("parent").alias("component")).unionAll(roots)
