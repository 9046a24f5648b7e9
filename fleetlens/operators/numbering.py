"""Row numbers over a whole table or within keys, with no task that sees a whole group.

The rows are range-partitioned by (keys, order), so that a crowded key, or a crowded moment, lies in
several ranges.  Every row is numbered within its range; the counts of the ranges, one small row
each, give the offsets that turn this into a place in the whole table.  The place of a key's first
row, taken off again, leaves the number within the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.session import scratch_dir

#: monotonically_increasing_id holds the partition above these bits and the row's place below them.
PLACE_BITS = 33


def ranged(df: DataFrame, order: Sequence[Column], partitions: int | None = None) -> DataFrame:
    """The rows with ``_range`` and their ``_place`` in it, sorted by ``order``.

    The ranges come from a sample that another evaluation would draw anew, so the rows are written
    once to the shared scratch folder and read from there.
    """
    spark = df.sparkSession
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_dir(spark, "ranges")
    tagged = df.repartitionByRange(count, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    tagged.write.parquet(path)
    read = spark.read.schema(tagged.schema).parquet(path)
    return read.select(*df.columns, F.shiftright("_id", PLACE_BITS).cast("int").alias("_range"),
                       F.col("_id").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("_place"))


def numbered(df: DataFrame, order: Sequence[Column | str], keys: Sequence[str] = (), name: str = "ordinal",
             partitions: int | None = None) -> DataFrame:
    """Add ``name``: 1, 2, ... by ``order`` (nulls first), within equal ``keys`` if there are any.

    Rows that tie in ``order`` are numbered in any order.  NULL keys count as equal.
    """
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = ranged(df, [*[F.col(k).asc_nulls_first() for k in keys], *by], partitions)
    counts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range, so its number is that of the partitions and never grows with a group
    offsets = counts.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    at = placed.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_before") + F.col("_place") + 1)
    if keys:
        first = at.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(F.min(name).alias("_first"))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
        at = at.join(first, same).withColumn(name, F.col(name) - F.col("_first") + 1)
    return at.select(*df.columns, name)
