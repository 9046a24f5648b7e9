"""Writers: day-partitioned appends, all-or-nothing batches, versioned state, retention."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions import scalars as S
from fleetlens.schemas import EVENT_TIME


def with_day(df: DataFrame, ts: str) -> DataFrame:
    """Rows with the UTC day of their event time; rows without a time get no partition."""
    return df.where(F.col(ts).isNotNull()).withColumn("day", F.to_date(ts))


def clustered(df: DataFrame, ts: str, keys: list[str]) -> DataFrame:
    """Day rows dealt to tasks by ranges of (day, key, time) and sorted so, which keeps files few,
    splits a hot day or key at a time, and lets key filters skip row groups."""
    return df.repartitionByRange("day", *keys, ts).sortWithinPartitions("day", *keys, ts)


def append_daily(df: DataFrame, path: str, ts: str, keys: list[str] | None = None) -> None:
    """Append to a table partitioned by the UTC day of ``ts``."""
    rows = with_day(df, ts)
    if keys:
        rows = clustered(rows, ts, keys)
    rows.write.partitionBy("day").mode("append").parquet(path)


def metric_sample_rows(df: DataFrame) -> DataFrame:
    return df.withColumn("labels", S.labels_json(F.col("labels")))


def write_metric_samples(df: DataFrame, path: str) -> None:
    """Append metric samples, their labels as JSON text."""
    append_daily(metric_sample_rows(df), path, "collected_at")


def append_log(df: DataFrame, path: str, per_database: bool = False) -> None:
    """Append log records as JSON lines: one shared log, or one folder per database.

    Fields keep the order timestamp, database, moduleId, ecid, message; per database
    the folder carries the name as ``log_database=<name>``.
    """
    rows = df.select("timestamp", "database", "moduleId", "ecid", "message")
    if per_database:
        rows = rows.withColumn("_folder", F.col("database"))
        rows.withColumnRenamed("_folder", "log_database").write.partitionBy("log_database").mode("append").json(path)
    else:
        rows.write.mode("append").json(path)


# --- batches that commit as a whole ------------------------------------------
#
# A table is a set of folders ``<name>/batch_id=<n>/day=<d>``.  One small text file per commit lists
# the folders that count, the columns of each table and the batches seen; readers open the newest.
# Days with many small folders are merged, so neither the list nor a read grows with the batches.

MANIFESTS = "_manifest"
#: Folders of a day above which they are merged, and finished versions that are kept for readers and replays.
MOST_FOLDERS, KEPT_VERSIONS = 16, 3


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    fs, folder = _folder(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, folder = _folder(spark, path)
    fs.delete(folder, True)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Finished ``version=<n>`` folders in order."""
    numbers = sorted(int(n.split("=")[1]) for n in children(spark, path) if n.startswith("version="))
    return [n for n in numbers if "_SUCCESS" in children(spark, f"{path}/version={n}")]


def _forget_old(spark: SparkSession, path: str) -> None:
    for old in versions(spark, path)[:-KEPT_VERSIONS]:
        remove(spark, f"{path}/version={old}")


def manifest(spark: SparkSession, root: str) -> tuple[int, dict]:
    """Number and content of the newest commit."""
    found = versions(spark, f"{root}/{MANIFESTS}")
    if not found:
        return -1, {"batches": [], "tables": {}}
    rows = spark.read.text(f"{root}/{MANIFESTS}/version={found[-1]}", wholetext=True).where("value <> ''").collect()
    return found[-1], json.loads(rows[0]["value"])


def _publish(spark: SparkSession, root: str, version: int, content: dict) -> None:
    text = spark.createDataFrame([(json.dumps(content),)], "value string").coalesce(1)
    text.write.mode("overwrite").text(f"{root}/{MANIFESTS}/version={version}")
    _forget_old(spark, f"{root}/{MANIFESTS}")


def is_committed(spark: SparkSession, root: str, batch_id: int) -> bool:
    return any(first <= batch_id <= last for first, last in manifest(spark, root)[1]["batches"])


def _with_batch(ranges: list, batch_id: int) -> list:
    joined: list = []
    for first, last in sorted([*ranges, [batch_id, batch_id]]):
        if joined and first <= joined[-1][1] + 1:
            joined[-1][1] = max(joined[-1][1], last)
        else:
            joined.append([first, last])
    return joined


def _wider(known: dict | None, df: DataFrame) -> dict:
    """Columns seen so far, new ones behind."""
    fields = T.StructType.fromJson(known).fields if known else []
    names = {f.name for f in fields}
    return T.StructType(fields + [f for f in df.schema.fields if f.name not in names]).jsonValue()


def _write_folder(spark: SparkSession, root: str, name: str, batch_id: int, df: DataFrame, by_day: bool) -> list:
    """Write one folder of a table; returns its parts as [folder, day]."""
    folder = f"batch_id={batch_id}"
    df.write.partitionBy(*(["day"] if by_day else [])).mode("overwrite").parquet(f"{root}/{name}/{folder}")
    if not by_day:
        return [[folder, None]]
    days = [n.split("=")[1] for n in children(spark, f"{root}/{name}/{folder}") if n.startswith("day=")]
    return [[f"{folder}/day={d}", d] for d in sorted(days)]


def commit_batch(spark: SparkSession, root: str, batch_id: int, tables: dict[str, DataFrame],
                 complete: Callable[[dict[str, DataFrame]], None] | None = None) -> bool:
    """Write all tables of a batch, then publish it with one small file.

    Readers only see published batches.  A batch that failed half-way is rewritten in
    full, one that was published is left alone (returns False).  ``complete`` gets the tables
    as written, before they are published.
    """
    version, content = manifest(spark, root)
    if any(first <= batch_id <= last for first, last in content["batches"]):
        return False
    written = {}
    for name, df in tables.items():
        ts = EVENT_TIME.get(name)
        by_day = ts in df.columns
        known = content["tables"].setdefault(name, {"columns": None, "parts": []})
        known["columns"] = _wider(known["columns"], df.drop("day", "batch_id"))
        rows = with_day(df, ts) if by_day else df
        known["parts"] += _write_folder(spark, root, name, batch_id, rows, by_day)
        written[name] = spark.read.schema(rows.schema).parquet(f"{root}/{name}/batch_id={batch_id}")
    if complete:
        complete(written)
    content["batches"] = _with_batch(content["batches"], batch_id)
    _publish(spark, root, version + 1, content)
    for name in tables:
        if _crowded(content["tables"][name], MOST_FOLDERS):
            compact(spark, root, name)
    return True


def _crowded(table: dict, most_folders: int) -> list:
    """Days (None: a table without days) that have more folders."""
    count = Counter(day for _, day in table["parts"])
    return [day for day, n in count.items() if n > most_folders]


def read_table(spark: SparkSession, root: str, name: str, days: list[date] | None = None) -> DataFrame | None:
    """Rows of all published batches of a table, or of some of its days; None while the table is not there.

    Only the folders of these days are opened, with the columns of the newest commit.
    """
    table = manifest(spark, root)[1]["tables"].get(name)
    if table is None:
        return None
    wanted = None if days is None else {str(d) for d in days}
    parts = [(f, d) for f, d in table["parts"] if wanted is None or d is None or d in wanted]
    extra = [T.StructField("batch_id", T.LongType())] + [T.StructField("day", T.DateType())] * any(d for _, d in table["parts"])
    schema = T.StructType(T.StructType.fromJson(table["columns"]).fields + extra)
    if not parts:
        return spark.createDataFrame([], schema)
    paths = [f"{root}/{name}/{f}" for f, _ in parts]
    return spark.read.schema(schema).option("basePath", f"{root}/{name}").parquet(*paths)


def compact(spark: SparkSession, root: str, name: str, most_folders: int = MOST_FOLDERS) -> bool:
    """Merge the folders of every day (or of a table without days) that has more than ``most_folders``.

    The merged rows have a negative ``batch_id``.  The old folders go after the new list is out.
    """
    version, content = manifest(spark, root)
    table = content["tables"][name]
    crowded = _crowded(table, most_folders)
    if not crowded:
        return False
    old = [p for p in table["parts"] if p[1] in crowded]
    by_day = crowded != [None]
    rows = read_table(spark, root, name, crowded if by_day else None)
    parts = _write_folder(spark, root, name, -version - 2, rows.drop("batch_id"), by_day)
    table["parts"] = [p for p in table["parts"] if p not in old] + parts
    _publish(spark, root, version + 1, content)
    for folder, _ in old:
        remove(spark, f"{root}/{name}/{folder}")
    return True


def expire(spark: SparkSession, root: str, name: str, cutoff: datetime, retention_seconds: float | None = None,
           dry_run: bool = True) -> list[str]:
    """Drop the days of a committed table that ended at or before ``cutoff``; returns their folders.

    A non-positive ``retention_seconds`` switches retention off.
    """
    if retention_seconds is not None and retention_seconds <= 0:
        return []
    version, content = manifest(spark, root)
    table = content["tables"].get(name, {"parts": []})
    old = [p for p in table["parts"] if p[1] and datetime.fromisoformat(p[1]) + timedelta(days=1) <= cutoff]
    if old and not dry_run:
        table["parts"] = [p for p in table["parts"] if p not in old]
        _publish(spark, root, version + 1, content)
        for folder, _ in old:
            remove(spark, f"{root}/{name}/{folder}")
    return sorted(folder for folder, _ in old)


# --- versioned state ----------------------------------------------------------

def read_state(spark: SparkSession, root: str, name: str, schema: T.StructType,
               before: int | None = None) -> DataFrame:
    """The newest finished version of a state table (older than ``before``), or an empty one."""
    found = [v for v in versions(spark, f"{root}/{name}") if before is None or v < before]
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/{name}/version={found[-1]}")


def write_state(spark: SparkSession, root: str, name: str, df: DataFrame, version: int, anew: bool = False) -> None:
    """Write a new version beside the one being read; a replay does nothing (``anew``: writes it again), old versions go."""
    if not anew and version in versions(spark, f"{root}/{name}"):
        return
    df.write.mode("overwrite").parquet(f"{root}/{name}/version={version}")
    _forget_old(spark, f"{root}/{name}")


# --- retention ------------------------------------------------------------------

def partition_days(spark: SparkSession, path: str) -> DataFrame:
    """The day folders of a table, from a listing; other names give NULL."""
    fs, folder = _folder(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()]
    listing = spark.createDataFrame([(n,) for n in names], "name string")
    digits = F.regexp_extract("name", r"^day=([0-9]{4}-[0-9]{2}-[0-9]{2})$", 1)
    return listing.withColumn("day", F.to_date(F.try_to_timestamp(F.nullif(digits, F.lit("")), F.lit("yyyy-MM-dd"))))


def drop_expired(spark: SparkSession, path: str, cutoff: datetime, retention_seconds: float | None = None,
                 dry_run: bool = True) -> list[str]:
    """Delete whole day folders that ended at or before ``cutoff``.

    A non-positive ``retention_seconds`` switches retention off.  With ``dry_run``
    the folders are only listed.
    """
    from fleetlens.operators.merges import expired_days

    if retention_seconds is not None and retention_seconds <= 0:
        return []
    expired = expired_days(partition_days(spark, path), F.lit(cutoff))
    names = sorted(r["name"] for r in expired.select("name").collect())
    if not dry_run:
        for name in names:
            remove(spark, f"{path}/{name}")
    return names
