"""Readers of landed source views, activity feeds and alert logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens import schemas
from fleetlens.functions import scalars as S
from fleetlens.operators.samples import recent  # noqa: F401  (part of the source surface)

# --- fixed values ---------------------------------------------------------
LOG_FLOOR = "1900-01-01T01:01:01.001Z"
LOG_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("database", T.StringType()),
    T.StructField("moduleId", T.StringType()),
    T.StructField("ecid", T.StringType()),
    T.StructField("message", T.StringType()),
])
# --------------------------------------------------------------------------


def read_raw(spark: SparkSession, view: str, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Landed rows of one source view with its fixed schema; other columns are not read.

    ``fmt="jdbc"`` takes the connection as options and ``path`` as the query.
    """
    schema = schemas.RAW[view]
    reader = spark.read.options(**options)
    if fmt == "jdbc":
        df = reader.format("jdbc").option("query", path).load()
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    return reader.schema(schema).format(fmt).load(path)


def on_days(df: DataFrame, ts: str, start: Column, end: Column | None = None, day: str = "day") -> DataFrame:
    """Bound a stored table by time and by its day partition, so that other days are not read."""
    kept = df.where(F.col(ts) >= start)
    if end is not None:
        kept = kept.where(F.col(ts) <= end)
    if day in df.columns:
        kept = kept.where(F.col(day) >= F.to_date(start))
        if end is not None:
            kept = kept.where(F.col(day) <= F.to_date(end))
    return kept


def incremental(df: DataFrame, watermarks: DataFrame, as_of: Column, overlap: float,
                initial: float = 120.0, ts: str = "sample_time") -> tuple[DataFrame, DataFrame]:
    """Rows of every database that come after its watermark minus ``overlap`` seconds.

    A database without watermark starts ``initial`` seconds before ``as_of``.  Also
    returns the new watermarks, which are to be stored once the rows are.
    """
    def back(at, seconds):
        return F.timestamp_micros(F.unix_micros(at) - int(seconds * 1_000_000))

    since = F.coalesce(back(F.col("_watermark"), overlap), back(as_of, initial))
    marks = watermarks.select("source_database", F.col("watermark").alias("_watermark"))
    rows = df.join(marks, "source_database", "left").where(F.col(ts) > since).select(*df.columns)
    read = rows.groupBy("source_database").agg(F.max(ts).alias("watermark"))
    moved = watermarks.unionByName(read).groupBy("source_database").agg(F.max("watermark").alias("watermark"))
    return rows, moved


def new_log_rows(logs: DataFrame, last_per_db: DataFrame, ts: str = "originating_timestamp") -> DataFrame:
    """Log rows strictly newer than the last stored record of their database."""
    last = last_per_db.select("source_database", F.col("last_timestamp").alias("_last"))
    floor = F.to_timestamp(F.lit(LOG_FLOOR))
    joined = logs.join(last, "source_database", "left")
    return joined.where(F.col(ts) > F.coalesce("_last", floor)).select(*logs.columns)


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a JSON-lines log with their position in file order."""
    lines = spark.read.text(path)
    return lines.select(
        "value",
        F.struct(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("position"),
    )


def last_log_record(lines: DataFrame, database: str | None = None, position: str = "position",
                    line_limit: int | None = None) -> DataFrame:
    """The last record in file order per database, or of one database.

    ``lines``: value and position.  Blank lines are skipped, a line that is
    no JSON, or with a ``line_limit`` one of more bytes, fails the job.  Without any record of ``database`` the default
    record is returned.
    """
    text = S.trim_space(F.col("value"))
    checked = text
    if line_limit is not None:
        too_long = F.raise_error(F.lit(f"log line exceeds {line_limit} bytes")).cast("string")
        checked = F.when(F.octet_length("value") > line_limit, too_long).otherwise(text)
    records = (
        lines.withColumn("_text", checked).where(F.length("_text") > 0)
        .select(F.from_json("_text", LOG_SCHEMA, {"mode": "FAILFAST"}).alias("r"), F.col(position).alias("_at"))
    )
    if database is None:
        return records.groupBy(F.col("r.database").alias("database")).agg(
            F.max_by(F.col("r"), F.col("_at")).alias("r")
        ).select("database", F.col("r.timestamp").alias("timestamp"), "r.moduleId", "r.ecid", "r.message")
    last = records.where(F.col("r.database") == database).agg(F.max_by(F.col("r"), F.col("_at")).alias("r"))
    return last.select(
        F.lit(database).alias("database"), F.coalesce("r.timestamp", F.lit(LOG_FLOOR)).alias("timestamp"),
        *[F.coalesce(f"r.{c}", F.lit("")).alias(c) for c in ("moduleId", "ecid", "message")],
    )


def alert_log_rows(raw: DataFrame) -> DataFrame:
    """Alert-log rows in the layout of the log: NULL as empty text, one trailing line feed dropped."""
    return raw.select(
        F.col("originating_timestamp").cast("string").alias("timestamp"),
        F.col("source_database").alias("database"),
        S.null_to_empty(F.col("module_id")).alias("moduleId"),
        S.null_to_empty(F.col("execution_context_id")).alias("ecid"),
        S.strip_one_newline(S.null_to_empty(F.col("message_text"))).alias("message"),
    )
