"""Daily row accounting and pass summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import scalars as S

# --- fixed values ---------------------------------------------------------
# dataset -> (counter, event time, own last-sample column)
DATASETS = {
    "metric_samples": ("additional_metric_rows", "collected_at", None),
    "sql_samples": ("sql_sample_rows", "collected_at", "last_sql_sample_at"),
    "sql_texts": ("sql_text_writes", "collected_at", None),
    "sql_cursor_metadata": ("sql_cursor_metadata_writes", "collected_at", None),
    "sql_plans": ("sql_plan_operation_writes", "collected_at", None),
    "session_samples": ("session_sample_rows", "collected_at", "last_session_sample_at"),
    "blocking_session_samples": ("blocking_session_sample_rows", "collected_at", None),
    "database_activity_samples": ("database_activity_sample_rows", "sample_time", "last_database_activity_sample_at"),
    "database_status_samples": ("database_status_sample_rows", "collected_at", None),
    "instance_samples": ("instance_sample_rows", "collected_at", None),
    "resource_limit_samples": ("resource_limit_sample_rows", "collected_at", None),
    "tablespace_samples": ("tablespace_sample_rows", "collected_at", None),
    "asm_diskgroup_samples": ("asm_diskgroup_sample_rows", "collected_at", None),
    "system_counter_samples": ("system_counter_sample_rows", "collected_at", None),
    "wait_class_samples": ("wait_class_sample_rows", "collected_at", None),
    "system_metric_samples": ("system_metric_sample_rows", "collected_at", None),
    "dataguard_destination_samples": ("dataguard_destination_rows", "collected_at", None),
    "dataguard_lag_samples": ("dataguard_lag_rows", "collected_at", None),
    "dataguard_process_samples": ("dataguard_process_rows", "collected_at", None),
    "scrape_status": ("scrape_status_rows", "collected_at", None),
}
COUNTERS = [counter for counter, _, _ in DATASETS.values()]
# The surge rule totals these; replication counters are not part of it.
SURGE_COUNTERS = [c for c in COUNTERS if not c.startswith("dataguard_")]
LAST_TIMES = ["last_sql_sample_at", "last_session_sample_at", "last_database_activity_sample_at"]
# --------------------------------------------------------------------------


def daily_ingest(datasets: dict[str, DataFrame]) -> DataFrame:
    """Rows written per (UTC day, database) and dataset, with first and last sample times.

    Every dataset is reduced to days before the union, so the union is tiny.
    """
    parts = []
    for name, df in datasets.items():
        counter, ts, last = DATASETS[name]
        valid = (F.length("source_database") > 0) & F.col(ts).isNotNull()
        part = df.where(valid).groupBy(S.day_start_utc(F.col(ts)).alias("sample_day"), "source_database").agg(
            F.count(F.lit(1)).alias("_rows"), F.min(ts).alias("first_sample_at"), F.max(ts).alias("last_sample_at")
        )
        parts.append(part.select(
            "sample_day", "source_database",
            *[(F.col("_rows") if c == counter else F.lit(0).cast("long")).alias(c) for c in COUNTERS],
            "first_sample_at", "last_sample_at",
            *[(F.col("last_sample_at") if c == last else F.lit(None).cast("timestamp")).alias(c) for c in LAST_TIMES],
        ))
    return _total(reduce(DataFrame.unionByName, parts))


def _total(df: DataFrame) -> DataFrame:
    flushed = [F.max("last_flushed_at").alias("last_flushed_at")] if "last_flushed_at" in df.columns else []
    return df.groupBy("sample_day", "source_database").agg(
        *[F.sum(c).alias(c) for c in COUNTERS],
        F.min("first_sample_at").alias("first_sample_at"), F.max("last_sample_at").alias("last_sample_at"),
        *[F.max(c).alias(c) for c in LAST_TIMES], *flushed,
    )


def merge_daily_ingest(existing: DataFrame, increments: DataFrame, flushed_at: Column | None = None) -> DataFrame:
    """Add increments to the stored totals; times widen, NULLs do not count."""
    if flushed_at is not None:
        increments = increments.withColumn("last_flushed_at", flushed_at)
    return _total(existing.unionByName(increments, allowMissingColumns=True))


def ingest_baseline(daily: DataFrame, value: Column, as_of: Column) -> DataFrame:
    """Yesterday's rows against the average of the week before, per database."""
    today = F.to_date(as_of)
    day = F.to_date("sample_day")
    yesterday = day == F.date_sub(today, 1)
    week = day.between(F.date_sub(today, 8), F.date_sub(today, 2))
    rows = daily.where(day >= F.date_sub(today, 8)).withColumn("_v", value)
    return rows.groupBy("source_database").agg(
        F.max(F.when(yesterday, F.col("_v"))).alias("yesterday_rows"),
        F.avg(F.when(week, F.col("_v"))).alias("baseline_rows"),
        F.count_if(week).alias("baseline_days"),
    )


def pass_summary(datasets: dict[str, DataFrame], statuses: DataFrame) -> DataFrame:
    """Samples and errors of every pass; status rows are not counted as samples."""
    counted = [
        df.groupBy("collected_at").agg(F.count(F.lit(1)).alias("sample_count"))
        .withColumn("total_errors", F.lit(0).cast("long"))
        for name, df in datasets.items() if name != "scrape_status"
    ]
    failed = statuses.groupBy("collected_at").agg(
        F.lit(0).cast("long").alias("sample_count"), F.count_if(~F.col("success")).alias("total_errors")
    )
    return reduce(DataFrame.unionByName, [*counted, failed]).groupBy("collected_at").agg(
        F.sum("sample_count").alias("sample_count"), F.sum("total_errors").alias("total_errors")
    )
