"""Read-side views over the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import scalars as S
from fleetlens.operators.deltas import rates
from fleetlens.operators.samples import cursor_context

# --- fixed values ---------------------------------------------------------
# latest view -> (stored table, collector that fills it)
LATEST = {
    "latest_tablespace_samples": ("tablespace_samples", "operational.tablespaces"),
    "latest_resource_limit_samples": ("resource_limit_samples", "operational.resource_limits"),
    "latest_asm_diskgroup_samples": ("asm_diskgroup_samples", "operational.asm_diskgroups"),
    "latest_dataguard_destination_samples": ("dataguard_destination_samples", "operational.dataguard"),
    "latest_dataguard_lag_samples": ("dataguard_lag_samples", "operational.dataguard"),
    "latest_dataguard_process_samples": ("dataguard_process_samples", "operational.dataguard"),
}
DAY_SECONDS = 86_400
# --------------------------------------------------------------------------


def latest_snapshot(samples: DataFrame, latest_status: DataFrame, collector: str,
                    as_of: Column | None = None, max_age: float | None = DAY_SECONDS) -> DataFrame:
    """Rows of every database's last attempt of ``collector``, successful or not.

    A failed last attempt leaves the database without rows.  The age bound is put on the
    day partition too, so older days are not read.
    """
    if as_of is not None and max_age is not None:
        start = F.timestamp_micros(F.unix_micros(as_of) - int(max_age * 1_000_000))
        samples = samples.where(F.col("collected_at") >= start)
        if "day" in samples.columns:
            samples = samples.where(F.col("day") >= F.to_date(start))
    attempt = latest_status.where(F.col("collector") == collector).select("source_database", "collected_at")
    return samples.join(attempt, ["source_database", "collected_at"], "left_semi")


def with_used_percent(samples: DataFrame) -> DataFrame:
    """Used percentage of resource limits and disk groups."""
    if "limit_value" in samples.columns:
        used = S.used_percent(F.col("current_value"), F.col("limit_value"))
    else:
        used = S.used_percent(F.col("total_bytes") - F.col("free_bytes"), F.col("total_bytes"))
    return samples.withColumn("used_percent", used)


def latest_view(name: str, tables: dict[str, DataFrame], as_of: Column) -> DataFrame:
    """One of the ``latest_*`` views."""
    table, collector = LATEST[name]
    rows = latest_snapshot(tables[table], tables["latest_scrape_status"], collector, as_of)
    if name in ("latest_resource_limit_samples", "latest_asm_diskgroup_samples"):
        return with_used_percent(rows)
    return rows


def counter_rates(counters: DataFrame) -> DataFrame:
    return rates(counters)


def wait_rates(waits: DataFrame) -> DataFrame:
    return rates(waits, "delta_wait_micro", "wait_micro_per_second")


def enrich_sql(samples: DataFrame, cursor_metadata: DataFrame) -> DataFrame:
    """SQL samples with the children, schemas and modules known for their plan.

    The dictionary is reduced to one row per plan before the join; a sample without
    plan hash matches nothing.
    """
    keys = ["source_database", "inst_id", "sql_id", "plan_hash_value"]
    joined = samples.join(cursor_context(cursor_metadata), keys, "left")
    fill = {"child_number": "child_numbers", "parsing_schema_name": "parsing_schema_names", "module": "modules"}
    added = {
        own: F.coalesce(F.col(own).cast("string"), F.col(known)) if own in samples.columns else F.col(known)
        for own, known in fill.items()
    }
    return joined.withColumns(added).drop(*fill.values())
