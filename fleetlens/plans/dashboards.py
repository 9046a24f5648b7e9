"""Dashboard queries over the stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import scalars as S
from fleetlens.operators.numbering import numbered
from fleetlens.operators.samples import failed_or_stale, merge_shared
from fleetlens.plans.views import latest_snapshot

# --- fixed values ---------------------------------------------------------
# category -> (shown from, alert threshold), both in percent
CAPACITY_LIMITS = {
    "Tablespace maximum": (80.0, 90.0),
    "Tablespace allocation": (85.0, 95.0),
    "Resource limit": (75.0, 85.0),
    "ASM diskgroup": (80.0, 90.0),
}
DISKGROUP_STATE = ["diskgroup_name", "inst_id", "total_bytes", "free_bytes", "usable_bytes", "used_percent"]
STATUS_COLUMNS = [
    "source_database", "db_unique_name", "dbid", "database_version_full", "database_role", "protection_mode",
    "protection_level", "inst_id", "instance_name", "instance_status", "database_status", "open_mode",
    "startup_time",
]
# --------------------------------------------------------------------------


def ascending(name: str) -> Column:
    """Ascending, NULL last."""
    return F.col(name).asc_nulls_last()


def descending(name: str) -> Column:
    """Descending, NULL first."""
    return F.col(name).desc_nulls_first()


def health_order() -> list[Column]:
    return [ascending("success"), descending("data_age_seconds"), ascending("source_database"), ascending("collector")]


def risk_order() -> list[Column]:
    worst = F.col("used_percent") / F.col("alert_threshold")
    return [worst.desc_nulls_first(), *[ascending(c) for c in ("source_database", "category", "object_name", "inst_id")]]


def positioned(rows: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Rows of a dashboard with their place in its order, for readers that lose the order itself."""
    return numbered(rows, order, name=name)


def collector_health(latest: DataFrame, as_of: Column) -> DataFrame:
    """Every collector with the age of its data, failures first."""
    age = S.age_seconds(as_of, F.col("collected_at"))
    return latest.select(
        "source_database", "collector", "success", F.col("collected_at").alias("last_collection"),
        age.alias("data_age_seconds"), S.round_half_up(F.col("duration_seconds"), 3).alias("duration_seconds"),
        *[c for c in ("sample_count", "error_message") if c in latest.columns],
    ).orderBy(*health_order())


def failed_collectors(latest: DataFrame, as_of: Column, max_age: float = 180.0) -> DataFrame:
    """Collectors that failed or went stale, oldest first."""
    rows = failed_or_stale(latest, as_of, max_age)
    return rows.orderBy(*[ascending(c) for c in ("success", "collected_at", "source_database", "collector")]).select(
        "source_database", "collector", "state", F.col("collected_at").alias("last_collection"),
        S.age_seconds(as_of, F.col("collected_at")).alias("data_age_seconds"), "error_message",
    )


def capacity_risks(tablespaces: DataFrame, limits: DataFrame, diskgroups: DataFrame) -> DataFrame:
    """Tablespaces, resource limits and disk groups close to their limit, worst first.

    The inputs are the latest views.
    """
    def branch(df, category, database, name, inst, used):
        shown, alert = CAPACITY_LIMITS[category]
        return df.select(
            database.alias("source_database"), F.lit(category).alias("category"), name.alias("object_name"),
            inst.cast("string").alias("inst_id"), used.alias("used_percent"), F.lit(alert).alias("alert_threshold"),
        ).where(F.col("used_percent") >= shown)

    database, none = F.col("source_database"), F.lit(None)
    limited = limits.where(~F.col("limit_unlimited") & (F.col("limit_value") > 0))
    shared = merge_shared(diskgroups.where(F.col("used_percent") >= CAPACITY_LIMITS["ASM diskgroup"][0]),
                          DISKGROUP_STATE)
    risks = reduce(DataFrame.unionByName, [
        branch(tablespaces, "Tablespace maximum", database, F.col("tablespace_name"), none, F.col("used_percent")),
        branch(tablespaces, "Tablespace allocation", database, F.col("tablespace_name"), none,
               S.percent(F.col("used_bytes"), F.col("allocated_bytes"))),
        branch(limited, "Resource limit", database, F.col("resource_name"), F.col("inst_id"), F.col("used_percent")),
        branch(shared, "ASM diskgroup", database, F.col("diskgroup_name"), F.col("inst_id"), F.col("used_percent")),
    ])
    return risks.orderBy(*risk_order()).select(
        "source_database", "category", "object_name", "inst_id", S.round_half_up(F.col("used_percent"), 2).alias("used_percent"),
        "alert_threshold",
        F.when(F.col("used_percent") > F.col("alert_threshold"), "ALERT THRESHOLD").otherwise("WATCH").alias("state"),
    )


def instance_state(status_samples: DataFrame, latest_status: DataFrame) -> DataFrame:
    """Instances as of the last status attempt of their database."""
    rows = latest_snapshot(status_samples, latest_status, "operational.database_status")
    return rows.orderBy(ascending("source_database"), ascending("inst_id")).select(
        *[c for c in STATUS_COLUMNS if c in rows.columns], F.col("collected_at").alias("last_observation")
    )


def cpu_pga_pressure(instances: DataFrame, counter_rates: DataFrame, latest_status: DataFrame) -> DataFrame:
    """CPU and private memory use against capacity per database, most pressed first."""
    capacity = latest_snapshot(instances, latest_status, "operational.instance").groupBy("source_database").agg(
        F.sum("cpu_count").cast("double").alias("cpu_capacity"),
        F.sum("pga_allocated_bytes").cast("double").alias("pga_allocated_bytes"),
        F.sum("pga_max_allocated_bytes").cast("double").alias("pga_peak_bytes"),
        F.sum("pga_aggregate_limit").cast("double").alias("pga_limit_bytes"),
    )
    busy = counter_rates.where(
        (F.col("con_id") == 0) & (F.col("stat_name") == "DB CPU") & F.col("value_per_second").isNotNull()
    )
    cpu = latest_snapshot(busy, latest_status, "operational.cpu_io_counters").groupBy("source_database").agg(
        (F.sum("value_per_second") / 1_000_000.0).alias("_cores")
    )

    def ratio(a, b):
        return F.col(a) / F.nullif(F.col(b), F.lit(0.0))

    def pct(a, b):
        return S.round_half_up(F.col(a) * 100.0 / F.nullif(F.col(b), F.lit(0.0)), 1)

    pressure = F.greatest(F.coalesce(ratio("_cores", "cpu_capacity"), F.lit(0.0)),
                          F.coalesce(ratio("pga_allocated_bytes", "pga_limit_bytes"), F.lit(0.0)))
    return capacity.join(cpu, "source_database", "left").orderBy(pressure.desc_nulls_first(), ascending("source_database")).select(
        "source_database", S.round_half_up(F.col("_cores"), 2).alias("db_cpu_cores"), "cpu_capacity",
        pct("_cores", "cpu_capacity").alias("cpu_used_percent"),
        "pga_allocated_bytes", "pga_peak_bytes", "pga_limit_bytes",
        pct("pga_allocated_bytes", "pga_limit_bytes").alias("pga_current_percent"),
        pct("pga_peak_bytes", "pga_limit_bytes").alias("pga_peak_percent"),
    )
