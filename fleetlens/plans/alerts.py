"""Alert rules: value queries, thresholds, and the pending/firing evaluation.

A value query gives one row per label set: ``(rule_id, labels, value)``.  A rule is
breached when its value exceeds the threshold, pending from the first breach of the
current run of breaches, and firing once the run has lasted the rule's duration.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions import scalars as S
from fleetlens.operators.accounting import SURGE_COUNTERS, ingest_baseline
from fleetlens.operators.samples import merge_shared
from fleetlens.operators.timeline import since_reset
from fleetlens.plans.dashboards import DISKGROUP_STATE


@dataclass(frozen=True)
class Rule:
    rule_id: str
    title: str
    threshold: float
    hold_seconds: int
    no_data: str
    severity: str
    every_seconds: int = 60


# --- fixed values ---------------------------------------------------------
RULES = [
    Rule("A-1", "collected data is stale", 180, 60, "Alerting", "critical"),
    Rule("A-2", "database connectivity failed", 0, 120, "Alerting", "critical"),
    Rule("A-3", "tablespace usage is high", 90, 300, "OK", "warning"),
    Rule("A-4", "resource limit usage is high", 85, 300, "OK", "warning"),
    Rule("A-5", "disk group usage is high", 90, 300, "OK", "warning"),
    Rule("A-6", "ingestion accounting is stale", 900, 300, "Alerting", "critical", 300),
    Rule("A-7", "SQL sample ingestion dropped sharply", 0, 900, "OK", "warning", 300),
    Rule("A-8", "ingestion increased sharply", 0, 900, "OK", "warning", 300),
    Rule("A-9", "activity collection is close to its timeout", 80, 300, "OK", "warning"),
    Rule("A-10", "collection cycle is close to its interval", 80, 300, "OK", "warning"),
    Rule("A-11", "writing takes too much of the interval", 50, 300, "OK", "warning"),
    Rule("A-12", "scheduler is delayed or skips intervals", 50, 120, "OK", "warning"),
    Rule("A-13", "replication destination is unhealthy", 0, 120, "OK", "critical"),
    Rule("A-14", "replication lag or telemetry age is high", 900, 300, "OK", "warning"),
    Rule("A-15", "managed recovery is stopped", 0, 120, "OK", "critical"),
]
BAD_DESTINATION_STATES = ["ERROR", "DISABLED", "BAD PARAM", "FULL"]
NEVER_FLUSHED_AGE = 1_000_000_000.0
DROP_MIN_ROWS, DROP_SHARE = 1000, 0.2
SURGE_MIN_ROWS, SURGE_FACTOR = 10_000, 3
BASELINE_MIN_DAYS = 4
FRESH_SECONDS, DELAY_WINDOW_SECONDS = 180, 300
# --------------------------------------------------------------------------


def _labelled(df: DataFrame, value: Column, **labels: Column | str) -> DataFrame:
    pairs = []
    for name, c in labels.items():
        c = F.col(c) if isinstance(c, str) else c
        pairs += [F.lit(name), c.cast("string")]
    return df.select(F.create_map(*pairs).alias("labels"), value.cast("double").alias("value"))


def _since(as_of: Column, seconds: int) -> Column:
    return F.timestamp_micros(F.unix_micros(as_of) - seconds * 1_000_000)


def _flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def _configured(t: dict[str, DataFrame]) -> DataFrame:
    return t["latest_scrape_status"].where(F.col("collector") == "scheduled").select("source_database")


def data_age(t, as_of):
    rows = t["latest_scrape_status"].where(F.col("collector") == "connectivity")
    return _labelled(rows, S.age_seconds(as_of, F.col("collected_at")), source_database="source_database")


def connectivity(t, as_of):
    rows = t["latest_scrape_status"].where(F.col("collector") == "connectivity")
    return _labelled(rows, _flag(~F.col("success")), source_database="source_database")


def tablespace_pressure(t, as_of):
    return _labelled(t["latest_tablespace_samples"], F.col("used_percent"),
                     source_database="source_database", tablespace_name="tablespace_name")


def resource_pressure(t, as_of):
    rows = t["latest_resource_limit_samples"].where(~F.col("limit_unlimited") & (F.col("limit_value") > 0))
    return _labelled(rows, F.col("used_percent"), source_database="source_database",
                     resource_name="resource_name", inst_id="inst_id")


def diskgroup_pressure(t, as_of):
    rows = merge_shared(t["latest_asm_diskgroup_samples"], DISKGROUP_STATE)
    return _labelled(rows, F.col("used_percent"), source_database="source_database",
                     diskgroup_name="diskgroup_name")


def accounting_age(t, as_of):
    flushed = t["repository_daily_ingest"].groupBy("source_database").agg(
        F.max("last_flushed_at").alias("last_flushed_at"))
    rows = _configured(t).join(flushed, "source_database", "left")
    age = F.coalesce(S.age_seconds(as_of, F.col("last_flushed_at")), F.lit(NEVER_FLUSHED_AGE))
    return _labelled(rows, age, source_database="source_database")


def _against_baseline(t, as_of, value: Column, condition: Column) -> DataFrame:
    daily = t["repository_daily_ingest"].where(
        F.col("sample_day") >= F.date_trunc("day", _since(as_of, 8 * 86_400)))
    rows = _configured(t).join(ingest_baseline(daily, value, as_of), "source_database", "left")
    enough = F.col("baseline_days") >= BASELINE_MIN_DAYS
    return _labelled(rows, _flag(F.coalesce(enough & condition, F.lit(False))), source_database="source_database")


def ingest_drop(t, as_of):
    condition = (F.col("baseline_rows") >= DROP_MIN_ROWS) & (
        F.coalesce("yesterday_rows", F.lit(0)) < F.col("baseline_rows") * DROP_SHARE)
    return _against_baseline(t, as_of, F.col("sql_sample_rows"), condition)


def ingest_surge(t, as_of):
    total = reduce(lambda a, b: a + b, [F.col(c) for c in SURGE_COUNTERS])
    condition = (F.col("baseline_rows") >= SURGE_MIN_ROWS) & (
        F.col("yesterday_rows") > F.col("baseline_rows") * SURGE_FACTOR)
    return _against_baseline(t, as_of, total, condition)


def activity_timeout(t, as_of):
    fresh = _since(as_of, FRESH_SECONDS)
    # At most one runtime row: the newest of the activity scheduler. Without one the rule has no rows.
    runtime = t["latest_runtime_status"].where(
        (F.col("scheduler") == "activity") & (F.col("observed_at") >= fresh))
    timeout = runtime.agg(
        F.max_by(F.struct("configured_query_timeout_seconds"), F.col("observed_at")).alias("_r")
    ).scalar()
    rows = t["latest_scrape_status"].where(
        (F.col("collector") == "activity") & (F.col("collected_at") >= fresh) & F.col("success")
    ).withColumn("_runtime", timeout).where(F.col("_runtime").isNotNull())
    value = S.ratio_percent(F.col("duration_seconds"), F.col("_runtime.configured_query_timeout_seconds"))
    return _labelled(rows, value, source_database="source_database")


def _runtime_share(t, as_of, duration: str) -> DataFrame:
    rows = t["latest_runtime_status"].where(
        F.col("write_success") & (F.col("observed_at") >= _since(as_of, FRESH_SECONDS)))
    value = S.ratio_percent(F.col(duration), F.col("configured_interval_seconds"))
    names = [c for c in ("ha_scope", "scheduler", "scraper_instance") if c in rows.columns]
    return _labelled(rows, value, **{n: n for n in names})


def cycle_pressure(t, as_of):
    return _runtime_share(t, as_of, "total_duration_seconds")


def write_pressure(t, as_of):
    return _runtime_share(t, as_of, "write_duration_seconds")


def scheduler_delay(t, as_of):
    recent = t["runtime_samples"].where(F.col("observed_at") >= _since(as_of, DELAY_WINDOW_SECONDS))
    delay = F.greatest(
        S.ratio_percent(F.col("scheduling_lag_seconds"), F.col("configured_interval_seconds")),
        F.when(F.col("missed_intervals") > 0, 100.0).otherwise(0.0),
    )
    rows = recent.groupBy("ha_scope", "scheduler").agg(F.max(delay).alias("_value"))
    return _labelled(rows, F.col("_value"), ha_scope="ha_scope", scheduler="scheduler")


def destination_health(t, as_of):
    empty = F.lit("")
    bad = (
        F.upper(F.coalesce("status", empty)).isin(BAD_DESTINATION_STATES)
        | (F.coalesce("error_message", empty) != "")
        | (F.upper(F.coalesce("gap_status", F.lit("NO GAP"))) != "NO GAP")
    )
    remote = F.coalesce("db_unique_name", "destination_name", F.lit("unknown"))
    return _labelled(t["latest_dataguard_destination_samples"], _flag(bad), source_database="source_database",
                     inst_id="inst_id", dest_id="dest_id", remote_database=remote)


def replication_delay(t, as_of):
    parts = ["transport_lag_seconds", "apply_lag_seconds", "datum_age_seconds"]
    rows = t["latest_dataguard_lag_samples"]
    worst = F.greatest(*[F.coalesce(c, F.lit(0.0)) for c in parts])
    return _labelled(rows, worst, source_database="source_database")


def apply_stopped(t, as_of):
    rows = t["latest_dataguard_process_samples"].groupBy("source_database").agg(
        F.sum("apply_processes").alias("_n"))
    return _labelled(rows, F.when(F.col("_n") > 0, 0.0).otherwise(1.0), source_database="source_database")


VALUE_QUERIES: dict[str, Callable[[dict[str, DataFrame], Column], DataFrame]] = {
    "A-1": data_age, "A-2": connectivity, "A-3": tablespace_pressure, "A-4": resource_pressure,
    "A-5": diskgroup_pressure, "A-6": accounting_age, "A-7": ingest_drop, "A-8": ingest_surge,
    "A-9": activity_timeout, "A-10": cycle_pressure, "A-11": write_pressure, "A-12": scheduler_delay,
    "A-13": destination_health, "A-14": replication_delay, "A-15": apply_stopped,
}


def rule_values(rule_id: str, tables: dict[str, DataFrame], as_of: Column) -> DataFrame:
    """Current values of a rule: rule_id, labels, value, as_of."""
    values = VALUE_QUERIES[rule_id](tables, as_of)
    return values.select(F.lit(rule_id).alias("rule_id"), "labels", "value", as_of.alias("as_of"))


def rules_frame(spark: SparkSession, rules: list[Rule] = RULES) -> DataFrame:
    return spark.createDataFrame(
        [(r.rule_id, float(r.threshold), r.hold_seconds, r.no_data, r.severity) for r in rules],
        "rule_id string, threshold double, hold_seconds long, no_data string, severity string",
    )


def breaches(values: DataFrame, rules: DataFrame) -> DataFrame:
    """Values with their rule and whether they break it; a NULL value does not."""
    return values.join(rules, "rule_id").withColumn(
        "breached", F.coalesce(F.col("value") > F.col("threshold"), F.lit(False)))


def pending(history: DataFrame, as_of: Column) -> DataFrame:
    """Label sets in breach at their last evaluation, with the start of the run of breaches.

    ``history``: rule_id, labels, as_of, breached, hold_seconds.
    """
    rows = history.where(F.col("as_of") <= as_of).withColumn("labels_key", S.labels_json(F.col("labels")))
    rows = rows.withColumnRenamed("as_of", "evaluated_at")
    run = since_reset(rows, ["rule_id", "labels_key"], "evaluated_at", ~F.col("breached"))
    held = S.seconds_between(F.col("last_evaluated_at"), F.col("pending_since"))
    return run.groupBy("rule_id", "labels_key").agg(
        F.min("evaluated_at").alias("pending_since"), F.max("evaluated_at").alias("last_evaluated_at"),
        F.max("hold_seconds").alias("hold_seconds"),
    ).withColumn("firing", held >= F.col("hold_seconds"))


def evaluate_step(values: DataFrame, rules: DataFrame, state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The same as :func:`evaluate_rules` with the state after the evaluation before in place of a history.

    State: rule_id, labels_key, pending_since of the label sets in breach; it grows with
    those and not with time.  Returns the evaluation and the state after it.
    """
    keys = ["rule_id", "labels_key"]
    current = breaches(values, rules).withColumn("labels_key", S.labels_json(F.col("labels")))
    if state is None:
        run = current.withColumn("_since", F.lit(None).cast("timestamp"))
    else:
        run = current.join(state.select(*keys, F.col("pending_since").alias("_since")), keys, "left")
    run = run.withColumn("pending_since", F.when(F.col("breached"), F.coalesce("_since", "as_of")))
    firing = F.coalesce(S.seconds_between(F.col("as_of"), F.col("pending_since")) >= F.col("hold_seconds"), F.lit(False))
    found = run.select(
        *keys, "value", "breached", "pending_since", (F.col("breached") & firing).alias("firing"),
        F.lit(None).cast("string").alias("no_data_state"), "severity")
    result = found.unionByName(_silent(values, rules))
    # Label sets that were not evaluated now stay pending, as the last evaluation left them.
    after = run.where("breached").select(*keys, "pending_since")
    if state is not None:
        after = after.unionByName(state.select(*keys, "pending_since").join(current.select(*keys), keys, "left_anti"))
    return result, after


def _silent(values: DataFrame, rules: DataFrame) -> DataFrame:
    """One row in its no-data state for every rule without values."""
    silent = rules.join(values.select("rule_id").distinct(), "rule_id", "left_anti")
    return silent.select(
        "rule_id", F.lit(None).cast("string").alias("labels_key"), F.lit(None).cast("double").alias("value"),
        F.lit(False).alias("breached"), F.lit(None).cast("timestamp").alias("pending_since"),
        (F.col("no_data") == "Alerting").alias("firing"), F.col("no_data").alias("no_data_state"), "severity",
    )


def evaluate_rules(values: DataFrame, rules: DataFrame, as_of: Column, history: DataFrame | None = None) -> DataFrame:
    """One row per rule and label set: value, breached, pending_since, firing.

    ``history`` holds earlier evaluations (rule_id, labels, value, as_of).  A rule
    without rows gives one row in its no-data state.
    """
    current = breaches(values, rules).withColumn("labels_key", S.labels_json(F.col("labels")))
    earlier = values.select("rule_id", "labels", "value", "as_of")
    if history is not None:
        earlier = history.select("rule_id", "labels", "value", "as_of").where(
            F.col("as_of") < as_of).unionByName(earlier)
    run = pending(breaches(earlier, rules), as_of).select("rule_id", "labels_key", "pending_since", "firing")
    found = current.join(run, ["rule_id", "labels_key"], "left").select(
        "rule_id", "labels_key", "value", "breached",
        F.when(F.col("breached"), F.col("pending_since")).alias("pending_since"),
        (F.col("breached") & F.coalesce("firing", F.lit(False))).alias("firing"),
        F.lit(None).cast("string").alias("no_data_state"), "severity",
    )
    return found.unionByName(_silent(values, rules))
