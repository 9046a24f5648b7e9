"""Counter deltas, consumer deltas, missed intervals, backoff and alert islands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import scalars as S
from fleetlens.operators.numbering import numbered
from fleetlens.operators.timeline import HOUR, newest_per_key, previous_values, since_reset, upcoming

# --- fixed values ---------------------------------------------------------
SERIES_KEYS = ["source_database", "inst_id", "con_id", "stat_name"]
CONSUMER_KEYS = ["source_database", "inst_id", "sql_id", "plan_hash_value"]
CONSUMER_COUNTERS = [
    "elapsed_time_micro", "cpu_time_micro", "user_io_wait_micro", "application_wait_micro",
    "concurrency_wait_micro", "cluster_wait_micro", "executions", "buffer_gets", "disk_reads",
]
# --------------------------------------------------------------------------


def counter_delta(df: DataFrame, keys: Sequence[str] = SERIES_KEYS, ts: str = "collected_at",
                  value: str = "cumulative_value", seq: str | None = "seq",
                  delta: str = "delta_value", slot_seconds: float = HOUR) -> DataFrame:
    """Delta to the previous reading of a series; a drop is a reset without delta.

    The first reading, and one whose time does not advance, has neither delta
    nor interval; it still is the baseline of the next reading.
    """
    rows = previous_values(df, keys, ts, [ts, value], seq, slot_seconds)
    advanced = F.col(f"prev_{ts}").isNotNull() & (F.col(ts) > F.col(f"prev_{ts}"))
    dropped = advanced & (F.col(value) < F.col(f"prev_{value}"))
    return rows.select(
        *df.columns,
        F.when(advanced & ~dropped, F.col(value) - F.col(f"prev_{value}")).alias(delta),
        F.when(advanced, S.seconds_between(F.col(ts), F.col(f"prev_{ts}"))).alias("interval_seconds"),
        F.coalesce(dropped, F.lit(False)).alias("counter_reset"),
    )


def rates(df: DataFrame, delta: str = "delta_value", out: str = "value_per_second") -> DataFrame:
    """Per-second rate of a delta; NULL over a reset or an empty interval."""
    usable = (F.col("interval_seconds") > 0) & ~F.col("counter_reset")
    return df.withColumn(out, F.when(usable, F.col(delta).cast("double") / F.col("interval_seconds")))


def consumer_delta(df: DataFrame, keys: Sequence[str] = CONSUMER_KEYS,
                   counters: Sequence[str] = CONSUMER_COUNTERS, ts: str = "collected_at",
                   snapshots: DataFrame | None = None, slot_seconds: float = HOUR) -> DataFrame:
    """Work done by every statement between two snapshots of its database.

    A database's first snapshot is only a baseline.  Later, a statement missing
    from the snapshot right before counts in full, and a counter that dropped
    counts 0.  ``snapshots`` (database, time) names snapshots that may be empty.
    """
    counters = [c for c in counters if c in df.columns]
    times = (df if snapshots is None else snapshots).select("source_database", ts).distinct()
    times = previous_values(times, ["source_database"], ts, [ts], None, slot_seconds).select(
        "source_database", ts, F.col(f"prev_{ts}").alias("_before")
    )
    rows = df.where(F.length("sql_id") > 0)
    rows = rows.withColumns(
        {"plan_hash_value": F.coalesce("plan_hash_value", F.lit(0)),
         **{c: F.coalesce(c, F.lit(0)).cast("long") for c in counters}}
    )
    rows = previous_values(rows, keys, ts, [ts, *counters], None, slot_seconds)
    rows = rows.join(times.where(F.col("_before").isNotNull()), ["source_database", ts])
    carried = F.coalesce(F.col(f"prev_{ts}") == F.col("_before"), F.lit(False))
    return rows.select(
        ts, *keys,
        *[F.when(carried, F.greatest(F.col(c) - F.col(f"prev_{c}"), F.lit(0).cast("long")))
           .otherwise(F.col(c)).alias(c) for c in counters],
    )


def top_consumers(deltas: DataFrame, interval: float | None = None, n: int = 20,
                  takes: DataFrame | None = None, ts: str = "collected_at") -> DataFrame:
    """The ``n`` statements of a database that did most work since the previous take.

    Takes are either the ends of fixed ``interval`` second windows or the rows of
    ``takes`` (database, time), e.g. thinned snapshot times; work after the last
    take is still open and not reported.
    """
    if takes is None:
        window = F.window(ts, f"{int(interval * 1_000_000)} microseconds")
        return ranked_work(deltas.withColumn("taken_at", window.getField("end")), n)
    return ranked_work(work_at_takes(deltas, takes, ts), n)


def work_at_takes(deltas: DataFrame, takes: DataFrame, ts: str = "collected_at") -> DataFrame:
    """Every delta with ``taken_at``, the first take at or after its snapshot; those that no take follows are left out."""
    times = deltas.select("source_database", ts).distinct()
    return deltas.join(upcoming(times, takes, ["source_database"], ts, "taken_at"), ["source_database", ts])


def ranked_work(tagged: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` statements with most work of every database and take."""
    counters = [c for c in CONSUMER_COUNTERS if c in tagged.columns]
    totals = tagged.groupBy("source_database", "taken_at", "sql_id").agg(
        *[F.sum(c).alias(c) for c in counters]
    ).where(F.col("elapsed_time_micro") > 0)
    ranking = [F.col(c).desc() for c in counters[:3]] + [F.col("sql_id").asc()]
    order = Window.partitionBy("source_database", "taken_at").orderBy(*ranking)
    return totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def missed_intervals(df: DataFrame, keys: Sequence[str], ts: str, interval: Column | float,
                     seq: str | None = "seq", slot_seconds: float = HOUR) -> DataFrame:
    """Whole intervals skipped since the previous run of the same key."""
    rows = previous_values(df, keys, ts, [ts], seq, slot_seconds)
    interval = interval if isinstance(interval, Column) else F.lit(float(interval))
    gap = F.unix_micros(ts) - F.unix_micros(f"prev_{ts}")
    periods = F.floor(gap / (interval * 1_000_000))
    return rows.withColumn(
        "missed_intervals",
        F.when((gap > 0) & (periods > 1), periods - 1).otherwise(0).cast("long"),
    ).drop(f"prev_{ts}")


def with_ordinal(df: DataFrame, ts: str, seq: str, per: Sequence[str] = (), name: str = "ordinal") -> DataFrame:
    """Row number by (ts, seq), numbered range by range so no task sees a whole group or a crowded moment."""
    return numbered(df, [F.col(ts).asc_nulls_first(), F.col(seq).asc_nulls_first()], per, name)


def failure_backoff(df: DataFrame, as_of: Column, keys: Sequence[str] = ("source_database",),
                    ts: str = "collected_at", success: str = "success", seq: str | None = "seq") -> DataFrame:
    """Consecutive failures since the last success, and when to try again."""
    failing = since_reset(df, keys, ts, F.col(success), seq)
    per_key = failing.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("consecutive_failures"), F.max(ts).alias("last_failure_at")
    )
    wait = S.retry_backoff(F.col("consecutive_failures"))
    retry_at = F.timestamp_micros(F.unix_micros("last_failure_at") + wait * 1_000_000)
    return per_key.withColumns({"backoff_seconds": wait, "retry_at": retry_at}).withColumn(
        "due", as_of >= F.col("retry_at")
    )


def connection_states(events: DataFrame, seq: str = "seq", slot_seconds: float = HOUR) -> DataFrame:
    """Connection state of every database folded from its event history.

    ``events``: source_database, event_at, seq, kind, message, duration_seconds, where kind is
    ``failure``, ``probe_start``, ``probe_failed``, ``probe_ok`` or ``activate``.

    A probe starts only from quarantine, and a database is in quarantine exactly when the
    event before was a failure; so the fold is one look-back and one aggregation.
    """
    broken = F.col("kind").isin("failure", "probe_failed")
    healthy = F.col("kind").isin("probe_ok", "activate")
    rows = previous_values(events, ["source_database"], "event_at", ["kind"], seq, slot_seconds)
    quarantined = F.coalesce(F.col("prev_kind").isin("failure", "probe_failed"), F.lit(False))
    rows = rows.withColumn("_counts", (F.col("kind") != "probe_start") | quarantined)
    at = F.struct("event_at", seq)
    probe = (F.col("kind") == "probe_start") & F.col("_counts")
    finish = F.col("kind").isin("probe_failed", "probe_ok")

    def newest(value, when):
        return F.max_by(value, F.when(when, at))

    folded = rows.groupBy("source_database").agg(
        F.max("event_at").alias("observed_at"),
        newest("kind", F.col("_counts")).alias("_kind"),
        F.max(F.when(broken, F.col("event_at"))).alias("last_failure_at"),
        newest(F.coalesce("message", F.lit("database connection is unavailable")), broken).alias("last_failure"),
        F.max(F.when(probe, F.col("event_at"))).alias("last_probe_at"),
        newest(F.when(finish, F.col("duration_seconds")), probe | finish).alias("last_probe_duration_seconds"),
        F.nullif(newest(F.when(F.col("kind") == "probe_failed", F.col("message")).otherwise(F.lit("")),
                        (F.col("kind") != "failure") & F.col("_counts")), F.lit("")).alias("last_probe_error"),
        F.count_if(probe).alias("probe_attempts"),
        F.max(F.when(F.col("kind") == "probe_ok", F.col("event_at"))).alias("recovered_at"),
    )
    # Quarantine began with the first failure after the last healthy event.
    onset = (
        since_reset(rows.select("source_database", "event_at", seq, "kind"), ["source_database"], "event_at", healthy, seq)
        .where(broken).groupBy("source_database").agg(F.min("event_at").alias("queued_at"))
    )
    state = (
        F.when(F.col("_kind") == "probe_start", "PROBING")
        .when(F.col("_kind").isin("failure", "probe_failed"), "QUARANTINED")
        .when(F.col("_kind").isin("probe_ok", "activate"), "ACTIVE")
        .otherwise("STARTING")
    )
    return folded.join(onset, "source_database", "left").select(
        "source_database", "observed_at", state.alias("state"), "queued_at", "last_failure_at", "last_failure",
        "last_probe_at", "last_probe_duration_seconds", "last_probe_error", "probe_attempts", "recovered_at",
    )


def latest_from_history(df: DataFrame, keys: Sequence[str], ts: str = "collected_at",
                        seq: str | None = None) -> DataFrame:
    """The newest row of every key."""
    return newest_per_key(df, keys, [ts] + ([seq] if seq else []))


def first_n_distinct(df: DataFrame, keys: Sequence[str], order: str, n: int, per: Sequence[str]) -> DataFrame:
    """The first ``n`` distinct ``keys`` of every ``per`` group in input order."""
    columns = list(dict.fromkeys([*per, *keys]))
    first_seen = df.groupBy(*columns).agg(F.min(order).alias(order))
    rank = F.row_number().over(Window.partitionBy(*per).orderBy(order))
    return first_seen.withColumn("_rank", rank).where(F.col("_rank") <= n).select(*columns, order)
