"""Streaming jobs over the given tables, run until all landed data is read.

Each run streams the events file, writes under the session's checkpoint folder and
returns what was stored; the checks are those of the batch twins.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from driverqueries import series, stores
from driverqueries.adapters import ADAPTERS, Inputs
from driverqueries.registry import query
from fleetlens.operators import timeline
from fleetlens.schemas import STORED
from fleetlens.session import scratch_dir
from fleetlens.sources import sinks
from fleetlens.streaming import jobs

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _events(fx: Inputs):
    """The events table as a stream of landed files."""
    return fx.spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(fx.sf_dir)


def _adapted(fx: Inputs, name: str):
    return fx.spark.sql(ADAPTERS[f"fx_{name}"], events=_events(fx))


def _wait(started):
    started.awaitTermination()


def _stored_files(fx, stream, name, partition_by=()):
    root = scratch_dir(fx.spark, name)
    _wait(jobs.to_files(stream, f"{root}/out", f"{root}/checkpoint", partition_by))
    return fx.spark.read.parquet(f"{root}/out")


@query("st_1_activity_ingest", f"""
select sample_id, sample_time, source_database, session_id, session_serial_number from (
  select *, row_number() over (partition by {stores._ACTIVITY_KEY} order by poll) as rn from {{fx_activity}}) r where rn = 1""")
def activity_ingest(fx):
    root = scratch_dir(fx.spark, "activity")
    _wait(jobs.stream_activity(_adapted(fx, "activity"), root, f"{root}/_checkpoint"))
    return sinks.read_table(fx.spark, root, "database_activity_samples").select(
        "sample_id", "sample_time", "source_database", "session_id", "session_serial_number")


@query("st_1_activity_ingest_bounded", f"""
select sample_id, sample_time, source_database, session_id, session_serial_number from (
  select *, row_number() over (partition by {stores._ACTIVITY_KEY} order by poll) as rn from {{fx_activity}}) r where rn = 1""")
def activity_ingest_bounded(fx):
    root = scratch_dir(fx.spark, "activity-bounded")
    _wait(jobs.stream_activity_bounded(_adapted(fx, "activity"), f"{root}/out", f"{root}/_checkpoint", "40 days"))
    return fx.spark.read.parquet(f"{root}/out").select(
        "sample_id", "sample_time", "source_database", "session_id", "session_serial_number")


@query("st_2_counter_delta", f"""
select source_database, inst_id, con_id, stat_name, seq, collected_at, cumulative_value, delta_value, interval_seconds, counter_reset
from ({series._DELTA}) d""")
def counter_delta(fx):
    root = scratch_dir(fx.spark, "counter-store")
    _wait(jobs.stream_counter_store(_adapted(fx, "counter"), root, f"{root}/_checkpoint"))
    return jobs.counter_samples(fx.spark, root).select(
        "source_database", "inst_id", "con_id", "stat_name", "seq", "collected_at", "cumulative_value", "delta_value",
        "interval_seconds", "counter_reset")


@query("st_2_late_readings", f"""
select source_database, inst_id, con_id, stat_name, seq, collected_at, cumulative_value, delta_value, interval_seconds, counter_reset
from ({series._DELTA}) d""")
def late_readings(fx):
    """Readings land by arrival number modulo three, so that two of three batches bring readings older than stored ones."""
    root = scratch_dir(fx.spark, "counter-late")
    fx.counter.withColumn("_file", F.col("seq") % 3).repartitionByRange(3, "_file").drop("_file").write.parquet(f"{root}/landed")
    stream = jobs.read_landed(fx.spark, f"{root}/landed", fx.counter.schema, maxFilesPerTrigger=1)
    _wait(jobs.stream_counter_store(stream, root, f"{root}/_checkpoint"))
    return jobs.counter_samples(fx.spark, root).select(
        "source_database", "inst_id", "con_id", "stat_name", "seq", "collected_at", "cumulative_value", "delta_value",
        "interval_seconds", "counter_reset")


@query("st_2_counter_delta_keyed", f"""
select source_database, inst_id, con_id, stat_name, seq, collected_at, cumulative_value, delta_value, interval_seconds, counter_reset
from ({series._DELTA}) d""")
def counter_delta_keyed(fx):
    return _stored_files(fx, jobs.stream_counter_delta(_adapted(fx, "counter")), "counter-delta")


@query("st_3_consumer_delta", series._CONSUMER)
def consumer_delta(fx):
    return jobs.consumer_deltas(fx.spark, _consumers(fx, "consumers")).select(
        "collected_at", "source_database", "inst_id", "sql_id", "plan_hash_value", *series._COUNTERS)


def _consumers(fx, name, **options):
    """Snapshots aggregated from events land in four files by plan, so that every batch splits every snapshot.

    ``options`` are functions of the landed snapshots, which are aggregated once.
    """
    root = scratch_dir(fx.spark, name)
    fx.sqlstats.repartition(4, "plan_hash_value").write.parquet(f"{root}/landed")
    landed = fx.spark.read.schema(fx.sqlstats.schema).parquet(f"{root}/landed")
    options = {k: (lambda spark, of=v: of(landed)) if callable(v) else v for k, v in options.items()}
    stream = jobs.read_landed(fx.spark, f"{root}/landed", fx.sqlstats.schema, maxFilesPerTrigger=1)
    _wait(jobs.stream_consumers(stream, root, f"{root}/_checkpoint", **options))
    return root


@query("st_3_top_consumers", f"""
with d as ({series._CONSUMER}), tk as (
  select distinct source_database, collected_at as taken_at from {{fx_sqlstats}} where hour(collected_at) % 8 = 0
), totals as (
  select d.source_database, (select min(taken_at) from tk where tk.source_database = d.source_database and taken_at >= d.collected_at) as taken_at, sql_id,
    {', '.join(f'cast(sum({c}) as bigint) as {c}' for c in series._COUNTERS)}
  from d group by 1, 2, 3
)
select * from (
  select *, row_number() over (partition by source_database, taken_at order by elapsed_time_micro desc, cpu_time_micro desc,
    user_io_wait_micro desc, sql_id) as rank
  from totals where elapsed_time_micro > 0 and taken_at is not null) r
where rank <= 3""")
def top_consumers(fx):
    takes = lambda landed: landed.where("hour(collected_at) % 8 = 0").select("source_database", "collected_at")
    complete = lambda landed: landed.select("source_database", "collected_at").distinct()
    root = _consumers(fx, "takes", takes=takes, complete=complete, n=3)
    return jobs.top_consumers(fx.spark, root).drop("batch_id", "revision", "day")


@query("st_4_latest_status", """
select source_database, collector, collected_at, success, duration_seconds, sample_count, error_message from {fx_latest_status}""")
def latest_status(fx):
    root = scratch_dir(fx.spark, "latest")
    schema = STORED["latest_scrape_status"]
    _wait(jobs.stream_latest(_adapted(fx, "status").drop("event_type"), root, "latest_scrape_status",
                             f"{root}/_checkpoint", ["source_database", "collector"], "collected_at", schema))
    return sinks.read_state(fx.spark, root, "latest_scrape_status", schema)


@query("st_5_daily_ingest", """
select date_trunc('day', collected_at) as sample_day, source_database, count(*) as scrape_status_rows, min(collected_at) as first_sample_at,
  max(collected_at) as last_sample_at
from {fx_status} group by 1, 2""")
def daily_ingest(fx):
    root = scratch_dir(fx.spark, "daily")
    _wait(jobs.stream_daily_ingest(_adapted(fx, "status"), root, f"{root}/_checkpoint", "scrape_status"))
    return sinks.read_state(fx.spark, root, "repository_daily_ingest", STORED["repository_daily_ingest"]).select(
        "sample_day", "source_database", "scrape_status_rows", "first_sample_at", "last_sample_at")


@query("st_6_thin_stream", series._thin_sql("{fx_counter}", ["source_database"], ">="))
def thin_stream(fx):
    root = scratch_dir(fx.spark, "thin-store")
    _wait(jobs.stream_thin_store(_adapted(fx, "counter"), root, f"{root}/_checkpoint", ["source_database"],
                                 "collected_at", 3 * 3600))
    return jobs.kept_ticks(fx.spark, root, ["source_database"])


@query("st_6_thin_late", series._thin_sql("{fx_counter}", ["source_database"], ">="))
def thin_late(fx):
    """Readings land by arrival number modulo three, so that every batch brings ticks between those already thinned."""
    root = scratch_dir(fx.spark, "thin-late")
    fx.counter.withColumn("_file", F.col("seq") % 3).repartitionByRange(3, "_file").drop("_file").write.parquet(f"{root}/landed")
    stream = jobs.read_landed(fx.spark, f"{root}/landed", fx.counter.schema, maxFilesPerTrigger=1)
    _wait(jobs.stream_thin_store(stream, root, f"{root}/_checkpoint", ["source_database"], "collected_at", 3 * 3600))
    return jobs.kept_ticks(fx.spark, root, ["source_database"])


@query("st_6_thin_stream_keyed", series._thin_sql("{fx_counter}", ["source_database"], ">="))
def thin_stream_keyed(fx):
    return _stored_files(fx, jobs.stream_thin(_adapted(fx, "counter"), ["source_database"], "collected_at", 3 * 3600), "thin")


@query("st_7_connection_stream", series._CONNECTION_FOLD)
def connection_stream(fx):
    states = _stored_files(fx, jobs.stream_connection_states(_adapted(fx, "connection")), "connection")
    return timeline.newest_per_key(states, ["source_database"], ["observed_at", "seq"]).drop("seq")


@query("st_8_backoff_stream", f"""
with s as (select *, sum(case when success then 1 else 0 end) over (partition by source_database order by collected_at, seq) as island from {{fx_status}}),
f as (select *, sum(case when success then 0 else 1 end) over (partition by source_database, island order by collected_at, seq) as failures from s)
select source_database, seq, collected_at, cast(failures as bigint) as consecutive_failures,
  cast(case when failures = 0 then 0 else least(900, 60 * power(2, least(failures - 1, 4))) end as bigint) as backoff_seconds,
  case when not success then collected_at + cast(least(900, 60 * power(2, least(failures - 1, 4))) as bigint) * interval '1 second' end as retry_at
from f""")
def backoff_stream(fx):
    return _stored_files(fx, jobs.stream_backoff(_adapted(fx, "status")), "backoff")


@query("st_9_plan_cache", """
select distinct source_database, inst_id, sql_id, child_number, plan_hash_value, plan_line_id, seq from {fx_plan}""")
def plan_cache(fx):
    root = scratch_dir(fx.spark, "plans")
    candidates = _adapted(fx, "plan").select("source_database", "inst_id", "sql_id", "child_number", "plan_hash_value")
    _wait(jobs.stream_plan_cache(candidates, fx.plan, root, f"{root}/_checkpoint"))
    return sinks.read_table(fx.spark, root, "sql_plans").select(
        "source_database", "inst_id", "sql_id", "child_number", "plan_hash_value", "plan_line_id", "seq")


@query("st_10_pending_stream", """
with e as (select event_id as seq, event_type as rule_id, cast(ts as timestamp) as evaluated_at, value > 60 as breached from {events}),
i as (select *, sum(case when breached then 0 else 1 end) over (partition by rule_id order by evaluated_at) as island from e),
p as (select *, min(case when breached then evaluated_at end) over (partition by rule_id, island) as since from i)
select rule_id, evaluated_at, breached, case when breached then since end as pending_since,
  coalesce(breached and epoch_us(evaluated_at) - epoch_us(since) >= 600 * 1000000, false) as firing
from p""")
def pending_stream(fx):
    rows = _events(fx).select(
        F.col("event_type").alias("rule_id"), F.lit("{}").alias("labels_key"), F.col("ts").cast("timestamp").alias("evaluated_at"),
        (F.col("value") > 60).alias("breached"), F.lit(600).cast("long").alias("hold_seconds"))
    return _stored_files(fx, jobs.stream_pending(rows), "pending").drop("labels_key")
