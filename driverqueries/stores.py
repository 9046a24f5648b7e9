"""Merges, retention, accounting and user metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from driverqueries.adapters import AS_OF
from driverqueries.registry import query
from fleetlens.functions import scalars as S
from fleetlens.operators import accounting, deltas, merges, metrics
from fleetlens.schemas import STORED
from fleetlens.sources import readers, sinks

_OLD, _NEW = "event_type in ('click', 'view')", "event_type not in ('click', 'view')"


def _halves(df):
    """Stored and incoming half of a fixture, interleaved in time."""
    old = F.col("event_type").isin("click", "view")
    return df.where(old), df.where(~old)


# --- writers (round trip through files) ------------------------------------------

@query("snk_1_daily_append", """
select cast(collected_at as date) as day, source_database, count(*) as n, min(collected_at) as first_at from {fx_counter} group by 1, 2""")
def daily_append(fx):
    from fleetlens.session import scratch_dir

    path = scratch_dir(fx.spark, "append")
    old = fx.counter.where("stat_name in ('click', 'view')")
    sinks.append_daily(old, path, "collected_at", ["source_database", "stat_name"])
    sinks.append_daily(fx.counter.where("stat_name not in ('click', 'view')"), path, "collected_at")
    return fx.spark.read.parquet(path).groupBy("day", "source_database").agg(
        F.count("*").alias("n"), F.min("collected_at").alias("first_at"))


@query("snk_2_metric_sample_rows", """
select seq, value_2 as metric, concat('{{"label_1":"', label_1, '","label_2":"', label_2, '"}}') as labels from {fx_metric_rows}""")
def metric_sample_rows(fx):
    labels = F.create_map(F.lit("label_2"), F.col("label_2"), F.lit("label_1"), F.col("label_1"))
    return sinks.metric_sample_rows(fx.metric_rows.select("seq", F.col("value_2").alias("metric"), labels.alias("labels")))


_ACTIVITY_KEY = "sample_time, source_database, inst_id, sample_id, session_id, coalesce(session_serial_number, -1)"


@query("snk_3_insert_if_absent", f"""
select sample_id, sample_time, source_database, poll from (
  select *, row_number() over (partition by {_ACTIVITY_KEY} order by poll) as rn from {{fx_activity}} where event_type <> 'view') i
where rn = 1 and not exists (select 1 from {{fx_activity}} e where e.event_type = 'view' and e.sample_id = i.sample_id)""")
def insert_if_absent(fx):
    stored = sinks.with_day(fx.activity.where("event_type = 'view'"), "sample_time")
    incoming = fx.activity.where("event_type <> 'view' or poll = 2")
    return merges.dedupe_insert(stored, incoming, seq="poll").select("sample_id", "sample_time", "source_database", "poll")


def _latest_sql(source, keys, ts, seq_order, columns):
    newest = f"select *, row_number() over (partition by {keys} order by {ts} desc, seq desc) as rn from {source} where {_OLD}"
    return f"""
select {columns} from (
  select *, row_number() over (partition by {keys} order by {ts} desc, origin desc, seq {seq_order}) as last from (
    select * exclude (rn), 0 as origin from ({newest}) o where rn = 1
    union all select *, 1 as origin from {source} where {_NEW}) b) r
where last = 1"""


@query("snk_4_latest_status", _latest_sql("{fx_status_hour}", "source_database, collector", "collected_at", "desc",
                                          "source_database, collector, collected_at, success, duration_seconds, sample_count, error_message"))
def latest_status(fx):
    old, new = _halves(fx.status_hour)
    keys = ["source_database", "collector"]
    stored = deltas.latest_from_history(old, keys, "collected_at", "seq").drop("seq", "event_type")
    return merges.merge_latest(stored, new.drop("event_type"), keys, "collected_at")


@query("snk_5_latest_runtime", """
with b as (select *, date_trunc('day', observed_at) as day from {fx_runtime}), old as (
  select *, row_number() over (partition by ha_scope, scheduler order by day desc, seq desc) as rn from b where scheduler in ('click', 'view') or write_success)
select ha_scope, scheduler, day as observed_at, scheduling_lag_seconds, missed_intervals from (
  select *, row_number() over (partition by ha_scope, scheduler order by day desc, origin desc, seq) as last from (
    select * exclude (rn), 0 as origin from old where rn = 1 union all
    select *, 1 as origin from b where not (scheduler in ('click', 'view') or write_success)) u) r
where last = 1""")
def latest_runtime(fx):
    rows = fx.runtime.withColumn("observed_at", F.date_trunc("day", "observed_at"))
    stored = F.col("scheduler").isin("click", "view") | F.col("write_success")
    keys = ["ha_scope", "scheduler"]
    existing = deltas.latest_from_history(rows.where(stored), keys, "observed_at", "seq").drop("seq")
    return merges.merge_latest(existing, rows.where(~stored), keys, "observed_at", tie="first").select(
        *keys, "observed_at", "scheduling_lag_seconds", "missed_intervals")


@query("snk_6_connection_state", f"""
select source_database, observed_at, state from (
  select *, row_number() over (partition by source_database order by observed_at desc, origin desc, seq desc) as last from (
    select source_database, date_trunc('hour', event_at) as observed_at, kind as state, seq,
      case when kind in ('failure', 'probe_start') then 1 else 0 end as origin from {{fx_connection}}) b) r
where last = 1 and source_database in (select source_database from {{fx_connection}} where kind in ('failure', 'probe_start'))""")
def connection_state_upsert(fx):
    rows = fx.connection.select("source_database", F.date_trunc("hour", "event_at").alias("observed_at"),
                                F.col("kind").alias("state"), "seq")
    new = F.col("state").isin("failure", "probe_start")
    stored = deltas.latest_from_history(rows.where(~new), ["source_database"], "observed_at", "seq").drop("seq")
    return merges.merge_state(stored, rows.where(new), complete=True)


_TEXT_ORIGIN = "case when event_type in ('click', 'view') then 0 when event_type = 'error' then 1 else 2 end"


@query("snk_7_sql_texts", f"""
select source_database, sql_id, first_seen_at, last_text_seen_at, last_text_seen_at as last_referenced_at, sql_fulltext from (
  select *, row_number() over (partition by source_database, sql_id order by collected_at desc, {_TEXT_ORIGIN} desc, seq desc) as rn,
    min(collected_at) over (partition by source_database, sql_id) as first_seen_at,
    max(collected_at) over (partition by source_database, sql_id) as last_text_seen_at
  from {{fx_text}}) r
where rn = 1""")
def sql_texts(fx):
    old, new = _halves(fx.text)
    empty = fx.spark.createDataFrame([], STORED["sql_texts"])
    stored = merges.merge_sql_texts(empty, None, old)
    return merges.merge_sql_texts(stored, new.where("event_type = 'error'"), new.where("event_type <> 'error'"))


_CURSOR = "source_database, inst_id, sql_id, child_number, plan_hash_value"


def _stored_cursors(old):
    newest = deltas.latest_from_history(old, merges.CURSOR_KEYS, "collected_at", "seq")
    first = old.groupBy(*merges.CURSOR_KEYS).agg(F.min("collected_at").alias("first_seen_at"))
    return newest.join(first, merges.CURSOR_KEYS).select(
        *merges.CURSOR_KEYS, "parsing_schema_name", "module", "first_seen_at", F.col("collected_at").alias("last_seen_at"))


@query("snk_8_cursor_metadata", f"""
with o as (
  select {_CURSOR}, parsing_schema_name, module, first_seen_at, collected_at as last_seen_at from (
    select *, row_number() over (partition by {_CURSOR} order by collected_at desc, seq desc) as rn,
      min(collected_at) over (partition by {_CURSOR}) as first_seen_at from {{fx_cursor}} where {_OLD}) r where rn = 1
), n as (
  select * from (select *, row_number() over (partition by {_CURSOR} order by collected_at desc, seq) as rn from {{fx_cursor}} where {_NEW}) r where rn = 1
), j as (
  select coalesce(o.source_database, n.source_database) as source_database, coalesce(o.inst_id, n.inst_id) as inst_id,
    coalesce(o.sql_id, n.sql_id) as sql_id, coalesce(o.child_number, n.child_number) as child_number,
    coalesce(o.plan_hash_value, n.plan_hash_value) as plan_hash_value,
    o.parsing_schema_name as os, o.module as om, o.first_seen_at, o.last_seen_at, n.parsing_schema_name as ns, n.module as nm, n.collected_at as at_,
    n.collected_at is not null and (o.last_seen_at is null or o.last_seen_at < date_trunc('day', n.collected_at)
      or (n.collected_at >= o.last_seen_at and (o.parsing_schema_name is distinct from n.parsing_schema_name or o.module is distinct from n.module))) as rewrite
  from o full join n on o.source_database = n.source_database and o.inst_id = n.inst_id and o.sql_id = n.sql_id
    and o.child_number = n.child_number and o.plan_hash_value = n.plan_hash_value
)
select {_CURSOR}, case when rewrite then ns else os end as parsing_schema_name, case when rewrite then nm else om end as module,
  case when rewrite then least(first_seen_at, at_) else first_seen_at end as first_seen_at,
  case when rewrite then greatest(last_seen_at, at_) else last_seen_at end as last_seen_at
from j""")
def cursor_metadata(fx):
    old, new = _halves(fx.cursor)
    return merges.merge_cursor_metadata(_stored_cursors(old), new)


_PLAN_LINE = f"{_CURSOR}, plan_line_id"


def _stored_plans(fx, old):
    times = old.groupBy(*merges.PLAN_LINE_KEYS).agg(
        F.min("collected_at").alias("first_seen_at"), F.max("collected_at").alias("last_seen_at"),
        F.max("collected_at").alias("last_referenced_at"))
    newest = deltas.latest_from_history(old, merges.PLAN_LINE_KEYS, "seq").select(
        *merges.PLAN_LINE_KEYS, "operation", "cost")
    return newest.join(times, merges.PLAN_LINE_KEYS)


@query("snk_9_sql_plans", f"""
with o as (
  select * from (select *, row_number() over (partition by {_PLAN_LINE} order by seq desc) as rn, min(collected_at) over (partition by {_PLAN_LINE}) as first_at,
    max(collected_at) over (partition by {_PLAN_LINE}) as last_at from {{fx_plan}} where {_OLD}) r where rn = 1
), n as (
  select * from (select *, row_number() over (partition by {_PLAN_LINE} order by seq desc) as rn from {{fx_plan}} where {_NEW}) r where rn = 1
)
select source_database, inst_id, sql_id, child_number, plan_hash_value, plan_line_id,
  coalesce(n.operation, o.operation) as operation, coalesce(n.cost, o.cost) as cost, least(o.first_at, n.collected_at) as first_seen_at,
  greatest(o.last_at, n.collected_at) as last_seen_at, greatest(o.last_at, n.collected_at) as last_referenced_at
from o full join n using (source_database, inst_id, sql_id, child_number, plan_hash_value, plan_line_id)""")
def sql_plans(fx):
    old, new = _halves(fx.plan)
    return merges.merge_sql_plans(_stored_plans(fx, old), new)


@query("snk_10_text_touch", """
with texts as (select source_database, sql_id, min(collected_at) as last_referenced_at from {fx_text} group by 1, 2),
refs as (
  select source_database, sql_id, max(collected_at) as at_ from (
    select source_database, sql_id, collected_at from {fx_session} union all
    select source_database, prev_sql_id, collected_at from {fx_session} union all
    select source_database, sql_id, collected_at from {fx_activity} union all
    select source_database, top_level_sql_id, collected_at from {fx_activity} union all
    select source_database, sql_id, collected_at from {fx_sqlstats}) r group by 1, 2
)
select t.source_database, t.sql_id, greatest(t.last_referenced_at, r.at_) as last_referenced_at
from texts t left join refs r on r.source_database = t.source_database and r.sql_id = t.sql_id""")
def text_touch(fx):
    texts = fx.text.groupBy("source_database", "sql_id").agg(F.min("collected_at").alias("last_referenced_at"))
    refs = merges.text_references(sql=fx.sqlstats, sessions=fx.session, activity=fx.activity)
    return merges.touch(texts, refs, ["source_database", "sql_id"])


@query("snk_10_plan_references", f"""
select {_CURSOR}, max(collected_at) as referenced_at from {{fx_cursor}} where child_number is not null and plan_hash_value > 0 group by all""")
def plan_references(fx):
    return merges.plan_references(fx.cursor)


# --- accounting -------------------------------------------------------------------

_DATASETS = [("system_counter_samples", "fx_counter", "collected_at"), ("session_samples", "fx_session", "collected_at"),
             ("database_activity_samples", "fx_activity", "sample_time"), ("scrape_status", "fx_status", "collected_at"),
             ("sql_samples", "fx_sqlstats", "collected_at")]


def _datasets(fx):
    return {name: getattr(fx, view.removeprefix("fx_")) for name, view, _ in _DATASETS}


def _daily_sql():
    counters = {name: accounting.DATASETS[name][0] for name, _, _ in _DATASETS}
    last = {name: accounting.DATASETS[name][2] for name, _, _ in _DATASETS}
    rows = " union all ".join(f"select '{n}' as dataset, source_database, {ts} as at_ from {{{v}}}" for n, v, ts in _DATASETS)
    sums = ", ".join(
        (f"count(*) filter (where dataset = '{[n for n in counters if counters[n] == c][0]}') as {c}" if c in counters.values()
         else f"cast(0 as bigint) as {c}") for c in accounting.COUNTERS)
    lasts = ", ".join(
        f"max(at_) filter (where dataset = '{[n for n in last if last[n] == t][0]}') as {t}" for t in accounting.LAST_TIMES)
    return f"""
select date_trunc('day', at_) as sample_day, source_database, {sums}, min(at_) as first_sample_at, max(at_) as last_sample_at, {lasts}
from ({rows}) r group by 1, 2"""


@query("agg_17_daily_ingest", _daily_sql())
def daily_ingest(fx):
    return accounting.daily_ingest(_datasets(fx))


@query("snk_11_merge_daily_ingest", f"""
select *, case when scrape_status_rows > 0 then timestamp '{AS_OF}' else timestamp '2024-01-01 00:00:00' end as last_flushed_at from ({_daily_sql()}) d""")
def merge_daily_ingest(fx):
    every = _datasets(fx)
    stored = accounting.daily_ingest({k: v for k, v in every.items() if k != "scrape_status"}).withColumn(
        "last_flushed_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    increments = accounting.daily_ingest({"scrape_status": every["scrape_status"]})
    return accounting.merge_daily_ingest(stored, increments, fx.as_of)


# Fixed value: the counters that the surge rule adds up.
_SURGE = """additional_metric_rows + sql_sample_rows + sql_text_writes + sql_cursor_metadata_writes + sql_plan_operation_writes + session_sample_rows + blocking_session_sample_rows + database_activity_sample_rows + database_status_sample_rows + instance_sample_rows + resource_limit_sample_rows + tablespace_sample_rows + asm_diskgroup_sample_rows + system_counter_sample_rows + wait_class_sample_rows + system_metric_sample_rows + scrape_status_rows"""


@query("agg_18_ingest_baseline", f"""
with days as (
  select source_database, date_diff('day', cast(sample_day as date), date '2024-01-30') as back, {_SURGE} as n from ({_daily_sql()}) d
)
select source_database, max(if(back = 0, n, null)) as yesterday_rows, avg(if(back > 0, n, null)) as baseline_rows, count_if(back > 0) as baseline_days
from days where back <= 7 group by 1""")
def ingest_baseline(fx):
    from functools import reduce

    total = reduce(lambda a, b: a + b, [F.col(c) for c in accounting.SURGE_COUNTERS])
    return accounting.ingest_baseline(accounting.daily_ingest(_datasets(fx)), total, fx.as_of)


@query("agg_23_pass_summary", """
select collected_at, cast(sum(n) as bigint) as sample_count, cast(sum(e) as bigint) as total_errors from (
  select collected_at, count(*) as n, 0 as e from {fx_counter} group by 1 union all
  select collected_at, count(*), 0 from {fx_session} group by 1 union all
  select collected_at, 0, count(*) filter (where not success) from {fx_status} group by 1) r group by 1""")
def pass_summary(fx):
    return accounting.pass_summary({"system_counter_samples": fx.counter, "session_samples": fx.session}, fx.status)


# --- logs, retention, batches, evolution ---------------------------------------------

@query("snk_12_log_append", """
select source_database as database, coalesce(module_id, '') as "moduleId", '' as ecid, message_text as message from {fx_log}""")
def log_append(fx):
    from fleetlens.session import scratch_dir

    path = scratch_dir(fx.spark, "log")
    sinks.append_log(readers.alert_log_rows(fx.log), path, per_database=True)
    return fx.spark.read.schema(readers.LOG_SCHEMA).json(path).select("database", "moduleId", "ecid", "message")


@query("snk_13_expired_days", """
select distinct cast(collected_at as date) as day from {fx_counter}
where cast(cast(collected_at as date) + 1 as timestamp) <= timestamp '2024-01-15 14:35:12'""")
def expired_days(fx):
    days = sinks.with_day(fx.counter, "collected_at").select("day").distinct()
    return merges.expired_days(days, F.lit("2024-01-15 14:35:12").cast("timestamp"))


@query("snk_14_retain", "select seq, collected_at from {fx_status} where collected_at >= date_trunc('day', timestamp '2024-01-15 14:35:12')")
def retain(fx):
    return merges.retain(fx.status, "collected_at", F.lit("2024-01-15 14:35:12").cast("timestamp")).select("seq", "collected_at")


@query("snk_15_delete_oldest", """
select seq, collected_at from {fx_cursor} where collected_at >= timestamp '2024-01-15 00:00:00'""")
def delete_oldest(fx):
    cutoff = F.lit("2024-01-15 14:35:12").cast("timestamp")
    return merges.delete_oldest(fx.cursor, "collected_at", ["seq"], cutoff).select("seq", "collected_at")


@query("snk_16_batch_commit", """
select 'system_counter_samples' as name, count(*) as n from {fx_counter} union all
select 'session_samples', count(*) from {fx_session}""")
def batch_commit(fx):
    from fleetlens.session import scratch_dir

    root = scratch_dir(fx.spark, "batch")
    old = F.col("type") == "USER"
    sinks.commit_batch(fx.spark, root, 1, {"system_counter_samples": fx.counter, "session_samples": fx.session.where(old)})
    sinks.commit_batch(fx.spark, root, 2, {"session_samples": fx.session.where(~old)})
    # A replay of a published batch and an unpublished batch change nothing.
    sinks.commit_batch(fx.spark, root, 2, {"session_samples": fx.session})
    sinks.with_day(fx.session, "collected_at").write.partitionBy("day").parquet(f"{root}/session_samples/batch_id=3")
    return _counted(fx.spark, root, "system_counter_samples").unionByName(_counted(fx.spark, root, "session_samples"))


def _counted(spark, root, name):
    return sinks.read_table(spark, root, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")


@query("snk_17_latest_backfill", """
select ha_scope, scheduler, observed_at, seq from (
  select *, row_number() over (partition by ha_scope, scheduler order by observed_at desc, seq desc) as rn from {fx_runtime}) r where rn = 1""")
def latest_backfill(fx):
    return deltas.latest_from_history(fx.runtime, ["ha_scope", "scheduler"], "observed_at", "seq").select(
        "ha_scope", "scheduler", "observed_at", "seq")


@query("snk_18_evolve", """
select collected_at, source_database, sample_id, sample_time, session_serial_number, sql_id, 'LEGACY' as sample_source,
  cast(2000000 as bigint) as sample_duration_micro, cast(null as string) as service_name
from {fx_activity}""")
def evolve(fx):
    return merges.evolve(fx.activity, STORED["database_activity_samples"], merges.ACTIVITY_DEFAULTS).select(
        "collected_at", "source_database", "sample_id", "sample_time", "session_serial_number", "sql_id", "sample_source",
        "sample_duration_micro", "service_name")


# --- user metrics ------------------------------------------------------------------------

DEFINITION = metrics.MetricDefinition(
    context="sessions", labels=("LABEL_1", "missing"), metrics_desc={"Value_1": "first", "value_2": "second", "absent": "x"},
    metrics_type={"VALUE_1": "Counter"})
APPENDED = metrics.MetricDefinition(
    context="sessions", labels=("label_1", "label_2"), metrics_desc={"value_1": "first", "value_2": "second"},
    field_to_append="label_2")
_CONST = "concat('{{\"database\":\"', source_database, '\",\"env\":\"', case when source_database = 'db1' then 'prod' else '' end, '\",'"


def _const_labels(fx):
    configured = fx.metric_rows.select("source_database").distinct().withColumn(
        "labels", F.when(F.col("source_database") == "db1", F.create_map(F.lit("env"), F.lit("prod"))))
    return metrics.constant_labels(configured)


@query("melt_1_metric_samples", f"""
with v as (
  select *, 'value_1' as metric_name, 'first' as metric_help, 'counter' as metric_type,
    case when value_1 = '<nil>' then 0.0 else try_cast(trim(value_1) as double) end as value from {{fx_metric_rows}}
  union all
  select *, 'value_2', 'second', 'gauge', cast(value_2 as double) from {{fx_metric_rows}}
)
select collected_at, source_database, 'sessions' as context, metric_name, metric_help, metric_type, value,
  {_CONST}, '"label_1":"', label_1, '","missing":""}}}}') as labels
from v where value is not null""")
def metric_samples(fx):
    melted = metrics.melt_metrics(metrics.text_result(fx.metric_rows), DEFINITION, _const_labels(fx))
    return melted.withColumn("labels", S.labels_json(F.col("labels")))


@query("melt_1_appended_name", """
select collected_at, source_database, concat('', label_2) as metric_name, metric_help, value, concat('{{"label_1":"', label_1, '"}}') as labels from (
  select *, 'first' as metric_help, case when value_1 = '<nil>' then 0.0 else try_cast(trim(value_1) as double) end as value from {fx_metric_rows}
  union all select *, 'second', cast(value_2 as double) from {fx_metric_rows}) v
where value is not null""")
def appended_name(fx):
    melted = metrics.melt_metrics(metrics.text_result(fx.metric_rows), APPENDED)
    return melted.select("collected_at", "source_database", "metric_name", "metric_help", "value",
                         S.labels_json(F.col("labels")).alias("labels"))


@query("melt_1_rejected_values", """
select source_database, 'value_1' as metric_name, count(*) as rejected from {fx_metric_rows} where value_1 = 'junk' group by 1""")
def rejected_values(fx):
    return metrics.rejected_values(metrics.text_result(fx.metric_rows), DEFINITION)


@query("melt_2_constant_labels", """
select source_database, concat('{{"database":"', source_database, '","env":"', case when source_database = 'db1' then 'prod' else '' end, '"}}') as labels
from (select distinct source_database from {fx_metric_rows}) d""")
def constant_labels(fx):
    return _const_labels(fx).select("source_database", S.labels_json(F.col("const_labels")).alias("labels"))


@query("melt_3_duplicate_labels", """
select p_partkey, p_type in ('STANDARD', 'PROMO') or p_brand = 'Brand#3' as duplicated from {part}""")
def duplicate_labels(fx):
    const = F.array(F.lit("STANDARD"), F.lit("PROMO"), F.lit("Brand#3"))
    return fx.part.select("p_partkey", metrics.duplicate_labels(const, F.array("p_type", "p_brand")).alias("duplicated"))


@query("melt_4_zero_results", """
select distinct source_database from {fx_status} except select source_database from {fx_metric_rows}""")
def zero_results(fx):
    samples = metrics.melt_metrics(metrics.text_result(fx.metric_rows), DEFINITION)
    return metrics.zero_results(fx.status, samples, DEFINITION)


@query("pf_15_enabled_definitions", """
select p_partkey from {part} where p_size % 3 = 0 or (p_size % 3 = 1 and p_brand = 'Brand#5')""")
def enabled_definitions(fx):
    listed = F.when(F.col("p_size") % 3 == 1, F.array("p_brand")).when(F.col("p_size") % 3 == 2, F.array().cast("array<string>"))
    return metrics.enabled_for(fx.part.withColumn("databases", listed), F.lit("Brand#5")).select("p_partkey")


@query("pf_16_label_names", """
select p_partkey, case when p_size % 2 = 0 then p_brand else concat(p_brand, ',', p_type) end as labels from {part}""")
def label_names(fx):
    appended = F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.lit(""))
    names = metrics.label_names(F.array("p_brand", "p_type"), appended)
    return fx.part.select("p_partkey", F.array_join(names, ",").alias("labels"))


def _registered(fx, **views):
    for name, df in views.items():
        df.createOrReplaceTempView(name)


@query("udf_1_slow_queries", """
select cast(inst_id as string) as inst_id, quantile_disc(elapsed_time_micro, 0.95) as p95, quantile_disc(elapsed_time_micro, 0.99) as p99
from {fx_cursor} group by 1""")
def slow_queries(fx):
    _registered(fx, raw_sql=fx.cursor)
    definition = metrics.MetricDefinition(
        context="slow_queries", labels=("inst_id",), metrics_desc={"p95": "95th percentile", "p99": "99th percentile"},
        request="""select inst_id, percentile_disc(0.95) within group (order by elapsed_time_micro) as p95,
                   percentile_disc(0.99) within group (order by elapsed_time_micro) as p99 from raw_sql group by inst_id""")
    melted = metrics.run_metric(fx.spark, definition, "fleet", fx.as_of)
    return melted.groupBy(F.col("labels")["inst_id"].alias("inst_id")).agg(
        *[F.max(F.when(F.col("metric_name") == p, F.col("value"))).cast("long").alias(p) for p in ("p95", "p99")])


@query("udf_1_top_segments", """
select segment_name, cast(sum(bytes) as double) as value from {fx_segment} where segment_type = 'TABLE' group by 1
order by value desc, segment_name limit 100""")
def top_segment_metric(fx):
    _registered(fx, raw_segments=fx.segment)
    definition = metrics.MetricDefinition(
        context="size_segments_top100", labels=("segment_name",), metrics_desc={"table_bytes": "table size"},
        ignore_zero_result=True,
        request="""select segment_name, sum(bytes) as table_bytes from raw_segments where segment_type = 'TABLE'
                   group by segment_name order by table_bytes desc, segment_name limit 100""")
    return metrics.run_metric(fx.spark, definition, "fleet", fx.as_of).select(
        F.col("labels")["segment_name"].alias("segment_name"), "value")


@query("udf_1_per_database", """
select source_database, cast(inst_id as string) as inst_id, cast(count(distinct sql_id) as double) as value from {fx_cursor} group by 1, 2""")
def statements_per_database(fx):
    _registered(fx, raw_sql=fx.cursor)
    definition = metrics.MetricDefinition(
        context="statements", labels=("inst_id",), metrics_desc={"statements": "distinct statements"},
        request="select source_database, inst_id, count(distinct sql_id) as statements from raw_sql group by source_database, inst_id")
    return metrics.run_metric(fx.spark, definition, as_of=fx.as_of).select(
        "source_database", F.col("labels")["inst_id"].alias("inst_id"), "value")
