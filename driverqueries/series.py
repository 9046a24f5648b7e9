"""Deltas, windows and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from driverqueries.adapters import AS_OF
from driverqueries.registry import query
from fleetlens.operators import deltas, samples, timeline

_DELTA = """
select collected_at, source_database, inst_id, con_id, stat_name, seq, cumulative_value,
  case when prev_at < collected_at and cumulative_value >= prev_value then cumulative_value - prev_value end as delta_value,
  case when prev_at < collected_at then cast(epoch_us(collected_at) - epoch_us(prev_at) as double) / 1000000.0 end as interval_seconds,
  coalesce(prev_at < collected_at and cumulative_value < prev_value, false) as counter_reset
from (
  select *, lag(collected_at) over w as prev_at, lag(cumulative_value) over w as prev_value from {fx_counter}
  window w as (partition by source_database, inst_id, con_id, stat_name order by collected_at, seq)
) s"""
DELTA_COLUMNS = ["collected_at", "source_database", "inst_id", "con_id", "stat_name", "seq", "cumulative_value",
                 "delta_value", "interval_seconds", "counter_reset"]


@query("w_2_counter_delta", _DELTA)
def counter_delta(fx):
    return deltas.counter_delta(fx.counter).select(*DELTA_COLUMNS)


# Every second reading has no arrival number; times are whole days, so that ties are decided by it.
_NULL_SEQ = _DELTA.replace("{fx_counter}", "{fx_counter_null_seq}").replace("order by collected_at, seq)", "order by collected_at nulls first, seq nulls first)")


@query("w_2_counter_delta_null_seq", _NULL_SEQ)
def counter_delta_null_seq(fx):
    return deltas.counter_delta(fx.counter_null_seq).select(*DELTA_COLUMNS)


@query("w_2_counter_delta_hot_series", _DELTA.replace("{fx_counter}", "{fx_counter_hot}"))
def counter_delta_hot_series(fx):
    return deltas.counter_delta(fx.counter_hot, slot_seconds=900).select(*DELTA_COLUMNS)


_RATES = f"""
with d as ({_DELTA})
select *, case when interval_seconds > 0 and not counter_reset then cast(delta_value as double) / interval_seconds end as value_per_second
from d"""


@query("pf_12_counter_rates", _RATES)
def counter_rates(fx):
    return deltas.rates(deltas.counter_delta(fx.counter)).select(*DELTA_COLUMNS, "value_per_second")


@query("entry_top_series_by_rate", f"""
with r as ({_RATES[_RATES.index('with d'):].replace('with d as', 'select * from (with d as', 1)}))
select source_database, stat_name, inst_id, value_per_second, collected_at from (
  select *, row_number() over (partition by source_database order by value_per_second desc, stat_name, collected_at, seq) as rn
  from r where value_per_second is not null) t
where rn <= 5""")
def top_series(fx):
    from pyspark.sql import Window

    rates = deltas.rates(deltas.counter_delta(fx.counter)).where(F.col("value_per_second").isNotNull())
    order = Window.partitionBy("source_database").orderBy(
        F.col("value_per_second").desc(), "stat_name", "collected_at", "seq")
    return rates.withColumn("rn", F.row_number().over(order)).where("rn <= 5").select(
        "source_database", "stat_name", "inst_id", "value_per_second", "collected_at")


@query("pf_13_wait_rates", """
with waits as (
  select *, cast(round(time_waited * 10000) as bigint) as cumulative_wait_micro from {fx_wait} where wait_class <> 'Idle'
), s as (
  select *, lag(collected_at) over w as prev_at, lag(cumulative_wait_micro) over w as prev_value from waits
  window w as (partition by source_database, inst_id, con_id, wait_class order by collected_at, seq)
)
select collected_at, source_database, inst_id, con_id, wait_class, cumulative_wait_micro,
  case when prev_at < collected_at and cumulative_wait_micro >= prev_value then cumulative_wait_micro - prev_value end as delta_wait_micro,
  case when prev_at < collected_at and cumulative_wait_micro >= prev_value
    then cast(cumulative_wait_micro - prev_value as double) / (cast(epoch_us(collected_at) - epoch_us(prev_at) as double) / 1000000.0) end as wait_micro_per_second
from s""")
def wait_rates(fx):
    from fleetlens.plans.views import wait_rates

    waits = deltas.counter_delta(
        samples.wait_classes(fx.wait), ["source_database", "inst_id", "con_id", "wait_class"],
        value="cumulative_wait_micro", delta="delta_wait_micro")
    return wait_rates(waits).select("collected_at", "source_database", "inst_id", "con_id", "wait_class",
                                    "cumulative_wait_micro", "delta_wait_micro", "wait_micro_per_second")


_COUNTERS = ["elapsed_time_micro", "cpu_time_micro", "user_io_wait_micro", "executions"]
_CONSUMER = f"""
select t.collected_at, t.source_database, t.inst_id, t.sql_id, t.plan_hash_value,
  {', '.join(f"case when t.prev_at = n.before_at then greatest(t.{c} - t.prev_{c}, 0) else t.{c} end as {c}" for c in _COUNTERS)}
from (
  select *, lag(collected_at) over w as prev_at, {', '.join(f'lag({c}) over w as prev_{c}' for c in _COUNTERS)}
  from {{fx_sqlstats}}
  window w as (partition by source_database, inst_id, sql_id, plan_hash_value order by collected_at)
) t join (
  select source_database, collected_at, lag(collected_at) over (partition by source_database order by collected_at) as before_at
  from (select distinct source_database, collected_at from {{fx_sqlstats}}) x
) n on n.source_database = t.source_database and n.collected_at = t.collected_at
where n.before_at is not null"""


@query("w_3_consumer_delta", _CONSUMER)
def consumer_delta(fx):
    return deltas.consumer_delta(fx.sqlstats)


@query("t_1_top_consumers", f"""
with d as ({_CONSUMER}), totals as (
  select source_database, time_bucket(interval '6 hours', collected_at, timestamp '1970-01-01') + interval '6 hours' as taken_at, sql_id,
    {', '.join(f'cast(sum({c}) as bigint) as {c}' for c in _COUNTERS)}
  from d group by 1, 2, 3
)
select * from (
  select *, row_number() over (partition by source_database, taken_at order by elapsed_time_micro desc, cpu_time_micro desc,
    user_io_wait_micro desc, sql_id) as rank
  from totals where elapsed_time_micro > 0) r
where rank <= 5""")
def top_consumers(fx):
    return deltas.top_consumers(deltas.consumer_delta(fx.sqlstats), interval=6 * 3600, n=5)


@query("w_1_busiest_child", """
select source_database, collected_at, inst_id, sql_id, plan_hash_value, child_number, elapsed_time, seq from (
  select source_database, date_trunc('day', collected_at) as collected_at, inst_id, sql_id, plan_hash_value, child_number,
    case when seq % 9 = 0 then null else elapsed_time_micro end as elapsed_time, seq,
    row_number() over (partition by source_database, date_trunc('day', collected_at), inst_id, sql_id, plan_hash_value
      order by case when seq % 9 = 0 then null else elapsed_time_micro end desc nulls first, child_number, seq) as rn
  from {fx_cursor}) r
where rn = 1""")
def busiest_child(fx):
    rows = fx.cursor.select(
        "source_database", F.date_trunc("day", "collected_at").alias("collected_at"), "inst_id", "sql_id",
        "plan_hash_value", "child_number",
        F.when(F.col("seq") % 9 != 0, F.col("elapsed_time_micro")).alias("elapsed_time"), "seq")
    # A child appears once per snapshot; the fixture's repeats are reduced to their first row.
    first = timeline.first_per_key(
        rows, ["source_database", "collected_at", "inst_id", "sql_id", "plan_hash_value", "child_number"],
        [-F.coalesce("elapsed_time", F.lit(2**60)), F.col("seq")])
    return samples.busiest_children(first).select(
        "source_database", "collected_at", "inst_id", "sql_id", "plan_hash_value", "child_number", "elapsed_time", "seq")


@query("w_4_latest_from_history", "select * from {fx_latest_status}")
def latest_from_history(fx):
    return deltas.latest_from_history(fx.status, ["source_database", "collector"], "collected_at", "seq").drop("event_type")


@query("w_5_missed_intervals", """
select ha_scope, scheduler, observed_at, seq,
  cast(case when gap > 0 and floor(gap / (600 * 1000000.0)) > 1 then floor(gap / (600 * 1000000.0)) - 1 else 0 end as bigint) as missed_intervals
from (select *, epoch_us(observed_at) - epoch_us(lag(observed_at) over (partition by ha_scope, scheduler order by observed_at, seq)) as gap
      from {fx_runtime}) r""")
def missed_intervals(fx):
    rows = fx.runtime.drop("missed_intervals")
    return deltas.missed_intervals(rows, ["ha_scope", "scheduler"], "observed_at",
                                   F.col("configured_interval_seconds")).select(
        "ha_scope", "scheduler", "observed_at", "seq", "missed_intervals")


@query("w_6_first_n_distinct", """
select source_database, inst_id, sql_id, child_number, plan_hash_value, seq from (
  select *, row_number() over (partition by source_database order by seq) as rn from (
    select source_database, inst_id, sql_id, child_number, plan_hash_value, min(seq) as seq
    from {fx_cursor} group by 1, 2, 3, 4, 5) k) r
where rn <= 100""")
def first_n_distinct(fx):
    return deltas.first_n_distinct(fx.cursor, ["inst_id", "sql_id", "child_number", "plan_hash_value"], "seq", 100,
                                   ["source_database"])


@query("w_7_row_ordinal", """
select event_id, event_type, row_number() over (partition by event_type order by ts, event_id) as ordinal from {events}""")
def row_ordinal(fx):
    rows = fx.events.select("event_id", "event_type", F.col("ts").cast("timestamp").alias("at"))
    return deltas.with_ordinal(rows, "at", "event_id", ["event_type"]).drop("at")


@query("w_7_row_ordinal_one_hour", """
with crowded as (
  select event_id, case when event_id % 7 = 0 then null else timestamp '2024-01-01' + to_microseconds((event_id * 7919) % 3600000000) end as event_at from {events}
)
select event_id, event_at, row_number() over (order by event_at nulls first, event_id) as ordinal from crowded""")
def row_ordinal_one_hour(fx):
    at = F.when(F.col("event_id") % 7 != 0, F.timestamp_micros(F.unix_micros(F.lit("2024-01-01").cast("timestamp")) + (F.col("event_id") * 7919) % 3_600_000_000))
    return deltas.with_ordinal(fx.events.select("event_id", at.alias("event_at")), "event_at", "event_id")


def _thin_sql(source: str, keys: list[str], compare: str) -> str:
    names = ", ".join(keys)
    same = " and ".join(f"t.{k} = k.{k}" for k in keys)
    return f"""
with recursive ticks as (select distinct {names}, collected_at from {source}),
kept as (
  select {names}, min(collected_at) as collected_at from ticks group by {names}
  union all
  select {', '.join('t.' + k for k in keys)}, min(t.collected_at) from kept k join ticks t
    on {same} and t.collected_at {compare} k.collected_at + interval '3 hours'
  group by {', '.join('t.' + k for k in keys)}
)
select {names}, collected_at from kept"""


@query("st_6_thin_ticks", _thin_sql("{fx_counter}", ["source_database"], ">="))
def thin_ticks(fx):
    return timeline.thin(fx.counter, ["source_database"], "collected_at", 3 * 3600)


@query("st_6_thin_metric_ticks", _thin_sql("{fx_counter}", ["source_database", "stat_name"], ">"))
def thin_metric_ticks(fx):
    return timeline.thin(fx.counter, ["source_database", "stat_name"], "collected_at", 3 * 3600, strict=True)


@query("t_1_top_consumers_at_takes", f"""
with recursive d as ({_CONSUMER}),
ticks as (select distinct source_database, collected_at from {{fx_sqlstats}}),
takes as (
  select source_database, min(collected_at) as collected_at from ticks group by source_database
  union all
  select t.source_database, min(t.collected_at) from takes k join ticks t
    on t.source_database = k.source_database and t.collected_at >= k.collected_at + interval '5 hours'
  group by t.source_database
), assigned as (
  select d.*, (select min(collected_at) from takes k where k.source_database = d.source_database and k.collected_at >= d.collected_at) as taken_at
  from d
), totals as (
  select source_database, taken_at, sql_id, {', '.join(f'cast(sum({c}) as bigint) as {c}' for c in _COUNTERS)}
  from assigned where taken_at is not null group by 1, 2, 3
)
select * from (
  select *, row_number() over (partition by source_database, taken_at order by elapsed_time_micro desc, cpu_time_micro desc,
    user_io_wait_micro desc, sql_id) as rank
  from totals where elapsed_time_micro > 0) r
where rank <= 20""")
def top_consumers_at_takes(fx):
    takes = timeline.thin(fx.sqlstats, ["source_database"], "collected_at", 5 * 3600)
    return deltas.top_consumers(deltas.consumer_delta(fx.sqlstats), n=20, takes=takes)


_CONNECTION_FOLD = """
with recursive numbered as (
  select *, row_number() over (partition by source_database order by event_at, seq) as n from {fx_connection}
), fold as (
  select source_database, cast(0 as bigint) as n, 'STARTING' as state, cast(null as timestamp) as observed_at, cast(null as timestamp) as queued_at,
    cast(null as timestamp) as last_failure_at, cast(null as varchar) as last_failure, cast(null as timestamp) as last_probe_at,
    cast(null as double) as last_probe_duration_seconds, cast(null as varchar) as last_probe_error, cast(0 as bigint) as probe_attempts,
    cast(null as timestamp) as recovered_at
  from (select distinct source_database from {fx_connection}) d
  union all
  select f.source_database, e.n,
    case when e.kind = 'probe_start' then case when f.state = 'QUARANTINED' then 'PROBING' else f.state end
         when e.kind in ('failure', 'probe_failed') then 'QUARANTINED' else 'ACTIVE' end,
    e.event_at,
    case when e.kind = 'probe_start' then f.queued_at
         when e.kind in ('failure', 'probe_failed') then
           case when f.queued_at is null or f.state not in ('QUARANTINED', 'PROBING') then e.event_at else f.queued_at end
         else null end,
    case when e.kind in ('failure', 'probe_failed') then e.event_at else f.last_failure_at end,
    case when e.kind in ('failure', 'probe_failed') then e.message else f.last_failure end,
    case when e.kind = 'probe_start' and f.state = 'QUARANTINED' then e.event_at else f.last_probe_at end,
    case when e.kind = 'probe_start' and f.state = 'QUARANTINED' then null
         when e.kind in ('probe_failed', 'probe_ok') then e.duration_seconds else f.last_probe_duration_seconds end,
    case when e.kind = 'probe_failed' then e.message
         when e.kind in ('probe_ok', 'activate') or (e.kind = 'probe_start' and f.state = 'QUARANTINED') then null
         else f.last_probe_error end,
    case when e.kind = 'probe_start' and f.state = 'QUARANTINED' then f.probe_attempts + 1 else f.probe_attempts end,
    case when e.kind = 'probe_ok' then e.event_at else f.recovered_at end
  from fold f join numbered e on e.source_database = f.source_database and e.n = f.n + 1
)
select source_database, observed_at, state, queued_at, last_failure_at, last_failure, last_probe_at, last_probe_duration_seconds,
  last_probe_error, probe_attempts, recovered_at
from (select *, row_number() over (partition by source_database order by n desc) as rn from fold) r where rn = 1"""


@query("st_7_connection_state", _CONNECTION_FOLD)
def connection_state(fx):
    return deltas.connection_states(fx.connection)


@query("st_8_failure_backoff", f"""
select source_database, collector, consecutive_failures, last_failure_at, backoff_seconds,
  last_failure_at + backoff_seconds * interval '1 second' as retry_at,
  timestamp '{AS_OF}' >= last_failure_at + backoff_seconds * interval '1 second' as due
from (
  select source_database, collector, count(*) as consecutive_failures, max(collected_at) as last_failure_at,
    cast(least(900, 60 * power(2, least(count(*) - 1, 4))) as bigint) as backoff_seconds
  from (select *, sum(case when success then 1 else 0 end) over (partition by source_database, collector order by collected_at desc, seq desc
          rows between unbounded preceding and current row) as later_successes from {{fx_status}}) s
  where later_successes = 0 group by source_database, collector) f""")
def failure_backoff(fx):
    return deltas.failure_backoff(fx.status, fx.as_of, ["source_database", "collector"])
