"""The scheduled pass as a whole: what it derives from the landed views, and what a commit leaves."""

from __future__ import annotations

from pyspark.sql import functions as F

from driverqueries.registry import query
from fleetlens.plans import passes
from fleetlens.session import scratch_dir
from fleetlens.sources import sinks

TOP = 5

_CURSOR = """
select date_trunc('hour', collected_at) as collected_at, source_database, inst_id, sql_id, child_number, plan_hash_value,
  parsing_schema_name, module, elapsed_time_micro as elapsed_time, concat('select ', cast(seq as string)) as sql_fulltext, seq
from {fx_cursor}"""
_OUTCOME = """
select collected_at, source_database, collector, duration_seconds, sample_count, error_message, seq, seq - seq % 5 as cycle_id from {fx_status}"""

# Work of a statement between neighbouring snapshots; what the snapshot before lacks counts in full.
_TOP = f"""
with summed as (
  select source_database, collected_at, inst_id, sql_id, plan_hash_value, sum(elapsed_time) as e, sum(cpu_time) as c, sum(user_io_wait_time) as u, sum(executions) as x
  from {{fx_rawstats}} where sql_id is not null group by all
), numbered as (
  select *, dense_rank() over (partition by source_database order by collected_at) as snapshot from summed
), work as (
  select now.source_database, now.collected_at as taken_at, now.sql_id, greatest(now.e - coalesce(old.e, 0), 0) as e, greatest(now.c - coalesce(old.c, 0), 0) as c,
    greatest(now.u - coalesce(old.u, 0), 0) as u, greatest(now.x - coalesce(old.x, 0), 0) as x
  from numbered now left join numbered old on old.source_database = now.source_database and old.inst_id = now.inst_id and old.sql_id = now.sql_id
    and old.plan_hash_value = now.plan_hash_value and old.snapshot = now.snapshot - 1
  where now.snapshot > 1
), totals as (select source_database, taken_at, sql_id, sum(e) as e, sum(c) as c, sum(u) as u, sum(x) as x from work group by all)
select source_database, taken_at, sql_id, cast(e as bigint) as elapsed_time_micro, cast(x as bigint) as executions,
  row_number() over (partition by source_database, taken_at order by e desc, c desc, u desc, sql_id) as rank
from totals where e > 0 qualify rank <= {TOP}"""

_DETAILS = f"""
select * from ({_CURSOR}) c semi join ({_TOP}) t on t.source_database = c.source_database and t.taken_at = c.collected_at and t.sql_id = c.sql_id
qualify row_number() over (partition by source_database, collected_at, inst_id, sql_id, plan_hash_value order by elapsed_time desc nulls first, child_number, seq) = 1"""


def _cursor(fx):
    return fx.cursor.select(
        F.date_trunc("hour", "collected_at").alias("collected_at"), "source_database", "inst_id", "sql_id", "child_number", "plan_hash_value",
        "parsing_schema_name", "module", F.col("elapsed_time_micro").alias("elapsed_time"), F.concat(F.lit("select "), F.col("seq").cast("string")).alias("sql_fulltext"), "seq")


def _landed(fx):
    outcomes = fx.status.select("collected_at", "source_database", "collector", "duration_seconds", "sample_count", "error_message", "seq",
                                (F.col("seq") - F.col("seq") % 5).alias("cycle_id"))
    raw = {"sqlstats": fx.rawstats, "sql": _cursor(fx), "sql_plan": fx.plan.drop("event_type")}
    return raw, {"outcomes": outcomes, "cycles": fx.cycle.drop("databases_succeeded"), "n": TOP}


def _result(fx):
    raw, options = _landed(fx)
    return passes.run_pass(raw, passes.empty_state(fx.spark), fx.as_of, **options)


@query("pass_top_consumers", _TOP)
def pass_top_consumers(fx):
    return _result(fx).appended["top_consumers"].select("source_database", "taken_at", "sql_id", "elapsed_time_micro", "executions", "rank")


# Takes lie at least five hours apart; work counts for the first take at or after its snapshot.
_TOP_APART = f"""
with recursive summed as (
  select source_database, collected_at, inst_id, sql_id, plan_hash_value, sum(elapsed_time) as e, sum(cpu_time) as c, sum(user_io_wait_time) as u, sum(executions) as x
  from {{fx_rawstats}} where sql_id is not null group by all
), numbered as (
  select *, dense_rank() over (partition by source_database order by collected_at) as snapshot from summed
), takes as (
  select source_database, min(collected_at) as taken_at from summed group by 1
  union all
  select s.source_database, min(s.collected_at) from takes k join summed s
    on s.source_database = k.source_database and s.collected_at >= k.taken_at + interval '5 hours' group by 1
), work as (
  select now.source_database, (select min(taken_at) from takes k where k.source_database = now.source_database and k.taken_at >= now.collected_at) as taken_at,
    now.sql_id, greatest(now.e - coalesce(old.e, 0), 0) as e, greatest(now.c - coalesce(old.c, 0), 0) as c,
    greatest(now.u - coalesce(old.u, 0), 0) as u, greatest(now.x - coalesce(old.x, 0), 0) as x
  from numbered now left join numbered old on old.source_database = now.source_database and old.inst_id = now.inst_id and old.sql_id = now.sql_id
    and old.plan_hash_value = now.plan_hash_value and old.snapshot = now.snapshot - 1
  where now.snapshot > 1
), totals as (
  select source_database, taken_at, sql_id, sum(e) as e, sum(c) as c, sum(u) as u, sum(x) as x from work where taken_at is not null group by all
)
select source_database, taken_at, sql_id, cast(e as bigint) as elapsed_time_micro, cast(x as bigint) as executions,
  row_number() over (partition by source_database, taken_at order by e desc, c desc, u desc, sql_id) as rank
from totals where e > 0 qualify rank <= {TOP}"""


@query("pass_top_consumers_apart", _TOP_APART)
def pass_top_consumers_apart(fx):
    """Two passes share the landed snapshots; the first ends between two takes, so work is handed on as state."""
    root = scratch_dir(fx.spark, "pass-apart")
    start, end = fx.rawstats.agg(F.min("collected_at"), F.max("collected_at")).first()
    middle = start + (end - start) / 2
    cursor = _cursor(fx)
    for i, part in enumerate((F.col("collected_at") < F.lit(middle), F.col("collected_at") >= F.lit(middle))):
        raw = {"sqlstats": fx.rawstats.where(part), "sql": cursor.where(part), "sql_plan": fx.plan.drop("event_type")}
        passes.perform_pass(fx.spark, root, i, raw, fx.as_of, n=TOP, detail_interval=5 * 3600)
    return sinks.read_table(fx.spark, root, "top_consumers").select(
        "source_database", "taken_at", "sql_id", "elapsed_time_micro", "executions", "rank")


@query("pass_sql_details", f"select source_database, collected_at, inst_id, sql_id, child_number, plan_hash_value, elapsed_time from ({_DETAILS}) d")
def pass_sql_details(fx):
    return _result(fx).appended["sql_details"].select("source_database", "collected_at", "inst_id", "sql_id", "child_number", "plan_hash_value", "elapsed_time")


@query("pass_sql_texts", f"""
with referenced as (
  select source_database, sql_id, max(collected_at) as at_ from {{fx_rawstats}} where sql_id is not null group by all
), texts as (
  select source_database, sql_id, arg_max(sql_fulltext, (collected_at, seq)) as sql_fulltext, min(collected_at) as first_seen_at, max(collected_at) as last_text_seen_at
  from ({_DETAILS}) d group by all
)
select source_database, sql_id, sql_fulltext, first_seen_at, last_text_seen_at, greatest(last_text_seen_at, at_) as last_referenced_at
from texts left join referenced using (source_database, sql_id)""")
def pass_sql_texts(fx):
    return _result(fx).states["sql_texts"]


@query("pass_sql_plans", f"""
with wanted as (select distinct source_database, inst_id, sql_id, child_number, plan_hash_value from ({_DETAILS}) d where child_number is not null and plan_hash_value > 0)
select source_database, inst_id, sql_id, child_number, plan_hash_value, plan_line_id, arg_max(operation, seq) as operation
from {{fx_plan}} semi join wanted using (source_database, inst_id, sql_id, child_number, plan_hash_value) group by all""")
def pass_sql_plans(fx):
    return _result(fx).states["sql_plans"].select("source_database", "inst_id", "sql_id", "child_number", "plan_hash_value", "plan_line_id", "operation")


@query("pass_known_plans", f"""
select source_database, inst_id, sql_id, child_number, plan_hash_value from {{fx_plan}}
semi join (select * from ({_DETAILS}) d where plan_hash_value > 0) w using (source_database, inst_id, sql_id, child_number, plan_hash_value) group by all""")
def pass_known_plans(fx):
    return _result(fx).states[passes.KNOWN_PLANS]


@query("pass_latest_status", f"""
select source_database, collector, arg_max(collected_at, (collected_at, seq)) as collected_at, arg_max(error_message is null, (collected_at, seq)) as success
from ({_OUTCOME}) o group by 1, 2""")
def pass_latest_status(fx):
    return _result(fx).states["latest_scrape_status"].select("source_database", "collector", "collected_at", "success")


@query("pass_runtime_rows", f"""
select cycle_id, count(o.seq) as databases_succeeded, greatest(any_value(error_count), any_value(databases_attempted) - count(o.seq)) as error_count
from {{fx_cycle}} c left join (select * from ({_OUTCOME}) x where collector = 'scheduled' and error_message is null) o using (cycle_id) group by 1""")
def pass_runtime_rows(fx):
    return _result(fx).appended["runtime_samples"].select("cycle_id", "databases_succeeded", "error_count")


@query("pass_committed_accounting", """
with rows as (
  select source_database, date_trunc('day', collected_at) as sample_day, 1 as n, 0 as s
  from (select distinct source_database, collected_at, inst_id, sql_id, plan_hash_value from {fx_rawstats} where sql_id is not null) q
  union all select source_database, date_trunc('day', collected_at), 0, 1 from {fx_status}
)
select source_database, sample_day, cast(sum(n) as bigint) as sql_sample_rows, cast(sum(s) as bigint) as scrape_status_rows from rows group by 1, 2""")
def pass_committed_accounting(fx):
    # committed twice: the replay must not count again
    root = scratch_dir(fx.spark, "pass")
    raw, options = _landed(fx)
    for _ in range(2):
        passes.perform_pass(fx.spark, root, 1, raw, fx.as_of, **options)
    stored = sinks.read_state(fx.spark, root, "repository_daily_ingest", passes.schemas.STORED["repository_daily_ingest"])
    return stored.select("source_database", "sample_day", "sql_sample_rows", "scrape_status_rows")
