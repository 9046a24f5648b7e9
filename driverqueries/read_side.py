"""Views, dashboards, alert rules and documented joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from driverqueries.adapters import AS_OF, AS_OF_ORDERS
from driverqueries.registry import query
from driverqueries.stores import _SURGE, _daily_sql, _datasets
from fleetlens.functions import scalars as S
from fleetlens.operators import accounting, deltas, samples
from fleetlens.operators.timeline import newest_per_key
from fleetlens.plans import alerts, dashboards, relations, views

_FRESH = f"timestamp '{AS_OF_ORDERS}' - interval '1 day'"


def _latest(source: str, collector: str, bounded: bool = True) -> str:
    bound = f" and s.collected_at >= {_FRESH}" if bounded else ""
    return f"""
select s.* from {source} s join {{fx_capacity_status}} st on st.source_database = s.source_database
  and st.collector = '{collector}' and st.collected_at = s.collected_at where true{bound}"""


_LATEST_TS = _latest("{fx_tablespace}", "operational.tablespaces")
_LATEST_LIMIT = f"""
select *, case when limit_value > 0 then cast(current_value as double) * 100.0 / cast(limit_value as double) end as used_percent
from ({_latest('{fx_limit}', 'operational.resource_limits')}) l"""
_LATEST_DG = f"""
select *, case when total_bytes > 0 then cast(total_bytes - free_bytes as double) * 100.0 / cast(total_bytes as double) end as used_percent
from ({_latest('{fx_diskgroup}', 'operational.asm_diskgroups')}) g"""


def _stored(fx):
    return {"tablespace_samples": fx.tablespace, "resource_limit_samples": fx.limit,
            "asm_diskgroup_samples": fx.diskgroup, "latest_scrape_status": fx.capacity_status}


def _view(fx, name):
    return views.latest_view(name, _stored(fx), fx.as_of_orders)


@query("j_14_latest_tablespaces", _LATEST_TS)
def latest_tablespaces(fx):
    return _view(fx, "latest_tablespace_samples")


@query("j_14_latest_resource_limits", _LATEST_LIMIT)
def latest_resource_limits(fx):
    return _view(fx, "latest_resource_limit_samples")


@query("j_14_latest_diskgroups", _LATEST_DG)
def latest_diskgroups(fx):
    return _view(fx, "latest_asm_diskgroup_samples")


# Replication samples spread over the order dates, so that the latest ones can be told.
_DEST = """
select cast(o_orderdate as timestamp) as collected_at, concat('db', cast(o_custkey % 4 as string)) as source_database,
  o_custkey % 2 + 1 as inst_id, o_orderkey as dest_id, case when o_orderstatus = 'F' then 'ERROR' else 'VALID' end as status,
  case when o_custkey % 3 = 0 then null else 'remote' end as db_unique_name, 'LOG' as destination_name,
  case when o_custkey % 5 = 0 then 'ORA-16198' end as error_message, case when o_custkey % 7 = 0 then 'RESOLVABLE GAP' end as gap_status
from {orders}"""
_LAGS = """
select cast(o_orderdate as timestamp) as collected_at, concat('db', cast(o_custkey % 4 as string)) as source_database,
  max(o_totalprice / 100) as transport_lag_seconds, max(case when o_orderstatus = 'O' then o_totalprice / 50 end) as apply_lag_seconds,
  cast(null as double) as datum_age_seconds
from {orders} group by 1, 2"""
_PROCS = """
select cast(o_orderdate as timestamp) as collected_at, concat('db', cast(o_custkey % 4 as string)) as source_database,
  o_custkey % 2 + 1 as inst_id, count(*) filter (where o_orderstatus = 'F') as apply_processes
from {orders} group by 1, 2, 3"""


def _from_orders(fx, text):
    return fx.spark.sql(text, orders=fx.orders)


@query("j_14_latest_destinations", _latest(f"({_DEST})", "operational.dataguard"))
def latest_destinations(fx):
    return views.latest_view("latest_dataguard_destination_samples",
                             {"dataguard_destination_samples": _from_orders(fx, _DEST),
                              "latest_scrape_status": fx.capacity_status}, fx.as_of_orders)


@query("j_14_latest_lag", _latest(f"({_LAGS})", "operational.dataguard"))
def latest_lag(fx):
    return views.latest_view("latest_dataguard_lag_samples",
                             {"dataguard_lag_samples": _from_orders(fx, _LAGS),
                              "latest_scrape_status": fx.capacity_status}, fx.as_of_orders)


@query("j_14_latest_processes", _latest(f"({_PROCS})", "operational.dataguard"))
def latest_processes(fx):
    return views.latest_view("latest_dataguard_process_samples",
                             {"dataguard_process_samples": _from_orders(fx, _PROCS),
                              "latest_scrape_status": fx.capacity_status}, fx.as_of_orders)


# --- dashboards ----------------------------------------------------------------------

_AGE = f"cast(epoch_us(timestamp '{AS_OF}') - epoch_us(collected_at) as double) / 1000000.0"


@query("d_1_collector_health", f"""
select source_database, collector, success, collected_at as last_collection, {_AGE} as data_age_seconds,
  cast(round(cast(duration_seconds as decimal(38, 12)), 3) as double) as duration_seconds, sample_count, error_message
from {{fx_latest_status}}""")
def collector_health(fx):
    return dashboards.collector_health(fx.latest_status, fx.as_of)


@query("t_6_collector_order", f"""
select source_database, collector, data_age_seconds,
  row_number() over (order by success asc nulls last, data_age_seconds desc nulls first, source_database asc nulls last, collector asc nulls last) as position
from (
  select source_database, collector, case when collector <> 'view' then success end as success, {_AGE} as data_age_seconds from (
    select source_database, collector, success, case when success then collected_at end as collected_at from {{fx_latest_status}}) r) t""")
def collector_order(fx):
    partly = fx.latest_status.withColumns({
        "collected_at": F.when(F.col("success"), F.col("collected_at")), "success": F.when(F.col("collector") != "view", F.col("success"))})
    return dashboards.positioned(dashboards.collector_health(partly, fx.as_of), dashboards.health_order()).select(
        "source_database", "collector", "data_age_seconds", "position")


@query("d_2_failed_collectors", f"""
select source_database, collector, case when not success then 'FAILED' else 'STALE' end as state, collected_at as last_collection,
  {_AGE} as data_age_seconds, error_message
from {{fx_latest_status}} where not success or collected_at < timestamp '{AS_OF}' - interval '3 minutes'""")
def failed_collectors(fx):
    return dashboards.failed_collectors(fx.latest_status, fx.as_of)


# The dashboard reads the latest views; here every snapshot counts as one, to have rows to judge.
_FULL = "cast({used} as double) * 100.0 / cast(nullif(greatest({room}, 0), 0) as double)"
# Every kind of capacity as one long relation; a table of thresholds says which rows count.
_CAPACITY = f"""
select source_database, 'Tablespace maximum' as category, tablespace_name as object_name, cast(null as bigint) as instance, used_percent as share
from {{fx_tablespace}}
union all
select source_database, 'Tablespace allocation', tablespace_name, null, {_FULL.format(used='used_bytes', room='allocated_bytes')} from {{fx_tablespace}}
union all
select source_database, 'Resource limit', resource_name, inst_id, {_FULL.format(used='current_value', room='limit_value')} from {{fx_limit}}
where not limit_unlimited
union all
select string_agg(source_database, ', ' order by source_database), 'ASM diskgroup', diskgroup_name, inst_id,
  {_FULL.format(used='any_value(total_bytes - free_bytes)', room='any_value(total_bytes)')}
from {{fx_diskgroup}} group by diskgroup_name, inst_id, total_bytes, free_bytes, usable_bytes"""


@query("d_3_capacity_risks", f"""
with thresholds(category, watched_from, alert_threshold) as (
  values ('Tablespace maximum', 80.0::double, 90.0::double), ('Tablespace allocation', 85.0, 95.0), ('Resource limit', 75.0, 85.0), ('ASM diskgroup', 80.0, 90.0))
select source_database, category, object_name, cast(instance as string) as inst_id,
  cast(round(cast(share as decimal(38, 12)), 2) as double) as used_percent, alert_threshold,
  if(share > alert_threshold, 'ALERT THRESHOLD', 'WATCH') as state
from ({_CAPACITY}) c join thresholds using (category) where share >= watched_from""")
def capacity_risks(fx):
    return dashboards.capacity_risks(
        fx.tablespace, views.with_used_percent(fx.limit), views.with_used_percent(fx.diskgroup))


_LATEST_CAPACITY = (_CAPACITY.replace("{fx_tablespace}", f"({_LATEST_TS}) t").replace("from {fx_limit}", f"from ({_LATEST_LIMIT}) m")
                    .replace("from {fx_diskgroup}", f"from ({_LATEST_DG}) x"))


@query("d_3_latest_capacity_risks", f"""
with thresholds(category, watched_from, alert_threshold) as (
  values ('Tablespace maximum', 80.0::double, 90.0::double), ('Tablespace allocation', 85.0, 95.0), ('Resource limit', 75.0, 85.0), ('ASM diskgroup', 80.0, 90.0))
select category, object_name, count(*) as n, max(share > alert_threshold) as alerting
from ({_LATEST_CAPACITY}) c join thresholds using (category) where share >= watched_from group by 1, 2""")
def latest_capacity_risks(fx):
    risks = dashboards.capacity_risks(_view(fx, "latest_tablespace_samples"), _view(fx, "latest_resource_limit_samples"), _view(fx, "latest_asm_diskgroup_samples"))
    return risks.groupBy("category", "object_name").agg(F.count("*").alias("n"), F.max(F.col("state") == "ALERT THRESHOLD").alias("alerting"))


_STATE_STATUS = """
select source_database, 'operational.database_status' as collector, max(collected_at) as collected_at from {fx_instance} group by 1"""


@query("d_4_instance_state", f"""
select s.source_database, s.db_unique_name, s.dbid, s.database_role, s.protection_mode, s.protection_level, s.inst_id, i.instance_name,
  i.status as instance_status, i.database_status, s.open_mode, i.startup_time, s.collected_at as last_observation
from {{fx_database}} s join {{fx_instance}} i on i.source_database = s.source_database and i.collected_at = s.collected_at and i.inst_id = s.inst_id
join ({_STATE_STATUS}) st on st.source_database = s.source_database and st.collected_at = s.collected_at""")
def instance_state(fx):
    status = samples.database_status(fx.instance, fx.database, fx.product).drop("database_version_full")
    latest = fx.instance.groupBy("source_database").agg(F.max("collected_at").alias("collected_at")).withColumn(
        "collector", F.lit("operational.database_status"))
    return dashboards.instance_state(status, latest)


_PRESSURE_STATUS = "select source_database, max(collected_at) as collected_at from {fx_session} where source_database <> 'db2' group by 1"


def _rounded(value, digits):
    return f"cast(round(cast({value} as decimal(38, 12)), {digits}) as double)"


@query("d_5_cpu_pga_pressure", f"""
with latest as ({_PRESSURE_STATUS}), totals as (
  select source_database, map_from_entries(list((name, total))) as of
  from (select source_database, name, sum(try_cast(value as bigint))::double as total
        from {{fx_parameter}} semi join latest using (source_database, collected_at) group by 1, 2) p
  group by 1
), named as (
  select source_database, of['cpu_count'] as cpus, of['sga_max_size'] as held, of['other'] as peak, of['pga_aggregate_limit'] as bound from totals
), busy as (
  select c.source_database, sum(cumulative_value::double * 1000) / 1000000.0 as cores
  from {{fx_counter}} c join latest l on c.source_database = l.source_database and date_trunc('day', c.collected_at) = l.collected_at
  where stat_name = 'click' group by 1
)
select source_database, {_rounded('cores', 2)} as db_cpu_cores, cpus as cpu_capacity, {_rounded('cores * 100.0 / nullif(cpus, 0)', 1)} as cpu_used_percent,
  held as pga_allocated_bytes, peak as pga_peak_bytes, bound as pga_limit_bytes, {_rounded('held * 100.0 / nullif(bound, 0)', 1)} as pga_current_percent,
  {_rounded('peak * 100.0 / nullif(bound, 0)', 1)} as pga_peak_percent
from named left join busy using (source_database)""")
def cpu_pga_pressure(fx):
    number = F.col("value").cast("long")
    named = {"cpu_count": "cpu_count", "sga_max_size": "pga_allocated_bytes", "other": "pga_max_allocated_bytes",
             "pga_aggregate_limit": "pga_aggregate_limit"}
    instances = fx.parameter.select("source_database", "collected_at", "inst_id", *[
        F.when(F.col("name") == name, number).alias(out) for name, out in named.items()])
    rates = fx.counter.select(
        "source_database", F.date_trunc("day", "collected_at").alias("collected_at"), "con_id",
        F.when(F.col("stat_name") == "click", "DB CPU").otherwise(F.col("stat_name")).alias("stat_name"),
        (F.col("cumulative_value").cast("double") * 1000).alias("value_per_second"))
    latest = fx.session.where("source_database <> 'db2'").groupBy("source_database").agg(
        F.max("collected_at").alias("collected_at"))
    both = latest.withColumn("collector", F.lit("operational.instance")).unionByName(
        latest.withColumn("collector", F.lit("operational.cpu_io_counters")))
    return dashboards.cpu_pga_pressure(instances, rates, both)


@query("j_20_agg_19_fleet_capacity", f"""
with latest as ({_PRESSURE_STATUS})
select source_database, cast(count(*) * 4 as double) as cpu_capacity, cast(sum(user_id) as double) as pga_limit_bytes
from {{fx_session}} semi join latest using (source_database, collected_at) group by 1""")
def fleet_capacity(fx):
    instances = fx.session.select(
        "source_database", "collected_at", "inst_id", F.lit(4).cast("bigint").alias("cpu_count"), F.lit(None).cast("bigint").alias("pga_allocated_bytes"),
        F.lit(None).cast("bigint").alias("pga_max_allocated_bytes"), F.col("user_id").alias("pga_aggregate_limit"))
    latest = fx.session.where("source_database <> 'db2'").groupBy("source_database").agg(F.max("collected_at").alias("collected_at"))
    both = latest.withColumn("collector", F.lit("operational.instance")).unionByName(
        latest.withColumn("collector", F.lit("operational.cpu_io_counters")))
    rates = fx.counter.select("source_database", "collected_at", "con_id", "stat_name", F.col("cumulative_value").cast("double").alias("value_per_second"))
    return dashboards.cpu_pga_pressure(instances, rates, both).select("source_database", "cpu_capacity", "pga_limit_bytes")


# --- alert values ---------------------------------------------------------------------

def _values(fx, rule_id, tables, as_of, *labels):
    values = alerts.rule_values(rule_id, tables, as_of)
    return values.select(*[F.col("labels")[name].alias(name) for name in labels], "value")


@query("a_1_data_age", f"select source_database, {_AGE} as value from {{fx_latest_status}} where collector = 'connectivity'")
def data_age(fx):
    return _values(fx, "A-1", {"latest_scrape_status": fx.latest_status}, fx.as_of, "source_database")


@query("a_2_connectivity", """
select source_database, cast(case when success then 0 else 1 end as double) as value from {fx_latest_status} where collector = 'connectivity'""")
def connectivity(fx):
    return _values(fx, "A-2", {"latest_scrape_status": fx.latest_status}, fx.as_of, "source_database")


@query("a_3_tablespace_pressure", "select source_database, tablespace_name, used_percent as value from {fx_tablespace}")
def tablespace_pressure(fx):
    return _values(fx, "A-3", {"latest_tablespace_samples": fx.tablespace}, fx.as_of, "source_database", "tablespace_name")


@query("a_4_resource_pressure", """
select source_database, resource_name, cast(inst_id as string) as inst_id, cast(current_value as double) * 100.0 / cast(limit_value as double) as value
from {fx_limit} where not limit_unlimited and limit_value > 0""")
def resource_pressure(fx):
    tables = {"latest_resource_limit_samples": views.with_used_percent(fx.limit)}
    return _values(fx, "A-4", tables, fx.as_of, "source_database", "resource_name", "inst_id")


@query("a_5_diskgroup_pressure", """
with dg as (select *, case when total_bytes > 0 then cast(total_bytes - free_bytes as double) * 100.0 / cast(total_bytes as double) end as used_percent from {fx_diskgroup})
select string_agg(source_database, ', ' order by source_database) as source_database, diskgroup_name, used_percent as value
from dg group by diskgroup_name, inst_id, total_bytes, free_bytes, usable_bytes, used_percent""")
def diskgroup_pressure(fx):
    tables = {"latest_asm_diskgroup_samples": views.with_used_percent(fx.diskgroup)}
    return _values(fx, "A-5", tables, fx.as_of, "source_database", "diskgroup_name")


@query("a_3_latest_tablespace_pressure", f"select source_database, tablespace_name, used_percent as value from ({_LATEST_TS}) t")
def latest_tablespace_pressure(fx):
    return _values(fx, "A-3", {"latest_tablespace_samples": _view(fx, "latest_tablespace_samples")}, fx.as_of, "source_database", "tablespace_name")


@query("a_4_latest_resource_pressure", f"""
select source_database, resource_name, cast(inst_id as string) as inst_id, used_percent as value from ({_LATEST_LIMIT}) l where not limit_unlimited and limit_value > 0""")
def latest_resource_pressure(fx):
    return _values(fx, "A-4", {"latest_resource_limit_samples": _view(fx, "latest_resource_limit_samples")}, fx.as_of, "source_database", "resource_name", "inst_id")


@query("a_5_latest_diskgroup_pressure", f"""
select diskgroup_name, used_percent as value, count(*) as n from (
  select diskgroup_name, used_percent from ({_LATEST_DG}) g group by diskgroup_name, inst_id, total_bytes, free_bytes, usable_bytes, used_percent) x group by 1, 2""")
def latest_diskgroup_pressure(fx):
    rows = _values(fx, "A-5", {"latest_asm_diskgroup_samples": _view(fx, "latest_asm_diskgroup_samples")}, fx.as_of, "diskgroup_name")
    return rows.groupBy("diskgroup_name", "value").agg(F.count("*").alias("n"))


def _from_latest(fx, name, text):
    view = f"latest_{name}"
    return {view: views.latest_view(view, {name: _from_orders(fx, text), "latest_scrape_status": fx.capacity_status}, fx.as_of_orders)}


@query("a_13_latest_destination_health", f"""
select source_database, cast(inst_id as string) as inst_id, cast(dest_id as string) as dest_id,
  if(list_contains(['ERROR', 'DISABLED', 'BAD PARAM', 'FULL'], upper(status)) or length(error_message) > 0 or gap_status <> 'NO GAP', 1.0, 0.0)::double as value
from ({_latest(f"({_DEST})", 'operational.dataguard')}) d""")
def latest_destination_health(fx):
    return _values(fx, "A-13", _from_latest(fx, "dataguard_destination_samples", _DEST), fx.as_of, "source_database", "inst_id", "dest_id")


@query("a_14_latest_replication_delay", f"""
select source_database, greatest(transport_lag_seconds, apply_lag_seconds, datum_age_seconds, 0) as value from ({_latest(f"({_LAGS})", 'operational.dataguard')}) l""")
def latest_replication_delay(fx):
    return _values(fx, "A-14", _from_latest(fx, "dataguard_lag_samples", _LAGS), fx.as_of, "source_database")


@query("a_15_latest_apply_stopped", f"""
select source_database, if(bool_or(apply_processes > 0), 0.0, 1.0)::double as value from ({_latest(f"({_PROCS})", 'operational.dataguard')}) p group by 1""")
def latest_apply_stopped(fx):
    return _values(fx, "A-15", _from_latest(fx, "dataguard_process_samples", _PROCS), fx.as_of, "source_database")


def _ingest_tables(fx):
    daily = accounting.daily_ingest(_datasets(fx)).withColumn("last_flushed_at", F.col("last_sample_at"))
    return {"latest_scrape_status": fx.latest_status, "repository_daily_ingest": daily}


_CONFIGURED = "select source_database from {fx_latest_status} where collector = 'scheduled'"


@query("a_6_accounting_age", f"""
select c.source_database, coalesce(cast(epoch_us(timestamp '{AS_OF}') - epoch_us(d.flushed) as double) / 1000000.0, 1000000000.0) as value
from ({_CONFIGURED}) c left join (select source_database, max(last_sample_at) as flushed from ({_daily_sql()}) d group by 1) d using (source_database)""")
def accounting_age(fx):
    return _values(fx, "A-6", _ingest_tables(fx), fx.as_of, "source_database")


def _baseline(value, condition):
    # Days count back from yesterday: 0 is yesterday, 1 to 7 the week before it.
    return f"""
with days as (
  select source_database, date_diff('day', cast(sample_day as date), date '2024-01-30') as back, {value} as n from ({_daily_sql()}) d
), judged as (
  select source_database, max(n) filter (where back = 0) as last_day, avg(n) filter (where back > 0) as usual, count(*) filter (where back > 0) as known
  from days where back between 0 and 7 group by 1
)
select source_database, if(known >= 4 and ({condition}), 1.0, 0.0)::double as value from ({_CONFIGURED}) c left join judged using (source_database)"""


@query("a_7_ingest_drop", _baseline("sql_sample_rows", "usual >= 1000 and 5 * coalesce(last_day, 0) < usual"))
def ingest_drop(fx):
    return _values(fx, "A-7", _ingest_tables(fx), fx.as_of, "source_database")


@query("a_8_ingest_surge", _baseline(_SURGE, "usual >= 10000 and last_day > 3 * usual"))
def ingest_surge(fx):
    return _values(fx, "A-8", _ingest_tables(fx), fx.as_of, "source_database")


def _runtime_tables(fx):
    runtime = fx.latest_runtime.withColumn("scheduler", F.when(F.col("scheduler") == "click", "activity").otherwise(
        F.col("scheduler")))
    latest = newest_per_key(fx.status.drop("event_type"), ["source_database", "collector"], ["collected_at", "seq"])
    return {"latest_runtime_status": runtime, "runtime_samples": fx.runtime, "latest_scrape_status": latest}


@query("a_9_activity_timeout", """
with r as (
  select configured_query_timeout_seconds as t from {fx_latest_runtime} where scheduler = 'click' and observed_at >= timestamp '2024-01-30 12:00:00' - interval '3 minutes'
  order by observed_at desc limit 1
)
select source_database, duration_seconds * 100.0 / nullif(t, 0) as value from {fx_latest_status} cross join r
where collector = 'activity' and collected_at >= timestamp '2024-01-30 12:00:00' - interval '3 minutes' and success""")
def activity_timeout(fx):
    noon = F.lit("2024-01-30 12:00:00").cast("timestamp")
    return _values(fx, "A-9", _runtime_tables(fx), noon, "source_database")


@query("t_4_latest_runtime_row", """
with newest as (select arg_max(configured_query_timeout_seconds, observed_at) as bound from {fx_runtime} where scheduler = 'click')
select source_database, duration_seconds * 100.0 / nullif(bound, 0) as value from {fx_latest_status}, newest
where collector = 'activity' and success and collected_at >= timestamp '2024-01-30 12:00:00'""")
def latest_runtime_row(fx):
    # all runtime rows are offered; the rule has to take the newest
    tables = _runtime_tables(fx)
    tables["latest_runtime_status"] = fx.runtime.withColumn("scheduler", F.when(F.col("scheduler") == "click", "activity").otherwise(F.col("scheduler"))).withColumn(
        "observed_at", F.col("observed_at") + F.expr("interval 1 day"))
    return _values(fx, "A-9", tables, F.lit("2024-01-30 12:03:00").cast("timestamp"), "source_database")


@query("j_19_status_with_runtime_row", """
select source_database, cast(null as double) as value from {fx_latest_status}
where collector = 'activity' and success and collected_at >= timestamp '2024-01-30 12:00:00'""")
def status_with_runtime_row(fx):
    # a runtime row without a timeout keeps the status rows; its share is unknown
    tables = _runtime_tables(fx)
    tables["latest_runtime_status"] = fx.runtime.select(
        F.lit("activity").alias("scheduler"), (F.col("observed_at") + F.expr("interval 1 day")).alias("observed_at"),
        F.lit(0.0).alias("configured_query_timeout_seconds"))
    return _values(fx, "A-9", tables, F.lit("2024-01-30 12:03:00").cast("timestamp"), "source_database")


@query("j_21_status_at_last_attempt", f"""
select d.source_database, d.collected_at, d.inst_id, d.dbid from {{fx_database}} d join ({_STATE_STATUS}) st
  on st.source_database = d.source_database and st.collected_at = d.collected_at""")
def status_at_last_attempt(fx):
    latest = fx.instance.groupBy("source_database").agg(F.max("collected_at").alias("collected_at")).withColumn(
        "collector", F.lit("operational.database_status"))
    return views.latest_snapshot(fx.database, latest, "operational.database_status").select(
        "source_database", "collected_at", "inst_id", "dbid")


def _share(duration):
    return f"""
select ha_scope, case when scheduler = 'click' then 'activity' else scheduler end as scheduler,
  {duration} * 100.0 / nullif(configured_interval_seconds, 0) as value
from {{fx_latest_runtime}} where write_success and observed_at >= timestamp '2024-01-30 12:00:00' - interval '3 minutes'"""


@query("a_10_cycle_pressure", _share("total_duration_seconds"))
def cycle_pressure(fx):
    noon = F.lit("2024-01-30 12:00:00").cast("timestamp")
    return _values(fx, "A-10", _runtime_tables(fx), noon, "ha_scope", "scheduler")


@query("a_11_write_pressure", _share("write_duration_seconds"))
def write_pressure(fx):
    noon = F.lit("2024-01-30 12:00:00").cast("timestamp")
    return _values(fx, "A-11", _runtime_tables(fx), noon, "ha_scope", "scheduler")


@query("a_12_agg_20_scheduler_delay", """
select ha_scope, scheduler, max(greatest(scheduling_lag_seconds * 100.0 / nullif(configured_interval_seconds, 0), case when missed_intervals > 0 then 100.0 else 0.0 end)) as value
from {fx_runtime} where observed_at >= timestamp '2024-01-30 12:00:00' - interval '5 minutes' group by 1, 2""")
def scheduler_delay(fx):
    noon = F.lit("2024-01-30 12:00:00").cast("timestamp")
    return _values(fx, "A-12", _runtime_tables(fx), noon, "ha_scope", "scheduler")


@query("a_13_destination_health", f"""
select source_database, cast(inst_id as string) as inst_id, cast(dest_id as string) as dest_id, coalesce(db_unique_name, destination_name, 'unknown') as remote_database,
  cast(case when upper(coalesce(status, '')) in ('ERROR', 'DISABLED', 'BAD PARAM', 'FULL') or coalesce(error_message, '') <> ''
    or upper(coalesce(gap_status, 'NO GAP')) <> 'NO GAP' then 1 else 0 end as double) as value
from ({_DEST}) d""")
def destination_health(fx):
    tables = {"latest_dataguard_destination_samples": _from_orders(fx, _DEST)}
    return _values(fx, "A-13", tables, fx.as_of, "source_database", "inst_id", "dest_id", "remote_database")


@query("a_14_replication_delay", f"""
select source_database, greatest(coalesce(transport_lag_seconds, 0), coalesce(apply_lag_seconds, 0), coalesce(datum_age_seconds, 0)) as value
from ({_LAGS}) l""")
def replication_delay(fx):
    return _values(fx, "A-14", {"latest_dataguard_lag_samples": _from_orders(fx, _LAGS)}, fx.as_of, "source_database")


@query("a_15_agg_21_apply_stopped", f"""
select source_database, cast(case when sum(apply_processes) > 0 then 0 else 1 end as double) as value from ({_PROCS}) p group by 1""")
def apply_stopped(fx):
    return _values(fx, "A-15", {"latest_dataguard_process_samples": _from_orders(fx, _PROCS)}, fx.as_of, "source_database")


@query("agg_22_last_flush", f"""
with flushed as (select source_database, max(last_sample_at) as flushed_at from ({_daily_sql()}) d group by 1)
select source_database, coalesce(cast(epoch_us(timestamp '2024-02-02 00:00:00') - epoch_us(flushed_at) as double) / 1000000.0, 1000000000.0) as value
from ({_CONFIGURED}) c left join flushed using (source_database)""")
def last_flush(fx):
    return _values(fx, "A-6", _ingest_tables(fx), F.lit("2024-02-02 00:00:00").cast("timestamp"), "source_database")


@query("j_18_configured_databases", f"""
select source_database, 1000000000.0::double as value from ({_CONFIGURED}) c""")
def configured_databases(fx):
    # no accounting at all: every configured database is still reported
    tables = {**_ingest_tables(fx), "repository_daily_ingest": fx.status.select(
        F.concat("source_database", F.lit(" elsewhere")).alias("source_database"), F.col("collected_at").alias("last_flushed_at"))}
    return _values(fx, "A-6", tables, fx.as_of, "source_database")


_PENDING = """
with h as (
  select rule_id, source_database, as_of, value > 20 as breached from {fx_evaluation}
), r as (
  select *, max(case when not breached then as_of end) over (partition by rule_id, source_database) as reset_at from h
)
select rule_id, source_database, min(as_of) as pending_since, max(as_of) as last_evaluated_at,
  epoch_us(max(as_of)) - epoch_us(min(as_of)) >= cast(7200 as bigint) * 1000000 as firing
from r where breached and (reset_at is null or as_of > reset_at) group by 1, 2"""


@query("st_10_pending_alerts", _PENDING)
def pending_alerts(fx):
    history = fx.evaluation.select(
        "rule_id", F.create_map(F.lit("source_database"), F.col("source_database")).alias("labels"), "as_of",
        (F.col("value") > 20).alias("breached"), F.lit(7200).alias("hold_seconds"))
    return alerts.pending(history, fx.as_of).select(
        "rule_id", S.parse_labels(F.col("labels_key"))["source_database"].alias("source_database"), "pending_since",
        "last_evaluated_at", "firing")


_EVALUATED = """
with rules(rule_id, threshold, hold, no_data) as (
  select event_type, avg(value), case when event_type = 'error' then 3600 else 10800 end, 'OK' from {events} group by 1, 3, 4
  union all select concat('silent_', r_name), 1.0, 60, case when r_regionkey % 2 = 0 then 'Alerting' else 'OK' end from {region}
), last as (
  select max(as_of) as at_ from {fx_evaluation}
), h as (
  select e.*, r.hold, coalesce(e.value > r.threshold, false) as breached from {fx_evaluation} e join rules r using (rule_id)
), resets as (
  select *, max(case when not breached then as_of end) over (partition by rule_id, source_database) as reset_at from h
), pend as (
  select rule_id, source_database, min(as_of) as since, epoch_us(max(as_of)) - epoch_us(min(as_of)) >= max(hold) * cast(1000000 as bigint) as firing
  from resets where breached and (reset_at is null or as_of > reset_at) group by 1, 2
), cur as (
  select h.* from h, last where as_of = at_
)
select c.rule_id, concat('{{"source_database":"', c.source_database, '"}}') as labels_key, c.value, c.breached,
  case when c.breached then p.since end as pending_since, c.breached and coalesce(p.firing, false) as firing, cast(null as string) as no_data_state
from cur c left join pend p on p.rule_id = c.rule_id and p.source_database = c.source_database
union all
select rule_id, null, null, false, null, no_data = 'Alerting', no_data from rules where rule_id not in (select rule_id from cur)"""


@query("a_16_evaluate_rules", _EVALUATED)
def evaluate_rules(fx):
    rules, values, earlier = _evaluation(fx)
    return alerts.evaluate_rules(values, rules, fx.as_of, earlier).drop("severity")


@query("a_16_evaluate_from_state", _EVALUATED)
def evaluate_from_state(fx):
    rules, values, earlier = _evaluation(fx)
    state = alerts.pending(alerts.breaches(earlier, rules), fx.as_of)
    return alerts.evaluate_step(values, rules, state)[0].drop("severity")


def _evaluation(fx):
    """Rules, the newest values and the evaluations before."""
    rules = fx.events.groupBy(F.col("event_type").alias("rule_id")).agg(F.avg("value").alias("threshold")).select(
        "rule_id", "threshold", F.when(F.col("rule_id") == "error", 3600).otherwise(10800).cast("long").alias("hold_seconds"),
        F.lit("OK").alias("no_data"), F.lit("warning").alias("severity"))
    silent = fx.region.select(
        F.concat(F.lit("silent_"), "r_name").alias("rule_id"), F.lit(1.0).alias("threshold"), F.lit(60).cast("long").alias("hold_seconds"),
        F.when(F.col("r_regionkey") % 2 == 0, "Alerting").otherwise("OK").alias("no_data"), F.lit("warning").alias("severity"))
    history = fx.evaluation.select(
        "rule_id", F.create_map(F.lit("source_database"), F.col("source_database")).alias("labels"), "value", "as_of")
    last = history.agg(F.max("as_of")).scalar()
    values = history.withColumn("_last", last).where(F.col("as_of") == F.col("_last")).drop("_last")
    return rules.unionByName(silent), values, history.withColumn("_last", last).where(F.col("as_of") < F.col("_last")).drop("_last")


# --- documented joins --------------------------------------------------------------------

# Stored tables of the join queries: (DuckDB text, Spark frame).
_TABLES = {
    "session_samples": ("select * from {fx_session}", lambda fx: fx.session),
    "sql_samples": ("""
select source_database, date_trunc('day', collected_at) as collected_at, sql_id, child_number, min(inst_id) as inst_id,
  min(plan_hash_value) as plan_hash_value, count(*) as executions from {fx_cursor} group by 1, 2, 3, 4""",
                    lambda fx: fx.cursor.groupBy(
                        "source_database", F.date_trunc("day", "collected_at").alias("collected_at"), "sql_id", "child_number").agg(
                        F.min("inst_id").alias("inst_id"), F.min("plan_hash_value").alias("plan_hash_value"),
                        F.count("*").alias("executions"))),
    "blocking_session_samples": ("""
select source_database, collected_at, inst_id, sid, serial_number, sql_id, prev_sql_id as blocking_sql_id, blocking_session
from {fx_session} where blocking_session is not null""",
                                 lambda fx: fx.session.where("blocking_session is not null").select(
                                     "source_database", "collected_at", "inst_id", "sid", "serial_number", "sql_id",
                                     F.col("prev_sql_id").alias("blocking_sql_id"), "blocking_session")),
    "database_activity_samples": ("""
select source_database, date_trunc('day', collected_at) as collected_at, inst_id, sample_id, sample_id as session_id, session_id as session_serial_number,
  sql_id, top_level_sql_id, sql_child_number, sql_plan_hash_value, sql_plan_line_id from {fx_activity}""",
                                  lambda fx: fx.activity.select(
                                      "source_database", F.date_trunc("day", "collected_at").alias("collected_at"), "inst_id",
                                      "sample_id", F.col("sample_id").alias("session_id"),
                                      F.col("session_id").alias("session_serial_number"), "sql_id", "top_level_sql_id",
                                      "sql_child_number", "sql_plan_hash_value", "sql_plan_line_id")),
    "sql_plans": ("""
select source_database, inst_id, sql_id, child_number, plan_hash_value, plan_line_id, max(operation) as operation from {fx_plan} group by all""",
                  lambda fx: fx.plan.groupBy("source_database", "inst_id", "sql_id", "child_number", "plan_hash_value",
                                             "plan_line_id").agg(F.max("operation").alias("operation"))),
    "sql_texts": ("select source_database, sql_id, max(sql_fulltext) as sql_fulltext from {fx_text} group by 1, 2",
                  lambda fx: fx.text.groupBy("source_database", "sql_id").agg(F.max("sql_fulltext").alias("sql_fulltext"))),
    "sql_cursor_metadata": ("""
select source_database, inst_id, sql_id, child_number, plan_hash_value, max(module) as module, max(parsing_schema_name) as parsing_schema_name
from {fx_cursor} group by all""",
                            lambda fx: fx.cursor.groupBy("source_database", "inst_id", "sql_id", "child_number", "plan_hash_value").agg(
                                F.max("module").alias("module"), F.max("parsing_schema_name").alias("parsing_schema_name"))),
    "instance_samples": ("select source_database, collected_at, inst_id, instance_name from {fx_instance}",
                         lambda fx: fx.instance.select("source_database", "collected_at", "inst_id", "instance_name")),
    "database_status_samples": ("select source_database, collected_at, inst_id, dbid, database_role from {fx_database}",
                                lambda fx: fx.database.select("source_database", "collected_at", "inst_id", "dbid", "database_role")),
}


def _daily(source, inst="inst_id", extra="seq"):
    text = f"select source_database, date_trunc('day', collected_at) as collected_at, {inst}, {extra} from {{{source}}}"
    return text, lambda fx: getattr(fx, source.removeprefix("fx_")).select(
        "source_database", F.date_trunc("day", "collected_at").alias("collected_at"), inst, extra)


_TABLES.update({
    "resource_limit_samples": _daily("fx_rawlimit"), "asm_diskgroup_samples": _daily("fx_rawlimit"),
    "system_counter_samples": _daily("fx_counter"), "wait_class_samples": _daily("fx_wait"),
    "system_metric_samples": _daily("fx_sysmetric"), "dataguard_destination_samples": _daily("fx_counter"),
    "dataguard_process_samples": _daily("fx_counter"), "dataguard_lag_samples": _daily("fx_counter"),
    "scrape_status": _daily("fx_status", "collector"),
})
# The status of a database where a relation names no instance: one row per snapshot.
_DATABASE_LEVEL = ("""
select source_database, collected_at, max(dbid) as dbid, max(database_role) as database_role from {fx_database} group by 1, 2""",
                   lambda fx: fx.database.groupBy("source_database", "collected_at").agg(
                       F.max("dbid").alias("dbid"), F.max("database_role").alias("database_role")))


# Cursor metadata as the join with SQL samples reads it: one row per plan.
_PER_PLAN = f"""
select source_database, inst_id, sql_id, plan_hash_value,
  string_agg(distinct cast(child_number as string), ', ' order by cast(child_number as string)) as child_numbers,
  string_agg(distinct parsing_schema_name, ', ' order by parsing_schema_name) as parsing_schema_names,
  string_agg(distinct module, ', ' order by module) as modules
from ({_TABLES['sql_cursor_metadata'][0]}) m group by 1, 2, 3, 4"""


def _register_relation(rel_id, rel):
    left_sql, left_df = _TABLES[rel.left]
    right_sql, right_df = _DATABASE_LEVEL if rel_id in ("R-21", "R-23") else _TABLES[rel.right]
    if rel_id == "R-7":
        right_sql = _PER_PLAN
    variants = rel.variants or {"r": rel.keys}
    joins = []
    for name, keys in variants.items():
        pairs = [("source_database", "source_database"), *keys] + ([("collected_at", "collected_at")] if rel.series else [])
        on = " and ".join(f"l.{a} = {name}.{b}" for a, b in pairs)
        joins.append(f"left join ({right_sql}) {name} on {on}")
    key = f"r_{rel_id[2:]}_{rel.left.removesuffix('_samples')}_to_{rel.right.removesuffix('_samples')}"

    def run(fx):
        left, right = left_df(fx), right_df(fx)
        joined = relations.relate(left, right, rel_id)
        hidden = [f"{n}_{c}" for n in variants for c in right.columns if c in left.columns]
        return joined.drop(*hidden)

    # Right-side columns under their prefix, without the repeated keys.
    sql = f"select l.*, {{columns}} from ({left_sql}) l {' '.join(joins)}"
    return key, run, sql, list(variants)


# The other side's columns that a relation shows: those its left side does not have.
_SHOWN = {
    "R-1": ["child_number", "plan_hash_value", "executions"],
    "R-2": ["seq", "user_id", "username", "status", "type", "state", "event", "wait_class", "wait_time_micro", "seconds_in_wait", "sql_child_number", "prev_sql_id", "blocking_instance", "audit_session_id", "own_session_id"],
    "R-3": ["child_number", "plan_hash_value", "executions"],
    "R-4": ["child_number", "plan_hash_value", "plan_line_id", "operation"],
    "R-5": ["sql_fulltext"],
    "R-6": ["plan_line_id", "operation"],
    "R-7": ["child_numbers", "parsing_schema_names", "modules"],
    "R-8": ["plan_line_id", "operation"],
    "R-9": ["sql_fulltext"],
    "R-10": ["sql_fulltext"],
    "R-11": ["sql_fulltext"],
    "R-12": ["sql_fulltext"],
    "R-13": ["seq", "sid", "serial_number", "user_id", "username", "status", "type", "state", "event", "wait_class", "wait_time_micro", "seconds_in_wait", "prev_sql_id", "blocking_session", "blocking_instance", "audit_session_id", "own_session_id"],
    "R-14": ["dbid", "database_role"],
    "R-15": ["instance_name"],
    "R-16": ["dbid", "database_role"],
    "R-17": ["instance_name"],
    "R-18": ["instance_name"],
    "R-19": ["instance_name"],
    "R-20": ["dbid", "database_role"],
    "R-21": ["dbid", "database_role"],
    "R-22": ["dbid", "database_role"],
    "R-23": ["dbid", "database_role"],
}

for _rel_id, _rel in relations.RELATIONS.items():
    _key, _run, _sql, _variants = _register_relation(_rel_id, _rel)
    query(_key, _sql.replace("{columns}", ", ".join(f"{v}.{c} as {v}_{c}" for v in _variants for c in _SHOWN[_rel_id])))(_run)
