"""Typed samples: sources, projections, joins, aggregations, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from driverqueries.adapters import AS_OF
from driverqueries.registry import query
from fleetlens.functions import scalars as S
from fleetlens.operators import metrics, samples
from fleetlens.sources import readers

KEYS = ["source_database", "collected_at", "inst_id"]


# --- sources -----------------------------------------------------------------

@query("src_1_typed_snapshot", """
select coalesce(source_database, '') as source_database, seq, inst_id, con_id, name, value from {fx_sysstat}""")
def typed_snapshot(fx):
    from fleetlens.session import scratch_dir

    landed = scratch_dir(fx.spark, "landed")
    fx.sysstat.withColumn("not_in_the_layout", F.lit(1)).write.parquet(landed)
    return readers.read_raw(fx.spark, "sysstat", landed).select(
        F.coalesce("source_database", F.lit("")).alias("source_database"), "seq", "inst_id", "con_id", "name", "value")


@query("src_2_text_rows", """
select coalesce(cast(seq as string), '<nil>') as seq, coalesce(source_database, '<nil>') as source_database,
  coalesce(wait_class, '<nil>') as wait_class, coalesce(cast(blocking_session as string), '<nil>') as blocking_session
from {fx_session}""")
def text_rows(fx):
    renamed = fx.session.select(F.col("seq").alias("SEQ"), F.col("source_database").alias("Source_Database"),
                                "wait_class", "blocking_session")
    return metrics.as_text_rows(renamed)


@query("src_3_recent", f"""
select seq, source_database, sql_id, last_active_time from {{fx_rawstats}}
where last_active_time >= timestamp '{AS_OF}' - interval '172800 seconds' and sql_id is not null""")
def recent(fx):
    return samples.recent(fx.rawstats, "last_active_time", fx.as_of, 86_400).select(
        "seq", "source_database", "sql_id", "last_active_time")


_MARKS = "select source_database, max(sample_time) as watermark from {fx_activity} where event_type = 'click' and source_database <> 'db3' group by 1"


def _watermarks(fx):
    return fx.activity.where((F.col("event_type") == "click") & (F.col("source_database") != "db3")).groupBy(
        "source_database").agg(F.max("sample_time").alias("watermark"))


@query("src_4_incremental_rows", f"""
with marks as ({_MARKS})
select a.sample_id, a.sample_time, a.source_database, a.poll from {{fx_activity}} a left join marks m using (source_database)
where a.sample_time > coalesce(m.watermark - interval '86400 seconds', timestamp '{AS_OF}' - interval '864000 seconds')""")
def incremental_rows(fx):
    rows, _ = readers.incremental(fx.activity, _watermarks(fx), fx.as_of, 86_400, 864_000)
    return rows.select("sample_id", "sample_time", "source_database", "poll")


@query("src_4_incremental_watermarks", f"""
with marks as ({_MARKS}), fresh as (
  select a.source_database, max(a.sample_time) as watermark from {{fx_activity}} a left join marks m using (source_database)
  where a.sample_time > coalesce(m.watermark - interval '86400 seconds', timestamp '{AS_OF}' - interval '864000 seconds') group by 1
)
select source_database, max(watermark) as watermark from (select * from marks union all select * from fresh) w group by 1""")
def incremental_watermarks(fx):
    return readers.incremental(fx.activity, _watermarks(fx), fx.as_of, 86_400, 864_000)[1]


@query("src_4_marks_after_commit", """
select sample_id, sample_time, source_database, session_id from {fx_activity} where poll = 1""")
def marks_after_commit(fx):
    from datetime import datetime

    from fleetlens.plans.scheduled import ingest_activity
    from fleetlens.session import scratch_dir
    from fleetlens.sources import sinks

    # the first half of the feed, its replay, then all of it: nothing is stored twice or left out
    root = scratch_dir(fx.spark, "polls")
    half = fx.activity.where("sample_time < timestamp '2024-01-15 00:00:00'")
    for poll, feed in ((1, half), (1, fx.activity), (2, fx.activity)):
        ingest_activity(fx.spark, feed, root, poll, datetime(2024, 1, 31), overlap=3600, initial=40 * 86_400)
    return sinks.read_table(fx.spark, root, "database_activity_samples").select("sample_id", "sample_time", "source_database", "session_id")


@query("src_5_new_log_rows", """
with stored as (select source_database, max(originating_timestamp) as last_timestamp from {fx_log}
                where message_text like 'signup%' and source_database <> 'db7' group by 1)
select l.source_database, l.originating_timestamp, l.message_text from {fx_log} l left join stored s using (source_database)
where l.originating_timestamp > coalesce(s.last_timestamp, timestamp '1900-01-01 01:01:01.001')""")
def new_log_rows(fx):
    stored = fx.log.where(F.col("message_text").startswith("signup") & (F.col("source_database") != "db7")).groupBy(
        "source_database").agg(F.max("originating_timestamp").alias("last_timestamp"))
    return readers.new_log_rows(fx.log, stored).select("source_database", "originating_timestamp", "message_text")


@query("src_6_last_log_record", """
select database, message from (
  select source_database as database, message_text as message, row_number() over (partition by source_database order by seq desc) as rn
  from {fx_log}) r
where rn = 1""")
def last_log_record(fx):
    rows = readers.alert_log_rows(fx.log.withColumn("originating_timestamp", F.col("originating_timestamp")))
    lines = fx.log.select("seq", F.to_json(F.struct(
        F.col("originating_timestamp").cast("string").alias("timestamp"), F.col("source_database").alias("database"),
        F.lit("").alias("moduleId"), F.lit("").alias("ecid"), F.col("message_text").alias("message"))).alias("value"))
    assert rows.columns == ["timestamp", "database", "moduleId", "ecid", "message"]
    return readers.last_log_record(lines, position="seq").select("database", "message")


# --- projections and filters -----------------------------------------------------

_ACTIVE = """type = 'USER' and status = 'ACTIVE' and (state <> 'WAITING' or wait_class <> 'Idle') and audit_session_id <> own_session_id"""


@query("pf_1_active_sessions", f"select sid, source_database, collected_at, wait_class from {{fx_session}} where {_ACTIVE}")
def active_sessions(fx):
    return samples.active_sessions(fx.session, "own_session_id").select(
        "sid", "source_database", "collected_at", "wait_class")


@query("pf_2_wait_projection", """
select sid, case when state = 'WAITING' then 'WAITING' else 'ON CPU' end as session_state,
  case when state = 'WAITING' then event end as event, case when state = 'WAITING' then wait_class end as wait_class,
  case when state = 'WAITING' then wait_time_micro end as wait_time_micro,
  case when state = 'WAITING' then wait_time_micro end as time_waited_micro
from {fx_session}""")
def wait_projection(fx):
    return samples.wait_columns(fx.session).select(
        "sid", "session_state", "event", "wait_class", "wait_time_micro", "time_waited_micro")


@query("pf_3_session_activity", f"""
select epoch_us(collected_at) * 1000 as sample_id, collected_at as sample_time, sid as session_id, 'FOREGROUND' as session_type,
  'SESSION' as sample_source, cast(2000000 as bigint) as sample_duration_micro
from {{fx_session}} where {_ACTIVE}""")
def session_activity(fx):
    return samples.activity_samples(fx.session, "SESSION", 2.0, "own_session_id").select(
        "sample_id", "sample_time", "session_id", "session_type", "sample_source", "sample_duration_micro")


@query("pf_3_history_activity", """
select sample_id, sample_time, session_serial as session_serial_number, 'ASH' as sample_source,
  case when usecs_per_row > 0 then usecs_per_row else 2000000 end as sample_duration_micro
from {fx_history} where session_type = 'FOREGROUND'""")
def history_activity(fx):
    return samples.activity_samples(fx.history, "ASH", 2.0).select(
        "sample_id", "sample_time", "session_serial_number", "sample_source", "sample_duration_micro")


@query("pf_4_foreground", "select sample_id, session_id from {fx_history} where session_type = 'FOREGROUND'")
def foreground(fx):
    return samples.foreground(fx.history).select("sample_id", "session_id")


@query("pf_5_user_sessions", """
select source_database, collected_at, inst_id, sid, serial_number, username, status, sql_id, sql_child_number, prev_sql_id, event,
  wait_class, state, seconds_in_wait, blocking_instance, blocking_session
from {fx_session} where type = 'USER'""")
def user_sessions(fx):
    return samples.user_sessions(fx.session)


@query("pf_6_resource_limits", """
select source_database, collected_at, inst_id, resource_name, seq, current_utilization as current_value, max_utilization as max_value,
  try_cast(case when regexp_matches(trim(initial_allocation), '^[0-9]+$') then trim(initial_allocation) end as bigint) as initial_limit,
  try_cast(case when regexp_matches(trim(limit_value), '^[0-9]+$') then trim(limit_value) end as bigint) as limit_value,
  trim(limit_value) = 'UNLIMITED' as limit_unlimited
from {fx_rawlimit}""")
def resource_limits(fx):
    return samples.resource_limits(fx.rawlimit)


# --- fixed values: names that a check expects, written out so that a wrong list in the engine shows ---------
_SYSTEM_COUNTERS = (
    "'parse count (total)', 'execute count', 'user commits', 'user rollbacks', 'physical reads', "
    "'physical writes', 'session logical reads', 'redo size'"
)
_SYSTEM_METRICS = (
    "'Buffer Cache Hit Ratio', 'Cursor Cache Hit Ratio', 'Host CPU Utilization (%)', 'Database CPU Time Ratio', "
    "'Database Wait Time Ratio'"
)
_IO_COUNTERS = (
    "'physical read total IO requests', 'physical write total IO requests', 'physical read total bytes', "
    "'physical write total bytes'"
)
_TIME_MODEL_COUNTERS = (
    "'DB CPU', 'DB time'"
)
_EDITION_MARKS = [
    ("ENTERPRISE EDITION", "Enterprise Edition"),
    ("STANDARD EDITION 2", "Standard Edition 2"),
    ("STANDARD EDITION", "Standard Edition"),
    ("EXPRESS EDITION", "Express Edition"),
    ("FREE", "Free"),
    ("PERSONAL EDITION", "Personal Edition"),
]
_PRODUCT = "ORACLE%DATABASE%"
_FAILURE_MARKS = [
    "ORA-01033", "ORA-01034", "ORA-01089", "ORA-03113", "ORA-03114", "ORA-03135", "ORA-12154", "ORA-12170",
    "ORA-125", "DPI-1010", "DPI-1080", "BROKEN PIPE", "CONNECTION REFUSED", "CONNECTION RESET", "DATABASE IS CLOSED",
    "NETWORK IS UNREACHABLE", "NO ROUTE TO HOST",
]
_STATISTICS = {
    "executions": "executions",
    "elapsed_time": "elapsed_time_micro",
    "cpu_time": "cpu_time_micro",
    "user_io_wait_time": "user_io_wait_micro",
    "application_wait_time": "application_wait_micro",
    "concurrency_wait_time": "concurrency_wait_micro",
    "cluster_wait_time": "cluster_wait_micro",
    "buffer_gets": "buffer_gets",
    "disk_reads": "disk_reads",
    "direct_writes": "direct_writes",
    "rows_processed": "rows_processed",
    "fetches": "fetches",
    "loads": "loads",
    "invalidations": "invalidations",
    "parse_calls": "parse_calls",
}
# -------------------------------------------------------------------------------------------------------------


@query("pf_7_system_counters", f"select * from {{fx_sysstat}} where name in ({_SYSTEM_COUNTERS})")
def system_counters(fx):
    return samples.select_named(fx.sysstat, "name", samples.SYSTEM_COUNTERS)


@query("pf_8_wait_classes", """
select seq, wait_class, cast(round(time_waited * 10000) as bigint) as cumulative_wait_micro from {fx_wait} where wait_class <> 'Idle'""")
def wait_classes(fx):
    return samples.wait_classes(fx.wait).select("seq", "wait_class", "cumulative_wait_micro")


@query("pf_9_system_metrics", f"select * from {{fx_sysmetric}} where metric_name in ({_SYSTEM_METRICS})")
def system_metrics(fx):
    return samples.select_named(fx.sysmetric, "metric_name", samples.SYSTEM_METRICS)


_EDITION = "case " + " ".join(f"when upper(product) like '%{m}%' then '{n}'" for m, n in _EDITION_MARKS) + " end"


@query("pf_10_editions", f"""
select product, {_EDITION} as edition, count(*) as products
from {{fx_product}} where upper(product) like '{_PRODUCT}' group by 1, 2""")
def editions(fx):
    rows = fx.product.where(F.upper("product").like(S.PRODUCT_PATTERN))
    return rows.groupBy("product", S.edition(F.col("product")).alias("edition")).agg(F.count("*").alias("products"))


@query("pf_11_diskgroups", """
select a.source_database, a.collected_at, a.inst_id, a.name as diskgroup_name, a.total_mb * 1048576 as total_bytes,
  a.free_mb * 1048576 as free_bytes, a.usable_file_mb * 1048576 as usable_bytes
from {fx_asm} a
where exists (select 1 from {fx_datafile} d where d.name like '+%' and d.source_database = a.source_database and d.collected_at = a.collected_at)
  and a.inst_id = (select max(i.inst_id) from {fx_asm} i where i.source_database = a.source_database and i.collected_at = a.collected_at)""")
def diskgroups(fx):
    return samples.diskgroups(fx.asm, fx.datafile, fx.asm)


@query("pf_14_limit_used_percent", """
select source_database, collected_at, resource_name,
  case when limit_value > 0 then cast(current_value as double) * 100.0 / cast(limit_value as double) end as used_percent
from {fx_limit}""")
def limit_used_percent(fx):
    from fleetlens.plans.views import with_used_percent

    return with_used_percent(fx.limit).select("source_database", "collected_at", "resource_name", "used_percent")


@query("pf_14_diskgroup_used_percent", """
select source_database, collected_at, diskgroup_name,
  case when total_bytes > 0 then cast(total_bytes - free_bytes as double) * 100.0 / cast(total_bytes as double) end as used_percent
from {fx_diskgroup}""")
def diskgroup_used_percent(fx):
    from fleetlens.plans.views import with_used_percent

    return with_used_percent(fx.diskgroup).select("source_database", "collected_at", "diskgroup_name", "used_percent")


@query("pf_17_sql_text_rows", """
select source_database, sql_id, sql_fulltext from {fx_document_text} where length(regexp_replace(sql_fulltext, '^\\s+|\\s+$', '', 'g')) > 0""")
def sql_text_rows(fx):
    return samples.sql_text_rows(fx.document_text).select("source_database", "sql_id", "sql_fulltext")


@query("pf_18_scrape_status", """
select seq, error_message is null as success, error_message from {fx_status}""")
def scrape_status(fx):
    return samples.scrape_status_rows(fx.status.drop("success")).select("seq", "success", "error_message")


@query("pf_19_runtime_rows", """
with done as (select cycle_id, count(*) filter (where success and collector = 'scheduled') as succeeded from {fx_cycle_status} group by 1),
c as (
  select c.*, coalesce(d.succeeded, 0) as ok,
    greatest(0.0, cast(epoch_us(started_at) - epoch_us(scheduled_at) as double) / 1000000.0) as lag
  from {fx_cycle} c left join done d on d.cycle_id = c.cycle_id
)
select cycle_id, ok as databases_succeeded, lag as scheduling_lag_seconds,
  cast(greatest(missed_intervals, floor(lag / 2)) as bigint) as missed_intervals,
  greatest(error_count, databases_attempted - ok) as error_count,
  cast(epoch_us(collection_finished_at) - epoch_us(started_at) as double) / 1000000.0 as collection_duration_seconds,
  cast(epoch_us(finished_at) - epoch_us(collection_finished_at) as double) / 1000000.0 as write_duration_seconds,
  cast(epoch_us(finished_at) - epoch_us(started_at) as double) / 1000000.0 as total_duration_seconds, error_message
from c""")
def runtime_rows(fx):
    cycles = fx.cycle.drop("databases_succeeded")
    return samples.runtime_rows(cycles, fx.cycle_status, "scheduled").select(
        "cycle_id", "databases_succeeded", "scheduling_lag_seconds", "missed_intervals", "error_count",
        "collection_duration_seconds", "write_duration_seconds", "total_duration_seconds", "error_message")


@query("pf_20_recovery_pass", """
select cycle_id, greatest(0.0, cast(epoch_us(started_at) - epoch_us(scheduled_at) as double) / 1000000.0) as scheduling_lag_seconds,
  cast(epoch_us(finished_at) - epoch_us(started_at) as double) / 1000000.0 as collection_duration_seconds,
  cast(floor(cast(epoch_us(finished_at) - epoch_us(started_at) as double) / 1000000.0 / 2) as bigint) as missed_intervals,
  databases_attempted, databases_succeeded
from {fx_cycle}""")
def recovery_pass(fx):
    return samples.recovery_pass_rows(fx.cycle).select(
        "cycle_id", "scheduling_lag_seconds", "collection_duration_seconds", "missed_intervals",
        "databases_attempted", "databases_succeeded")


@query("pf_21_failed_or_stale", f"""
select source_database, collector, case when not success then 'FAILED' else 'STALE' end as state, collected_at
from {{fx_latest_status}} where not success or collected_at < timestamp '{AS_OF}' - interval '3 hours'""")
def failed_or_stale(fx):
    return samples.failed_or_stale(fx.latest_status, fx.as_of, 3 * 3600).select(
        "source_database", "collector", "state", "collected_at")


_MARKERS = " or ".join(f"upper(error_message) like '%{m}%'" for m in _FAILURE_MARKS)


@query("pf_22_connection_failures", f"""
select seq, coalesce({_MARKERS}, false) as connection_failure from (
  select seq, case when sample_count % 5 = 0 then 'query timed out' when sample_count % 5 = 1 then 'ORA-00942: table missing'
    when sample_count % 5 = 2 then 'write: Broken pipe' when sample_count % 5 = 3 then error_message else null end as error_message
  from {{fx_status}}) s""")
def connection_failures(fx):
    kind = F.col("sample_count") % 5
    message = (F.when(kind == 0, "query timed out").when(kind == 1, "ORA-00942: table missing")
               .when(kind == 2, "write: Broken pipe").when(kind == 3, F.col("error_message")))
    return fx.status.select("seq", S.is_connection_failure(message).alias("connection_failure"))


# --- joins ------------------------------------------------------------------------

@query("j_1_blocking_sessions", """
select s.source_database, s.collected_at, s.inst_id, s.sid, s.serial_number, s.username, s.sql_id, s.event, s.wait_class,
  s.blocking_instance, s.blocking_session, b.username as blocking_username, b.sql_id as blocking_sql_id, b.event as blocking_event
from {fx_session} s left join {fx_session} b
  on b.source_database = s.source_database and b.collected_at = s.collected_at and b.inst_id = s.blocking_instance and b.sid = s.blocking_session
where s.blocking_session is not null""")
def blocking_sessions(fx):
    return samples.blocking_sessions(fx.session)


_STATUS = """
select i.source_database, i.collected_at, i.inst_id, i.instance_name, i.status as instance_status, i.database_status, i.startup_time,
  d.open_mode, d.database_role, d.cdb, d.con_id, d.con_name, d.platform_name
from {fx_instance} i join {fx_database} d on d.source_database = i.source_database and d.collected_at = i.collected_at and d.inst_id = i.inst_id"""


@query("j_2_instance_status", _STATUS)
def instance_status(fx):
    return samples.instance_status(fx.instance, fx.database)


_PRODUCT = f"""
select source_database, collected_at, product, {_EDITION} as edition, version, version_full from (
  select *, row_number() over (partition by source_database, collected_at order by product, version, version_full) as rn
  from {{fx_product}} where upper(product) like '{_PRODUCT}') p
where rn = 1"""


@query("t_3_first_product", f"""
select source_database, collected_at, product as database_product, edition as database_edition, version as database_version,
  version_full as database_version_full from ({_PRODUCT}) p""")
def first_product(fx):
    return samples.first_product(fx.product)


_IDENTITY = f"""
select d.source_database, d.collected_at, d.inst_id, d.dbid, d.db_unique_name, d.protection_mode, d.protection_level,
  p.product as database_product, p.edition as database_edition, p.version as database_version, p.version_full as database_version_full
from {{fx_database}} d left join ({_PRODUCT}) p on p.source_database = d.source_database and p.collected_at = d.collected_at"""


@query("j_3_database_identity", _IDENTITY)
def database_identity(fx):
    return samples.database_identity(fx.database, fx.product)


@query("j_4_database_status", f"""
select s.*, i.* exclude (source_database, collected_at, inst_id)
from ({_STATUS}) s left join ({_IDENTITY}) i
  on i.source_database = s.source_database and i.collected_at = s.collected_at and i.inst_id = s.inst_id""")
def database_status(fx):
    return samples.database_status(fx.instance, fx.database, fx.product)


# Several identities of an instance: the last by arrival counts, not the largest.
@query("j_4_last_identity_wins", """
with last as (select concat('db', cast(user_id % 4 as string)) as source_database, date_trunc('day', cast(ts as timestamp)) as collected_at,
  user_id % 3 + 1 as inst_id, arg_max(event_type, event_id) as db_unique_name from {events} group by 1, 2, 3)
select i.source_database, i.collected_at, i.inst_id, i.instance_name, l.db_unique_name
from {fx_instance} i left join last l using (source_database, collected_at, inst_id)""")
def last_identity(fx):
    source = fx.events.select(
        F.concat(F.lit("db"), (F.col("user_id") % 4).cast("string")).alias("source_database"),
        F.date_trunc("day", F.col("ts").cast("timestamp")).alias("collected_at"), (F.col("user_id") % 3 + 1).alias("inst_id"),
        F.col("event_type").alias("db_unique_name"), F.col("event_id").alias("seq"))
    rows = fx.instance.select("source_database", "collected_at", "inst_id", "instance_name")
    return samples.update_from(rows, source, ["source_database", "collected_at", "inst_id"], ["db_unique_name"], ["seq"])


_COUNTS = """
select source_database, collected_at, inst_id, count(*) filter (where type = 'USER') as user_sessions,
  count(*) filter (where type = 'USER' and status = 'ACTIVE') as active_user_sessions,
  count(*) filter (where type <> 'USER') as background_sessions
from {fx_session} group by 1, 2, 3"""


@query("agg_2_session_counts", _COUNTS)
def session_counts(fx):
    return samples.session_counts(fx.session)


_PROCESSES = "select source_database, collected_at, inst_id, count(*) as process_count from {fx_process} group by 1, 2, 3"


@query("agg_3_process_counts", _PROCESSES)
def process_counts(fx):
    return samples.process_counts(fx.process)


_PARAMETERS = """
select source_database, collected_at, inst_id, max(case when name = 'cpu_count' then cast(value as bigint) end) as cpu_count,
  max(case when name = 'sga_max_size' then cast(value as bigint) end) as sga_max_bytes,
  max(case when name = 'pga_aggregate_limit' then cast(value as bigint) end) as pga_aggregate_limit
from {fx_parameter} where name in ('cpu_count', 'sga_max_size', 'pga_aggregate_limit') group by 1, 2, 3"""


@query("agg_4_parameters", _PARAMETERS)
def parameters(fx):
    return samples.pivot_named(fx.parameter, "name", "value", samples.PARAMETERS)


_SGA = "select source_database, collected_at, inst_id, cast(sum(value) as bigint) as sga_allocated_bytes from {fx_memory} where con_id = 0 group by 1, 2, 3"


@query("agg_5_shared_memory", _SGA)
def shared_memory(fx):
    return samples.sga_bytes(fx.memory)


_PGA = """
select source_database, collected_at, inst_id, max(case when name = 'total PGA allocated' then value end) as pga_allocated_bytes,
  max(case when name = 'maximum PGA allocated' then value end) as pga_max_allocated_bytes
from {fx_memory} where con_id = 0 and name in ('total PGA allocated', 'maximum PGA allocated') group by 1, 2, 3"""


@query("agg_6_private_memory", _PGA)
def private_memory(fx):
    return samples.pga_bytes(fx.memory)


_MEMORY = f"""
select i.source_database, i.collected_at, i.inst_id, s.sga_allocated_bytes, p.pga_allocated_bytes, p.pga_max_allocated_bytes
from {{fx_instance}} i left join ({_SGA}) s using (source_database, collected_at, inst_id)
  left join ({_PGA}) p using (source_database, collected_at, inst_id)"""


@query("j_8_instance_memory", _MEMORY)
def instance_memory(fx):
    return samples.instance_memory(fx.instance, fx.memory, fx.memory)


_BASE = f"""
select i.source_database, i.collected_at, i.inst_id, coalesce(s.user_sessions, 0) as user_sessions,
  coalesce(s.active_user_sessions, 0) as active_user_sessions, coalesce(s.background_sessions, 0) as background_sessions,
  coalesce(p.process_count, 0) as process_count, r.cpu_count, r.sga_max_bytes, r.pga_aggregate_limit
from {{fx_instance}} i left join ({_COUNTS}) s using (source_database, collected_at, inst_id)
  left join ({_PROCESSES}) p using (source_database, collected_at, inst_id)
  left join ({_PARAMETERS}) r using (source_database, collected_at, inst_id)"""


@query("j_7_instance_base", _BASE)
def instance_base(fx):
    return samples.instance_base(fx.instance, fx.session, fx.process, fx.parameter)


@query("j_5_instance_samples", f"select b.*, m.sga_allocated_bytes, m.pga_allocated_bytes, m.pga_max_allocated_bytes from ({_BASE}) b left join ({_MEMORY}) m using (source_database, collected_at, inst_id)")
def instance_samples(fx):
    return samples.instance_samples(fx.instance, fx.session, fx.process, fx.parameter, fx.memory, fx.memory)


_USAGE = """
select u.source_database, u.collected_at, u.tablespace_name, t.contents, t.block_size * u.used_space as used_bytes,
  t.block_size * (u.tablespace_size - u.used_space) as free_bytes, t.block_size * u.tablespace_size as max_bytes, u.used_percent
from {fx_ts_usage} u join {fx_ts} t using (source_database, collected_at, tablespace_name) where t.contents <> 'TEMPORARY'"""


@query("j_9_permanent_tablespaces", _USAGE)
def permanent_tablespaces(fx):
    return samples.tablespace_usage(fx.ts, fx.ts_usage, fx.temp).where("contents <> 'TEMPORARY'")


_UNION = f"""
{_USAGE}
union all
select source_database, collected_at, tablespace_name, 'TEMPORARY', tablespace_size - free_space, free_space, tablespace_size,
  case when tablespace_size = 0 then 0.0 else cast(tablespace_size - free_space as double) / cast(tablespace_size as double) * 100 end
from {{fx_temp}}"""


@query("u_1_tablespace_union", _UNION)
def tablespace_union(fx):
    return samples.tablespace_usage(fx.ts, fx.ts_usage, fx.temp)


_ALLOCATION = """
select source_database, collected_at, tablespace_name, coalesce(t.bytes, d.bytes) as allocated_bytes
from (select source_database, collected_at, tablespace_name, cast(sum(bytes) as bigint) as bytes from {fx_data_files} group by 1, 2, 3) d
full join (select source_database, collected_at, tablespace_name, cast(sum(bytes) as bigint) as bytes from {fx_temp_files} group by 1, 2, 3) t
  using (source_database, collected_at, tablespace_name)"""


@query("agg_7_tablespace_allocation", _ALLOCATION)
def tablespace_allocation(fx):
    return samples.tablespace_allocation(fx.data_files, fx.temp_files)


@query("j_6_tablespace_samples", f"select u.*, a.allocated_bytes from ({_UNION}) u left join ({_ALLOCATION}) a using (source_database, collected_at, tablespace_name)")
def tablespace_samples(fx):
    return samples.tablespace_samples(fx.ts, fx.ts_usage, fx.temp, fx.data_files, fx.temp_files)


@query("u_2_allocation_union", """
select source_database, collected_at, tablespace_name, coalesce(t.bytes, d.bytes) as allocated_bytes
from (select source_database, collected_at, tablespace_name, cast(sum(bytes) as bigint) as bytes from {fx_data_files} group by 1, 2, 3) d
full join (select source_database, collected_at, tablespace_name, cast(sum(bytes) as bigint) as bytes from {fx_temp_files} group by 1, 2, 3) t
  using (source_database, collected_at, tablespace_name)""")
def allocation_union(fx):
    return samples.tablespace_allocation(fx.data_files, fx.temp_files)


@query("u_3_cpu_io_counters", f"""
select seq, source_database, collected_at, inst_id, con_id, value, name as stat_name from {{fx_sysstat}}
where con_id = 0 and name in ({_IO_COUNTERS})
union all
select seq, source_database, collected_at, inst_id, con_id, value, name from {{fx_time_model}}
where con_id = 0 and name in ({_TIME_MODEL_COUNTERS})""")
def cpu_io_counters(fx):
    return samples.cpu_io_counters(fx.sysstat, fx.time_model)


@query("u_5_cross_database_append", f"""
select source_database, name as stat_name, count(*) as n, cast(sum(value) as bigint) as total from {{fx_sysstat}}
where name in ({_SYSTEM_COUNTERS}) group by 1, 2""")
def cross_database_append(fx):
    from fleetlens.plans.collect import build_samples

    return build_samples({"sysstat": fx.sysstat})["system_counter_samples"].groupBy("source_database", "stat_name").agg(
        F.count("*").alias("n"), F.sum("cumulative_value").alias("total"))


@query("j_10_destinations", """
with remote as (
  select source_database, collected_at, inst_id, dest_id from {fx_dest} where target = 'STANDBY'
  union
  select source_database, collected_at, inst_id, dest_id from {fx_dest_status} where upper(type) not in ('LOCAL', 'CROSS-INSTANCE')
), reachable as (
  select * exclude (error, dest_name), error as error_message, dest_name as destination_name from {fx_dest}
  where destination is not null or db_unique_name is not null
)
select source_database, collected_at, inst_id, dest_id, r.destination_name, r.target, r.destination, r.status, r.db_unique_name, r.error_message,
  s.type as destination_type, s.gap_status, s.archived_seq as archived_sequence, s.applied_seq as applied_sequence
from remote join reachable r using (source_database, collected_at, inst_id, dest_id)
left join {fx_dest_status} s using (source_database, collected_at, inst_id, dest_id)""")
def destinations(fx):
    return samples.destinations(fx.dest, fx.dest_status)


# What a process does, told row by row; its roll-up is joined to the instances afterwards.
_ROLLED = """
select source_database, collected_at, inst_id, count(*) filter (where applies) as appliers, count(*) filter (where name = 'RFS') as receivers,
  max(action) filter (where applies) as apply_status, max(thread) filter (where reads_log) as thread_number, max(sequence) filter (where reads_log) as sequence_number
from (
  select *, name = 'MRP0' or coalesce(lower(role), '') = 'managed recovery' as applies,
    list_contains(['managed recovery', 'recovery logmerger'], lower(role)) as reads_log
  from {fx_dgproc}) tagged
group by all"""


@query("j_11_recovery_processes", f"""
select source_database, collected_at, inst_id, coalesce(appliers, 0) as apply_processes, coalesce(receivers, 0) as transport_processes,
  apply_status, thread_number, sequence_number
from (select distinct source_database, collected_at, inst_id from {{fx_dginst}}) i left join ({_ROLLED}) p using (source_database, collected_at, inst_id)""")
def recovery_processes(fx):
    return samples.recovery_processes(fx.dginst, fx.dgproc)


@query("agg_8_process_rollup", f"""
select source_database, cast(sum(appliers) as bigint) as apply_processes, cast(sum(receivers) as bigint) as transport_processes from ({_ROLLED}) p group by 1""")
def process_rollup(fx):
    every = fx.dgproc.select("source_database", "collected_at", "inst_id").distinct()
    return samples.recovery_processes(every, fx.dgproc).groupBy("source_database").agg(
        F.sum("apply_processes").alias("apply_processes"), F.sum("transport_processes").alias("transport_processes"))


@query("j_12_replication_enabled", """
select d.source_database, d.collected_at, d.database_role,
  d.database_role <> 'PRIMARY' or exists (select 1 from {fx_dest} a where a.source_database = d.source_database and a.collected_at = d.collected_at
    and a.target = 'STANDBY' and (a.destination is not null or a.db_unique_name is not null)) as enabled
from {fx_dgdatabase} d""")
def replication_enabled(fx):
    return samples.replication_enabled(fx.dgdatabase, fx.dest)


_STATEMENT = "source_database, inst_id, sql_id, plan_hash_value"


def _list_of(column):
    """Distinct values of a column per statement, as one text in order."""
    return f"""
select {_STATEMENT}, string_agg(v, ', ' order by v) as listed
from (select distinct {_STATEMENT}, cast({column} as string) as v from {{fx_cursor}} where {column} is not null) x group by all"""


def _lists(child, schema, module):
    return f"""
select {_STATEMENT}, c.listed as {child}, p.listed as {schema}, m.listed as {module} from (select distinct {_STATEMENT} from {{fx_cursor}}) k
left join ({_list_of('child_number')}) c using ({_STATEMENT}) left join ({_list_of('parsing_schema_name')}) p using ({_STATEMENT})
left join ({_list_of('module')}) m using ({_STATEMENT})"""


@query("j_13_enriched_sql", f"""
select s.*, l.child_number, l.parsing_schema_name, l.module
from {{fx_sqlstats}} s left join ({_lists('child_number', 'parsing_schema_name', 'module')}) l using ({_STATEMENT})""")
def enriched_sql(fx):
    from fleetlens.plans.views import enrich_sql

    return enrich_sql(fx.sqlstats, fx.cursor)


_TOP = """
select source_database, sql_id from (
  select source_database, sql_id, row_number() over (partition by source_database order by sum(elapsed_time_micro) desc, sql_id) as rn
  from {fx_sqlstats} group by 1, 2) r
where rn <= 5"""


def _top_ids(fx):
    from pyspark.sql import Window

    totals = fx.sqlstats.groupBy("source_database", "sql_id").agg(F.sum("elapsed_time_micro").alias("s"))
    order = Window.partitionBy("source_database").orderBy(F.col("s").desc(), "sql_id")
    return totals.withColumn("rn", F.row_number().over(order)).where("rn <= 5").select("source_database", "sql_id")


@query("j_16_top_consumer_details", f"""
with top as ({_TOP})
select source_database, inst_id, sql_id, child_number, plan_hash_value, elapsed_time_micro as elapsed_time from (
  select c.*, row_number() over (partition by source_database, collected_at, inst_id, sql_id, plan_hash_value
    order by elapsed_time_micro desc nulls first, child_number) as rn
  from {{fx_cursor}} c semi join top t on t.source_database = c.source_database and t.sql_id = c.sql_id) r
where rn = 1""")
def top_consumer_details(fx):
    return samples.sql_details(fx.cursor.withColumnRenamed("elapsed_time_micro", "elapsed_time"), _top_ids(fx)).select(
        "source_database", "inst_id", "sql_id", "child_number", "plan_hash_value", "elapsed_time")


_PLAN_KEYS = "source_database, inst_id, sql_id, child_number, plan_hash_value"
_KNOWN = f"select distinct {_PLAN_KEYS} from {{fx_plan}} where event_type in ('click', 'view')"
_WANTED = f"select distinct {_PLAN_KEYS} from {{fx_plan}} where event_type in ('view', 'error')"
PLAN_KEYS = [k.strip() for k in _PLAN_KEYS.split(",")]


def _known(fx):
    return fx.plan.where(F.col("event_type").isin("click", "view")).select(*PLAN_KEYS).distinct()


def _wanted(fx):
    return fx.plan.where(F.col("event_type").isin("view", "error")).select(*PLAN_KEYS).distinct()


@query("j_15_uncached_plans", f"select * from ({_WANTED}) w except select * from ({_KNOWN}) k")
def uncached_plans(fx):
    return samples.plan_cache_step(_known(fx), _wanted(fx), _wanted(fx))[0]


@query("u_6_plan_cache", f"""
select * from ({_KNOWN}) k intersect select * from ({_WANTED}) w
union
select distinct {_PLAN_KEYS} from {{fx_plan}} where event_type = 'signup'""")
def plan_cache(fx):
    collected = fx.plan.where(F.col("event_type") == "signup")
    return samples.plan_cache_step(_known(fx), _wanted(fx), collected)[1]


@query("j_17_plan_lines", f"""
select seq, source_database, sql_id, plan_line_id, operation from {{fx_plan}} p semi join ({_WANTED}) w
  on w.source_database = p.source_database and w.inst_id = p.inst_id and w.sql_id = p.sql_id and w.child_number = p.child_number
  and w.plan_hash_value = p.plan_hash_value""")
def plan_lines(fx):
    return samples.plan_lines(fx.plan, _wanted(fx)).select("seq", "source_database", "sql_id", "plan_line_id", "operation")


# --- aggregations --------------------------------------------------------------------

_SUMS = ", ".join(f"cast(sum({c}) as bigint) as {out}" for c, out in _STATISTICS.items())


@query("agg_1_sql_samples", f"""
select source_database, collected_at, inst_id, sql_id, plan_hash_value, {_SUMS}, max(last_active_time) as last_active_time
from {{fx_rawstats}} where sql_id is not null group by 1, 2, 3, 4, 5""")
def sql_samples(fx):
    return samples.sql_samples(fx.rawstats)


@query("agg_9_replication_lag", """
with parsed as (
  select source_database, name, seq,
    case when trim(value) = '' or upper(trim(value)) = 'UNKNOWN' then null
         when regexp_matches(value, '^[+-]?[0-9]+ ') then
           (case when value like '-%' then -1 else 1 end) * (cast(regexp_extract(value, '^[+-]?([0-9]+) ', 1) as double) * 86400
             + cast(regexp_extract(value, ' ([0-9]{{2}}):', 1) as double) * 3600 + cast(regexp_extract(value, ':([0-9]{{2}}):', 1) as double) * 60
             + cast(regexp_extract(value, ':([0-9.]+)$', 1) as double))
         else cast(value as double) end as seconds
  from {fx_lag}
), last as (select *, row_number() over (partition by source_database, name order by seq desc) as rn from parsed)
select source_database, max(case when name = 'transport lag' then seconds end) as transport_lag_seconds,
  max(case when name = 'apply lag' then seconds end) as apply_lag_seconds,
  max(case when name = 'apply finish time' then seconds end) as apply_finish_time_seconds,
  max(case when name = 'estimated startup time' then seconds end) as estimated_startup_seconds
from last where rn = 1 group by 1""")
def replication_lag(fx):
    return samples.replication_lag(fx.lag)


@query("agg_10_distinct_lists", _lists("child_numbers", "parsing_schema_names", "modules"))
def distinct_lists(fx):
    return samples.cursor_context(fx.cursor)


@query("agg_11_shared_diskgroups", """
select string_agg(source_database, ', ' order by source_database) as source_database, collected_at, inst_id, diskgroup_name, total_bytes, free_bytes, usable_bytes
from {fx_diskgroup} group by collected_at, inst_id, diskgroup_name, total_bytes, free_bytes, usable_bytes""")
def shared_diskgroups(fx):
    return samples.merge_shared(fx.diskgroup, ["collected_at", "inst_id", "diskgroup_name", "total_bytes",
                                               "free_bytes", "usable_bytes"])


@query("agg_12_percentiles", """
select event_type, quantile_disc(value, 0.95) as p95, quantile_disc(value, 0.99) as p99 from {events} group by 1""")
def percentiles(fx):
    return samples.percentiles(fx.events, ["event_type"], "value", {"p95": 0.95, "p99": 0.99})


@query("agg_13_ordinal_percentiles", """
select event_type, quantile_disc(n, 0.95) as p95_rows, quantile_disc(n, 0.99) as p99_rows
from (select event_type, row_number() over (partition by event_type order by ts, event_id) as n from {events}) r group by 1""")
def ordinal_percentiles(fx):
    return samples.ordinal_percentiles(fx.events, ["event_type"], {"p95_rows": 0.95, "p99_rows": 0.99})


@query("agg_14_queues_per_instance", """
select inst_id, count(*) as total_queues from (
  select distinct s.inst_id, q.queue_name from {fx_subscriber} s join {fx_queue} q on q.queue_id = s.queue_id) d group by 1""")
def queues_per_instance(fx):
    return samples.queue_counts(fx.subscriber, fx.queue)


@query("agg_14_subscribers_per_instance", """
select inst_id, count(*) as total_subscribers from (select distinct inst_id, subscriber_id from {fx_subscriber}) d group by 1""")
def subscribers_per_instance(fx):
    return samples.distinct_pairs(fx.subscriber, "inst_id", "subscriber_id", "total_subscribers")


@query("agg_15_subscriber_stats", """
with totals as (
  select inst_id, queue_id, subscriber_id, sum(enqueued_msgs) as put, sum(dequeued_msgs) as taken,
    min(time_since_last_dequeue) as waited, max(estd_time_to_drain_no_enq) as drain
  from {fx_subscriber} group by all
), names as (select queue_id, queue_name from {fx_queue} group by all)
select inst_id, queue_id, subscriber_id as subscriber_name, cast(put as bigint) as enqueued_msgs, cast(taken as bigint) as dequeued_msgs,
  cast(put - taken as bigint) as remained_msgs, waited as time_since_last_dequeue, drain as estd_time_to_drain_no_enq,
  10.0::double as message_latency_1, 20.0::double as message_latency_2, 30.0::double as message_latency_3, queue_name
from totals join names using (queue_id)""")
def subscriber_stats(fx):
    return samples.subscriber_stats(fx.subscriber, fx.queue)


@query("u_7_distinct_rows", """
select queue_name, count(distinct (inst_id, subscriber_id)) as subscribers
from {fx_subscriber} join (select queue_id, queue_name from {fx_queue} group by all) q using (queue_id) group by 1""")
def distinct_rows(fx):
    # one row per instance, queue and subscriber, although a queue is listed once per instance
    rows = samples.subscriber_stats(fx.subscriber, fx.queue)
    pairs = rows.select("queue_name", F.struct("inst_id", "subscriber_name").alias("pair"))
    return samples.distinct_pairs(pairs, "queue_name", "pair", "subscribers")


@query("t_5_owner_instance", "select min(inst_id) as inst_id from {fx_queue}")
def owner_instance(fx):
    return samples.owner_instance(fx.queue)


@query("agg_16_segment_sizes", """
select segment_name, cast(sum(bytes) as bigint) as bytes from {fx_segment} where segment_type = 'TABLE' group by 1""")
def segment_sizes(fx):
    return samples.segment_sizes(fx.segment, "TABLE")


for _type in ("TABLE", "TABLE PARTITION", "CLUSTER"):
    @query(f"t_2_top_{_type.lower().replace(' ', '_')}_segments", f"""
select segment_name, cast(sum(bytes) as bigint) as bytes from {{fx_segment}} where segment_type = '{_type}' group by 1
order by bytes desc, segment_name limit 100""")
    def top_segments(fx, _type=_type):
        return samples.top_segments(fx.segment, _type, 100)


# --- scalar functions -----------------------------------------------------------------

@query("s_1_clean_name", """
select p_partkey, lower(replace(replace(replace(replace(replace(replace(concat(p_name, ' (', p_type, ')/*', p_brand), ' ', '_'), '(', ''), ')', ''), '/', ''), '*', ''), '#', '#')) as name
from {part}""")
def clean_name(fx):
    text = F.concat("p_name", F.lit(" ("), "p_type", F.lit(")/*"), "p_brand")
    return fx.part.select("p_partkey", S.clean_name(text).alias("name"))


@query("s_2_mask_dsn", """
select c_custkey, case when c_custkey % 3 = 0 then c_name when c_custkey % 3 = 1 then concat('***@', c_mktsegment)
  else concat('***@', 'pw') end as dsn from {customer}""")
def mask_dsn(fx):
    kind = F.col("c_custkey") % 3
    dsn = (F.when(kind == 0, F.col("c_name")).when(kind == 1, F.concat("c_name", F.lit("/x@"), "c_mktsegment"))
           .otherwise(F.concat("c_name", F.lit("@pw@"), "c_mktsegment")))
    return fx.customer.select("c_custkey", S.mask_dsn(dsn).alias("dsn"))


@query("s_3_metric_value", """
select seq, case when value_1 = '<nil>' then 0.0 else try_cast(trim(value_1) as double) end as value from {fx_metric_rows}""")
def metric_value(fx):
    return fx.metric_rows.select("seq", S.parse_metric_value(F.col("value_1")).alias("value"))


@query("s_4_metric_id", """
select p_partkey, concat(p_type, '_', least(lower(p_name), lower(p_brand)), '_', greatest(lower(p_name), lower(p_brand))) as id from {part}""")
def metric_id(fx):
    return fx.part.select("p_partkey", S.metric_id(F.col("p_type"), F.array("p_name", "p_brand")).alias("id"))


@query("s_5_duration", """
select event_id, case when event_id % 4 = 0 then cast(user_id * 60 + event_id % 60 as double) when event_id % 4 = 1 then cast(user_id as double) * 3600
  when event_id % 4 = 2 then -1.5 end as seconds from {events}""")
def duration(fx):
    kind = F.col("event_id") % 4
    text = (F.when(kind == 0, F.concat(F.col("user_id").cast("string"), F.lit("m"), (F.col("event_id") % 60).cast("string"), F.lit("s")))
            .when(kind == 1, F.concat(F.col("user_id").cast("string"), F.lit("h"))).when(kind == 2, F.lit("-1.5s"))
            .otherwise(F.concat(F.col("user_id").cast("string"), F.lit(" days"))))
    return fx.events.select("event_id", S.parse_duration(text).alias("seconds"))


@query("s_6_lag_interval", """
select seq, case when value = 'UNKNOWN' then null when regexp_matches(value, '^[+-]?[0-9]+ ') then
  (case when value like '-%' then -1 else 1 end) * (cast(regexp_extract(value, '^[+-]?([0-9]+) ', 1) as double) * 86400
    + cast(regexp_extract(value, ' ([0-9]{{2}}):', 1) as double) * 3600 + cast(regexp_extract(value, ':([0-9]{{2}}):', 1) as double) * 60
    + cast(regexp_extract(value, ':([0-9.]+)$', 1) as double))
  else cast(value as double) end as seconds
from {fx_lag}""")
def lag_interval(fx):
    return fx.lag.select("seq", S.parse_lag_interval(F.col("value")).alias("seconds"))


@query("s_7_lag_timestamp", """
select event_id, case when event_id % 3 = 0 then null else cast(ts as timestamp) end as at,
  case when event_id % 3 = 0 then null else date_trunc('second', cast(ts as timestamp)) end as at_second
from {events}""")
def lag_timestamp(fx):
    at, kind = F.col("ts").cast("timestamp"), F.col("event_id") % 3
    text = F.when(kind == 0, F.lit("yesterday")).when(kind == 1, F.date_format(at, "MM/dd/yyyy HH:mm:ss.SSSSSS")).otherwise(
        F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return fx.events.select("event_id", S.parse_lag_timestamp(text).alias("at"),
                            S.parse_lag_timestamp(F.substring_index(text, ".", 1)).alias("at_second"))


@query("s_8_day_start", "select event_id, date_trunc('day', cast(ts as timestamp)) as day_start from {events}")
def day_start(fx):
    return fx.events.select("event_id", S.day_start_utc(F.col("ts").cast("timestamp")).alias("day_start"))


@query("s_9_partition_day", """
select o_orderkey, case when o_orderkey % 2 = 0 then cast(o_orderdate as date) end as day from {orders}""")
def partition_day(fx):
    day = F.date_format("o_orderdate", "yyyy_MM_dd")
    name = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("sql_samples_"), day)).otherwise(
        F.concat(F.lit("other_samples_"), day))
    return fx.orders.select("o_orderkey", S.partition_day("sql_samples", name).alias("day"))


@query("s_10_retry_backoff", """
select event_id, cast(case when event_id % 12 = 0 then 0 else least(900, 60 * power(2, least(event_id % 12 - 1, 10))) end as bigint) as seconds from {events}""")
def retry_backoff(fx):
    return fx.events.select("event_id", S.retry_backoff(F.col("event_id") % 12).alias("seconds"))


@query("s_11_strip_newline", """
select conv_id, turn, case when turn % 2 = 0 then text else concat(text, chr(10)) end as text from {conversations}""")
def strip_newline(fx):
    doubled = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit("\n"))).otherwise(F.concat("text", F.lit("\n\n")))
    return fx.conversations.select("conv_id", "turn", S.strip_one_newline(doubled).alias("text"))


@query("s_12_null_to_empty", "select seq, coalesce(wait_class, '') as wait_class from {fx_session}")
def null_to_empty(fx):
    return fx.session.select("seq", S.null_to_empty(F.col("wait_class")).alias("wait_class"))


@query("s_13_ages", f"""
select event_id, cast(epoch_us(timestamp '{AS_OF}') - epoch_us(cast(ts as timestamp)) as double) / 1000000.0 as age_seconds from {{events}}""")
def ages(fx):
    return fx.events.select("event_id", S.age_seconds(fx.as_of, F.col("ts").cast("timestamp")).alias("age_seconds"))


@query("s_14_conditional_math", """
select event_id, value * 100.0 / nullif(cast(user_id % 3 as double), 0) as share, greatest(nullif(user_id % 2, 0), 0) as floor_zero,
  round(value, 1) as rounded from {events}""")
def conditional_math(fx):
    zero = F.lit(0).cast("long")
    return fx.events.select(
        "event_id", S.ratio_percent(F.col("value"), F.col("user_id") % 3).alias("share"),
        F.greatest(F.nullif(F.col("user_id") % 2, zero), zero).alias("floor_zero"), F.round("value", 1).alias("rounded"))


@query("s_15_json", """
select event_id, cast(json_extract(props, '$.k') as bigint) as k,
  concat('{{"source_database":"db', cast(user_id % 4 as string), '","type":"', event_type, '"}}') as labels from {events}""")
def json(fx):
    labels = F.create_map(F.lit("type"), F.col("event_type"), F.lit("source_database"),
                          F.concat(F.lit("db"), (F.col("user_id") % 4).cast("string")))
    return fx.events.select("event_id", F.from_json("props", "k long").getField("k").alias("k"),
                            S.labels_json(labels).alias("labels"))
