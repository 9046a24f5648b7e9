"""Projections of the given tables onto the engine's inputs.

Each text is valid in Spark SQL and in DuckDB (session time zone UTC), reads its
whole tables and is deterministic.  ``{name}`` stands for a table or another adapter.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.session import adopt

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]
AS_OF = "2024-01-31 00:00:00"
AS_OF_ORDERS = "2001-08-02 00:00:00"

COLLECTORS = ["operational.tablespaces", "operational.resource_limits", "operational.asm_diskgroups",
              "operational.instance", "operational.cpu_io_counters", "operational.database_status",
              "operational.dataguard"]

_DB4 = "concat('db', cast(event_id % 4 as string))"
_INST4 = "cast(floor(event_id / 4) as bigint) % 4 + 1"
_INST3 = "cast(floor(event_id / 4) as bigint) % 3 + 1"

ADAPTERS: dict[str, str] = {
    "fx_counter": """
select event_id as seq, cast(ts as timestamp) as collected_at, concat('db', cast(user_id % 4 as string)) as source_database,
  user_id % 2 + 1 as inst_id, cast(0 as bigint) as con_id, event_type as stat_name,
  (event_id * 37) % 1009 as cumulative_value
from {events}""",
    # A third of the readings has no arrival number, a few have no time.
    "fx_counter_null_seq": """
select case when event_id % 3 <> 0 or event_id % 50 = 1 then event_id end as seq, case when event_id % 50 <> 1 then cast(ts as timestamp) end as collected_at,
  concat('db', cast(user_id % 4 as string)) as source_database, cast(1 as bigint) as inst_id, cast(0 as bigint) as con_id,
  'user calls' as stat_name, (event_id * 37) % 1009 as cumulative_value
from {events}""",
    # Two of three readings belong to one series.
    "fx_counter_hot": """
select event_id as seq, cast(ts as timestamp) as collected_at,
  case when event_id % 3 < 2 then 'db0' else concat('db', cast(user_id % 50 as string)) end as source_database,
  cast(1 as bigint) as inst_id, cast(0 as bigint) as con_id, 'user calls' as stat_name, (event_id * 37) % 1009 as cumulative_value
from {events}""",
    "fx_sqlstats": """
select date_trunc('hour', cast(ts as timestamp)) as collected_at, concat('db', cast(user_id % 2 as string)) as source_database,
  user_id % 2 + 1 as inst_id, concat('sql', cast(user_id % 15 as string)) as sql_id, user_id % 3 + 1 as plan_hash_value,
  max((event_id * 53) % 7919) as elapsed_time_micro, max((event_id * 31) % 4001) as cpu_time_micro,
  max((event_id * 17) % 997) as user_io_wait_micro, count(*) as executions
from {events} group by 1, 2, 3, 4, 5""",
    # Raw statistics: several container rows per statement and snapshot.
    "fx_rawstats": """
select event_id as seq, date_trunc('hour', cast(ts as timestamp)) as collected_at,
  concat('db', cast(user_id % 2 as string)) as source_database, user_id % 2 + 1 as inst_id,
  case when event_type = 'signup' then null else concat('sql', cast(user_id % 15 as string)) end as sql_id,
  user_id % 3 + 1 as plan_hash_value, event_id % 50 as executions, (event_id * 53) % 7919 as elapsed_time,
  (event_id * 31) % 4001 as cpu_time, (event_id * 17) % 997 as user_io_wait_time, event_id % 11 as application_wait_time,
  event_id % 13 as concurrency_wait_time, event_id % 17 as cluster_wait_time, event_id % 19 as buffer_gets,
  event_id % 23 as disk_reads, event_id % 29 as direct_writes, event_id % 31 as rows_processed, event_id % 37 as fetches,
  event_id % 41 as loads, event_id % 43 as invalidations, event_id % 47 as parse_calls,
  cast(ts as timestamp) as last_active_time
from {events}""",
    # One session per event: the session id is unique within a snapshot.
    "fx_session": f"""
select event_id as seq, date_trunc('day', cast(ts as timestamp)) as collected_at, {_DB4} as source_database,
  {_INST3} as inst_id, event_id as sid, user_id as serial_number, user_id, concat('user', cast(user_id as string)) as username,
  case when event_type in ('click', 'view', 'error') then 'ACTIVE' else 'INACTIVE' end as status,
  case when event_type = 'signup' then 'BACKGROUND' else 'USER' end as type,
  case when event_type = 'error' then 'WAITING' else 'WAITED' end as state,
  concat('event ', event_type) as event,
  case when user_id % 7 = 0 then 'Idle' when user_id % 7 = 1 then null else 'User I/O' end as wait_class,
  user_id * 10 as wait_time_micro, user_id % 60 as seconds_in_wait,
  concat('sql', cast(user_id % 15 as string)) as sql_id, user_id % 3 as sql_child_number,
  concat('sql', cast(event_id % 20 as string)) as prev_sql_id,
  case when event_type = 'error' then event_id - 12 * (1 + event_id % 3) end as blocking_session,
  case when event_type = 'error' then {_INST3} end as blocking_instance,
  user_id % 50 as audit_session_id, cast(7 as bigint) as own_session_id
from {{events}}""",
    "fx_cursor": """
select event_id as seq, cast(ts as timestamp) as collected_at, concat('db', cast(user_id % 2 as string)) as source_database,
  user_id % 2 + 1 as inst_id, concat('sql', cast(user_id % 15 as string)) as sql_id, event_id % 12 as child_number,
  user_id % 3 + 1 as plan_hash_value, case when event_type = 'view' then null else concat('APP_', event_type) end as parsing_schema_name,
  concat('mod_', cast(event_id % 4 as string)) as module, (event_id * 53) % 7919 as elapsed_time_micro,
  event_type
from {events}""",
    "fx_capacity": """
select cast(o_orderdate as timestamp) as collected_at, concat('db', cast(o_custkey % 4 as string)) as source_database,
  o_orderpriority as object_name, max(cast(floor(o_totalprice) as bigint)) as used_bytes,
  cast(500000 as bigint) as max_bytes, max(cast(floor(o_totalprice) as bigint)) + 20000 as allocated_bytes
from {orders} group by 1, 2, 3""",
    # Last attempt per database; db3's last attempt failed later than its last rows.
    "fx_last_order": """
select concat('db', cast(o_custkey % 4 as string)) as source_database, max(cast(o_orderdate as timestamp)) as last_at
from {orders} group by 1""",
    "fx_capacity_status": " union all ".join(f"""
select source_database, '{collector}' as collector,
  case when source_database = 'db3' then last_at + interval '1' hour else last_at end as collected_at,
  source_database <> 'db3' as success
from {{fx_last_order}}""" for collector in COLLECTORS),
    "fx_tablespace": """
select collected_at, source_database, object_name as tablespace_name, 'PERMANENT' as contents, used_bytes,
  max_bytes - used_bytes as free_bytes, max_bytes, cast(used_bytes as double) * 100.0 / cast(max_bytes as double) as used_percent,
  allocated_bytes
from {fx_capacity}""",
    "fx_limit": """
select collected_at, source_database, cast(1 as bigint) as inst_id, object_name as resource_name, used_bytes as current_value,
  used_bytes as max_value, max_bytes as initial_limit,
  case when object_name like '1%' then null when object_name like '2%' then cast(0 as bigint) else max_bytes end as limit_value,
  object_name like '1%' as limit_unlimited
from {fx_capacity}""",
    "fx_diskgroup": """
select collected_at, source_database, cast(1 as bigint) as inst_id, object_name as diskgroup_name,
  cast(floor(max_bytes / 100000) as bigint) * 100000 as total_bytes,
  max_bytes - cast(floor(used_bytes / 100000) as bigint) * 100000 as free_bytes,
  case when object_name like '3%' then null else cast(50000 as bigint) end as usable_bytes
from {fx_capacity}""",
    "fx_status": """
select event_id as seq, cast(ts as timestamp) as collected_at, concat('db', cast(user_id % 10 as string)) as source_database,
  case when user_id % 3 = 0 then 'connectivity' when user_id % 3 = 1 then 'scheduled' else 'activity' end as collector,
  event_type <> 'error' as success, cast(value as double) / cast(100 as double) as duration_seconds, event_id % 100 as sample_count,
  case when event_type = 'error' then 'ORA-12514: no service' end as error_message, event_type
from {events}""",
    "fx_status_hour": """
select seq, date_trunc('day', collected_at) as collected_at, source_database, collector, success, duration_seconds, sample_count,
  error_message, event_type
from {fx_status}""",
    "fx_latest_status": """
select seq, collected_at, source_database, collector, success, duration_seconds, sample_count, error_message
from (select *, row_number() over (partition by source_database, collector order by collected_at desc, seq desc) as rn
      from {fx_status}) s
where rn = 1""",
    # Every row polled twice, some without serial number.
    "fx_activity": " union all ".join(f"""
select event_id as sample_id, cast(ts as timestamp) as sample_time, concat('db', cast(user_id % 4 as string)) as source_database,
  user_id % 2 + 1 as inst_id, user_id as session_id, case when user_id % 5 = 0 then null else event_id end as session_serial_number,
  concat('sql', cast(user_id % 15 as string)) as sql_id, cast({poll} as bigint) as poll, cast(ts as timestamp) as collected_at,
  concat('sql', cast(event_id % 20 as string)) as top_level_sql_id, user_id % 3 as sql_child_number,
  user_id % 3 + 1 as sql_plan_hash_value, event_id % 5 as sql_plan_line_id, event_type
from {{events}}""" for poll in (1, 2)),
    "fx_history": """
select event_id as sample_id, cast(ts as timestamp) as sample_time, cast(ts as timestamp) as collected_at,
  concat('db', cast(user_id % 4 as string)) as source_database, user_id % 2 + 1 as inst_id, user_id as session_id,
  event_id as session_serial, case when event_type = 'signup' then 'BACKGROUND' else 'FOREGROUND' end as session_type,
  case when user_id % 5 = 0 then null when user_id % 5 = 1 then cast(0 as bigint) else user_id * 1000 end as usecs_per_row
from {events}""",
    "fx_runtime": """
select event_id as seq, cast(ts as timestamp) as observed_at, concat('scope', cast(user_id % 3 as string)) as ha_scope,
  event_type as scheduler, cast(600 as double) as configured_interval_seconds, value as scheduling_lag_seconds,
  value * cast(1.5 as double) as total_duration_seconds, value * cast(0.5 as double) as write_duration_seconds,
  event_id % 4 as missed_intervals, user_id % 11 <> 0 as write_success,
  case when user_id % 13 = 0 then cast(0 as double) else cast(5 as double) end as configured_query_timeout_seconds
from {events}""",
    "fx_latest_runtime": """
select * from (select *, row_number() over (partition by ha_scope, scheduler order by observed_at desc, seq) as rn
  from {fx_runtime}) r where rn = 1""",
    "fx_cycle": """
select event_id as cycle_id, cast(ts as timestamp) as scheduled_at,
  cast(ts as timestamp) + user_id * interval '50' millisecond - interval '1' second as started_at,
  cast(ts as timestamp) + user_id * interval '70' millisecond as collection_finished_at,
  cast(ts as timestamp) + user_id * interval '90' millisecond as finished_at,
  cast(2 as double) as configured_interval_seconds, event_id % 3 as missed_intervals,
  cast(10 as bigint) as databases_attempted, event_id % 4 as error_count, event_id % 10 as databases_succeeded,
  concat('note ', event_type) as error_message
from {events}""",
    "fx_cycle_status": """
select event_id - event_id % 5 as cycle_id, case when user_id % 3 = 0 then 'connectivity' else 'scheduled' end as collector,
  event_type <> 'error' as success
from {events}""",
    "fx_metric_rows": """
select event_id as seq, cast(ts as timestamp) as collected_at, concat('db', cast(user_id % 4 as string)) as source_database,
  event_type as label_1, cast(user_id % 7 as string) as label_2,
  case when event_id % 10 = 0 then '<nil>' when event_id % 10 = 1 then 'junk' else concat(' ', cast(event_id as string), ' ') end as value_1,
  cast(user_id as string) as value_2
from {events}""",
    "fx_segment": """
select p_brand as segment_name, case when p_size % 3 = 0 then 'TABLE' when p_size % 3 = 1 then 'CLUSTER' else 'TABLE PARTITION' end as segment_type,
  cast(floor(p_retailprice) as bigint) as bytes
from {part}""",
    "fx_lag": """
select source_database, name, seq,
  case when seq % 5 = 0 then 'UNKNOWN' when seq % 5 = 1 then '12.5'
       when seq % 5 = 2 then concat('-00 00:00:', lpad(cast(seq % 60 as string), 2, '0'))
       else concat('+0', cast(seq % 7 as string), ' 0', cast(seq % 9 as string), ':', lpad(cast(seq % 60 as string), 2, '0'), ':04.5') end as value
from (
  select concat('db', cast(c_custkey % 300 as string)) as source_database, c_custkey as seq,
    case when c_nationkey % 4 = 0 then 'transport lag' when c_nationkey % 4 = 1 then 'apply lag'
         when c_nationkey % 4 = 2 then 'apply finish time' else 'estimated startup time' end as name
  from {customer}
) src""",
    "fx_instance": f"""
select date_trunc('day', cast(ts as timestamp)) as collected_at, {_DB4} as source_database, {_INST4} as inst_id,
  concat('inst', cast({_INST4} as string)) as instance_name, 'OPEN' as status, 'ACTIVE' as database_status,
  min(cast(ts as timestamp)) as startup_time
from {{events}} group by 1, 2, 3, 4""",
    "fx_database": f"""
select date_trunc('day', cast(ts as timestamp)) as collected_at, {_DB4} as source_database, {_INST3} as inst_id,
  min(event_id) as dbid, concat('unique_', {_DB4}) as db_unique_name,
  max(case when event_type = 'view' then 'READ ONLY' else 'READ WRITE' end) as open_mode,
  case when event_id % 2 = 0 then 'PRIMARY' else 'PHYSICAL STANDBY' end as database_role, 'YES' as cdb,
  cast(1 as bigint) as con_id, 'CDB$ROOT' as con_name, 'Linux x86 64-bit' as platform_name,
  'MAXIMUM PERFORMANCE' as protection_mode, 'UNPROTECTED' as protection_level
from {{events}} group by 1, 2, 3, 5, 7""",
    "fx_product": f"""
select date_trunc('day', cast(ts as timestamp)) as collected_at, {_DB4} as source_database,
  case when user_id % 9 = 0 then 'Oracle Database 19c Enterprise Edition' when user_id % 9 = 1 then 'Oracle Database 19c Standard Edition 2'
       when user_id % 9 = 2 then 'Oracle Database 12c Standard Edition' when user_id % 9 = 3 then 'Oracle Database 23ai Free'
       else 'PL/SQL' end as product,
  cast(max(user_id % 9 + 10) as string) as version, cast(max(user_id % 9 + 10) * 10 as string) as version_full
from {{events}} group by 1, 2, 3""",
    "fx_process": f"""
select date_trunc('day', cast(ts as timestamp)) as collected_at, {_DB4} as source_database, {_INST3} as inst_id from {{events}}""",
    "fx_parameter": f"""
select date_trunc('day', cast(ts as timestamp)) as collected_at, {_DB4} as source_database, {_INST3} as inst_id,
  case when event_type = 'click' then 'cpu_count' when event_type = 'view' then 'sga_max_size'
       when event_type = 'error' then 'pga_aggregate_limit' else 'other' end as name,
  cast(event_id % 6400 as string) as value
from {{events}}""",
    "fx_memory": f"""
select date_trunc('day', cast(ts as timestamp)) as collected_at, {_DB4} as source_database, {_INST3} as inst_id, user_id % 2 as con_id,
  case when event_type = 'click' then 'total PGA allocated' when event_type = 'view' then 'maximum PGA allocated'
       else 'cache hit percentage' end as name,
  event_id * 1000 as value
from {{events}}""",
    "fx_rawlimit": """
select date_trunc('hour', cast(ts as timestamp)) as collected_at, concat('db', cast(user_id % 4 as string)) as source_database,
  user_id % 2 + 1 as inst_id, event_type as resource_name, event_id as seq, event_id % 100 as current_utilization,
  event_id % 200 as max_utilization,
  case when event_id % 3 = 0 then ' UNLIMITED' else concat('  ', cast(event_id as string)) end as initial_allocation,
  case when event_id % 4 = 0 then ' UNLIMITED ' when event_id % 4 = 1 then 'n/a' else concat(' ', cast(event_id as string), ' ') end as limit_value
from {events}""",
    "fx_ts": """
select timestamp '2001-08-01 00:00:00' as collected_at, concat('db', cast(p_size % 4 as string)) as source_database,
  p_brand as tablespace_name, max(case when p_size > 47 then 'UNDO' when p_size < 4 then 'TEMPORARY' else 'PERMANENT' end) as contents,
  cast(8192 as bigint) as block_size
from {part} group by 1, 2, 3""",
    "fx_ts_usage": """
select timestamp '2001-08-01 00:00:00' as collected_at, concat('db', cast(p_size % 4 as string)) as source_database,
  p_brand as tablespace_name, cast(sum(p_size) as bigint) as used_space, cast(sum(p_size) + count(*) * 10 as bigint) as tablespace_size,
  cast(max(p_size) as double) as used_percent
from {part} group by 1, 2, 3""",
    "fx_temp": """
select timestamp '2001-08-01 00:00:00' as collected_at, concat('db', cast(s_nationkey % 4 as string)) as source_database,
  concat('TEMP', cast(s_nationkey as string)) as tablespace_name,
  case when s_nationkey % 6 = 0 then cast(0 as bigint) else cast(sum(s_suppkey) + 1000 as bigint) end as tablespace_size,
  case when s_nationkey % 6 = 0 then cast(0 as bigint) else cast(count(*) as bigint) * 7 end as free_space
from {supplier} group by 1, 2, 3, s_nationkey""",
    "fx_data_files": """
select timestamp '2001-08-01 00:00:00' as collected_at, concat('db', cast(p_size % 4 as string)) as source_database,
  p_brand as tablespace_name, cast(floor(p_retailprice) as bigint) as bytes
from {part}""",
    "fx_temp_files": """
select timestamp '2001-08-01 00:00:00' as collected_at, concat('db', cast(c_nationkey % 4 as string)) as source_database,
  case when c_custkey % 2 = 0 then concat('TEMP', cast(c_nationkey as string)) else concat('Brand#', cast(c_nationkey as string)) end as tablespace_name,
  c_custkey as bytes
from {customer}""",
    "fx_asm": """
select timestamp '2001-08-01 00:00:00' as collected_at, concat('db', cast(s_nationkey % 5 as string)) as source_database,
  s_suppkey % 3 + 1 as inst_id, concat('DG', cast(s_nationkey as string)) as name, cast(sum(s_suppkey) + 5000 as bigint) as total_mb,
  cast(count(*) as bigint) as free_mb, case when s_nationkey % 3 = 0 then null else cast(min(s_suppkey) as bigint) end as usable_file_mb
from {supplier} group by 1, 2, 3, 4, s_nationkey""",
    "fx_datafile": """
select timestamp '2001-08-01 00:00:00' as collected_at, concat('db', cast(c_nationkey % 5 as string)) as source_database,
  case when c_nationkey % 5 = 2 then concat('/u01/', c_name) when c_custkey % 3 = 0 then concat('/u02/', c_name) else concat('+DATA/', c_name) end as name
from {customer}""",
    "fx_dginst": """
select timestamp '2001-08-01 00:00:00' as collected_at, concat('db', cast(s_nationkey % 5 as string)) as source_database,
  s_suppkey % 6 + 1 as inst_id
from {supplier} group by 1, 2, 3""",
    "fx_dgdatabase": """
select timestamp '2001-08-01 00:00:00' as collected_at, concat('db', cast(n_nationkey % 8 as string)) as source_database,
  cast(1 as bigint) as inst_id, case when n_nationkey % 8 in (1, 3) then 'PHYSICAL STANDBY' else 'PRIMARY' end as database_role
from {nation} group by 1, 2, 3, 4""",
    "fx_dest": """
select timestamp '2001-08-01 00:00:00' as collected_at, concat('db', cast(s_nationkey % 5 as string)) as source_database,
  s_suppkey % 2 + 1 as inst_id, s_suppkey as dest_id, concat('LOG_', cast(s_suppkey as string)) as dest_name,
  case when s_nationkey % 3 = 0 then 'STANDBY' else 'PRIMARY' end as target,
  case when s_nationkey % 7 = 0 then null else s_name end as destination,
  case when s_suppkey % 9 = 0 then 'error' when s_suppkey % 9 = 1 then null else 'VALID' end as status,
  case when s_nationkey % 2 = 0 then null else 'remote' end as db_unique_name,
  case when s_suppkey % 10 = 0 then 'ORA-16198: timeout' when s_suppkey % 10 = 1 then '' end as error
from {supplier}""",
    "fx_dest_status": """
select timestamp '2001-08-01 00:00:00' as collected_at, concat('db', cast(s_nationkey % 5 as string)) as source_database,
  case when s_acctbal < 500 then cast(9 as bigint) else s_suppkey % 2 + 1 end as inst_id, s_suppkey as dest_id,
  case when s_nationkey % 4 = 0 then null when s_nationkey % 4 = 1 then 'local' when s_nationkey % 4 = 2 then 'PHYSICAL'
       else 'cross-instance' end as type,
  case when s_suppkey % 8 = 0 then 'LOCALLY UNRESOLVABLE GAP' when s_suppkey % 8 = 1 then null else 'no gap' end as gap_status,
  s_suppkey * 2 as archived_seq, s_suppkey as applied_seq
from {supplier}""",
    "fx_dgproc": """
select timestamp '2001-08-01 00:00:00' as collected_at, concat('db', cast(c_nationkey % 5 as string)) as source_database,
  c_custkey % 4 + 1 as inst_id, case when c_custkey % 5 = 0 then 'MRP0' when c_custkey % 5 = 1 then 'RFS' else 'ARC1' end as name,
  case when c_custkey % 7 = 0 then 'Managed Recovery' when c_custkey % 7 = 1 then 'recovery logmerger' when c_custkey % 7 = 2 then null
       else 'archive local' end as role,
  concat('ACTION_', c_mktsegment) as action, c_custkey % 3 as thread, c_custkey as sequence
from {customer}""",
    "fx_sysstat": """
select event_id as seq, date_trunc('hour', cast(ts as timestamp)) as collected_at, concat('db', cast(user_id % 4 as string)) as source_database,
  user_id % 2 + 1 as inst_id, case when event_id % 6 = 0 then cast(1 as bigint) else cast(0 as bigint) end as con_id,
  case when event_type = 'click' then 'physical read total IO requests' when event_type = 'view' then 'user commits'
       when event_type = 'error' then 'redo size' when event_type = 'signup' then 'sorts (disk)'
       else 'physical write total bytes' end as name, event_id as value
from {events}""",
    "fx_time_model": """
select event_id as seq, date_trunc('hour', cast(ts as timestamp)) as collected_at, concat('db', cast(user_id % 4 as string)) as source_database,
  user_id % 2 + 1 as inst_id, case when event_id % 6 = 0 then cast(1 as bigint) else cast(0 as bigint) end as con_id,
  case when event_type = 'click' then 'DB CPU' when event_type = 'view' then 'DB time' else 'parse time elapsed' end as name,
  event_id * 100 as value
from {events}""",
    "fx_wait": """
select event_id as seq, cast(ts as timestamp) as collected_at, concat('db', cast(user_id % 4 as string)) as source_database,
  user_id % 2 + 1 as inst_id, cast(0 as bigint) as con_id,
  case when event_type = 'click' then 'Idle' when event_type = 'view' then null else concat('class ', event_type) end as wait_class,
  cast(event_id as double) * cast(1.00005 as double) as time_waited
from {events}""",
    "fx_sysmetric": """
select event_id as seq, cast(ts as timestamp) as collected_at, concat('db', cast(user_id % 4 as string)) as source_database,
  user_id % 2 + 1 as inst_id, cast(0 as bigint) as con_id,
  case when event_type = 'click' then 'Buffer Cache Hit Ratio' when event_type = 'view' then 'Host CPU Utilization (%)'
       when event_type = 'error' then 'Redo Allocation Hit Ratio' else 'Database Wait Time Ratio' end as metric_name, value
from {events}""",
    "fx_text": """
select event_id as seq, date_trunc('hour', cast(ts as timestamp)) as collected_at, concat('db', cast(user_id % 2 as string)) as source_database,
  concat('sql', cast(user_id % 60 as string)) as sql_id, concat('select ', cast(event_id as string), ' from t') as sql_fulltext, event_type
from {events}""",
    "fx_plan": """
select event_id as seq, cast(ts as timestamp) as collected_at, concat('db', cast(user_id % 2 as string)) as source_database,
  user_id % 2 + 1 as inst_id, concat('sql', cast(user_id % 15 as string)) as sql_id, event_id % 40 as child_number,
  user_id % 3 + 1 as plan_hash_value, event_id % 5 as plan_line_id, concat('OP ', event_type) as operation, user_id as cost, event_type
from {events}""",
    "fx_log": """
select event_id as seq, cast(ts as timestamp) as originating_timestamp, concat('db', cast(user_id % 10 as string)) as source_database,
  case when event_id % 2 = 0 then null else 'module' end as module_id, cast(null as string) as execution_context_id,
  concat(event_type, ' ', props) as message_text
from {events}""",
    "fx_queue": """
select l_suppkey % 4 as inst_id, l_partkey as queue_id, concat('queue', cast(l_partkey % 700 as string)) as queue_name
from {lineitem} group by 1, 2, 3""",
    "fx_subscriber": """
select l_suppkey % 4 as inst_id, l_partkey as queue_id, l_suppkey as subscriber_id, l_orderkey % 1000 as enqueued_msgs,
  l_orderkey % 900 as dequeued_msgs, cast(l_linenumber as bigint) as time_since_last_dequeue, l_orderkey % 77 as estd_time_to_drain_no_enq
from {lineitem}""",
    "fx_connection": """
select event_id as seq, cast(ts as timestamp) as event_at, concat('db', cast(user_id % 40 as string)) as source_database,
  case when event_type = 'error' then 'failure' when event_type = 'click' then 'probe_start'
       when event_type = 'view' then 'probe_failed' when event_type = 'signup' then 'probe_ok' else 'activate' end as kind,
  case when event_type in ('error', 'view') then concat('broken ', cast(event_id as string)) end as message,
  case when event_type in ('view', 'signup') then value end as duration_seconds
from {events}""",
    "fx_evaluation": """
select event_type as rule_id, date_trunc('hour', cast(ts as timestamp)) as as_of, concat('db', cast(user_id % 4 as string)) as source_database,
  max(value) as value
from {events} group by 1, 2, 3""",
    "fx_document_text": """
select doc_id as seq, timestamp '2024-01-01 00:00:00' as collected_at, source as source_database,
  concat('doc', cast(doc_id as string)) as sql_id,
  case when n_chars % 9 = 0 then concat('  ', chr(10), ' ') when n_chars % 9 = 1 then null else text end as sql_fulltext
from {documents}""",
}


def references(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


def with_adapters(body: str) -> str:
    """DuckDB text: the adapters a query names become common table expressions."""
    needed: list[str] = []

    def need(name: str) -> None:
        for inner in references(ADAPTERS.get(name, "")):
            need(inner)
        if name in ADAPTERS and name not in needed:
            needed.append(name)

    for name in references(body):
        need(name)
    names = {n: n for n in [*TABLES, *ADAPTERS]}
    ctes = [f"{n} as ({ADAPTERS[n].format(**names).strip()})" for n in needed]
    body = body.format(**names).strip()
    if not ctes:
        return body
    if body.lower().startswith("with recursive"):
        return f"with recursive {', '.join(ctes)}, {body[len('with recursive'):].strip()}"
    if body.lower().startswith("with "):
        return f"with {', '.join(ctes)}, {body[5:].strip()}"
    return f"with {', '.join(ctes)} {body}"


class Inputs:
    """Tables and adapters of one data folder as DataFrames, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = adopt(spark)
        self.sf_dir = sf_dir
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._frames:
            self._frames[name] = self._load(name)
        return self._frames[name]

    def _load(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        text = ADAPTERS[f"fx_{name}"]
        return self.spark.sql(text, **{r: self._load_ref(r) for r in references(text)})

    def _load_ref(self, ref: str) -> DataFrame:
        return getattr(self, ref.removeprefix("fx_"))

    @cached_property
    def as_of(self) -> Column:
        return F.lit(AS_OF).cast("timestamp")

    @cached_property
    def as_of_orders(self) -> Column:
        return F.lit(AS_OF_ORDERS).cast("timestamp")

    @cached_property
    def databases(self) -> DataFrame:
        return self.counter.select("source_database").distinct()
