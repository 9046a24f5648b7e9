"""Schemas of the landed source views and of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"bigint": T.LongType(), "string": T.StringType(), "timestamp": T.TimestampType(), "double": T.DoubleType(),
          "boolean": T.BooleanType(), "map<string,string>": T.MapType(T.StringType(), T.StringType())}


def layout(columns: str) -> T.StructType:
    """Schema of a column list like ``name type, name type``; needs no session."""
    pairs = (column.split() for column in columns.split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# --- fixed values: column lists of the landed views, between the columns that every view has -------------

_VIEWS = {
    "sqlstats": """
        inst_id bigint, sql_id string, plan_hash_value bigint, executions bigint, elapsed_time bigint,
        cpu_time bigint, user_io_wait_time bigint, application_wait_time bigint, concurrency_wait_time bigint,
        cluster_wait_time bigint, buffer_gets bigint, disk_reads bigint, direct_writes bigint,
        rows_processed bigint, fetches bigint, loads bigint, invalidations bigint, parse_calls bigint,
        last_active_time timestamp, con_id bigint""",
    "sql": """
        inst_id bigint, sql_id string, child_number bigint, plan_hash_value bigint, parsing_schema_name string,
        module string, sql_fulltext string, elapsed_time bigint, last_active_time timestamp""",
    "sql_plan": """
        inst_id bigint, sql_id string, child_number bigint, plan_hash_value bigint, id bigint, parent_id bigint,
        depth bigint, position bigint, operation string, options string, object_owner string, object_name string,
        object_type string, optimizer string, cost bigint, cardinality bigint, bytes bigint, cpu_cost bigint,
        io_cost bigint, temp_space bigint, partition_start string, partition_stop string, access_predicates string,
        filter_predicates string""",
    "session": """
        inst_id bigint, sid bigint, serial_number bigint, user_id bigint, username string, type string,
        status string, state string, sql_id string, sql_child_number bigint, prev_sql_id string,
        sql_exec_id bigint, sql_exec_start timestamp, event string, wait_class string, wait_time_micro bigint,
        seconds_in_wait bigint, blocking_instance bigint, blocking_session bigint, row_wait_obj bigint,
        row_wait_file bigint, row_wait_block bigint, machine string, program string, module string, action string,
        service_name string, client_identifier string, con_id bigint, audit_session_id bigint,
        logon_time timestamp""",
    "activity_history": """
        sample_id bigint, sample_time timestamp, inst_id bigint, session_id bigint, session_serial bigint,
        session_type string, user_id bigint, sql_id string, sql_child_number bigint, sql_exec_id bigint,
        sql_exec_start timestamp, top_level_sql_id string, session_state string, event string, wait_class string,
        wait_time bigint, time_waited bigint, blocking_session bigint, blocking_serial bigint,
        blocking_inst_id bigint, current_obj bigint, current_file bigint, current_block bigint, program string,
        module string, action string, machine string, pga_allocated bigint, temp_space_allocated bigint,
        con_id bigint, usecs_per_row bigint, sql_plan_hash_value bigint, sql_full_plan_hash_value bigint,
        sql_plan_line_id bigint, service_hash bigint, client_id string""",
    "instance": """
        inst_id bigint, instance_name string, status string, database_status string, startup_time timestamp""",
    "database": """
        inst_id bigint, dbid bigint, db_unique_name string, open_mode string, database_role string, cdb string,
        con_id bigint, con_name string, platform_name string, protection_mode string, protection_level string""",
    "product": """
        product string, version string, version_full string""",
    "process": """
        inst_id bigint""",
    "parameter": """
        inst_id bigint, name string, value string""",
    "sga": """
        inst_id bigint, con_id bigint, name string, value bigint""",
    "pgastat": """
        inst_id bigint, con_id bigint, name string, value bigint""",
    "resource_limit": """
        inst_id bigint, resource_name string, current_utilization bigint, max_utilization bigint,
        initial_allocation string, limit_value string""",
    "tablespace": """
        tablespace_name string, contents string, block_size bigint""",
    "tablespace_usage": """
        tablespace_name string, used_space bigint, tablespace_size bigint, used_percent double""",
    "temp_free": """
        tablespace_name string, tablespace_size bigint, free_space bigint""",
    "data_files": """
        tablespace_name string, bytes bigint""",
    "temp_files": """
        tablespace_name string, bytes bigint""",
    "asm_diskgroup": """
        inst_id bigint, name string, total_mb bigint, free_mb bigint, usable_file_mb bigint""",
    "datafile": """
        name string""",
    "sysstat": """
        inst_id bigint, con_id bigint, name string, value bigint""",
    "time_model": """
        inst_id bigint, con_id bigint, name string, value bigint""",
    "wait_class": """
        inst_id bigint, con_id bigint, wait_class string, time_waited bigint""",
    "sysmetric": """
        inst_id bigint, con_id bigint, metric_name string, value double, metric_unit string""",
    "archive_dest": """
        inst_id bigint, dest_id bigint, dest_name string, target string, destination string, status string,
        transmit_mode string, affirm string, valid_now string, db_unique_name string, applied_scn bigint,
        error string""",
    "archive_dest_status": """
        inst_id bigint, dest_id bigint, type string, database_mode string, recovery_mode string,
        protection_mode string, synchronized string, synchronization_status string, gap_status string,
        archived_thread bigint, archived_seq bigint, applied_thread bigint, applied_seq bigint""",
    "dataguard_stats": """
        name string, value string, time_computed string, datum_time string""",
    "dataguard_process": """
        inst_id bigint, name string, role string, action string, thread bigint, sequence bigint""",
    "alert_log": """
        originating_timestamp timestamp, module_id string, execution_context_id string, message_text string""",
    "segments": """
        segment_name string, segment_type string, bytes bigint""",
    "queues": """
        inst_id bigint, queue_id bigint, queue_name string""",
    "subscriber_stat": """
        inst_id bigint, queue_id bigint, subscriber_id bigint, enqueued_msgs bigint, dequeued_msgs bigint,
        time_since_last_dequeue bigint, estd_time_to_drain_no_enq bigint""",
}

# --- fixed values: column lists of the stored tables ------------------------------------------------------

_TABLES = {
    "metric_samples": """
        collected_at timestamp, source_database string, context string, metric_name string, metric_help string,
        metric_type string, value double, labels map<string,string>""",
    "sql_samples": """
        collected_at timestamp, source_database string, inst_id bigint, sql_id string, child_number bigint,
        plan_hash_value bigint, parsing_schema_name string, module string, executions bigint,
        elapsed_time_micro bigint, cpu_time_micro bigint, user_io_wait_micro bigint, application_wait_micro bigint,
        concurrency_wait_micro bigint, cluster_wait_micro bigint, buffer_gets bigint, disk_reads bigint,
        direct_writes bigint, rows_processed bigint, fetches bigint, loads bigint, invalidations bigint,
        parse_calls bigint, last_active_time timestamp""",
    "session_samples": """
        collected_at timestamp, source_database string, inst_id bigint, sid bigint, serial_number bigint,
        username string, status string, sql_id string, sql_child_number bigint, prev_sql_id string, event string,
        wait_class string, state string, seconds_in_wait bigint, blocking_instance bigint, blocking_session bigint,
        machine string, program string, module string, action string, service_name string, logon_time timestamp""",
    "blocking_session_samples": """
        collected_at timestamp, source_database string, inst_id bigint, sid bigint, serial_number bigint,
        username string, sql_id string, event string, wait_class string, blocking_instance bigint,
        blocking_session bigint, blocking_username string, blocking_sql_id string, blocking_event string""",
    "database_activity_samples": """
        collected_at timestamp, source_database string, sample_id bigint, sample_time timestamp, inst_id bigint,
        session_id bigint, session_serial_number bigint, session_type string, user_id bigint, sql_id string,
        sql_child_number bigint, sql_exec_id bigint, sql_exec_start timestamp, top_level_sql_id string,
        session_state string, event string, wait_class string, wait_time_micro bigint, time_waited_micro bigint,
        blocking_session bigint, blocking_session_serial_number bigint, blocking_inst_id bigint,
        current_object_id bigint, current_file_number bigint, current_block_number bigint, program string,
        module string, action string, machine string, pga_allocated bigint, temp_space_allocated bigint,
        con_id bigint, sample_source string, sample_duration_micro bigint, sql_plan_hash_value bigint,
        sql_full_plan_hash_value bigint, sql_plan_line_id bigint, service_hash bigint, service_name string,
        client_identifier string""",
    "database_status_samples": """
        collected_at timestamp, source_database string, inst_id bigint, instance_name string,
        instance_status string, database_status string, startup_time timestamp, open_mode string,
        database_role string, cdb string, con_id bigint, con_name string, platform_name string, dbid bigint,
        db_unique_name string, database_product string, database_edition string, database_version string,
        database_version_full string, protection_mode string, protection_level string""",
    "instance_samples": """
        collected_at timestamp, source_database string, inst_id bigint, user_sessions bigint,
        active_user_sessions bigint, background_sessions bigint, process_count bigint, cpu_count bigint,
        sga_max_bytes bigint, pga_aggregate_limit bigint, sga_allocated_bytes bigint, pga_allocated_bytes bigint,
        pga_max_allocated_bytes bigint""",
    "resource_limit_samples": """
        collected_at timestamp, source_database string, inst_id bigint, resource_name string, current_value bigint,
        max_value bigint, initial_limit bigint, limit_value bigint, limit_unlimited boolean""",
    "tablespace_samples": """
        collected_at timestamp, source_database string, tablespace_name string, contents string, used_bytes bigint,
        free_bytes bigint, max_bytes bigint, used_percent double, allocated_bytes bigint""",
    "asm_diskgroup_samples": """
        collected_at timestamp, source_database string, inst_id bigint, diskgroup_name string, total_bytes bigint,
        free_bytes bigint, usable_bytes bigint""",
    "system_counter_samples": """
        collected_at timestamp, source_database string, inst_id bigint, con_id bigint, stat_name string,
        cumulative_value bigint, delta_value bigint, interval_seconds double, counter_reset boolean""",
    "wait_class_samples": """
        collected_at timestamp, source_database string, inst_id bigint, con_id bigint, wait_class string,
        cumulative_wait_micro bigint, delta_wait_micro bigint, interval_seconds double, counter_reset boolean""",
    "system_metric_samples": """
        collected_at timestamp, source_database string, inst_id bigint, con_id bigint, metric_name string,
        value double, unit string""",
    "dataguard_destination_samples": """
        collected_at timestamp, source_database string, inst_id bigint, dest_id bigint, destination_name string,
        target string, destination string, status string, transmit_mode string, affirm string, valid_now string,
        db_unique_name string, destination_type string, database_mode string, recovery_mode string,
        protection_mode string, synchronized string, synchronization_status string, gap_status string,
        archived_thread bigint, archived_sequence bigint, applied_thread bigint, applied_sequence bigint,
        applied_scn bigint, error_message string""",
    "dataguard_lag_samples": """
        collected_at timestamp, source_database string, database_role string, transport_lag_seconds double,
        apply_lag_seconds double, apply_finish_time_seconds double, estimated_startup_seconds double,
        time_computed string, datum_time string, datum_age_seconds double""",
    "dataguard_process_samples": """
        collected_at timestamp, source_database string, inst_id bigint, database_role string,
        apply_processes bigint, transport_processes bigint, apply_status string, thread_number bigint,
        sequence_number bigint""",
    "scrape_status": """
        collected_at timestamp, source_database string, collector string, success boolean, duration_seconds double,
        sample_count bigint, error_message string""",
    "latest_scrape_status": """
        collected_at timestamp, source_database string, collector string, success boolean, duration_seconds double,
        sample_count bigint, error_message string""",
    "runtime_samples": """
        observed_at timestamp, scheduler string, trigger string, scraper_instance string, ha_scope string,
        scheduled_at timestamp, started_at timestamp, collection_finished_at timestamp, finished_at timestamp,
        configured_interval_seconds double, configured_query_timeout_seconds double, scheduling_lag_seconds double,
        collection_duration_seconds double, write_duration_seconds double, total_duration_seconds double,
        missed_intervals bigint, databases_attempted bigint, databases_succeeded bigint, sample_count bigint,
        error_count bigint, write_success boolean, error_message string""",
    "latest_runtime_status": """
        observed_at timestamp, scheduler string, trigger string, scraper_instance string, ha_scope string,
        scheduled_at timestamp, started_at timestamp, collection_finished_at timestamp, finished_at timestamp,
        configured_interval_seconds double, configured_query_timeout_seconds double, scheduling_lag_seconds double,
        collection_duration_seconds double, write_duration_seconds double, total_duration_seconds double,
        missed_intervals bigint, databases_attempted bigint, databases_succeeded bigint, sample_count bigint,
        error_count bigint, write_success boolean, error_message string""",
    "database_connection_state": """
        source_database string, observed_at timestamp, state string, queued_at timestamp,
        last_failure_at timestamp, last_failure string, last_probe_at timestamp,
        last_probe_duration_seconds double, last_probe_error string, probe_attempts bigint, recovered_at timestamp,
        scraper_instance string""",
    "sql_texts": """
        source_database string, sql_id string, sql_fulltext string, first_seen_at timestamp,
        last_text_seen_at timestamp, last_referenced_at timestamp""",
    "sql_cursor_metadata": """
        source_database string, inst_id bigint, sql_id string, child_number bigint, plan_hash_value bigint,
        parsing_schema_name string, module string, first_seen_at timestamp, last_seen_at timestamp""",
    "sql_plans": """
        source_database string, inst_id bigint, sql_id string, child_number bigint, plan_hash_value bigint,
        plan_line_id bigint, parent_id bigint, depth bigint, position bigint, operation string, options string,
        object_owner string, object_name string, object_type string, optimizer string, cost bigint,
        cardinality bigint, bytes bigint, cpu_cost bigint, io_cost bigint, temp_space bigint,
        partition_start string, partition_stop string, access_predicates string, filter_predicates string,
        first_seen_at timestamp, last_seen_at timestamp, last_referenced_at timestamp""",
    "repository_daily_ingest": """
        sample_day timestamp, source_database string, additional_metric_rows bigint, sql_sample_rows bigint,
        sql_text_writes bigint, sql_cursor_metadata_writes bigint, sql_plan_operation_writes bigint,
        session_sample_rows bigint, blocking_session_sample_rows bigint, database_activity_sample_rows bigint,
        database_status_sample_rows bigint, instance_sample_rows bigint, resource_limit_sample_rows bigint,
        tablespace_sample_rows bigint, asm_diskgroup_sample_rows bigint, system_counter_sample_rows bigint,
        wait_class_sample_rows bigint, system_metric_sample_rows bigint, dataguard_destination_rows bigint,
        dataguard_lag_rows bigint, dataguard_process_rows bigint, scrape_status_rows bigint,
        first_sample_at timestamp, last_sample_at timestamp, last_sql_sample_at timestamp,
        last_session_sample_at timestamp, last_database_activity_sample_at timestamp, last_flushed_at timestamp""",
}
# ------------------------------------------------------------------------------------------------------------


def _one_line(columns: str) -> str:
    return " ".join(columns.split())


RAW: dict[str, T.StructType] = {
    name: layout(f"source_database string, collected_at timestamp, {_one_line(columns)}, seq bigint") for name, columns in _VIEWS.items()
}
STORED: dict[str, T.StructType] = {name: layout(_one_line(columns)) for name, columns in _TABLES.items()}

# Column that gives the day partition of an append table.
EVENT_TIME = {
    **{name: "collected_at" for name, s in STORED.items() if "collected_at" in s.names
       and not name.startswith("latest_")},
    "database_activity_samples": "sample_time",
    "runtime_samples": "observed_at",
    "repository_daily_ingest": "sample_day",
    "consumer_snapshots": "collected_at",
    "consumer_deltas": "collected_at",
    "top_consumers": "taken_at",
    "kept_ticks": "collected_at",
    "kept_ticks_seen": "tick_at",
    "system_counter_samples_days": "first_at",
    "alert_evaluations": "evaluated_at",
}
# Values older partitions get for columns they lack.
DEFAULTS = {"database_activity_samples": {"sample_source": "LEGACY", "sample_duration_micro": 2_000_000},
            "repository_daily_ingest": {"sql_cursor_metadata_writes": 0, "dataguard_destination_rows": 0,
                                        "dataguard_lag_rows": 0, "dataguard_process_rows": 0}}
