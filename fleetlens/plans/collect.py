"""All typed samples of a set of landed views, as lazy plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import schemas
from fleetlens.operators import deltas, samples
from fleetlens.operators.merges import evolve


def build_samples(raw: dict[str, DataFrame], as_of: Column | None = None, interval: float = 15.0,
                  activity_interval: float = 2.0) -> dict[str, DataFrame]:
    """Typed samples for every dataset whose views are present.

    With ``as_of`` the SQL statistics are limited to statements active lately.  Counters
    and waits get their deltas from the snapshots in ``raw``.
    """
    out: dict[str, DataFrame] = {}

    def have(*views: str) -> bool:
        return all(v in raw for v in views)

    if have("sqlstats"):
        stats = raw["sqlstats"]
        if as_of is not None:
            stats = samples.recent(stats, "last_active_time", as_of, interval)
        out["sql_samples"] = samples.sql_samples(stats)
    if have("session"):
        out["session_samples"] = samples.user_sessions(raw["session"])
        out["blocking_session_samples"] = samples.blocking_sessions(raw["session"])
    if have("activity_history"):
        out["database_activity_samples"] = samples.activity_samples(
            raw["activity_history"], "ASH", activity_interval)
    elif have("session"):
        out["database_activity_samples"] = samples.activity_samples(raw["session"], "SESSION", activity_interval)
    if have("instance", "database", "product"):
        out["database_status_samples"] = samples.database_status(raw["instance"], raw["database"], raw["product"])
    if have("instance", "session", "process", "parameter", "sga", "pgastat"):
        out["instance_samples"] = samples.instance_samples(
            raw["instance"], raw["session"], raw["process"], raw["parameter"], raw["sga"], raw["pgastat"])
    if have("resource_limit"):
        out["resource_limit_samples"] = samples.resource_limits(raw["resource_limit"])
    if have("tablespace", "tablespace_usage", "temp_free", "data_files", "temp_files"):
        out["tablespace_samples"] = samples.tablespace_samples(
            raw["tablespace"], raw["tablespace_usage"], raw["temp_free"], raw["data_files"], raw["temp_files"])
    if have("asm_diskgroup", "datafile", "instance"):
        out["asm_diskgroup_samples"] = samples.diskgroups(raw["asm_diskgroup"], raw["datafile"], raw["instance"])
    if have("sysstat"):
        system = samples.select_named(raw["sysstat"], "name", samples.SYSTEM_COUNTERS).withColumnRenamed(
            "name", "stat_name")
        if have("time_model"):
            system = system.unionByName(
                samples.cpu_io_counters(raw["sysstat"], raw["time_model"]), allowMissingColumns=True)
        out["system_counter_samples"] = deltas.counter_delta(
            system.withColumnRenamed("value", "cumulative_value"))
    if have("wait_class"):
        waits = samples.wait_classes(raw["wait_class"])
        out["wait_class_samples"] = deltas.counter_delta(
            waits, ["source_database", "inst_id", "con_id", "wait_class"], value="cumulative_wait_micro",
            delta="delta_wait_micro")
    if have("sysmetric"):
        out["system_metric_samples"] = samples.select_named(
            raw["sysmetric"], "metric_name", samples.SYSTEM_METRICS).withColumnRenamed("metric_unit", "unit")
    if have("database", "archive_dest", "archive_dest_status"):
        roles = samples.replication_enabled(raw["database"], raw["archive_dest"])
        enabled = roles.where("enabled").select("source_database", "collected_at", "database_role")
        out["dataguard_destination_samples"] = samples.destinations(
            raw["archive_dest"], raw["archive_dest_status"]).join(
                enabled.drop("database_role"), samples.SNAPSHOT, "left_semi")
        if have("dataguard_stats"):
            out["dataguard_lag_samples"] = samples.replication_lag(raw["dataguard_stats"], enabled)
        if have("instance", "dataguard_process"):
            standby = enabled.where(F.upper("database_role") == "PHYSICAL STANDBY")
            out["dataguard_process_samples"] = samples.recovery_processes(
                raw["instance"], raw["dataguard_process"]).join(standby, samples.SNAPSHOT)
    return {
        name: evolve(df, schemas.STORED[name], schemas.DEFAULTS.get(name)) for name, df in out.items()
    }
