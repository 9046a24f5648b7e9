"""Typed samples from landed source views.

Every raw view carries ``source_database`` and ``collected_at``; together they
name one snapshot of one database, and every join or group key of a source-side
query is extended by them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import scalars as S
from fleetlens.operators.timeline import newest_per_key

SNAPSHOT = ["source_database", "collected_at"]

# --- fixed values ---------------------------------------------------------
SYSTEM_COUNTERS = [
    "parse count (total)", "execute count", "user commits", "user rollbacks",
    "physical reads", "physical writes", "session logical reads", "redo size",
]
IO_COUNTERS = [
    "physical read total IO requests", "physical write total IO requests",
    "physical read total bytes", "physical write total bytes",
]
TIME_MODEL_COUNTERS = ["DB CPU", "DB time"]
SYSTEM_METRICS = [
    "Buffer Cache Hit Ratio", "Cursor Cache Hit Ratio", "Host CPU Utilization (%)",
    "Database CPU Time Ratio", "Database Wait Time Ratio",
]
PARAMETERS = {
    "cpu_count": "cpu_count", "sga_max_size": "sga_max_bytes", "pga_aggregate_limit": "pga_aggregate_limit",
}
PGA_STATISTICS = {
    "total PGA allocated": "pga_allocated_bytes", "maximum PGA allocated": "pga_max_allocated_bytes",
}
LAG_STATISTICS = {
    "transport lag": "transport_lag_seconds", "apply lag": "apply_lag_seconds",
    "apply finish time": "apply_finish_time_seconds", "estimated startup time": "estimated_startup_seconds",
}
SQL_SUMS = {
    "executions": "executions", "elapsed_time": "elapsed_time_micro", "cpu_time": "cpu_time_micro",
    "user_io_wait_time": "user_io_wait_micro", "application_wait_time": "application_wait_micro",
    "concurrency_wait_time": "concurrency_wait_micro", "cluster_wait_time": "cluster_wait_micro",
    "buffer_gets": "buffer_gets", "disk_reads": "disk_reads", "direct_writes": "direct_writes",
    "rows_processed": "rows_processed", "fetches": "fetches", "loads": "loads",
    "invalidations": "invalidations", "parse_calls": "parse_calls",
}
SESSION_COLUMNS = [
    "inst_id", "sid", "serial_number", "username", "status", "sql_id", "sql_child_number", "prev_sql_id",
    "event", "wait_class", "state", "seconds_in_wait", "blocking_instance", "blocking_session", "machine",
    "program", "module", "action", "service_name", "logon_time",
]
PLAN_KEYS = ["inst_id", "sql_id", "child_number", "plan_hash_value"]
# --------------------------------------------------------------------------


def existing(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [n for n in names if n in df.columns]


# --- sessions and activity ------------------------------------------------

def active_sessions(sessions: DataFrame, excluded: str | None = None) -> DataFrame:
    """Active user sessions that are not idle, the collector's own (``excluded`` is
    the column with its audit id) left out.  A waiting session without a wait
    class is not active."""
    busy = (
        (F.col("type") == "USER") & (F.col("status") == "ACTIVE")
        & ((F.col("state") != "WAITING") | (F.col("wait_class") != "Idle"))
    )
    if excluded is not None:
        busy = busy & (F.col("audit_session_id") != F.col(excluded))
    return sessions.where(busy)


def wait_columns(df: DataFrame) -> DataFrame:
    """Session state and wait columns; wait details only while waiting."""
    waiting = F.col("state") == "WAITING"
    columns = {"session_state": F.when(waiting, "WAITING").otherwise("ON CPU")}
    for name in existing(df, ["event", "wait_class"]):
        columns[name] = F.when(waiting, F.col(name))
    if "wait_time_micro" in df.columns:
        columns["time_waited_micro"] = F.when(waiting, F.col("wait_time_micro"))
        columns["wait_time_micro"] = F.when(waiting, F.col("wait_time_micro"))
    return df.withColumns(columns)


def foreground(history: DataFrame) -> DataFrame:
    """Foreground rows of the activity history."""
    return history.where(F.col("session_type") == "FOREGROUND")


def activity_samples(df: DataFrame, source: str, interval: float, excluded: str | None = None) -> DataFrame:
    """Activity samples from session snapshots (``SESSION``) or from history rows (``ASH``)."""
    interval_micro = F.lit(int(interval * 1_000_000)).cast("long")
    if source == "SESSION":
        rows = wait_columns(active_sessions(df, excluded))
        renames = {
            "sid": "session_id", "serial_number": "session_serial_number", "blocking_instance": "blocking_inst_id",
            "row_wait_obj": "current_object_id", "row_wait_file": "current_file_number",
            "row_wait_block": "current_block_number",
        }
        rows = rows.withColumnsRenamed({k: v for k, v in renames.items() if k in rows.columns})
        return rows.withColumns({
            "sample_id": F.unix_micros("collected_at") * 1000,
            "sample_time": F.col("collected_at"),
            "session_type": F.lit("FOREGROUND"),
            "sample_source": F.lit("SESSION"),
            "sample_duration_micro": interval_micro,
        })
    rows = foreground(df)
    renames = {
        "session_serial": "session_serial_number", "wait_time": "wait_time_micro", "time_waited": "time_waited_micro",
        "blocking_serial": "blocking_session_serial_number", "current_obj": "current_object_id",
        "current_file": "current_file_number", "current_block": "current_block_number",
        "client_id": "client_identifier",
    }
    rows = rows.withColumnsRenamed({k: v for k, v in renames.items() if k in rows.columns})
    duration = F.when(F.col("usecs_per_row") > 0, F.col("usecs_per_row")).otherwise(interval_micro)
    return rows.withColumns({"sample_source": F.lit("ASH"), "sample_duration_micro": duration})


def user_sessions(sessions: DataFrame) -> DataFrame:
    """User sessions in the stored layout."""
    return sessions.where(F.col("type") == "USER").select(
        *existing(sessions, [*SNAPSHOT, *SESSION_COLUMNS])
    )


def blocking_sessions(sessions: DataFrame) -> DataFrame:
    """Every blocked session with the session that blocks it, one level deep.

    A session is unique within (snapshot, instance, sid), so a blocked row meets
    at most one blocker; many rows of one blocker are split by the skew join.
    """
    blocked = sessions.where(F.col("blocking_session").isNotNull()).select(
        *existing(sessions, [*SNAPSHOT, "inst_id", "sid", "serial_number", "username", "sql_id", "event",
                             "wait_class", "blocking_instance", "blocking_session"])
    )
    blockers = sessions.select(
        *SNAPSHOT, F.col("inst_id").alias("blocking_instance"), F.col("sid").alias("blocking_session"),
        *[F.col(c).alias(f"blocking_{c}") for c in existing(sessions, ["username", "sql_id", "event"])],
    )
    joined = blocked.join(blockers, [*SNAPSHOT, "blocking_instance", "blocking_session"], "left")
    return joined.select(*blocked.columns, *[c for c in blockers.columns if c not in blocked.columns])


# --- SQL statistics, details, plans ---------------------------------------

def recent(df: DataFrame, ts: str, as_of: Column, interval: float) -> DataFrame:
    """Rows active within ``max(2 * interval, 60)`` seconds of ``as_of``; NULL sql_id dropped."""
    lookback = int(max(2 * interval, 60) * 1_000_000)
    kept = df.where(F.col(ts) >= F.timestamp_micros(F.unix_micros(as_of) - lookback))
    return kept.where(F.col("sql_id").isNotNull()) if "sql_id" in df.columns else kept


def sql_samples(raw: DataFrame) -> DataFrame:
    """SQL statistics summed per instance, statement and plan; containers together."""
    sums = [F.sum(c).alias(SQL_SUMS[c]) for c in existing(raw, list(SQL_SUMS))]
    last = [F.max("last_active_time").alias("last_active_time")] if "last_active_time" in raw.columns else []
    return raw.where(F.col("sql_id").isNotNull()).groupBy(
        *SNAPSHOT, "inst_id", "sql_id", "plan_hash_value"
    ).agg(*sums, *last)


def busiest_children(raw_sql: DataFrame) -> DataFrame:
    """The child cursor with most elapsed time of every plan; unknown time ranks first."""
    order = Window.partitionBy(*SNAPSHOT, "inst_id", "sql_id", "plan_hash_value").orderBy(
        F.col("elapsed_time").desc_nulls_first(), F.col("child_number").asc_nulls_last()
    )
    return raw_sql.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def sql_details(raw_sql: DataFrame, top_ids: DataFrame) -> DataFrame:
    """Busiest child of every plan of the statements in ``top_ids``."""
    keys = [c for c in top_ids.columns if c in ("source_database", "collected_at", "sql_id")]
    return busiest_children(raw_sql.join(top_ids.select(*keys).distinct(), keys, "left_semi"))


def sql_text_rows(details: DataFrame) -> DataFrame:
    """Details that carry a non-blank full text, as text rows."""
    return details.where(F.length(S.trim_space(F.col("sql_fulltext"))) > 0).select(
        *existing(details, [*SNAPSHOT, "sql_id", "sql_fulltext", "seq"])
    )


def plan_lines(raw_plan: DataFrame, candidates: DataFrame) -> DataFrame:
    """Plan lines of the candidate plans."""
    keys = ["source_database", *PLAN_KEYS]
    return raw_plan.join(candidates.select(*keys).distinct(), keys, "left_semi")


def plan_cache_step(known: DataFrame, candidates: DataFrame, collected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One pass of the plan cache: (plans to fetch, plans known afterwards).

    A known plan stays known only while it is a candidate; plans whose lines
    arrived become known.
    """
    keys = ["source_database", *PLAN_KEYS]
    known, wanted = known.select(*keys), candidates.select(*keys).distinct()
    missing = wanted.join(known, keys, "left_anti")
    kept = known.join(wanted, keys, "left_semi")
    return missing, kept.unionByName(collected.select(*keys)).distinct()


# --- instances and databases ----------------------------------------------

def session_counts(sessions: DataFrame) -> DataFrame:
    user = F.col("type") == "USER"
    return sessions.groupBy(*SNAPSHOT, "inst_id").agg(
        F.count_if(user).alias("user_sessions"),
        F.count_if(user & (F.col("status") == "ACTIVE")).alias("active_user_sessions"),
        F.count_if(~user).alias("background_sessions"),
    )


def process_counts(processes: DataFrame) -> DataFrame:
    return processes.groupBy(*SNAPSHOT, "inst_id").agg(F.count(F.lit(1)).alias("process_count"))


def pivot_named(df: DataFrame, name: str, value: str, names: dict[str, str],
                by: Sequence[str] = (*SNAPSHOT, "inst_id")) -> DataFrame:
    """One column per entry of ``names`` with the highest value of that name."""
    number = F.col(value).cast("long")
    return df.where(F.col(name).isin(list(names))).groupBy(*by).agg(
        *[F.max(F.when(F.col(name) == key, number)).alias(out) for key, out in names.items()]
    )


def sga_bytes(sga: DataFrame) -> DataFrame:
    return sga.where(F.col("con_id") == 0).groupBy(*SNAPSHOT, "inst_id").agg(
        F.sum("value").alias("sga_allocated_bytes")
    )


def pga_bytes(pgastat: DataFrame) -> DataFrame:
    return pivot_named(pgastat.where(F.col("con_id") == 0), "name", "value", PGA_STATISTICS)


def instance_memory(instances: DataFrame, sga: DataFrame, pgastat: DataFrame) -> DataFrame:
    """Shared and private memory of every instance; unknown memory stays NULL."""
    keys = [*SNAPSHOT, "inst_id"]
    base = instances.select(*keys)
    return base.join(sga_bytes(sga), keys, "left").join(pga_bytes(pgastat), keys, "left")


def instance_base(instances: DataFrame, sessions: DataFrame, processes: DataFrame,
                  parameters: DataFrame) -> DataFrame:
    """Session and process counts and parameters of every instance."""
    keys = [*SNAPSHOT, "inst_id"]
    counts = ["user_sessions", "active_user_sessions", "background_sessions", "process_count"]
    joined = (
        instances.select(*keys)
        .join(session_counts(sessions), keys, "left")
        .join(process_counts(processes), keys, "left")
        .join(pivot_named(parameters, "name", "value", PARAMETERS), keys, "left")
    )
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})


def update_from(rows: DataFrame, source: DataFrame, keys: Sequence[str], columns: Sequence[str],
                order: Sequence[str] = ()) -> DataFrame:
    """Replace ``columns`` of the rows that ``source`` matches; other rows stay as they are.

    Of several source rows of a key the last by ``order`` wins; without an order a source
    must have one row per key.  No rows are added.
    """
    last = newest_per_key(source.select(*keys, *columns, *order), keys, order or columns)
    marked = last.select(*keys, F.struct(*columns).alias("_new"))
    joined = rows.join(marked, list(keys), "left")
    out = []
    for c in dict.fromkeys([*rows.columns, *columns]):
        if c in columns:
            old = F.col(c) if c in rows.columns else F.lit(None)
            out.append(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(old).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def instance_samples(instances: DataFrame, sessions: DataFrame, processes: DataFrame, parameters: DataFrame,
                     sga: DataFrame, pgastat: DataFrame) -> DataFrame:
    base = instance_base(instances, sessions, processes, parameters)
    memory = ["sga_allocated_bytes", "pga_allocated_bytes", "pga_max_allocated_bytes"]
    return update_from(base, instance_memory(instances, sga, pgastat), [*SNAPSHOT, "inst_id"], memory)


def first_product(products: DataFrame) -> DataFrame:
    """The first database product by name of every snapshot, with its edition."""
    rows = products.where(F.upper("product").like(S.PRODUCT_PATTERN))
    chosen = rows.groupBy(*SNAPSHOT).agg(
        F.min(F.struct("product", "version", "version_full")).alias("_p")
    )
    return chosen.select(
        *SNAPSHOT, F.col("_p.product").alias("database_product"),
        S.edition(F.col("_p.product")).alias("database_edition"),
        F.col("_p.version").alias("database_version"), F.col("_p.version_full").alias("database_version_full"),
    )


def database_identity(databases: DataFrame, products: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Identity of every database instance with its product, if one is known; ``order`` columns are kept."""
    names = [*existing(databases, ["dbid", "db_unique_name", "protection_mode", "protection_level"]), *order]
    return databases.select(*SNAPSHOT, "inst_id", *names).join(first_product(products), SNAPSHOT, "left")


def instance_status(instances: DataFrame, databases: DataFrame) -> DataFrame:
    """Instances joined to the database they have open."""
    status = ["open_mode", "database_role", "cdb", "con_id", "con_name", "platform_name"]
    left = instances.select(
        *SNAPSHOT, "inst_id", "instance_name", F.col("status").alias("instance_status"),
        "database_status", "startup_time",
    )
    right = databases.select(*SNAPSHOT, "inst_id", *existing(databases, status))
    return left.join(right, [*SNAPSHOT, "inst_id"])


def database_status(instances: DataFrame, databases: DataFrame, products: DataFrame) -> DataFrame:
    """Status rows enriched with the database identity."""
    order = existing(databases, ["seq"])
    identity = database_identity(databases, products, order)
    columns = [c for c in identity.columns if c not in (*SNAPSHOT, "inst_id", *order)]
    return update_from(instance_status(instances, databases), identity, [*SNAPSHOT, "inst_id"], columns, order)


# --- capacity --------------------------------------------------------------

def resource_limits(df: DataFrame) -> DataFrame:
    """Numeric limits from limit text; ``UNLIMITED`` as a flag."""

    def number(c):
        return F.when(F.trim(c).rlike("^[0-9]+$"), F.trim(c).try_cast("long"))

    return df.withColumns({
        "initial_limit": number(F.col("initial_allocation")),
        "limit_unlimited": F.coalesce(F.trim("limit_value") == "UNLIMITED", F.lit(False)),
        "limit_value": number(F.col("limit_value")),
    }).withColumnsRenamed(
        {"current_utilization": "current_value", "max_utilization": "max_value"}
    ).drop("initial_allocation")


def tablespace_usage(tablespaces: DataFrame, usage: DataFrame, temp: DataFrame) -> DataFrame:
    """Usage of permanent and undo tablespaces from block counts, of temporary ones from bytes."""
    keys = [*SNAPSHOT, "tablespace_name"]
    permanent = (
        usage.join(tablespaces.where(F.col("contents") != "TEMPORARY"), keys)
        .select(
            *keys, "contents",
            (F.col("block_size") * F.col("used_space")).alias("used_bytes"),
            (F.col("block_size") * (F.col("tablespace_size") - F.col("used_space"))).alias("free_bytes"),
            (F.col("block_size") * F.col("tablespace_size")).alias("max_bytes"),
            F.col("used_percent").cast("double").alias("used_percent"),
        )
    )
    size, used = F.col("tablespace_size"), F.col("tablespace_size") - F.col("free_space")
    temporary = temp.select(
        *keys, F.lit("TEMPORARY").alias("contents"), used.alias("used_bytes"),
        F.col("free_space").alias("free_bytes"), size.alias("max_bytes"),
        F.when(size == 0, 0.0).otherwise(
            used.cast("double") / F.nullif(size.cast("double"), F.lit(0.0)) * 100
        ).alias("used_percent"),
    )
    return permanent.unionByName(temporary)


def tablespace_allocation(data_files: DataFrame, temp_files: DataFrame) -> DataFrame:
    """Allocated bytes per tablespace; of a name in both kinds of file the temporary one counts."""
    keys = [*SNAPSHOT, "tablespace_name"]

    def total(files: DataFrame, rank: int) -> DataFrame:
        return files.groupBy(*keys).agg(F.sum("bytes").alias("allocated_bytes")).withColumn("_rank", F.lit(rank))

    both = total(data_files, 0).unionByName(total(temp_files, 1))
    return both.groupBy(*keys).agg(F.max_by("allocated_bytes", "_rank").alias("allocated_bytes"))


def tablespace_samples(tablespaces: DataFrame, usage: DataFrame, temp: DataFrame,
                       data_files: DataFrame, temp_files: DataFrame) -> DataFrame:
    return update_from(
        tablespace_usage(tablespaces, usage, temp), tablespace_allocation(data_files, temp_files),
        [*SNAPSHOT, "tablespace_name"], ["allocated_bytes"],
    )


def diskgroups(groups: DataFrame, datafiles: DataFrame, instances: DataFrame) -> DataFrame:
    """Disk group sizes in bytes, read from the highest instance, and only when the
    database keeps a file in a disk group."""
    uses = datafiles.where(F.col("name").startswith("+")).select(*SNAPSHOT).distinct()
    last = instances.groupBy(*SNAPSHOT).agg(F.max("inst_id").alias("inst_id"))
    megabyte = F.lit(1024 * 1024).cast("long")
    rows = groups.join(last, [*SNAPSHOT, "inst_id"], "left_semi").join(uses, SNAPSHOT, "left_semi")
    return rows.select(
        *SNAPSHOT, "inst_id", F.col("name").alias("diskgroup_name"),
        (F.col("total_mb") * megabyte).alias("total_bytes"), (F.col("free_mb") * megabyte).alias("free_bytes"),
        (F.col("usable_file_mb") * megabyte).alias("usable_bytes"),
    )


# --- counters, waits, metrics ----------------------------------------------

def select_named(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    return df.where(F.col(column).isin(list(names)))


def cpu_io_counters(sysstat: DataFrame, time_model: DataFrame) -> DataFrame:
    """Instance-level I/O statistics and CPU time as one counter feed."""
    columns = [c for c in sysstat.columns if c in (*SNAPSHOT, "inst_id", "con_id", "value", "seq")]

    def part(df, names):
        rows = df.where((F.col("con_id") == 0) & F.col("name").isin(names))
        return rows.select(*columns, F.col("name").alias("stat_name"))

    return part(sysstat, IO_COUNTERS).unionByName(part(time_model, TIME_MODEL_COUNTERS))


def wait_classes(df: DataFrame) -> DataFrame:
    """Cumulative waits in microseconds, idle waits left out."""
    return df.where(F.col("wait_class") != "Idle").withColumn(
        "cumulative_wait_micro", F.round(F.col("time_waited") * 10000).cast("long")
    )


# --- replication -------------------------------------------------------------

def replication_enabled(databases: DataFrame, destinations: DataFrame) -> DataFrame:
    """Role of every database and whether it replicates: it is a standby or has one."""
    standby = destinations.where(
        (F.col("target") == "STANDBY") & (F.col("destination").isNotNull() | F.col("db_unique_name").isNotNull())
    ).select(*SNAPSHOT).distinct().withColumn("_standby", F.lit(True))
    roles = databases.groupBy(*SNAPSHOT).agg(F.max("database_role").alias("database_role"))
    enabled = (F.col("database_role") != "PRIMARY") | F.col("_standby")
    return roles.join(standby, SNAPSHOT, "left").select(
        *SNAPSHOT, "database_role", F.coalesce(enabled, F.lit(False)).alias("enabled")
    )


def destinations(dests: DataFrame, status: DataFrame) -> DataFrame:
    """Remote archive destinations with their status."""
    keys = [*SNAPSHOT, "inst_id", "dest_id"]
    remote = (F.col("target") == "STANDBY") | ~F.upper(F.coalesce("type", F.lit("LOCAL"))).isin(
        "LOCAL", "CROSS-INSTANCE"
    )
    named = F.col("destination").isNotNull() | F.col("db_unique_name").isNotNull()
    names = {"dest_name": "destination_name", "type": "destination_type", "archived_seq": "archived_sequence",
             "applied_seq": "applied_sequence", "error": "error_message"}
    joined = dests.where(named).join(status, keys, "left").where(remote)
    return joined.withColumnsRenamed({k: v for k, v in names.items() if k in joined.columns})


def recovery_processes(instances: DataFrame, processes: DataFrame) -> DataFrame:
    """Apply and transport processes per instance; instances without any count 0."""
    keys = [*SNAPSHOT, "inst_id"]
    role = F.lower("role")
    applying = F.coalesce((F.col("name") == "MRP0") | (role == "managed recovery"), F.lit(False))
    merging = F.coalesce(role.isin("managed recovery", "recovery logmerger"), F.lit(False))
    # Aggregate first: instances are few, process rows are not.
    rolled = processes.groupBy(*keys).agg(
        F.count_if(applying).alias("apply_processes"),
        F.count_if(F.col("name") == "RFS").alias("transport_processes"),
        F.max(F.when(applying, F.col("action"))).alias("apply_status"),
        F.max(F.when(merging, F.col("thread"))).alias("thread_number"),
        F.max(F.when(merging, F.col("sequence"))).alias("sequence_number"),
    )
    joined = instances.select(*keys).distinct().join(rolled, keys, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("apply_processes", "transport_processes")})


def replication_lag(stats: DataFrame, roles: DataFrame | None = None, strict: bool = True,
                    seq: str = "seq") -> DataFrame:
    """The four lag statistics of a database snapshot as one row.

    ``roles`` (snapshot, database_role) limits the result to databases that are
    not primary.  Interval text that does not parse fails the job (``strict``) or
    is reported in ``lag_error``.
    """
    value = S.parse_lag_interval(F.col("value"))
    invalid = S.lag_interval_invalid(F.col("value"))
    if strict:
        message = F.concat(F.lit("not a lag interval: "), F.col("value"))
        value = F.when(invalid, F.raise_error(message).cast("double")).otherwise(value)
    has_times = existing(stats, ["time_computed", "datum_time"])
    rows = stats.where(F.col("name").isin(list(LAG_STATISTICS))).withColumn("_seconds", value)
    aggs = [
        F.max_by("_seconds", F.when(F.lower("name") == name, F.col(seq))).alias(out)
        for name, out in LAG_STATISTICS.items()
    ]
    aggs += [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in has_times]
    if len(has_times) == 2:
        age = S.seconds_between(S.parse_lag_timestamp(F.col("time_computed")),
                                S.parse_lag_timestamp(F.col("datum_time")))
        aggs.append(F.max(age).alias("datum_age_seconds"))
    if not strict:
        aggs.append(F.max(F.when(invalid, F.col("value"))).alias("lag_error"))
    wide = rows.groupBy(*existing(stats, SNAPSHOT)).agg(*aggs)
    if roles is None:
        return wide
    return wide.join(roles.where(F.upper("database_role") != "PRIMARY"), existing(stats, SNAPSHOT))


# --- lists, percentiles, queues, segments ------------------------------------

#: Equal parts of a percentile's bracket that are counted before values are ranked.
BRACKET_PARTS = 4096


def distinct_list(c: Column) -> Column:
    """Sorted distinct non-null values joined by a comma; NULL when there are none."""
    return F.nullif(F.array_join(F.array_sort(F.collect_set(c)), ", "), F.lit(""))


def cursor_context(metadata: DataFrame) -> DataFrame:
    """Children, schemas and modules seen for every plan, as text lists."""
    return metadata.groupBy("source_database", "inst_id", "sql_id", "plan_hash_value").agg(
        distinct_list(F.col("child_number").cast("string")).alias("child_numbers"),
        distinct_list(F.col("parsing_schema_name")).alias("parsing_schema_names"),
        distinct_list(F.col("module")).alias("modules"),
    )


def merge_shared(df: DataFrame, state: Sequence[str], name: str = "source_database") -> DataFrame:
    """Rows in the same state become one, their names joined in order (repeats kept)."""
    counted = df.groupBy(*state, name).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    names = F.flatten(F.array_sort(F.collect_list(F.array_repeat(F.col(name), F.col("_n")))))
    return counted.groupBy(*state).agg(F.array_join(names, ", ").alias(name))


def percentiles(df: DataFrame, by: Sequence[str], column: str, ps: dict[str, float],
                accuracy: int = 10_000) -> DataFrame:
    """Exact discrete percentiles per group: ``ps`` maps output name to fraction.

    A quantile sketch of fixed size brackets every percentile.  The bracket is cut into equal parts,
    and all rows are counted by part, those below and above it included; the distinct values of the
    one part that holds the percentile are ranked.  A sketch that errs makes that part larger, not wrong.
    """
    if not by:
        return percentiles(df.withColumn("_all", F.lit(1)), ["_all"], column, ps, accuracy).drop("_all")
    by = list(by)
    margin = 20.0 / accuracy
    values = df.where(F.col(column).isNotNull()).select(*by, F.col(column).alias("_v"))
    names = list(ps)
    edges = [min(max(p + d, 0.0), 1.0) for p in ps.values() for d in (-margin, margin)]
    sketch = values.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", edges, accuracy).alias("_edges")
    )
    brackets = sketch.select(
        *by,
        F.explode(F.array(*[
            F.struct(
                F.lit(name).alias("_name"),
                F.greatest(F.ceil(F.lit(str(p)).cast("decimal(12,10)") * F.col("_n")), F.lit(1))
                .cast("long").alias("_target"),
                F.col("_edges")[2 * i].alias("_lo"), F.col("_edges")[2 * i + 1].alias("_hi"),
            ) for i, (name, p) in enumerate(ps.items())
        ])).alias("_b"),
    ).select(*by, "_b.*")
    low, high, value = (F.col(c).cast("double") for c in ("_lo", "_hi", "_v"))
    inside = F.coalesce(F.width_bucket(value, low, high, F.lit(BRACKET_PARTS)), F.lit(0))
    part = F.when(F.col("_v") < F.col("_lo"), -1).when(F.col("_v") > F.col("_hi"), BRACKET_PARTS + 2).otherwise(inside).cast("long")
    parted = values.join(brackets, by).withColumn("_part", part)
    upto = Window.partitionBy(*by, "_name").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parted.groupBy(*by, "_name", "_target", "_part").agg(F.count(F.lit(1)).alias("_in_part")).withColumn("_upto", F.sum("_in_part").over(upto))
    chosen = parts.where((F.col("_upto") >= F.col("_target")) & (F.col("_upto") - F.col("_in_part") < F.col("_target"))).select(
        *by, "_name", "_part", (F.col("_upto") - F.col("_in_part")).alias("_before"))
    distinct = parted.join(chosen, [*by, "_name", "_part"]).groupBy(*by, "_name", "_target", "_before", "_v").agg(F.count(F.lit(1)).alias("_count"))
    rank = Window.partitionBy(*by, "_name").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = distinct.withColumn("_rank", F.col("_before") + F.sum("_count").over(rank)).where("_rank >= _target")
    return ranked.groupBy(*by).agg(*[F.min(F.when(F.col("_name") == n, F.col("_v"))).alias(n) for n in names])


def ordinal_percentiles(df: DataFrame, by: Sequence[str], ps: dict[str, float]) -> DataFrame:
    """Discrete percentiles of the row numbers of a group: they follow from its size."""
    n = F.count(F.lit(1))
    return df.groupBy(*by).agg(*[
        F.greatest(F.ceil(F.lit(str(p)).cast("decimal(12,10)") * n), F.lit(1)).cast("long").alias(name)
        for name, p in ps.items()
    ])


def distinct_pairs(df: DataFrame, by: str, item: str, out: str) -> DataFrame:
    """Number of distinct items per group."""
    return df.select(by, item).distinct().groupBy(by).agg(F.count(F.lit(1)).alias(out))


def queue_counts(subscribers: DataFrame, queues: DataFrame) -> DataFrame:
    """Distinct queue names with subscribers per instance."""
    pairs = subscribers.select("inst_id", "queue_id").distinct()
    named = pairs.join(queues.select("queue_id", "queue_name").distinct(), "queue_id")
    return distinct_pairs(named, "inst_id", "queue_name", "total_queues")


def subscriber_stats(subscribers: DataFrame, queues: DataFrame) -> DataFrame:
    """Message totals per instance, queue and subscriber, with the queue name."""
    totals = subscribers.groupBy("inst_id", "queue_id", "subscriber_id").agg(
        F.sum("enqueued_msgs").alias("enqueued_msgs"),
        F.sum("dequeued_msgs").alias("dequeued_msgs"),
        F.sum(F.col("enqueued_msgs") - F.col("dequeued_msgs")).alias("remained_msgs"),
        F.min("time_since_last_dequeue").alias("time_since_last_dequeue"),
        F.max("estd_time_to_drain_no_enq").alias("estd_time_to_drain_no_enq"),
    ).withColumnRenamed("subscriber_id", "subscriber_name")
    # averages of constants need no buffers, and totals and names are distinct already
    latencies = [F.lit(float(n)).alias(f"message_latency_{n // 10}") for n in (10, 20, 30)]
    return totals.join(queues.select("queue_id", "queue_name").distinct(), "queue_id").select(
        *[F.col(c) for c in ("queue_id", "inst_id", "subscriber_name", "enqueued_msgs", "dequeued_msgs", "remained_msgs",
                             "time_since_last_dequeue", "estd_time_to_drain_no_enq")], *latencies, "queue_name")


def owner_instance(queues: DataFrame) -> DataFrame:
    """One owning instance; the lowest id, so that reruns agree."""
    return queues.select(F.min("inst_id").alias("inst_id"))


def segment_sizes(segments: DataFrame, segment_type: str) -> DataFrame:
    return segments.where(F.col("segment_type") == segment_type).groupBy("segment_name").agg(
        F.sum("bytes").alias("bytes")
    )


def top_segments(segments: DataFrame, segment_type: str, n: int = 100) -> DataFrame:
    """The ``n`` largest segments of a type, names breaking ties."""
    return segment_sizes(segments, segment_type).orderBy(F.col("bytes").desc(), "segment_name").limit(n)


def integers(spark, n: int = 1000) -> DataFrame:
    """The generated values 0 to ``n``."""
    return spark.range(0, n + 1).select(F.col("id").alias("key"), F.col("id").alias("value"))


# --- statuses and runtime rows ------------------------------------------------

def scrape_status_rows(outcomes: DataFrame, message_length: int | None = None) -> DataFrame:
    """Status row of a collection: it succeeded when it has no error.  Messages are kept whole unless a length is given."""
    return outcomes.withColumns({
        "success": F.col("error_message").isNull(),
        "error_message": _message(message_length),
    })


def _message(length: int | None) -> Column:
    return F.col("error_message") if length is None else S.cut(F.col("error_message"), length)


def runtime_rows(cycles: DataFrame, statuses: DataFrame, completion_collector: str,
                 message_length: int | None = None) -> DataFrame:
    """Runtime row of a collection cycle.

    ``cycles``: cycle_id, scheduled_at, started_at, collection_finished_at, finished_at,
    configured_interval_seconds, missed_intervals, databases_attempted, error_count,
    error_message.  A database succeeded when ``statuses`` (cycle_id, collector, success)
    has a successful row of the completion collector.
    """
    done = F.col("success") & (F.col("collector") == completion_collector)
    counts = statuses.groupBy("cycle_id").agg(F.count_if(done).alias("databases_succeeded"))
    rows = cycles.join(counts, "cycle_id", "left")
    zero = F.lit(0.0)
    succeeded = F.coalesce(F.col("databases_succeeded"), F.lit(0)).cast("long")
    lag = F.greatest(zero, S.seconds_between(F.col("started_at"), F.col("scheduled_at")))
    interval = F.col("configured_interval_seconds")
    missed = F.when(interval > 0, F.floor(lag / interval)).otherwise(0)
    return rows.withColumns({
        "databases_succeeded": succeeded,
        "scheduling_lag_seconds": lag,
        "missed_intervals": F.greatest(F.coalesce("missed_intervals", F.lit(0)), missed).cast("long"),
        "error_count": F.greatest(F.coalesce("error_count", F.lit(0)),
                                  F.col("databases_attempted") - succeeded).cast("long"),
        "collection_duration_seconds": F.greatest(
            zero, S.seconds_between(F.col("collection_finished_at"), F.col("started_at"))),
        "write_duration_seconds": F.greatest(
            zero, S.seconds_between(F.col("finished_at"), F.col("collection_finished_at"))),
        "total_duration_seconds": F.greatest(zero, S.seconds_between(F.col("finished_at"), F.col("started_at"))),
        "error_message": _message(message_length),
    })


def recovery_pass_rows(passes: DataFrame) -> DataFrame:
    """Runtime row of a recovery pass: missed intervals follow from its own duration."""
    duration = S.seconds_between(F.col("finished_at"), F.col("started_at"))
    return passes.withColumns({
        "scheduling_lag_seconds": F.greatest(
            F.lit(0.0), S.seconds_between(F.col("started_at"), F.col("scheduled_at"))),
        "collection_duration_seconds": duration,
        "missed_intervals": F.floor(duration / F.col("configured_interval_seconds")).cast("long"),
    })


def failed_or_stale(latest: DataFrame, as_of: Column, max_age: float = 180.0) -> DataFrame:
    """Collectors that failed or have no fresh data; a failure outranks staleness."""
    stale = F.col("collected_at") < F.timestamp_micros(F.unix_micros(as_of) - int(max_age * 1_000_000))
    return latest.where(~F.col("success") | stale).withColumn(
        "state", F.when(~F.col("success"), "FAILED").otherwise("STALE")
    )
