"""One scheduled pass: every table that follows from the landed views, its bookkeeping, and its commit."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import schemas
from fleetlens.operators import accounting, deltas, merges, metrics, samples, timeline
from fleetlens.operators.metrics import MetricDefinition
from fleetlens.plans.collect import build_samples
from fleetlens.sources import sinks

# --- fixed values ---------------------------------------------------------
COMPLETION_COLLECTOR = "scheduled"
KNOWN_PLANS = "known_plans"
STATES = ["sql_texts", "sql_cursor_metadata", "sql_plans", "latest_scrape_status", "repository_daily_ingest"]
# last take, work of each statement since then, and newest snapshot of every database
LAST_TAKES, OPEN_WORK, BASELINE = "consumer_takes", "consumer_work", "consumer_baseline"
# --------------------------------------------------------------------------


@dataclass
class PassResult:
    """Rows to append, states after the pass, and the increments of the daily accounting."""

    appended: dict[str, DataFrame] = field(default_factory=dict)
    states: dict[str, DataFrame] = field(default_factory=dict)
    increments: DataFrame | None = None


def known_plans_schema():
    keys = ["source_database", *samples.PLAN_KEYS]
    return schemas.T.StructType([f for f in schemas.STORED["sql_plans"].fields if f.name in keys])


def state_schemas() -> dict[str, schemas.T.StructType]:
    """Every state of a pass with its schema."""
    columns = {
        LAST_TAKES: {"source_database": "string", "collected_at": "timestamp"},
        OPEN_WORK: {"source_database": "string", "sql_id": "string"},
        BASELINE: {"collected_at": "timestamp", "source_database": "string", "inst_id": "long", "sql_id": "string", "plan_hash_value": "long"},
    }
    kinds = {name: schemas.STORED[name] for name in STATES} | {KNOWN_PLANS: known_plans_schema()}
    for name, fields in columns.items():
        counters = {} if name == LAST_TAKES else dict.fromkeys(deltas.CONSUMER_COUNTERS, "long")
        kinds[name] = schemas.T.StructType()
        for column, kind in {**fields, **counters}.items():
            kinds[name].add(column, kind)
    return kinds


def empty_state(spark: SparkSession) -> dict[str, DataFrame]:
    """The states before the first pass."""
    return {name: spark.createDataFrame([], schema) for name, schema in state_schemas().items()}


def busiest_statements(sql_samples: DataFrame, state: dict[str, DataFrame], n: int, detail_interval: float,
                       hold: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The statements that did most work since the take before, at every take of the pass; and the states behind it.

    A snapshot is a take once ``detail_interval`` seconds have passed since the last take of its database; the
    first one is a take without work.  Work since the last take is state, so takes and passes need not
    coincide.  Snapshots not newer than the newest of the pass before take no part.
    """
    db, schema = "source_database", state_schemas()
    counters = deltas.CONSUMER_COUNTERS
    known = state[BASELINE].groupBy(db).agg(F.max("collected_at").alias("_known"))
    fresh = merges.evolve(sql_samples, schema[BASELINE]).where(F.col("collected_at").isNotNull()).join(known, db, "left")
    fresh = fresh.where(F.col("_known").isNull() | (F.col("collected_at") > F.col("_known"))).drop("_known")
    rows = fresh.unionByName(state[BASELINE])
    times = fresh.select(*samples.SNAPSHOT).distinct()
    gap = max(detail_interval, 1e-6)
    last = state[LAST_TAKES].select(db, F.col("collected_at").alias("_last"))
    waited = F.unix_micros("collected_at") - F.unix_micros("_last") >= int(gap * 1_000_000)
    due = times.join(last, db, "left").where(F.col("_last").isNull() | waited)
    takes = hold(timeline.thin(due, [db], "collected_at", gap))
    ahead = timeline.upcoming(times, takes, [db], "collected_at", "taken_at")
    work = deltas.consumer_delta(rows).join(ahead, samples.SNAPSHOT, "left")
    first = takes.groupBy(db).agg(F.min("collected_at").alias("taken_at"))
    names = [db, "taken_at", "sql_id"]
    totals = hold(work.select(*names, *counters).unionByName(state[OPEN_WORK].join(first, db, "left").select(*names, *counters))
                  .groupBy(*names).agg(*[F.sum(c).alias(c) for c in counters]))
    newest = rows.groupBy(db).agg(F.max("collected_at").alias("collected_at"))
    return deltas.ranked_work(totals.where("taken_at is not null"), n), {
        LAST_TAKES: takes.unionByName(state[LAST_TAKES]).groupBy(db).agg(F.max("collected_at").alias("collected_at")),
        OPEN_WORK: totals.where("taken_at is null").drop("taken_at"),
        BASELINE: rows.join(newest, samples.SNAPSHOT, "left_semi"),
    }


def run_pass(raw: dict[str, DataFrame], state: dict[str, DataFrame], as_of: Column, outcomes: DataFrame | None = None,
             cycles: DataFrame | None = None, definitions: list[MetricDefinition] = (), n: int = 20, interval: float = 15.0,
             detail_interval: float = 120.0, hold: Callable[[DataFrame], DataFrame] = lambda df: df) -> PassResult:
    """All tables of a pass as lazy plans.

    ``raw``: landed views of the pass; ``state``: tables as :func:`empty_state` names them;
    ``outcomes``: source_database, collected_at, collector, duration_seconds, sample_count,
    error_message, seq and cycle_id of every collection; ``cycles``: the row that
    :func:`samples.runtime_rows` completes; ``detail_interval``: seconds between takes of top
    consumers; ``hold`` is put around tables that several others derive from.
    """
    out = PassResult(appended=build_samples(raw, interval=interval), states=dict(state))
    if "sqlstats" in raw and "sql" in raw:
        out.appended["sql_samples"] = hold(out.appended["sql_samples"])
        top, consumers = busiest_statements(out.appended["sql_samples"], state, n, detail_interval, hold)
        out.appended["top_consumers"] = top = hold(top)
        out.states |= consumers
        _statements(out, raw, state, top, hold)
    for definition in definitions:
        rows = metrics.run_metric(as_of_session(raw), definition, as_of=as_of)
        known = out.appended.get("metric_samples")
        out.appended["metric_samples"] = rows if known is None else known.unionByName(rows, allowMissingColumns=True)
    if outcomes is not None:
        statuses = samples.scrape_status_rows(outcomes)
        columns = [f.name for f in schemas.STORED["scrape_status"].fields]
        out.appended["scrape_status"] = statuses.select(*columns)
        out.states["latest_scrape_status"] = merges.evolve(
            merges.merge_latest(state["latest_scrape_status"], statuses.select(*columns, "seq"), ["source_database", "collector"], "collected_at"),
            schemas.STORED["latest_scrape_status"])
        if cycles is not None:
            out.appended["runtime_samples"] = samples.runtime_rows(cycles, statuses, COMPLETION_COLLECTOR)
    counted = {k: v for k, v in out.appended.items() if k in accounting.DATASETS}
    out.increments = accounting.daily_ingest(counted)
    return out


def as_of_session(raw: dict[str, DataFrame]) -> SparkSession:
    return next(iter(raw.values())).sparkSession


def _statements(out: PassResult, raw: dict[str, DataFrame], state: dict[str, DataFrame], top: DataFrame,
                hold: Callable[[DataFrame], DataFrame]) -> None:
    """Details, texts, cursor metadata and plans of the top statements."""
    ids = top.select("source_database", F.col("taken_at").alias("collected_at"), "sql_id")
    details = hold(samples.sql_details(raw["sql"], ids))
    texts = samples.sql_text_rows(details)
    out.appended["sql_details"] = details
    named = merges.text_references(out.appended.get("sql_samples"), texts, out.appended.get("session_samples"), out.appended.get("blocking_session_samples"))
    merged = merges.merge_sql_texts(state["sql_texts"], None, texts)
    out.states["sql_texts"] = merges.touch(merged, named, ["source_database", "sql_id"])
    out.states["sql_cursor_metadata"] = merges.merge_cursor_metadata(state["sql_cursor_metadata"], details)
    candidates = details.where(F.col("child_number").isNotNull() & (F.col("plan_hash_value") > 0))
    if "sql_plan" in raw:
        missing, _ = samples.plan_cache_step(state[KNOWN_PLANS], candidates, state[KNOWN_PLANS].limit(0))
        lines = hold(samples.plan_lines(raw["sql_plan"].withColumnsRenamed({"id": "plan_line_id"}), missing))
        _, known = samples.plan_cache_step(state[KNOWN_PLANS], candidates, lines)
        out.states[KNOWN_PLANS] = known
        missing_columns = {f.name: F.lit(None).cast(f.dataType) for f in schemas.STORED["sql_plans"].fields if f.name not in (*lines.columns, *merges.PLAN_TIMES)}
        plans = merges.merge_sql_plans(state["sql_plans"], lines.withColumns(missing_columns))
        out.states["sql_plans"] = merges.touch(plans, merges.plan_references(details), merges.CURSOR_KEYS)


def commit_pass(spark: SparkSession, root: str, pass_id: int, result: PassResult, flushed_at: Column) -> bool:
    """Publish the rows of a pass, its states and its accounting as one; a replay changes nothing (returns False).

    The accounting counts the rows as written.  A pass that stopped half-way was not published, and
    is written anew as a whole, so rows, states and accounting always come from one run.
    """
    daily, schema = "repository_daily_ingest", schemas.STORED["repository_daily_ingest"]

    def complete(written: dict[str, DataFrame]) -> None:
        stored = sinks.read_state(spark, root, daily, schema, before=pass_id)
        counted = {k: v for k, v in written.items() if k in accounting.DATASETS}
        total = accounting.merge_daily_ingest(stored, accounting.daily_ingest(counted), flushed_at) if counted else stored
        for name, df in {**result.states, daily: merges.evolve(total, schema)}.items():
            sinks.write_state(spark, root, name, df, pass_id, anew=True)

    return sinks.commit_batch(spark, root, pass_id, result.appended, complete)


def perform_pass(spark: SparkSession, root: str, pass_id: int, raw: dict[str, DataFrame], as_of: Column, **options) -> bool:
    """Run a pass on the states that the one before left, and commit it; returns False for one already committed.

    Tables that others derive from are computed once and kept while the pass is written.
    """
    if sinks.is_committed(spark, root, pass_id):
        return False
    held: list[DataFrame] = []

    def hold(df: DataFrame) -> DataFrame:
        held.append(df.persist())
        return held[-1]

    try:
        return commit_pass(spark, root, pass_id, run_pass(raw, read_states(spark, root, pass_id), as_of, hold=hold, **options), as_of)
    finally:
        for df in held:
            df.unpersist()


def read_states(spark: SparkSession, root: str, before: int | None = None) -> dict[str, DataFrame]:
    """The states that the newest published pass (before ``before``) left."""
    published = [last for _, last in sinks.manifest(spark, root)[1]["batches"]]
    limit = max(published, default=-1) + 1
    limit = limit if before is None else min(limit, before)
    return {name: sinks.read_state(spark, root, name, schema, limit) for name, schema in state_schemas().items()}
