"""Structured Streaming twins of the batch operators.

Feeds that need a whole snapshot or a store run in ``foreachBatch`` on the batch
functions; every write there is keyed by the batch id, so a replay after a lost
executor or driver changes nothing.  Per-key folds use keyed state.  Batches are
bounded by the source options of the stream (``maxFilesPerTrigger``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from fleetlens import schemas
from fleetlens.operators import accounting, deltas, merges, samples
from fleetlens.operators.timeline import (
    chained, gathered, newest_per_key, previous_values, replayed, slot_functions, spacing, ticks_of, upcoming,
)
from fleetlens.sources import sinks


def read_landed(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", **options) -> DataFrame:
    """A stream over landed files."""
    return spark.readStream.schema(schema).options(**options).format(fmt).load(path)


def per_batch(stream: DataFrame, checkpoint: str, step, available_now: bool = True,
              processing_time: str | None = None) -> StreamingQuery:
    """Run ``step`` on every micro-batch, which is computed once and kept while the step runs."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            step(batch, batch_id)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return _trigger(writer, available_now, processing_time).start()


def to_files(stream: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = (),
             available_now: bool = True, processing_time: str | None = None) -> StreamingQuery:
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return _trigger(writer, available_now, processing_time).start(path)


def _trigger(writer, available_now, processing_time):
    if processing_time:
        return writer.trigger(processingTime=processing_time)
    return writer.trigger(availableNow=True) if available_now else writer


# --- stores --------------------------------------------------------------------

def stream_activity(stream: DataFrame, root: str, checkpoint: str, keys=merges.ACTIVITY_KEYS,
                    seq: str = "poll", **trigger) -> StreamingQuery:
    """Overlapping activity polls into an exactly-once store.

    Each batch inserts the rows whose key is not stored yet, however late they are;
    only the stored days the batch touches are read.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        days = [r[0] for r in batch.select(F.to_date("sample_time")).distinct().collect()]
        stored = sinks.read_table(spark, root, "database_activity_samples", days)
        fresh = merges.dedupe_insert(stored, batch, keys, seq)
        sinks.commit_batch(spark, root, batch_id, {"database_activity_samples": fresh})

    return per_batch(stream, checkpoint, step, **trigger)


def stream_activity_bounded(stream: DataFrame, path: str, checkpoint: str, lateness: str,
                            keys=merges.ACTIVITY_KEYS, **trigger) -> StreamingQuery:
    """Like :func:`stream_activity` for feeds whose rows are never later than ``lateness``:
    duplicates are found in bounded state, the store is not read."""
    rows = stream.withColumn("session_serial_number_key", F.coalesce("session_serial_number", F.lit(-1)))
    names = [k for k in keys if k != "session_serial_number"] + ["session_serial_number_key"]
    rows = rows.withWatermark("sample_time", lateness).dropDuplicatesWithinWatermark(names)
    rows = rows.drop("session_serial_number_key").withColumn("day", F.to_date("sample_time"))
    return to_files(rows, path, checkpoint, ["day"], **trigger)


def stream_latest(stream: DataFrame, root: str, name: str, checkpoint: str, keys: Sequence[str], ts: str,
                  schema: T.StructType, tie: str = "last", seq: str = "seq", complete: bool = False,
                  **trigger) -> StreamingQuery:
    """Latest-state table kept by merging every batch."""
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stored = sinks.read_state(spark, root, name, schema, before=batch_id)
        merged = merges.merge_latest(stored, batch, keys, ts, tie, seq)
        if complete:
            merged = merged.join(batch.select(*keys).distinct(), list(keys), "left_semi")
        sinks.write_state(spark, root, name, merges.evolve(merged, schema), batch_id)

    return per_batch(stream, checkpoint, step, **trigger)


def stream_daily_ingest(stream: DataFrame, root: str, checkpoint: str, dataset: str, **trigger) -> StreamingQuery:
    """Daily accounting: each batch's increments are added once, keyed by its id."""
    schema = schemas.STORED["repository_daily_ingest"]
    name = "repository_daily_ingest"

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stored = sinks.read_state(spark, root, name, schema, before=batch_id)
        increments = accounting.daily_ingest({dataset: batch})
        merged = accounting.merge_daily_ingest(stored, increments)
        sinks.write_state(spark, root, name, merges.evolve(merged, schema), batch_id)

    return per_batch(stream, checkpoint, step, **trigger)


SNAPSHOT = ["source_database", "collected_at"]


def _newest(df: DataFrame | None, spark: SparkSession, schema: str, keys: Sequence[str]) -> DataFrame:
    """Newest revision of every key."""
    known = spark.createDataFrame([], schema) if df is None else df
    return known.groupBy(*keys).agg(F.max("revision").alias("revision"))


def _days(df: DataFrame, *columns: str) -> list:
    """The distinct days of a few time columns; a batch touches few."""
    every = F.array(*[F.to_date(c) for c in columns])
    return [r[0] for r in df.select(F.explode(every).alias("day")).where("day is not null").distinct().collect()]


def stream_consumers(stream: DataFrame, root: str, checkpoint: str, keys=deltas.CONSUMER_KEYS,
                     counters=deltas.CONSUMER_COUNTERS, complete=None, takes=None, n: int = 20,
                     **trigger) -> StreamingQuery:
    """Consumer deltas of complete snapshots, and the top consumers of every take.

    ``complete(spark)`` gives the complete snapshots (database, time), as scrape statuses name
    them; a snapshot that it does not name yet is stored and waits.  Without it a snapshot counts
    as it has arrived so far.  ``takes(spark)`` gives the takes (database, time).

    A batch computes the snapshots that are new, became complete or got more rows, and the one
    after each, whose baseline they may be; likewise the takes that these fall into.  Results carry
    the batch as revision and replace older ones of the same snapshot or take: read them with
    :func:`consumer_deltas` and :func:`top_consumers`.  Of the snapshots only the days in question
    are read; the list of snapshots done has two narrow columns per snapshot.
    """
    counters = [c for c in counters if c in stream.columns]

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = _newest(sinks.read_table(spark, root, "consumer_done"), spark, "source_database string, collected_at timestamp, revision long", SNAPSHOT)
        here = batch.select(*SNAPSHOT).distinct().withColumn("_here", F.lit(True))
        known = complete(spark) if complete else here.unionByName(done, allowMissingColumns=True)
        times = known.select(*SNAPSHOT).distinct().join(here, SNAPSHOT, "left").join(done, SNAPSHOT, "left")
        fresh = F.col("revision").isNull() | F.col("_here").isNotNull()
        order = Window.partitionBy("source_database").orderBy("collected_at")
        todo = (times.withColumn("_fresh", fresh)
                .withColumns({"_before": F.lag("collected_at").over(order), "_after_fresh": F.coalesce(F.lag("_fresh").over(order), F.lit(False))})
                .where(F.col("_fresh") | F.col("_after_fresh")).select(*SNAPSHOT, "_before")).persist()
        needed = todo.select(*SNAPSHOT).unionByName(todo.where("_before is not null").select("source_database", F.col("_before").alias("collected_at"))).distinct()
        stored = sinks.read_table(spark, root, "consumer_snapshots", _days(todo, "collected_at", "_before"))
        rows = batch if stored is None else batch.unionByName(stored.select(*batch.columns))
        made = deltas.consumer_delta(rows.join(needed, SNAPSHOT, "left_semi"), keys, counters, snapshots=needed)
        made = made.join(todo, SNAPSHOT, "left_semi").persist()
        revision = F.lit(batch_id).cast("long").alias("revision")
        tables = {
            "consumer_snapshots": batch,
            "consumer_deltas": made.select("*", revision),
            "consumer_done": todo.select(*SNAPSHOT, revision),
        }
        given = takes(spark).select(*SNAPSHOT).where("source_database is not null and collected_at is not null").distinct().persist() if takes else None
        if takes:
            tables |= _retake(spark, root, done, todo, made, given, n, revision)
        sinks.commit_batch(spark, root, batch_id, tables)
        if takes:
            given.unpersist()
        made.unpersist()
        todo.unpersist()

    return per_batch(stream, checkpoint, step, **trigger)


def _retake(spark, root, done, todo, made, takes, n, revision) -> dict[str, DataFrame]:
    """Top consumers of those of the distinct ``takes`` that are new, follow a new one, or whose snapshots changed."""
    keys = ["source_database", "taken_at"]
    before = _newest(sinks.read_table(spark, root, "takes_done"), spark, "source_database string, taken_at timestamp, revision long", keys)
    changed = upcoming(todo.select(*SNAPSHOT), takes, ["source_database"], "collected_at", "taken_at").select(*keys).distinct()
    spans = (takes.withColumnRenamed("collected_at", "taken_at").join(before, keys, "left")
             .join(changed.withColumn("_changed", F.lit(True)), keys, "left").withColumn("_new", F.col("revision").isNull()))
    spans = previous_values(spans, ["source_database"], "taken_at", ["taken_at", "_new"])
    redo = (spans.where(F.col("_new") | F.col("_changed") | F.col("prev__new"))
            .select(*keys, F.col("prev_taken_at").alias("_since")).persist())
    first, last = redo.agg(F.min("_since"), F.max("taken_at")).first()
    whole = redo.where("_since is null").isEmpty()
    kept = consumer_deltas(spark, root, done)
    rows = made
    if kept is not None:
        if last is not None:
            kept = kept.where(F.col("day") <= F.lit(last.date()))
            kept = kept.where(F.col("day") >= F.lit(first.date())) if whole and first else kept
        rows = made.unionByName(kept.join(todo, SNAPSHOT, "left_anti").select(*made.columns))
    top = deltas.ranked_work(deltas.work_at_takes(rows, takes).join(redo, keys, "left_semi"), n)
    return {"top_consumers": top.select("*", revision), "takes_done": redo.select(*keys, revision)}


def consumer_deltas(spark: SparkSession, root: str, done: DataFrame | None = None) -> DataFrame | None:
    """The stored deltas in force: those of the newest revision of every snapshot."""
    made = sinks.read_table(spark, root, "consumer_deltas")
    if made is None:
        return None
    if done is None:
        done = _newest(sinks.read_table(spark, root, "consumer_done"), spark, "", SNAPSHOT)
    return made.join(done, [*SNAPSHOT, "revision"], "left_semi")


def top_consumers(spark: SparkSession, root: str) -> DataFrame | None:
    """The stored top consumers in force."""
    made, keys = sinks.read_table(spark, root, "top_consumers"), ["source_database", "taken_at"]
    if made is None:
        return None
    return made.join(_newest(sinks.read_table(spark, root, "takes_done"), spark, "", keys), [*keys, "revision"], "left_semi")


def stream_counter_store(stream: DataFrame, root: str, checkpoint: str, keys=deltas.SERIES_KEYS,
                         ts: str = "collected_at", value: str = "cumulative_value", seq: str = "seq",
                         table: str = "system_counter_samples", **trigger) -> StreamingQuery:
    """Counter delta with reset across micro-batches, in whatever order the readings come.

    Beside the readings the store keeps the first and the last one of every series and day.  They
    give the neighbours of a reading across days, so that a batch reads the readings of its own days only,
    however late it is.  The reading behind a late one is computed anew; results carry the batch as
    revision, and :func:`counter_samples` reads the newest of each reading.
    """
    keys, ends = list(keys), f"{table}_days"
    reading = F.struct(ts, seq, value)

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        needed = batch.select(*keys, ts, seq, value).where(F.col(ts).isNotNull())
        here = needed.groupBy(*keys, F.to_date(ts).alias("_day")).agg(F.min(reading).alias("first_reading"), F.max(reading).alias("last_reading"))
        days = _days(needed, ts)
        known, stored = sinks.read_table(spark, root, ends), sinks.read_table(spark, root, table, days)
        rows = needed.withColumn("_new", F.lit(True))
        if known is not None:
            # one row per day of a series that the batch names, not per reading
            both = here.select(*keys, "_day", F.lit(True).alias("_touched")).unionByName(
                known.select(*keys, F.to_date("first_at").alias("_day"), "first_reading", "last_reading"), allowMissingColumns=True)
            per_day = both.groupBy(*keys, "_day").agg(F.max("_touched").alias("_touched"), F.min("first_reading").alias("f"), F.max("last_reading").alias("l"))
            order = Window.partitionBy(*keys).orderBy("_day")
            before, behind = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
            beside = per_day.withColumns({"_before": F.last("l", ignorenulls=True).over(before), "_behind": F.first("f", ignorenulls=True).over(behind)})
            edges = beside.where("_touched").select(*keys, F.explode(F.array("_before", "_behind")).alias("r")).where("r is not null").select(*keys, "r.*")
            old = stored.select(*keys, ts, seq, value).unionByName(edges).withColumn("_new", F.lit(False))
            rows = rows.unionByName(old).groupBy(*keys, ts, seq, value).agg(F.max("_new").alias("_new"))
        rows = previous_values(rows, keys, ts, ["_new"], seq)
        made = deltas.counter_delta(rows, keys, ts, value, seq).where("_new or coalesce(prev__new, false)").drop("_new", "prev__new", f"prev_{ts}")
        marks = here.select(*keys, F.col(f"first_reading.{ts}").alias("first_at"), "first_reading", "last_reading")
        sinks.commit_batch(spark, root, batch_id, {table: made.withColumn("revision", F.lit(batch_id).cast("long")), ends: marks})

    return per_batch(stream, checkpoint, step, **trigger)


def counter_samples(spark: SparkSession, root: str, keys=deltas.SERIES_KEYS, ts: str = "collected_at", seq: str = "seq",
                    table: str = "system_counter_samples", days: list | None = None) -> DataFrame | None:
    """The stored readings with the deltas in force, of some days or all."""
    made = sinks.read_table(spark, root, table, days)
    return None if made is None else newest_per_key(made, [*keys, ts, seq], ["revision"])


def thin_slot(interval: float) -> float:
    """Seconds of a slot in the store: at most a day, unless the interval is longer."""
    return max(interval, min(interval * 512, 86_400.0), 1.0)


def _same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """A semi or anti join in which NULL keys are equal."""
    other = right.select(*[F.col(k).alias(f"_other_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_other_{k}"))
    return left.join(other, same, how)


def stream_thin_store(stream: DataFrame, root: str, checkpoint: str, keys: Sequence[str], ts: str, interval: float,
                      strict: bool = False, table: str = "kept_ticks", **trigger) -> StreamingQuery:
    """Minimum-spacing thinning across micro-batches, in whatever order the ticks come.

    The store keeps the ticks by day and one function per (key, slot) of how a last kept time
    that enters the slot leaves it.  A batch solves the slots it touches anew, chains the functions of
    its keys from there on, and replays the slots that are touched or entered otherwise
    than before; only their days are read.  Results carry the batch as revision; :func:`kept_ticks`
    reads those in force.
    """
    keys, gap, width = list(keys), spacing(interval, strict), thin_slot(interval)
    kept_in, slots_in, ticks_in = table, f"{table}_slots", f"{table}_seen"

    def days_of(slots: DataFrame) -> list:
        end = F.timestamp_micros(F.col("_slot") + int(width * 1_000_000) - 1)
        every = slots.select(F.explode(F.sequence(F.to_date(F.timestamp_micros("_slot")), F.to_date(end))).alias("day"))
        return [r[0] for r in every.distinct().collect()]

    def with_stored(spark: SparkSession, slots: DataFrame, wanted: DataFrame) -> DataFrame:
        """The gathered ``slots`` and the stored ticks of the ``wanted`` ones."""
        stored = sinks.read_table(spark, root, ticks_in, days_of(wanted))
        return slots if stored is None else slots.unionByName(_same_keys(gathered(ticks_of(stored, keys, "tick_at", width), keys), wanted, [*keys, "_slot"], "left_semi"))

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = gathered(ticks_of(batch, keys, ts, width), keys).persist()
        touched = fresh.select(*keys, "_slot")
        there = with_stored(spark, fresh, touched).persist()
        functions = slot_functions(there, keys, gap).withColumns({"_touched": F.lit(True), "_was": F.lit(None).cast("long")})
        known, starts = _slots(spark, root, slots_in, keys), None
        if known is not None:
            first = touched.groupBy(*[F.col(k).alias(f"_other_{k}") for k in keys]).agg(F.min("_slot").alias("_from"))
            same = F.lit(True)
            for k in keys:
                same = same & F.col(k).eqNullSafe(F.col(f"_other_{k}"))
            near = known.join(first, same).drop(*[f"_other_{k}" for k in keys]).persist()
            starts = near.where("_slot < _from").groupBy(*keys).agg(F.max_by("_leave", "_slot").alias("_start"))
            behind = _same_keys(near.where("_slot >= _from"), touched, [*keys, "_slot"], "left_anti")
            functions = functions.unionByName(behind.select(*keys, "_slot", "_starts", "_exits", F.lit(False).alias("_touched"), F.col("_entry").alias("_was")))
        functions = functions.persist()
        entries = chained(functions.select(*keys, "_slot", "_starts", "_exits"), keys, gap, width, starts)
        names = [*keys, "_slot"]
        both = functions.unionByName(entries, allowMissingColumns=True).groupBy(*names).agg(
            *[F.first(c, ignorenulls=True).alias(c) for c in ("_starts", "_exits", "_touched", "_was", "_entry", "_leave")])
        changed = both.where("_touched or _was <> _entry").persist()
        slots = there if known is None else with_stored(spark, there, changed.where("not _touched"))
        revision = F.lit(batch_id).cast("long").alias("revision")
        kept = replayed(slots, changed.select(*names, "_entry"), keys, gap)
        sinks.commit_batch(spark, root, batch_id, {
            ticks_in: fresh.select(*keys, F.explode("_ticks").alias("_tick")).select(*keys, F.timestamp_micros("_tick").alias("tick_at")),
            slots_in: changed.select(*names, "_starts", "_exits", "_entry", "_leave", revision),
            kept_in: kept.select(*keys, F.timestamp_micros("_tick").alias(ts), "_slot", revision),
        })
        for held in (fresh, there, functions, changed, *([near] if known is not None else [])):
            held.unpersist()

    return per_batch(stream, checkpoint, step, **trigger)


def _slots(spark: SparkSession, root: str, name: str, keys: Sequence[str]) -> DataFrame | None:
    """Newest revision of every slot."""
    made = sinks.read_table(spark, root, name)
    return None if made is None else newest_per_key(made.drop("batch_id"), [*keys, "_slot"], ["revision"])


def kept_ticks(spark: SparkSession, root: str, keys: Sequence[str], table: str = "kept_ticks") -> DataFrame | None:
    """The stored kept ticks in force: those of the newest revision of every slot."""
    kept, slots = sinks.read_table(spark, root, table), _slots(spark, root, f"{table}_slots", keys)
    return None if kept is None else _same_keys(kept, slots, [*keys, "_slot", "revision"], "left_semi").drop("_slot", "revision", "batch_id", "day")


def stream_plan_cache(candidates: DataFrame, plan_lines: DataFrame, root: str, checkpoint: str,
                      **trigger) -> StreamingQuery:
    """Plan cache: every batch of candidates fetches the unknown plans and remembers them."""
    keys = ["source_database", *samples.PLAN_KEYS]
    schema = T.StructType([f for f in candidates.schema if f.name in keys])

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = sinks.read_state(spark, root, "known_plans", schema, before=batch_id)
        missing, _ = samples.plan_cache_step(known, batch, known.limit(0))
        fetched = samples.plan_lines(plan_lines, missing)
        _, after = samples.plan_cache_step(known, batch, fetched)
        sinks.commit_batch(spark, root, batch_id, {"sql_plans": fetched})
        sinks.write_state(spark, root, "known_plans", merges.evolve(after, schema), batch_id)

    return per_batch(candidates, checkpoint, step, **trigger)


# --- keyed folds -----------------------------------------------------------------
#
# One key's rows of one micro-batch are folded by one task.  These forms suit feeds of
# many small series and low latency; where one series may hold a large share of a
# batch, use the ``*_store`` forms above.

WHOLE = ("bigint", "int", "smallint", "tinyint")
#: Rows of a key that are Python objects at one time.
FOLD_ROWS = 10_000


def ordered_rows(batches, order: Sequence[str], columns: Sequence[str], kinds: dict):
    """Tuples of ``columns`` of one key's frames by ``order``, NULL first, a part at a time.

    The rows lie in Arrow columns, so that a long series takes bytes and not objects a row.
    ``kinds`` gives the columns' types; whole numbers come as text.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    def column(values, kind):
        if kind in WHOLE:
            return pa.array(values, pa.string(), from_pandas=True).cast(pa.int64())
        return pa.array(values, {"string": pa.large_string(), "boolean": pa.bool_(), "double": pa.float64()}.get(kind), from_pandas=True)

    names = list(dict.fromkeys([*order, *columns]))
    rows = pa.concat_tables([pa.table({c: column(b[c], kinds[c]) for c in names}) for b in batches], promote_options="default").combine_chunks()
    places = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in order], null_placement="at_start")
    rows = rows.select(list(columns))
    for at in range(0, len(places), FOLD_ROWS):
        yield list(zip(*(c.to_pylist() for c in rows.take(places[at:at + FOLD_ROWS]).columns)))


def keyed_fold(stream: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str],
               out: str, state: str, start: tuple, step, timeout_ms: int | None = None) -> DataFrame:
    """Fold the rows of every key in ``order`` with keyed state.

    ``step(state, row) -> (state, output tuple or None)`` is called in order within a
    micro-batch; ``out`` names the output columns behind the keys.  With a timeout the
    state of a key that stays silent is dropped.
    """
    keys, order, columns = list(keys), list(order), list(columns)
    key_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema if f.name in keys)
    names = [part.strip().split(" ")[0].strip("`") for part in out.split(",")]
    key_names = [f.name for f in stream.schema if f.name in keys]

    def run(key, batches, group):
        import pandas as pd

        if group.hasTimedOut:
            group.remove()
            return
        value = group.get if group.exists else start
        for rows in ordered_rows(batches, order, columns, kinds):
            made = []
            for row in rows:
                value, result = step(value, row)
                if result is not None:
                    made.append(key + result)
            if made:
                yield pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip(key_names + names, zip(*made))})
        group.update(value)
        if timeout_ms is not None:
            group.setTimeoutDuration(timeout_ms)

    wait = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms is not None else GroupStateTimeout.NoTimeout
    # Whole numbers travel as text: beside a NULL, pandas would turn them into floats and lose digits.
    names_needed = list(dict.fromkeys([*key_names, *order, *columns]))
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    whole = [c for c in names_needed if c not in key_names and kinds[c] in WHOLE]
    needed = stream.select(*[F.col(c).cast("string").alias(c) if c in whole else F.col(c) for c in names_needed])
    return needed.groupBy(*key_names).applyInPandasWithState(run, f"{key_ddl}, {out}", state, "append", wait)


def stream_counter_delta(stream: DataFrame, keys=deltas.SERIES_KEYS, value: str = "cumulative_value",
                         seq: str = "seq", timeout_ms: int | None = None) -> DataFrame:
    """Counter delta with reset across micro-batches."""
    rows = stream.withColumn("_at", F.unix_micros("collected_at"))

    def step(state, row):
        at, seq_, now = row
        before, last = state
        if at is None:
            return state, (seq_, at, now, None, None, False)
        if before is None or at <= before:
            made = (seq_, at, now, None, None, False)
        elif now is None or last is None:
            made = (seq_, at, now, None, (at - before) / 1e6, False)
        elif now < last:
            made = (seq_, at, now, None, (at - before) / 1e6, True)
        else:
            made = (seq_, at, now, now - last, (at - before) / 1e6, False)
        return (at, now), made

    out = (f"{seq} long, _at long, cumulative_value long, delta_value long, interval_seconds double, "
           "counter_reset boolean")
    folded = keyed_fold(rows, keys, ["_at", seq], ["_at", seq, value], out, "at long, value long",
                        (None, None), step, timeout_ms)
    return folded.withColumn("collected_at", F.timestamp_micros("_at")).drop("_at")


def stream_thin(stream: DataFrame, keys: Sequence[str], ts: str, interval: float, strict: bool = False) -> DataFrame:
    """Minimum-spacing thinning across micro-batches."""
    rows = stream.withColumn("_at", F.unix_micros(ts))
    gap = int(interval * 1_000_000) + (1 if strict else 0)

    def step(state, row):
        at, last = row[0], state[0]
        if at is None:
            return state, None
        if last is not None and at < last + gap:
            return state, None
        return (at,), (at,)

    kept = keyed_fold(rows, keys, ["_at"], ["_at"], "_at long", "at long", (None,), step)
    return kept.select(*keys, F.timestamp_micros("_at").alias(ts))


def stream_connection_states(stream: DataFrame, seq: str = "seq") -> DataFrame:
    """State of every database after each of its connection events."""
    rows = stream.withColumn("_at", F.unix_micros("event_at"))
    start = ("STARTING", None, None, None, None, None, None, 0, None)

    def step(state, row):
        at, seq_, kind, message, duration = row
        duration = None if duration is None or duration != duration else float(duration)
        name, queued, failed, failure, probed, took, probe_error, attempts, recovered = state
        if kind == "probe_start":
            if name == "QUARANTINED":
                name, probed, took, probe_error, attempts = "PROBING", at, None, None, attempts + 1
        elif kind in ("failure", "probe_failed"):
            if kind == "probe_failed":
                took, probe_error = duration, message
            if queued is None or name not in ("QUARANTINED", "PROBING"):
                queued = at
            name, failed = "QUARANTINED", at
            failure = message if message is not None else "database connection is unavailable"
        else:
            if kind == "probe_ok":
                took, recovered = duration, at
            name, queued, probe_error = "ACTIVE", None, None
        state = (name, queued, failed, failure, probed, took, probe_error, attempts, recovered)
        return state, (seq_, at, *state)

    fields = ("state string, queued_us long, failed_us long, last_failure string, probed_us long, "
              "last_probe_duration_seconds double, last_probe_error string, probe_attempts long, recovered_us long")
    folded = keyed_fold(rows, ["source_database"], ["_at", seq], ["_at", seq, "kind", "message", "duration_seconds"],
                        f"{seq} long, observed_us long, {fields}", fields, start, step)
    times = {"observed_us": "observed_at", "queued_us": "queued_at", "failed_us": "last_failure_at",
             "probed_us": "last_probe_at", "recovered_us": "recovered_at"}
    return folded.select("source_database", seq, *[
        F.timestamp_micros(c).alias(times[c]) if c in times else F.col(c)
        for c in folded.columns if c not in ("source_database", seq)
    ])


def stream_backoff(stream: DataFrame, seq: str = "seq") -> DataFrame:
    """Consecutive failures and the earliest retry after each outcome of a database."""
    rows = stream.withColumn("_at", F.unix_micros("collected_at"))

    def step(state, row):
        at, seq_, success = row
        # An unknown outcome is neither a success nor a failure.
        failures = state[0] if success is None else 0 if success else state[0] + 1
        wait = min(60 * 2 ** min(failures - 1, 4), 900) if failures else 0
        return (failures,), (seq_, at, failures, wait, at + wait * 1_000_000 if success is not None and not success else None)

    out = f"{seq} long, _at long, consecutive_failures long, backoff_seconds long, _retry long"
    folded = keyed_fold(rows, ["source_database"], ["_at", seq], ["_at", seq, "success"], out, "failures long",
                        (0,), step)
    return folded.select("source_database", seq, F.timestamp_micros("_at").alias("collected_at"),
                         "consecutive_failures", "backoff_seconds", F.timestamp_micros("_retry").alias("retry_at"))


def stream_pending(stream: DataFrame) -> DataFrame:
    """Pending and firing state after each evaluation of a rule and label set.

    ``stream``: rule_id, labels_key, evaluated_at, breached, hold_seconds.
    """
    rows = stream.withColumn("_at", F.unix_micros("evaluated_at"))

    def step(state, row):
        at, breached, hold = row
        if breached is None:
            since = state[0]
        else:
            since = (state[0] if state[0] is not None else at) if breached else None
        firing = since is not None and at - since >= hold * 1_000_000
        return (since,), (at, breached, since, firing)

    folded = keyed_fold(rows, ["rule_id", "labels_key"], ["_at"], ["_at", "breached", "hold_seconds"],
                        "_at long, breached boolean, _since long, firing boolean", "since long", (None,), step)
    return folded.select("rule_id", "labels_key", F.timestamp_micros("_at").alias("evaluated_at"), "breached",
                         F.timestamp_micros("_since").alias("pending_since"), "firing")
