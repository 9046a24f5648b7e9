import random

from pyspark.sql import functions as F

from fleetlens.operators import deltas, merges, timeline
from fleetlens.schemas import STORED
from fleetlens.sources import sinks
from fleetlens.streaming import jobs


def land(spark, tmp_path, df, cuts, order):
    """Write rows in ``order`` as one file per slice, oldest file first, and stream them one by one."""
    import os

    folder = tmp_path / "landed"
    rows = df.orderBy(order).collect()
    bounds = [0, *cuts, len(rows)]
    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
        part = tmp_path / f"part{i}"
        spark.createDataFrame(rows[a:b], df.schema).coalesce(1).write.parquet(str(part))
        folder.mkdir(exist_ok=True)
        file = next(p for p in part.iterdir() if p.suffix == ".parquet")
        target = folder / f"{i}.parquet"
        target.write_bytes(file.read_bytes())
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    return jobs.read_landed(spark, str(folder), df.schema, maxFilesPerTrigger=1)


def files(spark, tmp_path, stream, name="out"):
    jobs.to_files(stream, str(tmp_path / name), str(tmp_path / f"{name}-checkpoint")).awaitTermination()
    return spark.read.parquet(str(tmp_path / name))


def counters(spark, at, n=300):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "b"]), 1, 0, "s", at(i // 2), i, rng.randrange(100)) for i in range(n)]
    return spark.createDataFrame(rows, "source_database string, inst_id long, con_id long, stat_name string, "
                                       "collected_at timestamp, seq long, cumulative_value long")


def same(a, b):
    names = sorted(a.columns)
    assert sorted(b.columns) == names
    left, right = a.select(*names), b.select(*names)
    assert left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


def test_counter_delta_over_batches(spark, at, tmp_path):
    df = counters(spark, at)
    stream = land(spark, tmp_path, df, [70, 71, 180], "seq")
    same(files(spark, tmp_path, jobs.stream_counter_delta(stream)), deltas.counter_delta(df))


def test_counter_store_over_batches(spark, at, tmp_path):
    df = counters(spark, at)
    stream = land(spark, tmp_path, df, [70, 71, 180], "seq")
    root = str(tmp_path / "store")
    jobs.stream_counter_store(stream, root, str(tmp_path / "cp")).awaitTermination()
    same(jobs.counter_samples(spark, root).drop("batch_id", "day", "revision"), deltas.counter_delta(df))


def test_late_readings_equal_the_batch_form(spark, at, tmp_path):
    """Readings of several days land in an order of their own; a replay under a new checkpoint changes nothing."""
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "b", None]), 1, None, "s", at(rng.randrange(12) * 40_000 + rng.randrange(3)), i, rng.choice([None, *range(50)])) for i in range(160)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], counters(spark, at, 1).schema.add("landed", "long"))
    stream = land(spark, tmp_path, df, [30, 60, 61, 120], "landed").drop("landed")
    root = str(tmp_path / "store")
    jobs.stream_counter_store(stream, root, str(tmp_path / "cp")).awaitTermination()
    whole = deltas.counter_delta(df.drop("landed"))
    same(jobs.counter_samples(spark, root).drop("batch_id", "day", "revision"), whole)
    days = [r[0] for r in df.select(F.to_date("collected_at")).distinct().limit(1).collect()]
    same(jobs.counter_samples(spark, root, days=days).drop("batch_id", "day", "revision"), whole.where(F.to_date("collected_at") == F.lit(days[0])))
    jobs.stream_counter_store(stream, root, str(tmp_path / "cp2")).awaitTermination()
    same(jobs.counter_samples(spark, root).drop("batch_id", "day", "revision"), whole)


def test_thin_store_over_batches(spark, at, tmp_path):
    df = counters(spark, at)
    for strict in (False, True):
        (tmp_path / str(strict)).mkdir()
        stream = land(spark, tmp_path / str(strict), df, [33, 150], "seq")
        root = str(tmp_path / str(strict) / "store")
        jobs.stream_thin_store(stream, root, str(tmp_path / str(strict) / "cp"), ["source_database"], "collected_at", 7,
                               strict).awaitTermination()
        same(jobs.kept_ticks(spark, root, ["source_database"]),
             timeline.thin(df, ["source_database"], "collected_at", 7, strict))


def test_late_ticks_equal_the_batch_form(spark, at, tmp_path):
    """Ticks over some days land in an order of their own; a replay under a new checkpoint changes nothing."""
    rng = random.Random(6)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), at(rng.randrange(3) * 86_000 + rng.randrange(4000)), i) for i in range(500)]
    df = spark.createDataFrame(rows, "source_database string, collected_at timestamp, landed long")
    stream = land(spark, tmp_path, df, [100, 101, 300], "landed").drop("landed")
    root, whole = str(tmp_path / "store"), timeline.thin(df, ["source_database"], "collected_at", 50)
    for checkpoint in ("cp", "cp2"):
        jobs.stream_thin_store(stream, root, str(tmp_path / checkpoint), ["source_database"], "collected_at", 50).awaitTermination()
        same(jobs.kept_ticks(spark, root, ["source_database"]), whole)
    slots = sinks.read_table(spark, root, "kept_ticks_slots")
    assert slots.where("revision = 1").count() < slots.where("revision = 0").count()  # one tick does not solve every slot anew


def test_thinning_over_batches(spark, at, tmp_path):
    df = counters(spark, at)
    stream = land(spark, tmp_path, df, [33, 150], "seq")
    kept = files(spark, tmp_path, jobs.stream_thin(stream, ["source_database"], "collected_at", 7))
    same(kept, timeline.thin(df, ["source_database"], "collected_at", 7))


def test_connection_states_over_batches(spark, at, tmp_path):
    rng = random.Random(4)
    kinds = ["failure", "probe_start", "probe_failed", "probe_ok", "activate"]
    rows = [(rng.choice("abc"), at(i), i, rng.choice(kinds), rng.choice([None, f"m{i}"]), 0.25) for i in range(200)]
    df = spark.createDataFrame(rows, "source_database string, event_at timestamp, seq long, kind string, message string, duration_seconds double")
    stream = land(spark, tmp_path, df, [20, 120], "seq")
    states = files(spark, tmp_path, jobs.stream_connection_states(stream))
    last = timeline.newest_per_key(states, ["source_database"], ["observed_at", "seq"]).drop("seq")
    same(last, deltas.connection_states(df))


def test_activity_store_is_exactly_once(spark, at, tmp_path):
    rows = [(at(t * 3600), "db", 1, t, 1, None if t % 2 else t, poll) for poll in (1, 2) for t in range(60)]
    df = spark.createDataFrame(rows, "sample_time timestamp, source_database string, inst_id long, sample_id long, "
                                     "session_id long, session_serial_number long, poll long")
    stream = land(spark, tmp_path, df, [50, 90], "poll")
    root = str(tmp_path / "store")
    jobs.stream_activity(stream, root, str(tmp_path / "cp")).awaitTermination()
    assert sinks.read_table(spark, root, "database_activity_samples").count() == 60
    # A new checkpoint replays every batch against the store.
    jobs.stream_activity(stream, root, str(tmp_path / "cp2")).awaitTermination()
    got = sinks.read_table(spark, root, "database_activity_samples")
    assert got.count() == 60 and got.select("sample_id").distinct().count() == 60


def test_latest_state_over_batches(spark, at, tmp_path):
    rng = random.Random(9)
    rows = [(at(rng.randrange(30)), rng.choice("ab"), rng.choice("xy"), bool(i % 3), 0.1, i, None, i) for i in range(100)]
    df = spark.createDataFrame(rows, "collected_at timestamp, source_database string, collector string, success boolean, "
                                     "duration_seconds double, sample_count long, error_message string, seq long")
    stream = land(spark, tmp_path, df, [10, 60], "seq")
    root, keys = str(tmp_path / "state"), ["source_database", "collector"]
    stored = STORED["latest_scrape_status"]
    jobs.stream_latest(stream, root, "latest", str(tmp_path / "cp"), keys, "collected_at", stored).awaitTermination()
    whole = merges.merge_latest(spark.createDataFrame([], stored), df, keys, "collected_at")
    same(sinks.read_state(spark, root, "latest", stored), whole)


def test_daily_ingest_adds_each_batch_once(spark, at, tmp_path):
    df = counters(spark, at)
    stream = land(spark, tmp_path, df, [100, 200], "seq")
    root = str(tmp_path / "state")
    jobs.stream_daily_ingest(stream, root, str(tmp_path / "cp"), "system_counter_samples").awaitTermination()
    jobs.stream_daily_ingest(stream, root, str(tmp_path / "cp2"), "system_counter_samples").awaitTermination()
    daily = sinks.read_state(spark, root, "repository_daily_ingest", STORED["repository_daily_ingest"])
    assert daily.agg(F.sum("system_counter_sample_rows")).first()[0] == df.count()


def test_consumer_delta_over_snapshots(spark, at, tmp_path):
    rng = random.Random(2)
    rows = [("db", 1, f"s{k}", 1, at(60 * t), rng.randrange(1000), rng.randrange(10), 0) for t in range(9) for k in range(6)
            if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "source_database string, inst_id long, sql_id string, plan_hash_value long, collected_at timestamp, "
                                     "elapsed_time_micro long, cpu_time_micro long, user_io_wait_micro long")
    times = [r[4] for r in sorted(rows, key=lambda r: r[4])]
    cuts = [times.index(at(180)), times.index(at(360))]
    stream = land(spark, tmp_path, df, cuts, "collected_at")
    root = str(tmp_path / "store")
    jobs.stream_consumers(stream, root, str(tmp_path / "cp")).awaitTermination()
    same(jobs.consumer_deltas(spark, root).drop("batch_id", "day", "revision"), deltas.consumer_delta(df))


def snapshots(spark, at, seed, n=9):
    rng = random.Random(seed)
    rows = [(db, 1, f"s{k}", 1, at(60 * t), rng.randrange(1000), rng.randrange(10), 0) for db in ("db", "other") for t in range(n) for k in range(6)
            if rng.random() < 0.8]
    rng.shuffle(rows)
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "source_database string, inst_id long, sql_id string, plan_hash_value long, "
                                 "collected_at timestamp, elapsed_time_micro long, cpu_time_micro long, user_io_wait_micro long, arrival long")


def test_split_and_late_snapshots_equal_the_batch_form(spark, at, tmp_path):
    df = snapshots(spark, at, 5)
    stream = land(spark, tmp_path, df, [20, 45, 60], "arrival").drop("arrival")
    root = str(tmp_path / "store")
    takes = spark.createDataFrame([("db", at(130)), ("db", at(400)), ("other", at(300))], "source_database string, collected_at timestamp")
    jobs.stream_consumers(stream, root, str(tmp_path / "cp"), takes=lambda s: takes, n=3).awaitTermination()
    whole = deltas.consumer_delta(df.drop("arrival"))
    same(jobs.consumer_deltas(spark, root).drop("batch_id", "day", "revision"), whole)
    same(jobs.top_consumers(spark, root).drop("batch_id", "day", "revision"), deltas.top_consumers(whole, n=3, takes=takes))


def test_late_takes_shorten_the_one_behind(spark, at, tmp_path):
    df = snapshots(spark, at, 8)
    stream = land(spark, tmp_path, df, [20, 45, 60], "arrival").drop("arrival")
    root, calls = str(tmp_path / "store"), []
    lists = [[130, 400], [130, 400], [130, 250, 400], [130, 250, 400, 410]]

    def takes(s):
        calls.append(1)
        return s.createDataFrame([("db", at(t)) for t in lists[min(len(calls), len(lists)) - 1]], "source_database string, collected_at timestamp")

    jobs.stream_consumers(stream, root, str(tmp_path / "cp"), takes=takes, n=3).awaitTermination()
    assert len(calls) >= 3
    whole = deltas.consumer_delta(df.drop("arrival"))
    last = takes(spark)
    same(jobs.top_consumers(spark, root).drop("batch_id", "day", "revision"), deltas.top_consumers(whole, n=3, takes=last))


def test_incomplete_snapshots_wait(spark, at, tmp_path):
    df = snapshots(spark, at, 6)
    stream = land(spark, tmp_path, df, [30, 60], "arrival").drop("arrival")
    root, named = str(tmp_path / "store"), df.where(F.col("collected_at") < F.lit(at(300))).select("source_database", "collected_at").distinct()
    jobs.stream_consumers(stream, root, str(tmp_path / "cp"), complete=lambda s: named).awaitTermination()
    same(jobs.consumer_deltas(spark, root).drop("batch_id", "day", "revision"), deltas.consumer_delta(df.where(F.col("collected_at") < F.lit(at(300))).drop("arrival")))


def test_keyed_folds_keep_nulls_and_large_numbers(spark, at, tmp_path):
    big = 2**60 + 1
    rows = [("a", 1, 0, "s", at(t), t, v) for t, v in enumerate([big, None, big + 2, big + 5, 3, None])]
    df = spark.createDataFrame(rows, "source_database string, inst_id long, con_id long, stat_name string, collected_at timestamp, seq long, cumulative_value long")
    stream = land(spark, tmp_path, df, [2, 4], "seq")
    got = files(spark, tmp_path, jobs.stream_counter_delta(stream))
    same(got, deltas.counter_delta(df))
    assert got.where("seq = 3").first().delta_value == 3
    outcomes = stream.select("source_database", "collected_at", "seq", F.when(F.col("seq") != 2, F.col("seq") == 4).alias("success"))
    states = files(spark, tmp_path, jobs.stream_backoff(outcomes), "outcomes").orderBy("seq").collect()
    assert [r.consecutive_failures for r in states] == [1, 2, 2, 3, 0, 1]


def test_reads_do_not_grow_with_the_batches(spark, at, tmp_path):
    root, schema = str(tmp_path / "store"), "source_database string, collected_at timestamp, v long"
    listed = []
    for i in range(40):
        sinks.commit_batch(spark, root, i, {"scrape_status": spark.createDataFrame([("a", at(i), i)], schema).coalesce(1)})
        listed.append(len(sinks.manifest(spark, root)[1]["tables"]["scrape_status"]["parts"]))
    stored = sinks.read_table(spark, root, "scrape_status")
    assert stored.count() == 40 and max(listed) <= sinks.MOST_FOLDERS + 1 and len(stored.inputFiles()) <= 2 * sinks.MOST_FOLDERS
    assert len(sinks.versions(spark, f"{root}/{sinks.MANIFESTS}")) <= sinks.KEPT_VERSIONS
    assert not sinks.commit_batch(spark, root, 7, {}) and sinks.read_table(spark, root, "scrape_status", []).count() == 0
    assert sinks.expire(spark, root, "scrape_status", at(86400 * 2)) and sinks.read_table(spark, root, "scrape_status").count() == 40
    sinks.expire(spark, root, "scrape_status", at(86400 * 2), dry_run=False)
    assert sinks.read_table(spark, root, "scrape_status").count() == 0


def test_plan_cache_fetches_a_plan_again_after_it_left(spark, tmp_path):
    schema = "source_database string, inst_id long, sql_id string, child_number long, plan_hash_value long, n long"
    df = spark.createDataFrame([("db", 1, "a", 0, 7, 1), ("db", 1, "a", 0, 7, 2), ("db", 1, "b", 0, 7, 3), ("db", 1, "a", 0, 7, 4)], schema)
    lines = spark.createDataFrame([("db", 1, s, 0, 7, i) for s in "ab" for i in range(2)],
                                  "source_database string, inst_id long, sql_id string, child_number long, plan_hash_value long, plan_line_id long")
    stream = land(spark, tmp_path, df, [1, 2, 3], "n").drop("n")
    root = str(tmp_path / "store")
    jobs.stream_plan_cache(stream, lines, root, str(tmp_path / "cp")).awaitTermination()
    got = sinks.read_table(spark, root, "sql_plans").groupBy("batch_id", "sql_id").count().orderBy("batch_id").collect()
    assert [(r.batch_id, r.sql_id, r["count"]) for r in got] == [(0, "a", 2), (2, "b", 2), (3, "a", 2)]


def test_backoff_and_pending_over_batches(spark, at, tmp_path):
    df = spark.createDataFrame([("a", at(t), t, t in (3,)) for t in range(8)],
                               "source_database string, collected_at timestamp, seq long, success boolean")
    stream = land(spark, tmp_path, df, [2, 5], "seq")
    got = files(spark, tmp_path, jobs.stream_backoff(stream)).orderBy("seq").collect()
    assert [r.consecutive_failures for r in got] == [1, 2, 3, 0, 1, 2, 3, 4]
    assert [r.backoff_seconds for r in got] == [60, 120, 240, 0, 60, 120, 240, 480]
    rows = stream.select(F.lit("r").alias("rule_id"), F.col("source_database").alias("labels_key"),
                         F.col("collected_at").alias("evaluated_at"), (~F.col("success")).alias("breached"),
                         F.lit(2).cast("long").alias("hold_seconds"))
    got = files(spark, tmp_path, jobs.stream_pending(rows), "pending").orderBy("evaluated_at").collect()
    assert [r.firing for r in got] == [False, False, True, False, False, False, True, True]
    assert got[-1].pending_since == at(4)


def test_due_rules_keep_their_state(spark, at, tmp_path):
    from fleetlens.plans import scheduled
    from fleetlens.plans.alerts import Rule

    root, rules = str(tmp_path / "alerts"), [Rule("A-2", "connectivity", 0, 120, "Alerting", "critical"), Rule("A-1", "age", 180, 60, "Alerting", "critical", 300)]
    schema = "source_database string, collector string, collected_at timestamp, success boolean"
    done = []
    for i, ok in enumerate([False, False, False, True]):
        status = spark.createDataFrame([("db", "connectivity", at(60 * i), ok), ("db", "scheduled", at(60 * i), True)], schema)
        done.append(scheduled.evaluate_due(spark, {"latest_scrape_status": status}, root, i, at(60 * i), rules))
    assert done == [["A-2", "A-1"], ["A-2"], ["A-2"], ["A-2"]]
    got = sinks.read_table(spark, root, "alert_evaluations").where("rule_id = 'A-2'").orderBy("evaluated_at").collect()
    assert [(r.breached, r.firing) for r in got] == [(True, False), (True, False), (True, True), (False, False)]
    assert [r.pending_since for r in got] == [at(0), at(0), at(0), None]
    assert sinks.read_state(spark, root, "pending_alerts", scheduled.PENDING).count() == 0


def test_rows_of_a_key_are_folded_in_parts():
    import pandas as pd

    kinds = {"at": "bigint", "seq": "bigint", "breached": "boolean", "message": "string", "took": "double"}
    rows = [(None if i % 97 == 0 else str(2**60 + i * 7919 % 1009), str(i), [True, False, None][i % 3], None if i % 5 else f"m{i}", i / 2 if i % 4 else None)
            for i in range(25_000)]
    frames = (pd.DataFrame(rows[i:i + 700], columns=list(kinds)) for i in range(0, len(rows), 700))
    parts = list(jobs.ordered_rows(frames, ["at"], ["seq", "at", "breached", "message", "took"], kinds))
    assert [len(p) for p in parts] == [10_000, 10_000, 5_000]
    expected = sorted(rows, key=lambda r: (r[0] is not None, int(r[0] or 0)))
    assert [r for p in parts for r in p] == [(int(s), None if a is None else int(a), b, m, t) for a, s, b, m, t in expected]


def test_takes_come_from_the_landed_snapshots(spark, monkeypatch):
    from driverqueries import streams
    from driverqueries.adapters import Inputs

    given = {}
    monkeypatch.setattr(streams, "_wait", lambda started: None)
    monkeypatch.setattr(streams.jobs, "stream_consumers", lambda stream, root, checkpoint, **options: given.update(options, root=root))
    monkeypatch.setattr(streams.jobs, "top_consumers", lambda spark, root: spark.range(1).selectExpr("1 batch_id", "1 revision", "1 day", "id"))
    fx = Inputs(spark, "/root/testdata/sf0.001")
    streams.top_consumers(fx)
    for name in ("takes", "complete"):
        assert all("/landed/" in f for f in given[name](spark).inputFiles()) and given[name](spark).count()


def test_ticks_of_a_slot_travel_in_one_row(spark, at):
    ticks = spark.createDataFrame([("a", at(i % 50)) for i in range(400)] + [(None, at(7)), ("a", at(7200)), ("a", None)], "k string, t timestamp")
    slots = timeline.gathered(timeline.ticks_of(ticks, ["k"], "t", 3600.0), ["k"])
    assert sorted((r["k"] is None, r["_slot"] % 10**10, len(r["_ticks"])) for r in slots.collect()) == sorted(
        [(False, timeline_slot(at(0)), 50), (False, timeline_slot(at(7200)), 1), (True, timeline_slot(at(0)), 1)])
    twice = slots.unionByName(slots)
    assert sorted(map(str, timeline.slot_functions(twice, ["k"], 10).collect())) == sorted(map(str, timeline.slot_functions(slots, ["k"], 10).collect()))


def timeline_slot(time):
    from datetime import timezone

    return int(time.replace(tzinfo=timezone.utc).timestamp()) * 1_000_000 % 10**10
