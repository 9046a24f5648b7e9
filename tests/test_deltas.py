import bisect
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from fleetlens.operators import deltas, timeline

SERIES = "source_database string, inst_id long, con_id long, stat_name string, collected_at timestamp, seq long, cumulative_value long"


def counters(spark, at, points, key=("db", 1, 0, "s")):
    return spark.createDataFrame([(*key, at(t), i, v) for i, (t, v) in enumerate(points)], SERIES)


def test_counter_delta_with_reset(spark, at):
    rows = deltas.counter_delta(counters(spark, at, [(0, 100), (60, 160), (120, 5)])).orderBy("seq").collect()
    assert [(r.delta_value, r.interval_seconds, r.counter_reset) for r in rows] == [
        (None, None, False), (60, 60.0, False), (None, 60.0, True)]


def test_counter_delta_without_advance_moves_the_baseline(spark, at):
    rows = deltas.counter_delta(counters(spark, at, [(0, 100), (0, 90), (10, 95)])).orderBy("seq").collect()
    assert [(r.delta_value, r.counter_reset) for r in rows] == [(None, False), (None, False), (5, False)]


def test_rates(spark, at):
    rows = deltas.rates(deltas.counter_delta(counters(spark, at, [(0, 1), (4, 9), (8, 2)]))).orderBy("seq").collect()
    assert [r.value_per_second for r in rows] == [None, 2.0, None]


def test_previous_values_equal_a_plain_lag_on_a_hot_series(spark):
    """Two thirds of the rows in one series, slots with gaps, NULL keys, equal times."""
    rng = random.Random(7)
    start = datetime(2024, 1, 1)
    rows = [(rng.choice(["hot", "hot", "cold", None]), start + timedelta(seconds=rng.randrange(0, 40_000, 7)), i, i * 3)
            for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, t timestamp, seq long, v long")
    last, expected = {}, {}
    for k, t, seq, v in sorted(rows, key=lambda r: (r[1], r[2])):
        expected[seq] = last.get(k, (None, None))
        last[k] = (t, v)
    for slot in (1, 600, 10**7):
        rows_ = timeline.previous_values(df, ["k"], "t", ["t", "v"], "seq", slot).collect()
        assert {r.seq: (r.prev_t, r.prev_v) for r in rows_} == expected, slot


def test_missing_times_and_arrival_numbers_sort_first(spark):
    rng = random.Random(6)
    start = datetime(2024, 1, 1)
    rows = [("one", start + timedelta(seconds=30 * i), None if i % 2 else i, rng.randrange(100)) for i in range(300)]
    rows += [("one", start + timedelta(seconds=30 * i), 10_000 + i, rng.randrange(100)) for i in range(0, 300, 7)]
    rows += [("one", None, -i, rng.randrange(100)) for i in range(1, 4)]
    df = spark.createDataFrame(rows, "k string, t timestamp, seq long, v long")
    ordered = sorted(rows, key=lambda r: (r[1] is not None, r[1] or start, r[2] is not None, r[2] or 0))
    expected = sorted(map(str, [(*r, *((None, None) if b is None else (b[1], b[3]))) for b, r in zip([None, *ordered], ordered)]))
    for slot in (1, 90, 10**7):
        got = timeline.previous_values(df, ["k"], "t", ["t", "v"], "seq", slot).collect()
        assert sorted(str(tuple(r)) for r in got) == expected, slot


def test_running_total_crosses_slots(spark):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(seconds=rng.randrange(20_000)), i, rng.randrange(5)) for i in range(800)]
    df = spark.createDataFrame(rows, "t timestamp, seq long, n long").withColumn("k", F.lit("one"))
    got = {r.seq: r.total for r in timeline.running_total(df, ["k"], "t", F.col("n"), "total", "seq", 300).collect()}
    total = 0
    for _, seq, n in sorted(rows, key=lambda r: (r[0], r[1])):
        total += n
        assert got[seq] == total


SQL = "source_database string, inst_id long, sql_id string, plan_hash_value long, collected_at timestamp, elapsed_time_micro long, cpu_time_micro long, user_io_wait_micro long"


def stats(spark, at, rows):
    return spark.createDataFrame([("db", i, s, p, at(t), e, 0, 0) for t, i, s, p, e in rows], SQL)


def test_top_consumers_by_recent_work(spark, at):
    rows = [(0, 1, "historical", 1, 10000), (0, 1, "current", 1, 100), (0, 2, "current", 1, 200),
            (60, 1, "historical", 1, 10010), (60, 1, "current", 1, 150), (60, 2, "current", 1, 240),
            (120, 1, "historical", 1, 10020), (120, 1, "current", 1, 180), (120, 2, "current", 1, 280)]
    made = deltas.consumer_delta(stats(spark, at, rows))
    takes = spark.createDataFrame([("db", at(0)), ("db", at(120)), ("db", at(180))], "source_database string, collected_at timestamp")
    top = deltas.top_consumers(made, n=20, takes=takes).orderBy("taken_at", "rank").collect()
    assert [(r.taken_at, r.sql_id, r.elapsed_time_micro) for r in top] == [
        (at(120), "current", 160), (at(120), "historical", 20)]


def test_consumer_drop_counts_nothing_and_new_counts_in_full(spark, at):
    rows = [(0, 1, "reset", 1, 500), (60, 1, "reset", 1, 25), (60, 1, "new", None, 40), (60, 1, "", 1, 9)]
    top = deltas.top_consumers(deltas.consumer_delta(stats(spark, at, rows)), interval=3600, n=20).collect()
    assert [r.sql_id for r in top] == ["new"]


def test_consumer_absent_from_the_snapshot_before_counts_in_full(spark, at):
    rows = [(0, 1, "a", 1, 100), (0, 1, "b", 1, 1), (60, 1, "b", 1, 2), (120, 1, "a", 1, 130), (120, 1, "b", 1, 5)]
    got = {(r.sql_id, r.collected_at): r.elapsed_time_micro for r in deltas.consumer_delta(stats(spark, at, rows)).collect()}
    assert got == {("b", at(60)): 1, ("a", at(120)): 130, ("b", at(120)): 3}


def test_consumer_empty_snapshot_breaks_the_chain(spark, at):
    rows = [(0, 1, "a", 1, 100), (120, 1, "a", 1, 130)]
    times = spark.createDataFrame([("db", at(t)) for t in (0, 60, 120)], "source_database string, collected_at timestamp")
    got = deltas.consumer_delta(stats(spark, at, rows), snapshots=times).collect()
    assert [r.elapsed_time_micro for r in got] == [130]


def test_missed_intervals(spark, at):
    times = [0, 2, 4.001, 8.001, 16.001]
    df = spark.createDataFrame([("s", at(t), i) for i, t in enumerate(times)], "k string, t timestamp, seq long")
    rows = deltas.missed_intervals(df, ["k"], "t", 2.0).orderBy("seq").collect()
    assert [r.missed_intervals for r in rows] == [0, 0, 0, 1, 3]


def greedy(ticks, gap, strict):
    kept = []
    for t in sorted(set(ticks)):
        if not kept or (t > kept[-1] + gap if strict else t >= kept[-1] + gap):
            kept.append(t)
    return kept


def test_thin_literal(spark, at):
    df = spark.createDataFrame([("a", at(0)), ("a", at(60)), ("a", at(120)), ("b", at(60))], "source_database string, t timestamp")
    kept = sorted((r[0], r[1]) for r in timeline.thin(df, ["source_database"], "t", 120).collect())
    assert kept == [("a", at(0)), ("a", at(120)), ("b", at(60))]
    strict = sorted((r[0], r[1]) for r in timeline.thin(df, ["source_database"], "t", 120, strict=True).collect())
    assert strict == [("a", at(0)), ("b", at(60))]


def test_thin_equals_the_greedy_scan_over_many_slots(spark, at):
    rng = random.Random(11)
    ticks = {"hot": [rng.randrange(50_000) for _ in range(4000)] + list(range(60_000, 70_000, 15)),
             "regular": list(range(0, 20_000, 15)), "sparse": [rng.randrange(10**6) for _ in range(50)]}
    df = spark.createDataFrame([(k, at(t)) for k, ts in ticks.items() for t in ts], "k string, t timestamp")
    for strict in (False, True):
        got = {}
        for r in timeline.thin(df, ["k"], "t", 120, strict, slot_seconds=600).collect():
            got.setdefault(r.k, []).append(r.t)
        for k, ts in ticks.items():
            assert sorted(got[k]) == [at(t) for t in greedy(ts, 120, strict)], (k, strict)


def test_connection_states(spark, at):
    events = [("db", 1, "failure", "first"), ("db", 2, "failure", "second"), ("db", 3, "probe_start", None),
              ("db", 4, "probe_start", None), ("db", 5, "probe_failed", "still down"), ("db", 6, "probe_start", None),
              ("ok", 1, "failure", "x"), ("ok", 2, "probe_start", None), ("ok", 3, "probe_ok", None),
              ("warm", 1, "activate", None), ("warm", 2, "probe_start", None), ("new", 1, "probe_start", None)]
    df = spark.createDataFrame([(d, at(t), t, k, m, 0.5) for d, t, k, m in events],
                               "source_database string, event_at timestamp, seq long, kind string, message string, duration_seconds double")
    got = {r.source_database: r for r in deltas.connection_states(df).collect()}
    db = got["db"]
    assert (db.state, db.queued_at, db.last_failure_at, db.last_failure, db.probe_attempts, db.last_probe_error) == (
        "PROBING", at(1), at(5), "still down", 2, None)
    assert (got["ok"].state, got["ok"].queued_at, got["ok"].recovered_at, got["ok"].last_probe_duration_seconds) == (
        "ACTIVE", None, at(3), 0.5)
    assert (got["warm"].state, got["warm"].recovered_at, got["warm"].probe_attempts) == ("ACTIVE", None, 0)
    assert (got["new"].state, got["new"].probe_attempts) == ("STARTING", 0)


def test_failure_backoff(spark, at):
    outcomes = [("a", t, False) for t in range(10)] + [("b", 0, False), ("b", 1, True), ("b", 2, False), ("c", 0, True)]
    df = spark.createDataFrame([(d, at(t), t, s) for d, t, s in outcomes],
                               "source_database string, collected_at timestamp, seq long, success boolean")
    rows = {r.source_database: r for r in deltas.failure_backoff(df, F.lit(at(62)).cast("timestamp")).collect()}
    assert {d: (r.consecutive_failures, r.backoff_seconds, r.due) for d, r in rows.items()} == {
        "a": (10, 900, False), "b": (1, 60, True)}


def test_first_n_distinct(spark):
    rows = [("db", 1, "s1", c, i) for i, c in enumerate([3, 3, 1, 2, 1])]
    df = spark.createDataFrame(rows, "source_database string, inst_id long, sql_id string, child_number long, seq long")
    got = deltas.first_n_distinct(df, ["inst_id", "sql_id", "child_number"], "seq", 2, ["source_database"]).orderBy("seq")
    assert [r.child_number for r in got.collect()] == [3, 1]


def test_thinning_through_composed_runs(spark, at, monkeypatch):
    """Slots composed three at a time, many runs per key, against the greedy rule."""
    import random

    monkeypatch.setattr(timeline, "FAN", 3)
    rnd = random.Random(3)
    rows = sorted({(k, rnd.randrange(40_000)) for k in ("hot", "hot", "b") for _ in range(700)})
    df = spark.createDataFrame([(k, at(s)) for k, s in rows] + [(None, None)], "k string, t timestamp")
    for gap, strict in ((60, False), (61, True), (400, False)):
        want, last = [], {}
        for k, s in rows:
            if k not in last or s - last[k] > gap or (s - last[k] == gap and not strict):
                want.append((k, at(s)))
                last[k] = s
        got = sorted((r.k, r.t) for r in timeline.thin(df, ["k"], "t", gap, strict, slot_seconds=gap * 2).collect())
        assert got == want


def test_upcoming_marks_of_one_hot_series(spark, at):
    """10,000 marks of one database, times at marks, in gaps of many slots, after the last mark, and without a time."""
    rng = random.Random(3)
    marks = sorted({rng.randrange(0, 40_000_000) for _ in range(10_000)})
    times = [None, -5, 0, 50_000_000, *marks[::97], *(rng.randrange(-100, 41_000_000) for _ in range(3_000))]
    schema = "source_database string, collected_at timestamp, n long"
    moment = lambda t: None if t is None else at(t)
    rows = [(db, moment(t), i) for db in ("hot", "bare", None) for i, t in enumerate(times)]
    every = [("hot", at(t), 0) for t in marks] + [("hot", None, 0), (None, at(7), 0), ("hot", at(marks[3]), 0)]
    got = timeline.upcoming(spark.createDataFrame(rows, schema), spark.createDataFrame(every, schema), ["source_database"], "collected_at", "mark")
    want = {("hot", i): at(marks[k]) for i, t in enumerate(times) if t is not None for k in [bisect.bisect_left(marks, t)] if k < len(marks)}
    want |= {(None, i): at(7) for i, t in enumerate(times) if t is not None and t <= 7}
    assert {(r.source_database, r.n): r.mark for r in got.collect()} == want
    assert timeline.upcoming(spark.createDataFrame(rows, schema).limit(0), spark.createDataFrame(every, schema), ["source_database"], "collected_at", "mark").count() == 0
