import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import samples
from fleetlens.plans import alerts, views
from fleetlens.plans.collect import build_samples
from fleetlens.schemas import RAW, STORED


def frame(spark, at, schema, rows):
    """Rows of (db, seconds, ...)."""
    return spark.createDataFrame([(d, at(t), *rest) for d, t, *rest in rows],
                                 "source_database string, collected_at timestamp, " + schema)


def test_active_sessions_three_valued(spark, at):
    rows = [("db", 0, i, *r) for i, r in enumerate([
        ("USER", "ACTIVE", "WAITED", None), ("USER", "ACTIVE", "WAITING", None), ("USER", "ACTIVE", "WAITING", "Idle"),
        ("USER", "ACTIVE", "WAITING", "User I/O"), ("USER", "INACTIVE", "WAITED", "x"), ("BACKGROUND", "ACTIVE", "WAITED", "x")])]
    df = frame(spark, at, "sid long, type string, status string, state string, wait_class string", rows)
    assert sorted(r.sid for r in samples.active_sessions(df).collect()) == [0, 3]


def test_recent_lookback_is_at_least_a_minute(spark, at):
    df = frame(spark, at, "sql_id string, last_active_time timestamp",
               [("db", 0, "a", at(940)), ("db", 0, "b", at(939)), ("db", 0, None, at(990))])
    got = samples.recent(df, "last_active_time", F.lit(at(1000)).cast("timestamp"), 15).collect()
    assert [r.sql_id for r in got] == ["a"]


@pytest.mark.parametrize("column, value", [("dbid", 9)])
def test_update_from_leaves_unmatched_rows(spark, at, column, value):
    rows = frame(spark, at, "inst_id long, dbid long", [("db", 0, 1, None), ("db", 0, 2, 5)])
    source = frame(spark, at, "inst_id long, dbid long", [("db", 0, 1, value), ("db", 0, 7, 1)])
    got = samples.update_from(rows, source, [*samples.SNAPSHOT, "inst_id"], [column]).orderBy("inst_id").collect()
    assert [(r.inst_id, r.dbid) for r in got] == [(1, 9), (2, 5)]


def test_last_identity_of_an_instance_wins(spark, at):
    keys = "source_database string, collected_at timestamp, inst_id long"
    instances = spark.createDataFrame([("db", at(0), 1, "i", "OPEN", "ACTIVE", at(0))], f"{keys}, instance_name string, status string, database_status string, startup_time timestamp")
    databases = spark.createDataFrame([("db", at(0), 1, 9, "b", 1), ("db", at(0), 1, 1, "a", 2)], f"{keys}, dbid long, db_unique_name string, seq long")
    products = spark.createDataFrame([], "source_database string, collected_at timestamp, product string, version string, version_full string")
    got = samples.database_status(instances, databases, products).select("dbid", "db_unique_name").distinct().collect()
    assert [tuple(r) for r in got] == [(1, "a")]


def test_update_from_takes_null_of_a_match(spark, at):
    rows = frame(spark, at, "inst_id long, dbid long", [("db", 0, 1, 5)])
    source = frame(spark, at, "inst_id long, dbid long", [("db", 0, 1, None)])
    assert samples.update_from(rows, source, [*samples.SNAPSHOT, "inst_id"], ["dbid"]).first().dbid is None


def test_cpu_io_counters(spark, at):
    sysstat = frame(spark, at, "inst_id long, con_id long, name string, value long",
                    [("db", 0, 1, 0, "physical read total bytes", 5), ("db", 0, 1, 3, "physical read total bytes", 6),
                     ("db", 0, 1, 0, "redo size", 7)])
    model = frame(spark, at, "inst_id long, con_id long, name string, value long", [("db", 0, 1, 0, "DB CPU", 8)])
    got = samples.cpu_io_counters(sysstat, model).collect()
    assert sorted((r.stat_name, r.value) for r in got) == [("DB CPU", 8), ("physical read total bytes", 5)]


def test_replication_lag_row_order_and_age(spark, at):
    df = frame(spark, at, "seq long, name string, value string, time_computed string, datum_time string", [
        ("db", 0, 1, "transport lag", "+00 00:01:30", "01/01/2024 00:10:00", "01/01/2024 00:09:00"),
        ("db", 0, 2, "apply lag", "+00 00:00:05", "01/01/2024 00:10:30", None),
        ("db", 0, 3, "apply finish time", "UNKNOWN", None, "01/01/2024 00:08:00"),
        ("primary", 0, 4, "apply lag", "+00 00:00:05", None, None)])
    roles = frame(spark, at, "database_role string", [("db", 0, "PHYSICAL STANDBY"), ("primary", 0, "PRIMARY")])
    row, = samples.replication_lag(df, roles).collect()
    assert (row.transport_lag_seconds, row.apply_lag_seconds, row.apply_finish_time_seconds) == (90.0, 5.0, None)
    assert (row.time_computed, row.datum_time, row.datum_age_seconds) == ("01/01/2024 00:10:30", "01/01/2024 00:08:00", 60.0)


def test_replication_lag_strict_and_lenient(spark, at):
    df = frame(spark, at, "seq long, name string, value string", [("db", 0, 1, "apply lag", "soon")])
    with pytest.raises(Exception, match="not a lag interval"):
        samples.replication_lag(df).collect()
    assert samples.replication_lag(df, strict=False).first().lag_error == "soon"


def test_percentiles_equal_sorting(spark):
    rng = random.Random(5)
    rows = [("hot", rng.randrange(500)) for _ in range(4000)] + [("cold", rng.randrange(9)) for _ in range(7)] + [("one", 3), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v long")
    got = {r.k: (r.p50, r.p95, r.p99) for r in samples.percentiles(df, ["k"], "v", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, accuracy=200).collect()}
    for k in ("hot", "cold", "one"):
        values = sorted(v for n, v in rows if n == k)
        expected = tuple(values[max(-(-len(values) * p // 100), 1) - 1] for p in (50, 95, 99))
        assert got[k] == expected, k


def test_plan_cache_forgets_plans_that_leave(spark):
    schema = "source_database string, inst_id long, sql_id string, child_number long, plan_hash_value long"

    def keys(*ids):
        return spark.createDataFrame([("db", 1, i, 0, 7) for i in ids], schema)

    def names(df):
        return sorted(r.sql_id for r in df.collect())

    missing, known = samples.plan_cache_step(keys(), keys("a", "b", "a"), keys("a"))
    assert (names(missing), names(known)) == (["a", "b"], ["a"])
    missing, known = samples.plan_cache_step(known, keys("a", "b"), keys("b"))
    assert (names(missing), names(known)) == (["b"], ["a", "b"])
    missing, known = samples.plan_cache_step(known, keys("b"), keys())
    assert (names(missing), names(known)) == ([], ["b"])
    missing, _ = samples.plan_cache_step(known, keys("a", "b"), keys())
    assert names(missing) == ["a"]


def test_merge_shared_keeps_repeats(spark):
    df = spark.createDataFrame([("b", "g", None), ("a", "g", None), ("a", "g", None), ("c", "g", 1)],
                               "source_database string, diskgroup_name string, usable_bytes long")
    got = samples.merge_shared(df, ["diskgroup_name", "usable_bytes"]).collect()
    assert sorted((r.source_database, r.usable_bytes) for r in got) == [("a, a, b", None), ("c", 1)]


def test_runtime_rows(spark, at):
    cycles = spark.createDataFrame([(1, at(0), at(4.5), at(5.4), at(5.5), 2.0, 0, 2, 0, "e" * 3000)],
                                   "cycle_id long, scheduled_at timestamp, started_at timestamp, collection_finished_at timestamp, finished_at timestamp, "
                                   "configured_interval_seconds double, missed_intervals long, databases_attempted long, error_count long, error_message string")
    statuses = spark.createDataFrame([(1, "connectivity", True), (1, "scheduled", True), (1, "scheduled", False)],
                                     "cycle_id long, collector string, success boolean")
    row = samples.runtime_rows(cycles, statuses, "scheduled").first()
    assert (row.missed_intervals, row.databases_attempted, row.databases_succeeded, row.error_count) == (2, 2, 1, 1)
    assert (row.scheduling_lag_seconds, row.collection_duration_seconds, len(row.error_message)) == (4.5, 0.9, 3000)
    short = samples.runtime_rows(cycles, statuses, "scheduled", message_length=2000).first()
    assert len(short.error_message) == 2000


def test_enriched_sql_lists(spark, at):
    meta = spark.createDataFrame([("db", 1, "s", c, 7, n, m) for c, n, m in [(10, "B", None), (2, "A", None), (2, "A", None)]],
                                 "source_database string, inst_id long, sql_id string, child_number long, plan_hash_value long, parsing_schema_name string, module string")
    sql = spark.createDataFrame([("db", 1, "s", 7, None, "OWN"), ("db", 1, "s", None, None, None)],
                                "source_database string, inst_id long, sql_id string, plan_hash_value long, child_number long, parsing_schema_name string")
    got = {r.plan_hash_value: r for r in views.enrich_sql(sql, meta).collect()}
    assert (got[7].child_number, got[7].parsing_schema_name, got[7].module) == ("10, 2", "OWN", None)
    assert got[None].child_number is None


def test_latest_snapshot_uses_the_last_attempt(spark, at):
    rows = frame(spark, at, "v long", [("a", 10, 1), ("a", 20, 2), ("b", 10, 3)])
    status = frame(spark, at, "collector string", [("a", 20, "c"), ("b", 30, "c")])
    assert [r.v for r in views.latest_snapshot(rows, status, "c").collect()] == [2]


def test_alert_states(spark, at):
    rules = alerts.rules_frame(spark, [r for r in alerts.RULES if r.rule_id in ("A-2", "A-3", "A-6")])
    schema = "rule_id string, labels map<string,string>, value double, as_of timestamp"
    history = spark.createDataFrame([("A-2", {"db": d}, v, at(t)) for d, t, v in [
        ("x", 0, 1.0), ("x", 60, 1.0), ("y", 0, 1.0), ("y", 60, 0.0), ("z", 60, 1.0)]], schema)
    values = spark.createDataFrame([("A-2", {"db": d}, v, at(120)) for d, v in [("x", 1.0), ("y", 1.0), ("z", 0.0)]], schema)
    got = alerts.evaluate_rules(values, rules, F.lit(at(120)).cast("timestamp"), history).collect()
    rows = {(r.rule_id, r.labels_key): r for r in got}
    x, y, z = (rows[("A-2", f'{{"db":"{d}"}}')] for d in "xyz")
    assert (x.pending_since, x.firing) == (at(0), True)
    assert (y.pending_since, y.firing) == (at(120), False)
    assert (z.breached, z.pending_since, z.firing) == (False, None, False)
    assert (rows[("A-3", None)].no_data_state, rows[("A-3", None)].firing) == ("OK", False)
    assert (rows[("A-6", None)].no_data_state, rows[("A-6", None)].firing) == ("Alerting", True)


def test_build_samples_has_the_stored_layout(spark):
    raw = {name: spark.createDataFrame([], schema) for name, schema in RAW.items()}
    made = build_samples(raw)
    for name, df in made.items():
        assert df.columns == STORED[name].names, name
    assert {"sql_samples", "database_status_samples", "dataguard_lag_samples", "system_counter_samples"} <= set(made)
    assert made["instance_samples"].count() == 0


def test_percentiles_never_miss(spark, monkeypatch):
    """A sketch whose bracket lies beside the percentile costs work, not the result."""
    import math
    import random

    rnd = random.Random(2)
    values = {"steep": [2.0 ** rnd.randrange(60) for _ in range(900)], "two": [0.0] * 500 + [1.0] * 3, "one": [7.5], "tail": [float(i) ** 5 for i in range(700)]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double")
    real = F.percentile_approx
    ps = {"low": 0.01, "mid": 0.5, "high": 0.99}
    for wrong in (None, lambda e: e[0], lambda e: e[-1]):
        if wrong:  # every edge is the lowest, or the highest, quantile
            monkeypatch.setattr(samples.F, "percentile_approx", lambda c, edges, acc: real(c, [wrong([0.0, 1.0])] * len(edges), acc))
        got = {r.k: (r.low, r.mid, r.high) for r in samples.percentiles(df, ["k"], "v", ps, accuracy=50).collect()}
        assert got == {k: tuple(sorted(vs)[max(math.ceil(p * len(vs)), 1) - 1] for p in ps.values()) for k, vs in values.items()}


def test_subscriber_stats_aggregate_once(spark):
    subscribers = spark.createDataFrame([(1, 7, 3, 5, 2, 9, 4), (1, 7, 3, 1, None, 6, 8), (2, 7, 3, 2, 2, 1, 1)], """inst_id long, queue_id long, subscriber_id long,
        enqueued_msgs long, dequeued_msgs long, time_since_last_dequeue long, estd_time_to_drain_no_enq long""")
    queues = spark.createDataFrame([(7, "q"), (7, "q"), (7, "r")], "queue_id long, queue_name string")
    made = samples.subscriber_stats(subscribers, queues)
    assert sorted(map(tuple, made.collect())) == [(7, i, 3, *v, 10.0, 20.0, 30.0, q) for i, v in ((1, (6, 2, 3, 6, 8)), (2, (2, 2, 0, 1, 1))) for q in "qr"]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2 and "avg(" not in plan  # totals and names
