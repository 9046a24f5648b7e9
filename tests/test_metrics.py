import pytest
from pyspark.sql import functions as F

from fleetlens.operators import metrics
from fleetlens.sources import definitions

TOML = """
[[metric]]
context = "sessions"
labels = ["Status", "TYPE"]
metricsdesc = { B = "b value", a = "a value" }
metricstype = { A = "Counter" }
request = "select 1"
fieldtoappend = "TYPE"

[[metric]]
context = "sessions"
metricsdesc = { A = "later", b = "later" }
request = "select 2"
databases = []
"""
YAML = """
metrics:
  - context: waits
    metricsdesc: {time: seconds}
    request: select 3
    databases: [db1]
    ignorezeroresult: true
"""


def test_definitions_normalise_and_override(tmp_path):
    first, second = tmp_path / "a.toml", tmp_path / "b.yaml"
    first.write_text(TOML)
    second.write_text(YAML)
    loaded = definitions.load_definitions([str(first), "  ", str(second)])
    assert list(loaded) == ["sessions_a_b", "waits_time"]
    assert loaded["sessions_a_b"].request == "select 2"
    d = definitions.parse_definitions(TOML, True)[0]
    assert (d.labels, d.label_names, d.field_to_append, d.metrics_type) == (
        ("status", "type"), ["status"], "type", {"a": "Counter"})


def test_bad_file_keeps_the_last_good_set(tmp_path):
    bad = tmp_path / "bad.toml"
    bad.write_text("[[metric")
    good = {"x": metrics.MetricDefinition("x", {"a": "b"})}
    assert definitions.load_definitions([str(bad)], good) is good
    with pytest.raises(Exception):
        definitions.load_definitions([str(bad)])


def test_definitions_frame(spark, tmp_path):
    path = tmp_path / "a.yaml"
    path.write_text(YAML)
    df = definitions.definitions_frame(spark, definitions.load_definitions([str(path)]))
    assert metrics.enabled_for(df, F.lit("db1")).count() == 1
    assert metrics.enabled_for(df, F.lit("db2")).count() == 0


def rows(spark, at, data):
    return spark.createDataFrame([("db", at(0), *r) for r in data],
                                 "source_database string, collected_at timestamp, V string, w string, kind string")


def test_melt_values(spark, at):
    d = metrics.MetricDefinition("ctx", {"v": "help v", "W": "help w", "gone": "x"}, labels=("kind", "absent"),
                                 metrics_type={"V": "COUNTER"})
    text = metrics.text_result(rows(spark, at, [("42.5", "bad", "A b"), (None, " 1 ", None)]))
    got = metrics.melt_metrics(text, d).collect()
    assert sorted((r.metric_name, r.metric_type, r.value, r.labels["kind"], r.labels["absent"]) for r in got) == [
        ("v", "counter", 0.0, "<nil>", ""), ("v", "counter", 42.5, "A b", ""), ("w", "gauge", 1.0, "<nil>", "")]


def test_melt_appended_name(spark, at):
    d = metrics.MetricDefinition("ctx", {"v": "h", "w": "h"}, labels=("kind",), field_to_append="Kind")
    got = metrics.melt_metrics(metrics.text_result(rows(spark, at, [("1", "2", "A (b)/c")])), d).collect()
    assert [(r.metric_name, r.value, r.labels) for r in got] == [("a_bc", 1.0, {}), ("a_bc", 2.0, {})]


def test_constant_labels_and_overlap(spark, at):
    configured = spark.createDataFrame([("db", {"env": "prod"}), ("other", None), ("named", {"database": "own"})],
                                       "source_database string, labels map<string,string>")
    const = metrics.constant_labels(configured)
    assert {r.source_database: r.const_labels for r in const.collect()} == {
        "db": {"database": "db", "env": "prod"}, "other": {"database": "other", "env": ""}, "named": {"database": "own", "env": ""}}
    text = metrics.text_result(rows(spark, at, [("1", "2", "x")]))
    ok = metrics.MetricDefinition("ctx", {"v": "h"}, labels=("kind",))
    clash = metrics.MetricDefinition("ctx", {"v": "h"}, labels=("kind", "env"))
    assert metrics.melt_metrics(text, ok, const).first().labels == {"database": "db", "env": "prod", "kind": "x"}
    assert metrics.melt_metrics(text, clash, const).count() == 0


@pytest.mark.parametrize("const, labels, expected", [
    ([], [], False), (["a"], [], False), ([], ["a"], False), (["a"], ["b"], False), (["a", "b"], ["b", "c"], True), (["a"], ["a"], True)])
def test_duplicate_labels(spark, const, labels, expected):
    lists = [F.array(*[F.lit(x) for x in xs]).cast("array<string>") for xs in (const, labels)]
    assert spark.range(1).select(metrics.duplicate_labels(*lists)).first()[0] is expected


def test_zero_results(spark, at):
    databases = spark.createDataFrame([("db",), ("quiet",)], "source_database string")
    d = metrics.MetricDefinition("ctx", {"v": "h"})
    samples = metrics.melt_metrics(metrics.text_result(rows(spark, at, [("1", "2", "x")])), d)
    assert [r[0] for r in metrics.zero_results(databases, samples, d).collect()] == ["quiet"]
    ignoring = metrics.MetricDefinition("ctx", {"v": "h"}, ignore_zero_result=True)
    assert metrics.zero_results(databases, samples, ignoring).count() == 0


@pytest.mark.parametrize("definition, expected", [
    (metrics.MetricDefinition("context_no_label", {"value_1": "one", "value_2": "two"},
                              "select 1 as value_1, 2 as value_2"), [("value_1", 1.0, {}), ("value_2", 2.0, {})]),
    (metrics.MetricDefinition("test", {"value_1": "one"}, "select 1 as VALUE_1, 'First' as label_1", labels=("label_1",)),
     [("value_1", 1.0, {"label_1": "First"})]),
    (metrics.MetricDefinition("test_histo", {"data": "sum"}, "select 123.45 as data, 3 as le_20, 'x' as label1",
                              labels=("label1",), metrics_type={"data": "histogram"}, metrics_buckets={"data": {"le_20": "20"}}),
     [("data", 123.45, {"label1": "x"})])])
def test_run_metric(spark, at, definition, expected):
    got = metrics.run_metric(spark, definition, "db", F.lit(at(5)).cast("timestamp")).collect()
    assert sorted((r.metric_name, r.value, r.labels) for r in got) == expected
    assert {(r.source_database, r.collected_at) for r in got} == {("db", at(5))}


def test_run_metric_limits_databases(spark, at):
    d = metrics.MetricDefinition("ctx", {"v": "h"}, "select 1 as v", databases=("db2",))
    got = metrics.run_metric(spark, d, as_of=F.lit(at(0)).cast("timestamp")).collect()
    assert [r.source_database for r in got] == ["db2"]
    with pytest.raises(ValueError, match="names no database"):
        metrics.run_metric(spark, metrics.MetricDefinition("ctx", {"v": "h"}, "select 1 as v"))


def test_integers(spark):
    from fleetlens.operators.samples import integers

    row = integers(spark).agg(F.count("*"), F.min("value"), F.max("value"), F.count_if(F.col("key") == F.col("value"))).first()
    assert tuple(row) == (1001, 0, 1000, 1001)


def test_shipped_sample_metrics_run(spark, at):
    import os

    from fleetlens.schemas import RAW

    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "examples", "sample_metrics.toml")
    loaded = definitions.load_definitions([path])
    rows = {
        "sql": [("db", at(300), 1, f"s{i}", i, 1, None, None, None, 10 * (i + 1), at(100), i) for i in range(20)],
        "segments": [("db", at(0), f"t{i % 3}", "TABLE", i, i) for i in range(9)],
        "queues": [("db", at(0), 1, q, f"q{q}", q) for q in range(3)],
        "subscriber_stat": [("db", at(0), 1, q, s, 10, 4, 1, 2, 0) for q in range(3) for s in range(2)],
        "instance": [("db", at(0), 3, "i", "OPEN", "ACTIVE", at(0), 0)],
    }
    for view, schema in RAW.items():
        spark.createDataFrame(rows.get(view, []), schema).createOrReplaceTempView(f"raw_{view}")
    values = {}
    for d in loaded.values():
        for r in metrics.run_metric(spark, d, "db", F.lit(at(0)).cast("timestamp")).collect():
            values.setdefault(r.metric_name, []).append(r.value)
    assert (values["p95_time_usecs"], values["p99_time_usecs"]) == ([190.0], [200.0])
    assert (values["p95_rows"], values["total_queues"], values["total_subscribers"]) == ([19.0], [3.0], [2.0])
    assert (sorted(values["table_bytes"]), values["curr_inst_id"], values["inst_id"]) == ([9.0, 12.0, 15.0], [3.0], [1.0])
    assert (values["remained_msgs"], sum(values["value"]), values["data"]) == ([6.0] * 6, 500500.0, [123.45])
    assert "cluster_bytes" not in values
