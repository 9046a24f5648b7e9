from pyspark.sql import functions as F

from fleetlens.operators import accounting
from fleetlens.plans import passes
from fleetlens.schemas import STORED
from fleetlens.sources import sinks

STATS = "source_database string, collected_at timestamp, inst_id long, sql_id string, plan_hash_value long, elapsed_time long, cpu_time long, executions long"
CURSOR = ("collected_at timestamp, source_database string, inst_id long, sql_id string, child_number long, plan_hash_value long, "
          "parsing_schema_name string, module string, elapsed_time long, sql_fulltext string, seq long")


def landed(spark, at, *snapshots):
    """Views of a pass: per snapshot its time and the elapsed time of each statement."""
    stats = [("db", at(t), 1, sql, 7, value, value // 2, 1) for t, values in snapshots for sql, value in values.items()]
    cursors = [(at(t), "db", 1, sql, 0, 7, "app", "m", value, f"select {sql}", t) for t, values in snapshots for sql, value in values.items()]
    return {"sqlstats": spark.createDataFrame(stats, STATS), "sql": spark.createDataFrame(cursors, CURSOR)}


def taken(spark, root, at):
    rows = sinks.read_table(spark, root, "top_consumers").orderBy("taken_at", "rank").collect()
    return [((r.taken_at - at(0)).total_seconds(), r.sql_id, r.elapsed_time_micro) for r in rows]


def test_work_gathers_over_passes_until_a_take_is_due(spark, at, tmp_path):
    root = str(tmp_path)
    # takes every 120 s: at 0, 120 and 240; the passes end between them
    feed = [
        [(0, {"a": 100, "b": 100}), (60, {"a": 110, "b": 400})],
        [(120, {"a": 150, "b": 10}), (180, {"a": 250})],       # b was reset at 120 and left at 180
        [(210, {"a": 260, "b": 30}), (240, {"a": 260, "b": 31, "c": 5})],
    ]
    for i, snapshots in enumerate(feed):
        assert passes.perform_pass(spark, root, i, landed(spark, at, *snapshots), F.lit(at(1000)))
    assert taken(spark, root, at) == [(120, "b", 300), (120, "a", 50), (240, "a", 110), (240, "b", 31), (240, "c", 5)]
    states = passes.read_states(spark, root)
    assert states[passes.OPEN_WORK].count() == 0 and states[passes.LAST_TAKES].first().collected_at == at(240)
    assert passes.read_states(spark, root, 2)[passes.OPEN_WORK].select("sql_id", "elapsed_time_micro").collect() == [("a", 100)]
    details = sinks.read_table(spark, root, "sql_details")
    assert {r[0] for r in details.select("collected_at").distinct().collect()} == {at(120), at(240)}


def test_replayed_and_old_snapshots_change_nothing(spark, at, tmp_path):
    root, first = str(tmp_path), landed(spark, at, (0, {"a": 1}), (200, {"a": 5}))
    assert passes.perform_pass(spark, root, 0, first, F.lit(at(1000)))
    assert not passes.perform_pass(spark, root, 0, first, F.lit(at(1000)))
    assert passes.perform_pass(spark, root, 1, landed(spark, at, (100, {"a": 3}), (200, {"a": 5})), F.lit(at(1000)))
    assert taken(spark, root, at) == [(200, "a", 4)]


def test_empty_pass(spark, at, tmp_path):
    root, empty = str(tmp_path), {name: df.limit(0) for name, df in landed(spark, at, (0, {"a": 1})).items()}
    assert passes.perform_pass(spark, root, 0, empty, F.lit(at(0)))
    assert sinks.read_table(spark, root, "top_consumers").count() == 0
    assert passes.perform_pass(spark, root, 1, landed(spark, at, (0, {"a": 1}), (120, {"a": 4})), F.lit(at(0)))
    assert taken(spark, root, at) == [(120, "a", 3)]


def test_a_pass_that_stops_half_way_is_written_anew_as_a_whole(spark, at, tmp_path, monkeypatch):
    root, kept = str(tmp_path), accounting.merge_daily_ingest
    raw = landed(spark, at, (0, {"a": 1, "b": 1}), (200, {"a": 5, "b": 1}))

    def fail(*args):
        raise RuntimeError("lost")

    passes.perform_pass(spark, root, 0, landed(spark, at, (-200, {"a": 0})), F.lit(at(0)))
    monkeypatch.setattr(passes.accounting, "merge_daily_ingest", fail)
    try:
        passes.perform_pass(spark, root, 1, raw, F.lit(at(0)))
        raise AssertionError("the pass went through")
    except RuntimeError:
        pass
    # nothing of the pass is seen: neither rows nor states nor accounting
    assert sinks.read_table(spark, root, "sql_samples").count() == 1
    assert passes.read_states(spark, root)[passes.LAST_TAKES].first().collected_at == at(-200)
    monkeypatch.setattr(passes.accounting, "merge_daily_ingest", kept)
    more = {name: df.unionByName(df.where("sql_id = 'a'").withColumn("sql_id", F.lit("d"))) for name, df in raw.items()}  # the views grew meanwhile
    assert passes.perform_pass(spark, root, 1, more, F.lit(at(0)))
    daily = sinks.read_state(spark, root, "repository_daily_ingest", STORED["repository_daily_ingest"])
    assert daily.agg(F.sum("sql_sample_rows")).first()[0] == sinks.read_table(spark, root, "sql_samples").count() == 7
