import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fleetlens.schemas import RAW
from fleetlens.sources import readers, sinks


def line(**fields):
    return json.dumps(fields)


def write(tmp_path, lines):
    path = tmp_path / "log.json"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_last_record_in_file_order(spark, tmp_path):
    path = write(tmp_path, [line(timestamp="12:01", database="a", message="m1"), line(timestamp="12:05", database="b", message="m2"),
                            "", line(timestamp="12:03", database="a", message="m3")])
    lines = readers.read_log_lines(spark, path)
    assert readers.last_log_record(lines, "a").first().message == "m3"
    assert readers.last_log_record(lines, "b").first().timestamp == "12:05"
    default = readers.last_log_record(lines, "c").first()
    assert (default.timestamp, default.message) == (readers.LOG_FLOOR, "")
    assert {r.database: r.message for r in readers.last_log_record(lines).collect()} == {"a": "m3", "b": "m2"}


def test_bad_and_long_lines_fail(spark, tmp_path):
    bad = readers.read_log_lines(spark, write(tmp_path, ["{nope"]))
    with pytest.raises(Exception):
        readers.last_log_record(bad, "a").collect()
    (tmp_path / "l").mkdir()
    large = readers.read_log_lines(spark, write(tmp_path / "l", [line(database="a", message="x" * 70_000)]))
    assert len(readers.last_log_record(large, "a").first().message) == 70_000
    (tmp_path / "h").mkdir()
    huge = readers.read_log_lines(spark, write(tmp_path / "h", [line(database="a", message="x" * 1_100_000)]))
    assert len(readers.last_log_record(huge, "a").first().message) == 1_100_000
    with pytest.raises(Exception, match="exceeds"):
        readers.last_log_record(huge, "a", line_limit=1 << 20).collect()


def test_new_log_rows(spark, at):
    logs = spark.createDataFrame([("a", at(1), "x"), ("a", at(2), "y"), ("b", at(1), "z")],
                                 "source_database string, originating_timestamp timestamp, message_text string")
    last = spark.createDataFrame([("a", at(1))], "source_database string, last_timestamp timestamp")
    assert sorted(r.message_text for r in readers.new_log_rows(logs, last).collect()) == ["y", "z"]


def test_incremental(spark, at):
    rows = spark.createDataFrame([(d, at(t)) for d in "ab" for t in (0, 100, 118, 120, 200)],
                                 "source_database string, sample_time timestamp")
    marks = spark.createDataFrame([("a", at(120))], "source_database string, watermark timestamp")
    got, moved = readers.incremental(rows, marks, F.lit(at(220)).cast("timestamp"), overlap=2)
    assert sorted((r.source_database, r.sample_time) for r in got.collect()) == [
        ("a", at(120)), ("a", at(200)), ("b", at(118)), ("b", at(120)), ("b", at(200))]
    assert {r.source_database: r.watermark for r in moved.collect()} == {"a": at(200), "b": at(200)}


def test_read_raw_prunes_and_keeps_nulls(spark, tmp_path, at):
    df = spark.createDataFrame([("db", at(0), 1, None, 7)],
                               "source_database string, collected_at timestamp, inst_id long, name string, con_id long")
    df.write.parquet(str(tmp_path / "sysstat"))
    row = readers.read_raw(spark, "sysstat", str(tmp_path / "sysstat")).first()
    assert (row.inst_id, row.name, row.value) == (1, None, None)
    assert readers.read_raw(spark, "sysstat", str(tmp_path / "sysstat")).schema.names == RAW["sysstat"].names


def test_append_daily_prunes_days(spark, tmp_path, at):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", at(0), 1), ("a", at(86400), 2), ("a", None, 3)],
                               "source_database string, collected_at timestamp, v long")
    sinks.append_daily(df, path, "collected_at", ["source_database"])
    assert sorted(d for d in os.listdir(path) if d.startswith("day=")) == ["day=2024-01-01", "day=2024-01-02"]
    bounded = readers.on_days(spark.read.parquet(path), "collected_at", F.lit(at(86400)).cast("timestamp"))
    assert [r.v for r in bounded.collect()] == [2]
    plan = bounded._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "PushedFilters: [IsNotNull(collected_at), GreaterThanOrEqual" in plan


def test_batches_publish_as_a_whole(spark, tmp_path, at):
    root = str(tmp_path / "store")
    df = spark.createDataFrame([("a", at(0), True), ("b", at(1), False)],
                               "source_database string, collected_at timestamp, success boolean")
    assert sinks.read_table(spark, root, "scrape_status") is None
    assert sinks.commit_batch(spark, root, 1, {"scrape_status": df})
    assert not sinks.commit_batch(spark, root, 1, {"scrape_status": df})
    sinks.with_day(df, "collected_at").write.partitionBy("day").parquet(f"{root}/scrape_status/batch_id=2")
    assert sinks.read_table(spark, root, "scrape_status").count() == 2
    assert sinks.commit_batch(spark, root, 2, {"scrape_status": df})
    assert sinks.read_table(spark, root, "scrape_status").count() == 4


def test_state_versions(spark, tmp_path):
    root = str(tmp_path / "state")
    df = spark.createDataFrame([("a", 1)], "k string, v long")
    assert sinks.read_state(spark, root, "s", df.schema).count() == 0
    sinks.write_state(spark, root, "s", df, 3)
    sinks.write_state(spark, root, "s", df.withColumn("v", F.lit(9).cast("long")), 3)
    assert sinks.read_state(spark, root, "s", df.schema).first().v == 1
    assert sinks.read_state(spark, root, "s", df.schema, before=3).count() == 0


def test_drop_expired(spark, tmp_path):
    path = tmp_path / "t"
    for name in ("day=2024-01-01", "day=2024-01-02", "day=2024-01-03", "day=nonsense", "other"):
        (path / name).mkdir(parents=True)
    cutoff = datetime(2024, 1, 3, 0, 0)
    assert sinks.drop_expired(spark, str(path), cutoff, 0, dry_run=False) == []
    assert sinks.drop_expired(spark, str(path), cutoff) == ["day=2024-01-01", "day=2024-01-02"]
    assert len(os.listdir(path)) == 5
    sinks.drop_expired(spark, str(path), cutoff, dry_run=False)
    assert sorted(os.listdir(path)) == ["day=2024-01-03", "day=nonsense", "other"]


def test_append_log(spark, tmp_path):
    raw = spark.createDataFrame([("a", None, "m\n\n"), ("b", "mod", None)],
                                "source_database string, module_id string, message_text string").withColumns(
        {"originating_timestamp": F.lit("t"), "execution_context_id": F.lit(None).cast("string")})
    path = str(tmp_path / "log")
    sinks.append_log(readers.alert_log_rows(raw), path)
    got = {r.value for r in spark.read.text(path).collect()}
    assert got == {'{"timestamp":"t","database":"a","moduleId":"","ecid":"","message":"m\\n"}',
                   '{"timestamp":"t","database":"b","moduleId":"mod","ecid":"","message":""}'}
    sinks.append_log(readers.alert_log_rows(raw), str(tmp_path / "per"), per_database=True)
    assert sorted(d for d in os.listdir(tmp_path / "per") if "=" in d) == ["log_database=a", "log_database=b"]
