import math

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import scalars as S


def evaluate(spark, fn, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, s string")
    return [r[1] for r in rows.select("i", fn(F.col("s"))).orderBy("i").collect()]


def test_metric_values(spark):
    texts = ["42.5", "  7.25  ", "<nil>", "not-a-number", "1d", "1F", "1e999", "-1e999", "inf", "-Infinity", "-NaN", "",
             "  ", "1_000", ".5", "5.", "\t9\n", "1e5", None]
    assert evaluate(spark, S.parse_metric_value, texts) == [
        42.5, 7.25, 0.0, None, None, None, None, None, math.inf, -math.inf, None, None, None, None, 0.5, 5.0, 9.0, 1e5,
        None]
    assert math.isnan(evaluate(spark, S.parse_metric_value, ["nan"])[0])


def test_durations(spark):
    assert evaluate(spark, S.parse_duration, ["1m30s", "720h", "250ms", "1.5h", "-2s", "0", "", "5", "1d", "10 s"]) == [
        90.0, 2592000.0, 0.25, 5400.0, -2.0, 0.0, None, None, None, None]


def test_lag_intervals(spark):
    texts = ["+00 00:01:30", "+01 02:03:04.5", "-00 00:00:02", "12.5", "UNKNOWN", " unknown ", "", None, "abc"]
    assert evaluate(spark, S.parse_lag_interval, texts) == [90.0, 93784.5, -2.0, 12.5, None, None, None, None, None]
    assert evaluate(spark, S.lag_interval_invalid, texts) == [False] * 8 + [True]


def test_lag_timestamps(spark):
    got = evaluate(spark, S.parse_lag_timestamp, ["01/02/2024 03:04:05", "2024-01-02 03:04:05.25", "soon"])
    assert [None if g is None else g.isoformat() for g in got] == [
        "2024-01-02T03:04:05", "2024-01-02T03:04:05.250000", None]


def test_names_and_masks(spark):
    assert evaluate(spark, S.clean_name, ["Host CPU Utilization (%)", "a/b*c D"]) == ["host_cpu_utilization_%", "abc_d"]
    assert evaluate(spark, S.mask_dsn, ["user/pw@host:1/db", "host", "a@b@c"]) == ["***@host:1/db", "host", "***@b"]


def test_metric_id(spark):
    ids = spark.range(1).select(S.metric_id(F.lit("sessions"), F.array(F.lit("B"), F.lit("a")))).first()[0]
    assert ids == "sessions_a_b"


def test_partition_day(spark):
    got = evaluate(spark, lambda c: S.partition_day("sql_samples", c),
                   ["sql_samples_2026_06_26", "other_2026_06_26", "sql_samples_2026_6_26", "sql_samples_2026_13_40"])
    assert [None if g is None else g.isoformat() for g in got] == ["2026-06-26", None, None, None]


def test_backoff(spark):
    rows = spark.range(0, 11).select("id", S.retry_backoff(F.col("id"))).orderBy("id").collect()
    assert [r[1] for r in rows] == [0, 60, 120, 240, 480, 900, 900, 900, 900, 900, 900]


@pytest.mark.parametrize("text, failed", [
    ("ORA-12514: listener does not know of service", True), ("ORA-01033: initialization in progress", True),
    ("dial: network is unreachable", True), ("context deadline exceeded", False), ("ORA-00942: no table or grant", False),
    ("ORA-00936: missing expression", False), (None, False)])
def test_connection_failures(spark, text, failed):
    assert evaluate(spark, S.is_connection_failure, [text]) == [failed]


def test_connection_failure_kind(spark):
    row = spark.range(1).select(S.is_connection_failure(F.lit("x"), F.lit("bad_connection"))).first()
    assert row[0] is True


def test_one_newline_and_empty(spark):
    assert evaluate(spark, S.strip_one_newline, ["a\n\n", "a\n", "a"]) == ["a\n", "a", "a"]
    assert evaluate(spark, S.null_to_empty, [None, "x"]) == ["", "x"]


def test_edition_order(spark):
    assert evaluate(spark, S.edition, ["x Standard Edition 2 y", "Standard Edition One", "19c enterprise edition", "other"]) == [
        "Standard Edition 2", "Standard Edition", "Enterprise Edition", None]


def test_round_half_up(spark):
    row = spark.range(1).select(S.round_half_up(F.lit(1.45) / F.lit(100.0), 3), S.round_half_up(F.lit(2.5), 0)).first()
    assert tuple(row) == (0.015, 3.0)
