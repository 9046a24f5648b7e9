from pyspark.sql import functions as F

from fleetlens.operators import accounting, merges
from fleetlens.schemas import STORED

LATEST = "source_database string, collector string, collected_at timestamp, success boolean"


def test_merge_latest_ties(spark, at):
    old = spark.createDataFrame([("a", "c", at(10), True), ("b", "c", at(10), True), ("z", "c", at(5), True)], LATEST)
    new = spark.createDataFrame([("a", "c", at(10), False, 1), ("b", "c", at(9), False, 2), ("d", "c", at(1), True, 3),
                                 ("d", "c", at(1), False, 4)], LATEST + ", seq long")
    keys = ["source_database", "collector"]
    last = {r.source_database: r.success for r in merges.merge_latest(old, new, keys, "collected_at").collect()}
    assert last == {"a": False, "b": True, "z": True, "d": False}
    first = {r.source_database: r.success for r in merges.merge_latest(old, new, keys, "collected_at", tie="first").collect()}
    assert first == {"a": False, "b": True, "z": True, "d": True}


def test_merge_latest_does_not_depend_on_batching(spark, at):
    rows = [("a", "c", at(t % 4), t % 3 == 0, t) for t in range(12)]
    schema = LATEST + ", seq long"
    empty = spark.createDataFrame([], LATEST)
    keys = ["source_database", "collector"]
    whole = merges.merge_latest(empty, spark.createDataFrame(rows, schema), keys, "collected_at").collect()
    state = empty
    for i in range(0, 12, 3):
        part = spark.createDataFrame(list(reversed(rows[i:i + 3])), schema)
        state = merges.merge_latest(state, part, keys, "collected_at")
    assert state.select(*empty.columns).collect() == spark.createDataFrame(whole, LATEST).select(*empty.columns).collect()


def test_merge_state_prunes_only_when_complete(spark, at):
    schema = "source_database string, observed_at timestamp, state string"
    old = spark.createDataFrame([("gone", at(0), "ACTIVE"), ("kept", at(0), "ACTIVE")], schema)
    new = spark.createDataFrame([("kept", at(1), "QUARANTINED", 1)], schema + ", seq long")
    assert {r.source_database for r in merges.merge_state(old, new, False).collect()} == {"gone", "kept"}
    assert [tuple(r)[0::2] for r in merges.merge_state(old, new, True).collect()] == [("kept", "QUARANTINED")]
    assert merges.merge_state(old, new.limit(0), True).collect() == []


def test_sql_texts_keep_the_newest(spark, at):
    empty = spark.createDataFrame([], STORED["sql_texts"])
    schema = "source_database string, sql_id string, sql_fulltext string, collected_at timestamp, seq long"
    batch = spark.createDataFrame([("db", "s", "newer", at(10), 1), ("db", "s", "older", at(5), 2)], schema)
    row = merges.merge_sql_texts(empty, None, batch).first()
    assert (row.sql_fulltext, row.first_seen_at, row.last_text_seen_at) == ("newer", at(5), at(10))
    stored = merges.merge_sql_texts(empty, None, batch)
    late = spark.createDataFrame([("db", "s", "late", at(7), 3)], schema)
    assert merges.merge_sql_texts(stored, None, late).first().sql_fulltext == "newer"
    equal = spark.createDataFrame([("db", "s", "equal", at(10), 4)], schema)
    assert merges.merge_sql_texts(stored, None, equal).first().sql_fulltext == "equal"


def test_text_references(spark, at):
    sessions = spark.createDataFrame([("db", "s1", "s2", at(1)), ("db", None, " ", at(2))],
                                     "source_database string, sql_id string, prev_sql_id string, collected_at timestamp")
    blockers = spark.createDataFrame([("db", "s3", "s4", at(3))],
                                     "source_database string, sql_id string, blocking_sql_id string, collected_at timestamp")
    activity = spark.createDataFrame([("db", "s1", "s5", at(4))],
                                     "source_database string, sql_id string, top_level_sql_id string, collected_at timestamp")
    refs = merges.text_references(sessions=sessions, blockers=blockers, activity=activity)
    assert {(r.sql_id, r.referenced_at) for r in refs.collect()} == {
        ("s1", at(4)), ("s2", at(1)), ("s3", at(3)), ("s4", at(3)), ("s5", at(4))}
    texts = spark.createDataFrame([("db", "s1", at(0)), ("db", "s9", at(9)), ("db", "s4", at(8))],
                                  "source_database string, sql_id string, last_referenced_at timestamp")
    touched = merges.touch(texts, refs, ["source_database", "sql_id"])
    assert {(r.sql_id, r.last_referenced_at) for r in touched.collect()} == {("s1", at(4)), ("s9", at(9)), ("s4", at(8))}


CURSOR = "source_database string, inst_id long, sql_id string, child_number long, plan_hash_value long, parsing_schema_name string, module string, collected_at timestamp, seq long"


def test_cursor_metadata_is_rewritten_only_when_it_matters(spark, at):
    def batch(t, module, seq=1):
        return spark.createDataFrame([("db", 1, "s", 0, 7, "APP", module, at(t), seq)], CURSOR)

    store = merges.merge_cursor_metadata(spark.createDataFrame([], STORED["sql_cursor_metadata"]), batch(3600, "m"))
    assert store.first().last_seen_at == at(3600)
    store = merges.merge_cursor_metadata(store, batch(7200, "m"))
    assert store.first().last_seen_at == at(3600)
    store = merges.merge_cursor_metadata(store, batch(10800, None))
    assert (store.first().last_seen_at, store.first().module) == (at(10800), None)
    store = merges.merge_cursor_metadata(store, batch(9000, "old"))
    assert (store.first().last_seen_at, store.first().module) == (at(10800), None)
    store = merges.merge_cursor_metadata(store, batch(3600 + 86400, None))
    row = store.first()
    assert (row.first_seen_at, row.last_seen_at) == (at(3600), at(3600 + 86400))


def test_cursor_metadata_skips_unusable_rows(spark, at):
    rows = [("db", 1, " ", 0, 7, "A", "m", at(1), 1), ("db", 1, "s", None, 7, "A", "m", at(1), 2),
            ("db", 1, "s", 0, None, "A", "m", at(1), 3), (None, 1, "s", 0, 7, "A", "m", at(1), 4)]
    store = merges.merge_cursor_metadata(spark.createDataFrame([], STORED["sql_cursor_metadata"]),
                                         spark.createDataFrame(rows, CURSOR))
    assert store.count() == 0


PLAN = ("source_database string, inst_id long, sql_id string, child_number long, plan_hash_value long, plan_line_id long, "
        "operation string, cost long")


def test_sql_plans_take_attributes_of_older_rows(spark, at):
    old = spark.createDataFrame([("db", 1, "s", 0, 7, 1, "SCAN", 5, at(0), at(100), at(100))],
                                PLAN + ", first_seen_at timestamp, last_seen_at timestamp, last_referenced_at timestamp")
    new = spark.createDataFrame([("db", 1, "s", 0, 7, 1, "SEEK", None, at(50), 1), ("db", 1, "s", 0, 7, 2, "SORT", 1, at(50), 2),
                                 ("db", 1, "s", 0, 7, 2, "HASH", 2, at(40), 3)], PLAN + ", collected_at timestamp, seq long")
    rows = {r.plan_line_id: r for r in merges.merge_sql_plans(old, new).collect()}
    assert (rows[1].operation, rows[1].cost, rows[1].last_seen_at) == ("SEEK", None, at(100))
    assert (rows[2].operation, rows[2].first_seen_at) == ("HASH", at(40))


def test_plan_references_need_child_and_plan(spark, at):
    rows = spark.createDataFrame([("db", 1, "s", 0, 7, at(1)), ("db", 1, "s", 0, 7, at(2)), ("db", 1, "s", None, 7, at(1)),
                                  ("db", 1, "s", 0, 0, at(1))],
                                 "source_database string, inst_id long, sql_id string, child_number long, plan_hash_value long, collected_at timestamp")
    refs = merges.plan_references(rows).collect()
    assert [(r.child_number, r.plan_hash_value, r.referenced_at) for r in refs] == [(0, 7, at(2))]


ACTIVITY = "sample_time timestamp, source_database string, inst_id long, sample_id long, session_id long, session_serial_number long, poll long"


def test_dedupe_insert(spark, at):
    rows = [(at(1), "db", 1, 1, 1, None, 1), (at(1), "db", 1, 1, 1, None, 2), (at(1), "db", 1, 1, 1, 5, 1), (at(2), "db", 1, 2, 1, 5, 1)]
    incoming = spark.createDataFrame(rows, ACTIVITY)
    assert merges.dedupe_insert(None, incoming, seq="poll").count() == 3
    stored = incoming.where("sample_id = 1").withColumn("day", F.to_date("sample_time"))
    got = merges.dedupe_insert(stored, incoming, seq="poll").collect()
    assert [r.sample_id for r in got] == [2]


def test_daily_ingest_groups_by_day_and_database(spark, at):
    day = 86400
    rows = spark.createDataFrame([(at(day - 60), "a"), (at(day + 60), "a"), (at(day + 60), "b"), (None, "a"), (at(1), "")],
                                 "collected_at timestamp, source_database string")
    daily = accounting.daily_ingest({"sql_samples": rows, "scrape_status": rows})
    got = {(r.sample_day, r.source_database): (r.sql_sample_rows, r.scrape_status_rows, r.last_sql_sample_at) for r in daily.collect()}
    assert got == {(at(0), "a"): (1, 1, at(day - 60)), (at(day), "a"): (1, 1, at(day + 60)), (at(day), "b"): (1, 1, at(day + 60))}


def test_merge_daily_ingest_adds(spark, at):
    rows = spark.createDataFrame([(at(10), "a"), (at(20), "a")], "collected_at timestamp, source_database string")
    more = spark.createDataFrame([(at(5), "a"), (at(30), "a"), (at(8), "a")], "collected_at timestamp, source_database string")
    stored = accounting.daily_ingest({"sql_samples": rows}).withColumn("last_flushed_at", F.lit(at(50)).cast("timestamp"))
    merged = accounting.merge_daily_ingest(stored, accounting.daily_ingest({"sql_samples": more}),
                                           F.lit(at(40)).cast("timestamp")).first()
    assert (merged.sql_sample_rows, merged.first_sample_at, merged.last_sample_at, merged.last_flushed_at) == (
        5, at(5), at(30), at(50))


def test_retention(spark, at):
    days = spark.createDataFrame([("2024-01-01",), ("2024-01-02",), (None,)], "day string").select(F.to_date("day").alias("day"))
    cutoff = F.lit("2024-01-02 12:35:12").cast("timestamp")
    assert [str(r.day) for r in merges.expired_days(days, cutoff).collect()] == ["2024-01-01"]
    rows = spark.createDataFrame([(at(86400 - 1),), (at(86400),)], "t timestamp")
    assert [r.t for r in merges.retain(rows, "t", cutoff).collect()] == [at(86400)]
    keyed = spark.createDataFrame([(at(i), i) for i in range(10)], "t timestamp, k long")
    left = merges.delete_oldest(keyed, "t", ["k"], cutoff, 4)
    assert sorted(r.k for r in left.collect()) == [4, 5, 6, 7, 8, 9]


def test_evolve_defaults(spark):
    old = spark.createDataFrame([(1, "s")], "sample_id long, sql_id string")
    row = merges.evolve(old, STORED["database_activity_samples"], merges.ACTIVITY_DEFAULTS).first()
    assert (row.sample_id, row.sample_source, row.sample_duration_micro, row.service_name) == (1, "LEGACY", 2000000, None)
