"""The queries against their SQL, and the pipeline's stages on a small corpus."""
import os

import pytest

import corpus_pipeline
from driverqueries.check import compare, duck
from fleetlens.llm import decontaminate, language, near_copies, secrets
from fleetlens.llm.queries import CHECKS, QUERIES
from pyspark.sql import functions as F

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.mark.parametrize("key", list(CHECKS))
def test_query_agrees_with_its_sql(spark, key):
    df = QUERIES[key](spark, SF_DIR)
    cursor = duck(SF_DIR).execute(CHECKS[key])
    names = [d[0] for d in cursor.description]
    assert compare([tuple(r) for r in df.collect()], df.columns, cursor.fetchall(), names) is None


def test_one_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language", "near_duplicates", "decontaminate", "secrets", "packing"]
    identified = steps["language"](spark, docs, SF_DIR)
    told = {r[0]: r[1] for r in language.identify(docs).select("doc_id", "language.rejected").collect()}
    assert identified.columns == columns and {r["doc_id"] for r in identified.collect()} == {i for i, rejected in told.items() if not rejected}
    single = steps["near_duplicates"](spark, identified, SF_DIR)
    texts = {r["doc_id"]: r["text"] for r in identified.collect()}
    sets = {i: set(near_copies.shingles_of(t).tolist()) for i, t in texts.items()}
    label = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and label[i] != label[j] and (len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                a, b = label[i], label[j]
                label = {k: min(a, b) if v in (a, b) else v for k, v in label.items()}
    assert single.columns == columns and {r["doc_id"] for r in single.collect()} == set(label.values())
    clean = steps["decontaminate"](spark, single, SF_DIR)
    items = [decontaminate.reduced(r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    left = {r["doc_id"] for r in clean.collect()}
    assert clean.columns == columns and left <= set(label.values())
    assert not any(item in decontaminate.reduced(texts[i]) for i in left for item in items)
    safe = steps["secrets"](spark, clean, SF_DIR)
    assert safe.columns == columns and {r["doc_id"] for r in safe.collect()} == left
    assert all(not secrets.base_spans(r["text"]) and r["n_chars"] == len(r["text"]) for r in safe.collect())
    packed = steps["packing"](spark, safe, SF_DIR)
    assert packed.agg(F.sum("n_tokens")).first()[0] == sum(len(r["text"].encode()) for r in safe.collect())


def test_stages_on_odd_rows(docs_of):
    spark = docs_of([]).sparkSession
    odd = docs_of([(1, None), (2, ""), (3, "same text here for you"), (3, "same text here for you"), (None, "same text here for you"), (4, "x" * 20_000)])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.withColumn("extra", F.lit(1)), SF_DIR).count() >= 0
        assert stage(spark, odd.limit(0), SF_DIR).count() == 0
    kept = corpus_pipeline.drop_near_copies(spark, odd, SF_DIR).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == [(False, 1), (False, 3), (False, 4), (True, 0)]
