"""The corpus pipeline: identify the language, drop near copies, drop benchmark leaks, redact secrets, pack.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet
and reads again as the next one's documents.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import decontaminate, language, near_copies, packing, secrets
from fleetlens.llm.common import prepare, stored, table


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a sufficient margin; the rest (``und`` included) go."""
    prepare(spark)
    verdict = "language_verdict_of_stage"
    content = language.learn(docs.where(~language.held_out(F.col("doc_id"))))
    return docs.withColumn(verdict, language.classify(F.col("text"), content)).where(f"not {verdict}.rejected").drop(verdict)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, Jaccard similarity 0.8 or more): that of the smallest id.

    Of a repeated row one stays.  An id that stands at different texts stays if it is the smallest
    of any of their groups; documents without an id are in no group and stay.
    """
    prepare(spark)
    groups = stored(near_copies.near_copies(docs), "groups")
    ids = groups.groupBy("doc_id").agg(F.max("component_id").alias("high"), F.count("*").alias("rows"))
    gone = ids.where("high <> doc_id").select(F.col("doc_id").alias("gone"))
    kept = docs.join(gone, F.col("doc_id") == F.col("gone"), "left_anti")
    repeated = ids.where("rows > 1 and high = doc_id").select(F.col("doc_id").alias("again"))
    if repeated.isEmpty():
        return kept
    twice = F.col("doc_id") == F.col("again")
    return kept.join(repeated, twice, "left_anti").unionByName(kept.join(repeated, twice, "left_semi").dropDuplicates(["doc_id", "text"]))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark and ``n_chars`` counted anew."""
    prepare(spark)
    model = secrets.learn(docs)
    clean = docs.withColumn("text", secrets.redact(F.col("text"), model))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences of the permitted lengths."""
    return packing.packed(docs)


STAGES = [
    ("language", keep_identified),
    ("near_duplicates", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: SQL cannot express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
