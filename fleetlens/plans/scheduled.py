"""Steps of a scheduler over committed stores: feeds read from their marks on, and alert rules with their state."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.operators import merges
from fleetlens.plans import alerts
from fleetlens.sources import readers, sinks

MARKS = T.StructType([T.StructField("source_database", T.StringType()), T.StructField("watermark", T.TimestampType())])
PENDING = T.StructType([T.StructField("rule_id", T.StringType()), T.StructField("labels_key", T.StringType()), T.StructField("pending_since", T.TimestampType())])
EVALUATED = T.StructType([T.StructField("rule_id", T.StringType()), T.StructField("evaluated_at", T.TimestampType())])


def ingest_activity(spark: SparkSession, feed: DataFrame, root: str, poll_id: int, as_of: datetime, overlap: float, initial: float = 120.0) -> bool:
    """Store the rows of an activity feed that come after the marks, then move the marks.

    The marks are a state of their own that is written after the rows are published: a poll that
    stops in between reads the same rows again, finds them stored, and moves the marks then.
    """
    marks = sinks.read_state(spark, root, "activity_marks", MARKS, before=poll_id)
    rows, moved = readers.incremental(feed, marks, F.lit(as_of).cast("timestamp"), overlap, initial)
    rows = rows.persist()
    days = [r[0] for r in rows.select(F.to_date("sample_time")).distinct().collect()]
    stored = sinks.read_table(spark, root, "database_activity_samples", days)
    fresh = merges.dedupe_insert(stored, rows, seq="poll")
    published = sinks.commit_batch(spark, root, poll_id, {"database_activity_samples": fresh})
    sinks.write_state(spark, root, "activity_marks", moved, poll_id)
    rows.unpersist()
    return published


def due_rules(rules: list[alerts.Rule], last: dict[str, datetime], as_of: datetime) -> list[alerts.Rule]:
    """Rules never evaluated, or for the last time at least their interval ago."""
    return [r for r in rules if r.rule_id not in last or (as_of - last[r.rule_id]).total_seconds() >= r.every_seconds]


def evaluate_due(spark: SparkSession, tables: dict[str, DataFrame], root: str, pass_id: int, as_of: datetime,
                 rules: list[alerts.Rule] = alerts.RULES) -> list[str]:
    """Evaluate the rules that are due, append the evaluation, and keep the label sets in breach as state.

    Returns the rules evaluated.  A replay of a pass appends nothing and writes the same state.
    """
    last = {r["rule_id"]: r["evaluated_at"] for r in sinks.read_state(spark, root, "evaluated_rules", EVALUATED, before=pass_id).collect()}
    due = due_rules(rules, last, as_of)
    if not due:
        return []
    now = F.lit(as_of).cast("timestamp")
    values = None
    for rule in due:
        part = alerts.rule_values(rule.rule_id, tables, now)
        values = part if values is None else values.unionByName(part)
    state = sinks.read_state(spark, root, "pending_alerts", PENDING, before=pass_id)
    result, after = alerts.evaluate_step(values, alerts.rules_frame(spark, due), state)
    result = result.withColumn("evaluated_at", now)
    sinks.commit_batch(spark, root, pass_id, {"alert_evaluations": result})
    sinks.write_state(spark, root, "pending_alerts", after, pass_id)
    moved = [(k, v) for k, v in ({**last, **{r.rule_id: as_of for r in due}}).items()]
    sinks.write_state(spark, root, "evaluated_rules", spark.createDataFrame(moved, EVALUATED), pass_id)
    return [r.rule_id for r in due]
