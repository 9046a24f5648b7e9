"""Merges of incoming rows into stored state: ``merge(existing, incoming) -> new state``.

All of them are pure and bring rows of one key together by grouping, which is
combined before the shuffle, or by joining two sides that are unique per key.
Tie rules differ on purpose; every incoming batch carries ``seq`` (arrival order).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions import scalars as S
from fleetlens.operators.timeline import first_per_key, newest_per_key

# --- fixed values ---------------------------------------------------------
ACTIVITY_KEYS = ["sample_time", "source_database", "inst_id", "sample_id", "session_id", "session_serial_number"]
CURSOR_KEYS = ["source_database", "inst_id", "sql_id", "child_number", "plan_hash_value"]
PLAN_LINE_KEYS = [*CURSOR_KEYS, "plan_line_id"]
PLAN_TIMES = ["first_seen_at", "last_seen_at", "last_referenced_at"]
ACTIVITY_DEFAULTS = {"sample_source": "LEGACY", "sample_duration_micro": 2_000_000}
# --------------------------------------------------------------------------


def without(df: DataFrame, *names: str) -> list[str]:
    return [c for c in df.columns if c not in names]


def not_blank(*columns: str) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.coalesce(F.length(S.trim_space(F.col(c))) > 0, F.lit(False))
    return ok


def dedupe_insert(existing: DataFrame | None, incoming: DataFrame, keys: Sequence[str] = ACTIVITY_KEYS,
                  seq: str = "seq", nullable: str | None = "session_serial_number") -> DataFrame:
    """Incoming rows that are not stored yet; the first row of a key wins.

    A NULL in ``nullable`` is a value of its own (-1).  Stored rows are read only for
    the days the batch touches when ``existing`` is partitioned by ``day``.
    """
    def keyed(df):
        return df.withColumn("_key", F.coalesce(nullable, F.lit(-1))) if nullable else df

    names = [k for k in keys if k != nullable] + (["_key"] if nullable else [])
    fresh = first_per_key(keyed(incoming), names, [seq])
    if existing is not None:
        stored = keyed(existing)
        if "day" in existing.columns:
            # A join on the partition column prunes the stored days at run time; a batch touches few days.
            days = incoming.select(F.to_date("sample_time").alias("day")).distinct()
            stored = stored.join(days, "day", "left_semi")
        fresh = fresh.join(stored.select(*names), names, "left_anti")
    return fresh.select(*incoming.columns)


def merge_latest(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], ts: str,
                 tie: str = "last", seq: str = "seq") -> DataFrame:
    """Keep the newest row per key; an incoming row replaces a stored one of equal time.

    Among incoming rows of equal time the ``last`` or the ``first`` to arrive wins.
    """
    arrival = F.col(seq) if tie == "last" else -F.col(seq)
    both = existing.withColumn("_incoming", F.lit(0)).unionByName(
        incoming.withColumn("_incoming", F.lit(1)), allowMissingColumns=True
    )
    newest = newest_per_key(both, keys, [F.col(ts), F.col("_incoming"), arrival])
    return newest.select(*without(incoming, seq))


def merge_state(existing: DataFrame, incoming: DataFrame, complete: bool,
                key: str = "source_database", ts: str = "observed_at") -> DataFrame:
    """Latest state per database; a ``complete`` batch also drops databases it does not name."""
    merged = merge_latest(existing, incoming, [key], ts)
    return merged.join(incoming.select(key).distinct(), key, "left_semi") if complete else merged


def merge_sql_texts(existing: DataFrame, sql_rows: DataFrame | None, text_rows: DataFrame) -> DataFrame:
    """SQL-text dictionary.  The newest text wins; of equal times the later one, rows of
    ``text_rows`` counting as later than ``sql_rows`` and both as later than the store."""
    def incoming(df, rank):
        return df.where(F.col("sql_fulltext").isNotNull()).select(
            "source_database", "sql_id", "sql_fulltext", F.col("collected_at").alias("first_seen_at"),
            F.col("collected_at").alias("last_text_seen_at"), F.col("collected_at").alias("last_referenced_at"),
            F.lit(rank).alias("_rank"), F.col("seq").alias("_seq"),
        )

    both = existing.withColumns({"_rank": F.lit(0), "_seq": F.lit(0).cast("long")})
    if sql_rows is not None:
        both = both.unionByName(incoming(sql_rows, 1))
    both = both.unionByName(incoming(text_rows, 2))
    return both.groupBy("source_database", "sql_id").agg(
        F.max_by("sql_fulltext", F.struct("last_text_seen_at", "_rank", "_seq")).alias("sql_fulltext"),
        F.min("first_seen_at").alias("first_seen_at"),
        F.max("last_text_seen_at").alias("last_text_seen_at"),
        F.max("last_referenced_at").alias("last_referenced_at"),
    )


def merge_cursor_metadata(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Cursor metadata, rewritten only when it matters: on a new UTC day, or when a row
    that is not older brings another schema or module."""
    valid = not_blank("source_database", "sql_id") & F.col("child_number").isNotNull() & F.col(
        "plan_hash_value").isNotNull() & F.col("collected_at").isNotNull()
    fresh = newest_per_key(incoming.where(valid), CURSOR_KEYS, [F.col("collected_at"), -F.col("seq")])
    new = fresh.select(*CURSOR_KEYS, F.struct("parsing_schema_name", "module", "collected_at").alias("n"))
    old = existing.select(
        *CURSOR_KEYS, F.struct("parsing_schema_name", "module", "first_seen_at", "last_seen_at").alias("o")
    )
    at, seen = F.col("n.collected_at"), F.col("o.last_seen_at")
    differs = ~F.col("o.parsing_schema_name").eqNullSafe(F.col("n.parsing_schema_name")) | ~F.col(
        "o.module").eqNullSafe(F.col("n.module"))
    rewrite = F.col("n").isNotNull() & (
        F.col("o").isNull() | (seen < S.day_start_utc(at)) | ((at >= seen) & differs)
    )
    rewrite = F.coalesce(rewrite, F.lit(False))
    newer = F.col("o").isNull() | (at >= seen)
    return old.join(new, CURSOR_KEYS, "full").select(
        *CURSOR_KEYS,
        F.when(rewrite & newer, F.col("n.parsing_schema_name")).otherwise(
            F.col("o.parsing_schema_name")).alias("parsing_schema_name"),
        F.when(rewrite & newer, F.col("n.module")).otherwise(F.col("o.module")).alias("module"),
        F.when(rewrite, F.least(F.col("o.first_seen_at"), at)).otherwise(
            F.col("o.first_seen_at")).alias("first_seen_at"),
        F.when(rewrite, F.greatest(seen, at)).otherwise(seen).alias("last_seen_at"),
    )


def merge_sql_plans(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Plan lines.  Incoming attributes replace stored ones even when they are older; only
    the three times are merged.  The last incoming row of a key wins."""
    attributes = [c for c in existing.columns if c not in (*PLAN_LINE_KEYS, *PLAN_TIMES)]
    fresh = newest_per_key(incoming, PLAN_LINE_KEYS, ["seq"])
    new = fresh.select(*PLAN_LINE_KEYS, F.struct(*attributes, "collected_at").alias("n"))
    old = existing.select(*PLAN_LINE_KEYS, F.struct(*attributes, *PLAN_TIMES).alias("o"))
    replaced = F.col("n").isNotNull()
    return old.join(new, PLAN_LINE_KEYS, "full").select(
        *PLAN_LINE_KEYS,
        *[F.when(replaced, F.col(f"n.{a}")).otherwise(F.col(f"o.{a}")).alias(a) for a in attributes],
        F.least(F.col("o.first_seen_at"), F.col("n.collected_at")).alias("first_seen_at"),
        F.greatest(F.col("o.last_seen_at"), F.col("n.collected_at")).alias("last_seen_at"),
        F.greatest(F.col("o.last_referenced_at"), F.col("n.collected_at")).alias("last_referenced_at"),
    )


def text_references(sql: DataFrame | None = None, texts: DataFrame | None = None,
                    sessions: DataFrame | None = None, blockers: DataFrame | None = None,
                    activity: DataFrame | None = None) -> DataFrame:
    """Latest reference time of every statement named by a batch."""
    named = [(sql, ["sql_id"]), (texts, ["sql_id"]), (sessions, ["sql_id", "prev_sql_id"]),
             (blockers, ["sql_id", "blocking_sql_id"]), (activity, ["sql_id", "top_level_sql_id"])]
    parts = []
    for df, columns in named:
        if df is None:
            continue
        ids = [F.col(c) for c in columns if c in df.columns]
        parts.append(df.select("source_database", F.explode(F.array(*ids)).alias("sql_id"),
                               F.col("collected_at").alias("referenced_at")))
    refs = parts[0]
    for p in parts[1:]:
        refs = refs.unionByName(p)
    valid = not_blank("source_database", "sql_id") & F.col("referenced_at").isNotNull()
    return refs.where(valid).groupBy("source_database", "sql_id").agg(F.max("referenced_at").alias("referenced_at"))


def plan_references(*rows: DataFrame) -> DataFrame:
    """Latest reference time of every plan named by SQL and detail rows."""
    parts = [
        df.where(F.col("child_number").isNotNull() & (F.col("plan_hash_value") > 0)).select(
            *CURSOR_KEYS, F.col("collected_at").alias("referenced_at"))
        for df in rows
    ]
    refs = parts[0]
    for p in parts[1:]:
        refs = refs.unionByName(p)
    return refs.groupBy(*CURSOR_KEYS).agg(F.max("referenced_at").alias("referenced_at"))


def touch(existing: DataFrame, refs: DataFrame, keys: Sequence[str], ts: str = "last_referenced_at",
          ref: str = "referenced_at") -> DataFrame:
    """Move the reference time of stored rows forward; unmatched references are ignored."""
    newest = refs.groupBy(*keys).agg(F.max(ref).alias("_ref"))
    return existing.join(newest, list(keys), "left").withColumn(ts, F.greatest(ts, "_ref")).select(*existing.columns)


# --- retention and evolution -------------------------------------------------

def expired_days(days: DataFrame, cutoff: Column, day: str = "day") -> DataFrame:
    """Day partitions that ended at or before ``cutoff``; unparsed days are left alone."""
    ended = F.date_add(F.col(day), 1).cast("timestamp")
    return days.where(F.col(day).isNotNull() & (ended <= cutoff))


def retain(df: DataFrame, ts: str, cutoff: Column) -> DataFrame:
    """Rows from the UTC day of ``cutoff`` on."""
    return df.where(F.col(ts) >= S.day_start_utc(cutoff))


def delete_oldest(df: DataFrame, ts: str, keys: Sequence[str], cutoff: Column,
                  limit: int | None = None) -> DataFrame:
    """Drop the expired rows, or with a ``limit`` the oldest so many of them.  ``keys`` are unique per row."""
    expired = F.coalesce(F.col(ts) < S.day_start_utc(cutoff), F.lit(False))
    if limit is None:
        return df.where(~expired)
    doomed = df.where(expired).select(ts, *keys).orderBy(ts, *keys).limit(limit)
    return df.join(doomed.select(*keys), list(keys), "left_anti").select(*df.columns)


def evolve(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """Bring older rows to the current layout; missing columns get a default or NULL."""
    defaults = defaults or {}
    return df.select(*[
        F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns
        else F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])
