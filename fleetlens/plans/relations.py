"""Documented joins between stored tables.

Dictionaries are the right side with unique keys.  Joins between two series also
match the snapshot time, so one row does not meet the other side's whole history.
No side is forced to be broadcast: Spark does that below its size threshold, and
beyond it splits a hot key of the left side at run time.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.samples import cursor_context


@dataclass(frozen=True)
class Relation:
    left: str
    right: str
    keys: tuple[tuple[str, str], ...]
    series: bool = False
    variants: dict[str, tuple[tuple[str, str], ...]] = field(default_factory=dict)


def _same(*names: str) -> tuple[tuple[str, str], ...]:
    return tuple((n, n) for n in names)


# --- fixed values ---------------------------------------------------------
# Keys besides source_database, as (left column, right column).
_CURSOR = _same("inst_id", "sql_id", "child_number", "plan_hash_value")
RELATIONS: dict[str, Relation] = {
    "R-1": Relation("session_samples", "sql_samples",
                    (("sql_id", "sql_id"), ("sql_child_number", "child_number")), True),
    "R-2": Relation("blocking_session_samples", "session_samples", _same("inst_id", "sid", "serial_number"), True),
    "R-3": Relation("database_activity_samples", "sql_samples",
                    (("sql_id", "sql_id"), ("sql_child_number", "child_number")), True),
    "R-4": Relation("database_activity_samples", "sql_plans",
                    (("inst_id", "inst_id"), ("sql_id", "sql_id"), ("sql_child_number", "child_number"),
                     ("sql_plan_hash_value", "plan_hash_value"), ("sql_plan_line_id", "plan_line_id"))),
    "R-5": Relation("sql_samples", "sql_texts", _same("sql_id")),
    "R-6": Relation("sql_samples", "sql_plans", _CURSOR),
    "R-7": Relation("sql_samples", "sql_cursor_metadata", _same("inst_id", "sql_id", "plan_hash_value")),
    "R-8": Relation("sql_cursor_metadata", "sql_plans", _CURSOR),
    "R-9": Relation("sql_plans", "sql_texts", _same("sql_id")),
    "R-10": Relation("session_samples", "sql_texts", (), False,
                     {"current": _same("sql_id"), "previous": (("prev_sql_id", "sql_id"),)}),
    "R-11": Relation("blocking_session_samples", "sql_texts", (), False,
                     {"waiter": _same("sql_id"), "blocker": (("blocking_sql_id", "sql_id"),)}),
    "R-12": Relation("database_activity_samples", "sql_texts", (), False,
                     {"own": _same("sql_id"), "top": (("top_level_sql_id", "sql_id"),)}),
    "R-13": Relation("database_activity_samples", "session_samples",
                     (("inst_id", "inst_id"), ("session_id", "sid"), ("session_serial_number", "serial_number")),
                     True),
    "R-14": Relation("instance_samples", "database_status_samples", _same("inst_id"), True),
    "R-15": Relation("resource_limit_samples", "instance_samples", _same("inst_id"), True),
    "R-16": Relation("asm_diskgroup_samples", "database_status_samples", _same("inst_id"), True),
    "R-17": Relation("system_counter_samples", "instance_samples", _same("inst_id"), True),
    "R-18": Relation("wait_class_samples", "instance_samples", _same("inst_id"), True),
    "R-19": Relation("system_metric_samples", "instance_samples", _same("inst_id"), True),
    "R-20": Relation("dataguard_destination_samples", "database_status_samples", _same("inst_id"), True),
    "R-21": Relation("dataguard_lag_samples", "database_status_samples", (), True),
    "R-22": Relation("dataguard_process_samples", "database_status_samples", _same("inst_id"), True),
    "R-23": Relation("scrape_status", "database_status_samples", (), True),
}
# --------------------------------------------------------------------------


def relate(left: DataFrame, right: DataFrame, rel_id: str, how: str = "left",
           at: str | None = "collected_at") -> DataFrame:
    """Join two stored tables along a documented relation.

    Columns of the right side get the prefix ``r_`` (``<variant>_`` where a relation has
    several keys into one dictionary).  ``at=None`` drops the snapshot-time match.  Cursor
    metadata is reduced to one row per plan before SQL samples meet it.
    """
    rel = RELATIONS[rel_id]
    if rel_id == "R-7":
        right = cursor_context(right)
    joined = left
    for name, keys in (rel.variants or {"r": rel.keys}).items():
        pairs = [("source_database", "source_database"), *keys]
        if rel.series and at is not None:
            pairs.append((at, at))
        renamed = right.select(*[F.col(c).alias(f"{name}_{c}") for c in right.columns])
        matched = F.lit(True)
        for own, other in pairs:
            matched = matched & (joined[own] == renamed[f"{name}_{other}"])
        joined = joined.join(renamed, matched, how)
    return joined
