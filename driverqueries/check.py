"""Compare registered queries with their SQL on one data folder.

usage: python -m driverqueries.check <sf_dir> [key prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter


def normal(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.12g}")
    if isinstance(value, dict):
        return tuple(sorted(value.items()))
    if isinstance(value, list):
        return tuple(normal(v) for v in value)
    if hasattr(value, "tzinfo") and getattr(value, "tzinfo", None) is not None:
        return value.replace(tzinfo=None)
    return value


def kinds(rows):
    found = [set() for _ in (rows[0] if rows else [])]
    for r in rows:
        for s, v in zip(found, r):
            if v is not None:
                s.add(type(v).__name__)
    return found


def compare(spark_rows, spark_names, sql_rows, sql_names) -> str | None:
    if sorted(spark_names) != sorted(sql_names):
        return f"columns {sorted(spark_names)} <> {sorted(sql_names)}"
    order_a = [spark_names.index(n) for n in sorted(spark_names)]
    order_b = [sql_names.index(n) for n in sorted(sql_names)]
    a = [tuple(normal(r[i]) for i in order_a) for r in spark_rows]
    b = [tuple(normal(r[i]) for i in order_b) for r in sql_rows]
    if len(a) != len(b):
        return f"rows {len(a)} <> {len(b)}"
    for name, x, y in zip(sorted(spark_names), kinds(a), kinds(b)):
        if x and y and x != y:
            return f"column {name}: {x} <> {y}"
    left, right = Counter(a), Counter(b)
    if left != right:
        return f"{sum((left - right).values())} rows differ, e.g. {list((left - right))[:2]} <> {list((right - left))[:2]}"
    return None


def duck(sf_dir):
    import duckdb

    from driverqueries.adapters import TABLES

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def check(spark, con, key, sf_dir):
    from driverqueries import CHECKS, QUERIES

    started = time.time()
    df = QUERIES[key](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - started
    if key not in CHECKS:
        return f"rows only ({len(rows)})", took, len(rows)
    cursor = con.execute(CHECKS[key])
    names = [d[0] for d in cursor.description]
    return compare(rows, df.columns, cursor.fetchall(), names), took, len(rows)


def main() -> int:
    from driverqueries import QUERIES
    from fleetlens.session import local_session

    sf_dir, prefixes = sys.argv[1], sys.argv[2:]
    spark, con = local_session(cores="8"), duck(sf_dir)
    bad = 0
    for key in QUERIES:
        if prefixes and not any(key.startswith(p) for p in prefixes):
            continue
        try:
            result, took, n = check(spark, con, key, sf_dir)
        except Exception as e:  # noqa: BLE001  (report and go on)
            result, took, n = f"{type(e).__name__}: {str(e)[:600]}", 0.0, -1
        ok = result is None or result.startswith("rows only")
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {key:34s} {n:7d} rows {took:6.2f}s {result or ''}", flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(main())
