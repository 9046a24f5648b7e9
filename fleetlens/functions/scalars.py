"""Scalar helpers: ``Column -> Column``, all inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values ---------------------------------------------------------
# Text written for a NULL result value by the row source.
NIL = "<nil>"
# Ordered product markers and the edition each one stands for.
EDITIONS = [
    ("ENTERPRISE EDITION", "Enterprise Edition"),
    ("STANDARD EDITION 2", "Standard Edition 2"),
    ("STANDARD EDITION", "Standard Edition"),
    ("EXPRESS EDITION", "Express Edition"),
    ("FREE", "Free"),
    ("PERSONAL EDITION", "Personal Edition"),
]
# Prefix and infix of product rows that name the database itself.
PRODUCT_PATTERN = "ORACLE%DATABASE%"
# Upper-case fragments of error texts that mean the connection is gone.
CONNECTION_FAILURE_MARKERS = [
    "ORA-01033", "ORA-01034", "ORA-01089", "ORA-03113", "ORA-03114", "ORA-03135",
    "ORA-12154", "ORA-12170", "ORA-125", "DPI-1010", "DPI-1080", "BROKEN PIPE",
    "CONNECTION REFUSED", "CONNECTION RESET", "DATABASE IS CLOSED",
    "NETWORK IS UNREACHABLE", "NO ROUTE TO HOST",
]
# Error kinds reported by a client driver that mean the same.
CONNECTION_FAILURE_KINDS = ["bad_connection", "connection_done", "session_not_initialized", "network"]
# Units of duration text, in seconds.
DURATION_UNITS = {
    "ns": 1e-9, "us": 1e-6, "µs": 1e-6, "μs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0,
}
# --------------------------------------------------------------------------

_BLANKS = " \t\n\r\f\x0b"


def trim_space(c: Column) -> Column:
    """Strip every kind of white space at both ends."""
    return F.btrim(c, F.lit(_BLANKS))


def clean_name(c: Column) -> Column:
    """Metric name from a free-text value: blanks to ``_``, ``()/*`` dropped, lower case."""
    return F.lower(F.translate(c, " ()/*", "_"))


def mask_dsn(c: Column) -> Column:
    """Hide the credentials in front of the first ``@`` of a connect string."""
    return F.when(F.instr(c, "@") > 0, F.concat(F.lit("***@"), F.split(c, "@").getItem(1))).otherwise(c)


def parse_float(c: Column) -> Column:
    """Float text to double; anything that is not a float in range gives NULL."""
    s = trim_space(c)
    return checked_float(s, s.try_cast("double"))


def checked_float(s: Column, number: Column) -> Column:
    """``number``, the cast of the trimmed text ``s``, unless the text is no float.

    The cast also takes a ``d`` or ``f`` suffix, a signed NaN, and a number out of
    range as infinite.
    """
    return (
        F.when(F.abs(number) == F.lit(float("inf")), F.when(F.lower(s).contains("n"), number))
        .when(F.isnan(number), F.when(F.lower(s) == "nan", number))
        .when(~F.lower(F.right(s, F.lit(1))).isin("d", "f"), number)
    )


def parse_metric_value(c: Column) -> Column:
    """Result value of a user metric: a NULL of the source counts as 0."""
    return F.when(c == NIL, F.lit(0.0)).otherwise(parse_float(c))


def metric_id(context: Column, names: Column) -> Column:
    """``context`` and the sorted lower-case metric names joined by ``_``."""
    lowered = F.array_sort(F.array_distinct(F.transform(names, F.lower)))
    return F.array_join(F.concat(F.array(context), lowered), "_")


def parse_duration(c: Column) -> Column:
    """Duration text such as ``1m30s`` to seconds; invalid text gives NULL."""
    body = F.regexp_replace(c, r"^[+-]", "")
    sign = F.when(c.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    part = r"([0-9]+\.?[0-9]*|\.[0-9]+)(ns|us|µs|μs|ms|s|m|h)"
    numbers = F.regexp_extract_all(body, F.lit(part), F.lit(1))
    units = F.regexp_extract_all(body, F.lit(part), F.lit(2))
    factors = F.create_map(*[F.lit(x) for kv in DURATION_UNITS.items() for x in kv])
    terms = F.zip_with(numbers, units, lambda n, u: n.try_cast("double") * factors[u])
    total = F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(body.rlike(f"^({part})+$"), sign * total).when(body == "0", F.lit(0.0))


def parse_lag_interval(c: Column) -> Column:
    """``+DD HH:MI:SS.f`` or plain seconds to signed seconds; NULL for unknown or invalid text."""
    s = trim_space(c)
    sign = F.left(s, F.lit(1))
    days_and_clock = F.split(F.when(sign.isin("+", "-"), F.substring(s, 2, 2**31 - 1)).otherwise(s), " ")
    clock = F.split(F.get(days_and_clock, F.lit(1)), ":")
    seconds_and_fraction = F.split(F.get(clock, F.lit(2)), r"\.")
    whole = [F.get(days_and_clock, F.lit(0)), F.get(clock, F.lit(0)), F.get(clock, F.lit(1)), F.get(seconds_and_fraction, F.lit(0))]
    fraction = F.coalesce(F.get(seconds_and_fraction, F.lit(1)), F.lit("0"))
    digits = F.concat(*whole, fraction).rlike("^[0-9]+$") & (F.length(whole[0]) > 0) & (F.length(fraction) > 0)
    two_each = (F.length(whole[1]) == 2) & (F.length(whole[2]) == 2) & (F.length(whole[3]) == 2)
    counts = (F.size(days_and_clock) == 2) & (F.size(clock) == 3) & (F.size(seconds_and_fraction) <= 2)
    days, hours, minutes = (w.try_cast("double") for w in whole[:3])
    total = days * 86400 + hours * 3600 + minutes * 60 + F.get(clock, F.lit(2)).try_cast("double")
    signed = F.when(sign == "-", -total).otherwise(total)
    return F.when(lag_interval_unknown(c), F.lit(None).cast("double")).when(
        F.coalesce(counts & digits & two_each, F.lit(False)), signed
    ).otherwise(parse_float(s))


def lag_interval_unknown(c: Column) -> Column:
    """True for the texts that legitimately carry no interval."""
    s = trim_space(c)
    return c.isNull() | (s == "") | (F.upper(s) == "UNKNOWN")


def lag_interval_invalid(c: Column) -> Column:
    """True for text that is neither an interval, a float nor unknown."""
    return ~lag_interval_unknown(c) & parse_lag_interval(c).isNull()


def parse_lag_timestamp(c: Column) -> Column:
    """``MM/DD/YYYY HH:MM:SS`` or ISO date and time, fractions allowed; else NULL."""
    s = trim_space(c)
    return F.coalesce(
        F.try_to_timestamp(s, F.lit("MM/dd/yyyy H:mm:ss[.SSSSSSSSS]")),
        F.try_to_timestamp(s, F.lit("yyyy-MM-dd H:mm:ss[.SSSSSSSSS]")),
    )


def day_start_utc(c: Column) -> Column:
    """Midnight of the UTC day (sessions run in UTC)."""
    return F.date_trunc("day", c)


def partition_day(parent: str, name: Column) -> Column:
    """Day encoded in a partition name ``<parent>_YYYY_MM_DD``; NULL for any other name."""
    digits = F.regexp_extract(name, rf"^\Q{parent}\E_([0-9]{{4}}_[0-9]{{2}}_[0-9]{{2}})$", 1)
    return F.to_date(F.try_to_timestamp(F.nullif(digits, F.lit("")), F.lit("yyyy_MM_dd")))


def retry_backoff(failures: Column) -> Column:
    """Seconds to wait after ``failures`` consecutive failures: 60 doubling up to 900."""
    doublings = F.least(failures.cast("double") - 1, F.lit(4.0))
    wait = F.least(F.lit(900.0), 60.0 * F.pow(F.lit(2.0), doublings))
    return F.when(failures <= 0, F.lit(0.0)).otherwise(wait).cast("long")


def strip_one_newline(c: Column) -> Column:
    """Drop a single trailing line feed."""
    return F.regexp_replace(c, "\n\\z", "")


def null_to_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def seconds_between(later: Column, earlier: Column) -> Column:
    """Exact microsecond difference in seconds."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1_000_000.0)


def age_seconds(as_of: Column, c: Column) -> Column:
    return seconds_between(as_of, c)


def percent(part: Column, whole: Column) -> Column:
    """``part * 100 / whole`` as double, NULL unless ``whole`` is positive."""
    return F.when(whole > 0, part.cast("double") * 100.0 / whole.cast("double"))


def used_percent(used: Column, total: Column) -> Column:
    return percent(used, total)


def ratio_percent(part: Column, whole: Column) -> Column:
    """``part * 100 / nullif(whole, 0)`` as double."""
    return part.cast("double") * 100.0 / F.nullif(whole.cast("double"), F.lit(0.0))


def round_half_up(c: Column, digits: int) -> Column:
    """Round the decimal reading of a double, so that 0.0145 held as 0.01449… becomes 0.015."""
    return F.round(c.cast("decimal(38,12)"), digits).cast("double")


def labels_json(labels: Column) -> Column:
    """Label map as a JSON object with its keys in order."""
    return F.to_json(F.map_from_entries(F.sort_array(F.map_entries(labels))))


def parse_labels(text: Column) -> Column:
    return F.from_json(text, T.MapType(T.StringType(), T.StringType()))


def edition(product: Column) -> Column:
    """Edition of a product text; the first marker found wins."""
    upper = F.upper(product)
    (first_marker, first_name), *rest = EDITIONS
    expr = F.when(upper.contains(first_marker), first_name)
    return reduce(lambda e, kv: e.when(upper.contains(kv[0]), kv[1]), rest, expr)


def is_connection_failure(message: Column, kind: Column | None = None) -> Column:
    """True when an error means the connection was lost, not that the query failed."""
    pattern = "|".join(CONNECTION_FAILURE_MARKERS)
    hit = F.coalesce(F.upper(message).rlike(pattern), F.lit(False))
    if kind is None:
        return hit
    return hit | F.coalesce(kind.isin(CONNECTION_FAILURE_KINDS), F.lit(False))


def cut(c: Column, length: int) -> Column:
    """First ``length`` characters of a message."""
    return F.substring(c, 1, length)
