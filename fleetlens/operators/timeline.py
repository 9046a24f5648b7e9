"""Series helpers that stay balanced when one series holds most of the rows.

A window over the bare series key would put a whole series into one task.  Every series is cut
into fixed time slots instead: the window runs per (series, slot), and only one summary row per
slot crosses slot borders.  The summary enters the next slot as a carry row, so nothing has to be
joined back and NULL keys group as usual.  Rows without a time form a slot of their own before
all others, as they sort first in a window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3600.0
SLOT, CARRY = "_slot", "_carry"


def slot_start(ts: Column, slot_seconds: float) -> Column:
    """Start of the time slot in epoch microseconds."""
    micros = F.unix_micros(ts)
    return micros - F.pmod(micros, F.lit(int(slot_seconds * 1_000_000)))


def newest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The row with the highest ``order`` of every key, combined before the shuffle."""
    return _pick(df, keys, order, F.max_by)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The row with the lowest ``order`` of every key, combined before the shuffle."""
    return _pick(df, keys, order, F.min_by)


def _pick(df, keys, order, chooser) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    chosen = df.groupBy(*keys).agg(
        chooser(F.struct(*rest) if rest else F.struct(F.lit(1)), F.struct(*order)).alias("_row")
    )
    return chosen.select(*[F.col(c) if c in keys else F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def place(ts: str, seq: str | None, slot: str = SLOT) -> Column:
    """Place of a row within its slot as one number that is never NULL, so that finding a slot's
    last row is a hash aggregate.  NULL sorts before every time and every arrival number."""
    offset = F.coalesce(F.unix_micros(ts) - F.col(slot), F.lit(0))
    if seq is None:
        return offset
    arrival = F.coalesce(F.col(seq).cast("decimal(20,0)") + F.lit(str(2**63 + 1)).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return offset.cast("decimal(17,0)") * F.lit(str(10**20)).cast("decimal(21,0)") + arrival


def previous_values(df: DataFrame, keys: Sequence[str], ts: str, values: Sequence[str],
                    seq: str | None = None, slot_seconds: float = HOUR) -> DataFrame:
    """Add ``prev_<value>`` columns from the preceding row of the series by (ts, seq)."""
    order = [ts] + ([seq] if seq else [])
    needed = list(dict.fromkeys([ts, *values]))
    slotted = df.withColumn(SLOT, slot_start(F.col(ts), slot_seconds))
    last = place(ts, seq)
    tails = slotted.groupBy(*keys, SLOT).agg(*[F.max_by(c, last).alias(c) for c in needed])
    # The last row of a slot is repeated as a plain row of the next one, where it sorts first.
    history = Window.partitionBy(*keys).orderBy(SLOT)
    carried = (
        tails.select(*keys, SLOT, *[F.lag(c).over(history).alias(c) for c in needed], F.lag(F.lit(True)).over(history).alias(CARRY))
        .where(F.col(CARRY))
    )
    both = slotted.withColumn(CARRY, F.lit(False)).unionByName(carried, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, SLOT).orderBy(*order)
    return (
        both.withColumns({f"prev_{v}": F.lag(v).over(inside) for v in values})
        .where(~F.col(CARRY))
        .select(*df.columns, *[f"prev_{v}" for v in values])
    )


def running_total(df: DataFrame, keys: Sequence[str], ts: str, increment: Column, name: str,
                  seq: str | None = None, slot_seconds: float = HOUR) -> DataFrame:
    """Add ``name``: the sum of ``increment`` over the series up to and including the row."""
    order = [ts] + ([seq] if seq else [])
    slotted = df.withColumn("_inc", increment).withColumn(SLOT, slot_start(F.col(ts), slot_seconds))
    sums = slotted.groupBy(*keys, SLOT).agg(F.sum("_inc").alias("_inc"))
    before = Window.partitionBy(*keys).orderBy(SLOT).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        sums.withColumn("_inc", F.sum("_inc").over(before))
        .where(F.col("_inc").isNotNull())
        .withColumn(CARRY, F.lit(True))
    )
    both = slotted.withColumn(CARRY, F.lit(False)).unionByName(carried, allowMissingColumns=True)
    inside = (
        Window.partitionBy(*keys, SLOT)
        .orderBy(F.col(CARRY).desc(), *order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return both.withColumn(name, F.sum("_inc").over(inside)).where(~F.col(CARRY)).select(*df.columns, name)


def upcoming(times: DataFrame, marks: DataFrame, keys: Sequence[str], ts: str, name: str,
             slot_seconds: float = HOUR) -> DataFrame:
    """As-of join: add ``name``, the time of the first mark of the series at or after the row.

    Marks have ``keys`` and ``ts``.  Rows that no mark follows, or without a time, are left out.  The first
    mark of a slot is handed to the occupied slots before it.
    """
    slotted = lambda df: df.where(F.col(ts).isNotNull()).withColumn(SLOT, slot_start(F.col(ts), slot_seconds))
    marked = slotted(marks.select(*keys, ts).distinct()).withColumn(name, F.col(ts))
    rows = slotted(times).withColumns({name: F.lit(None).cast("timestamp"), CARRY: F.lit(0)})
    ends = marked.groupBy(*keys, SLOT).agg(F.min(ts).alias(name)).unionByName(rows.select(*keys, SLOT, name).distinct())
    later = Window.partitionBy(*keys).orderBy(SLOT).rowsBetween(1, Window.unboundedFollowing)
    carried = (ends.groupBy(*keys, SLOT).agg(F.min(name).alias(name))
               .withColumn(name, F.first(name, ignorenulls=True).over(later)).where(F.col(name).isNotNull()))
    both = rows.unionByName(marked.withColumn(CARRY, F.lit(1)), allowMissingColumns=True).unionByName(
        carried.withColumn(CARRY, F.lit(2)), allowMissingColumns=True)
    ahead = (Window.partitionBy(*keys, SLOT).orderBy(F.col(CARRY) == 2, ts, CARRY)
             .rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return (both.withColumn(name, F.first(name, ignorenulls=True).over(ahead))
            .where((F.col(CARRY) == 0) & F.col(name).isNotNull()).select(*times.columns, name))


def since_reset(df: DataFrame, keys: Sequence[str], ts: str, reset: Column,
                seq: str | None = None) -> DataFrame:
    """Rows of every series that come after its last ``reset`` row (all rows if it has none)."""
    position = F.struct(*([ts] + ([seq] if seq else [])))
    resets = df.where(reset).groupBy(*keys).agg(F.max(position).alias("_reset"))
    return (
        df.where(~reset)
        .join(resets, list(keys), "left")
        .where(F.col("_reset").isNull() | (position > F.col("_reset")))
        .select(*df.columns)
    )


#: Entry of a slot that no kept tick precedes.
NO_TICK = -(2**62)
#: Slots whose functions are composed in one task; one composed function enters the chain of a key.
FAN = 1024


def thin(df: DataFrame, keys: Sequence[str], ts: str, interval: float, strict: bool = False,
         slot_seconds: float | None = None) -> DataFrame:
    """Ticks kept by minimum spacing: the first tick of a key, then every tick that comes
    at least ``interval`` seconds (``strict``: more than that) after the last kept one.

    The rule is greedy, but one slot is enough to know how a last-kept time that
    enters it leaves it.  Slots are solved side by side, their functions are
    composed and chained (:func:`chained`), and every slot is replayed from
    its entry time.  Only distinct ticks take part.
    """
    gap, slot = spacing(interval, strict), max(slot_seconds or interval * 512, interval, 1.0)
    slots = gathered(ticks_of(df, keys, ts, slot), keys)
    entries = chained(slot_functions(slots, keys, gap), keys, gap, slot).drop("_leave")
    return replayed(slots, entries, keys, gap).select(*keys, F.timestamp_micros("_tick").alias(ts))


def spacing(interval: float, strict: bool) -> int:
    """Least distance of kept ticks in microseconds."""
    return int(interval * 1_000_000) + (1 if strict else 0)


def ticks_of(df: DataFrame, keys: Sequence[str], ts: str, slot_seconds: float) -> DataFrame:
    """Ticks in microseconds with their slots."""
    rows = df.where(F.col(ts).isNotNull())
    return rows.select(*keys, F.unix_micros(ts).alias("_tick"), slot_start(F.col(ts), slot_seconds).alias(SLOT))


def gathered(ticks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The distinct ticks of every slot in one row (``_ticks``), so that neither keys nor repeats travel with each tick."""
    return ticks.groupBy(*keys, SLOT).agg(F.collect_set("_tick").alias("_ticks"))


def _fields(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)


def slot_functions(slots: DataFrame, keys: Sequence[str], gap: int) -> DataFrame:
    """Per slot, whose ticks are gathered in one row or several: the ticks at which its kept ticks can start, and the last kept tick of each (``_starts``, ``_exits``)."""
    keys = list(keys)

    def slot_function(pdf):
        import numpy as np
        import pandas as pd

        t = np.unique(np.concatenate(pdf["_ticks"].to_list()))
        following = np.searchsorted(t, t + gap)
        leave = np.where(following < len(t), following, np.arange(len(t)))
        while True:
            further = leave[leave]
            if (further == leave).all():
                break
            leave = further
        # Starts can only lie within one gap of the slot's first tick, or be the
        # first tick after it; runs of starts with one exit are stored once.
        reach = min(int(np.searchsorted(t, t[0] + gap)) + 1, len(t))
        exits = t[leave[:reach]]
        ends = np.flatnonzero(np.append(exits[1:] != exits[:-1], True))
        row = pdf.iloc[:1][keys + ["_slot"]].copy()
        row["_starts"] = pd.Series([t[ends].tolist()], index=row.index)
        row["_exits"] = pd.Series([exits[ends].tolist()], index=row.index)
        return row

    return slots.groupBy(*keys, SLOT).applyInPandas(slot_function, f"{_fields(slots, keys)}, _slot long, _starts array<long>, _exits array<long>")


def left(starts, exits, kept: int, gap: int) -> int:
    """Last kept tick behind a slot, or a run of slots, that is entered with ``kept``."""
    import numpy as np

    at = int(np.searchsorted(np.asarray(starts), kept + gap))
    return int(exits[at]) if at < len(exits) else kept


def composed(functions, gap: int) -> tuple[list[int], list[int]]:
    """One function for a run of slots, given in order as (starts, exits)."""
    starts: list[int] = []
    exits: list[int] = []
    for s, e in functions:
        exits = [left(s, e, x, gap) for x in exits]
        behind = [i for i, x in enumerate(s) if not starts or x > starts[-1]]
        starts, exits = starts + [int(s[i]) for i in behind], exits + [int(e[i]) for i in behind]
        # what enters lies before the run, so no start beyond the first that is a gap after its first tick is ever used
        far = next((i for i, x in enumerate(starts) if x >= starts[0] + gap), len(starts))
        starts, exits = starts[:far + 1], exits[:far + 1]
    last = [i for i in range(len(exits)) if i + 1 == len(exits) or exits[i + 1] != exits[i]]
    return [starts[i] for i in last], [exits[i] for i in last]


def chained(functions: DataFrame, keys: Sequence[str], gap: int, slot_seconds: float, starts: DataFrame | None = None) -> DataFrame:
    """``_entry`` and ``_leave`` of every slot: the last kept tick before and behind it.

    The functions of FAN slots at a time are composed, side by side; a key chains the composed ones
    only, and each run of slots is then passed through from its entry.  ``starts`` (keys, ``_start``) gives
    the last kept tick of keys that do not begin with their first slot.
    """
    keys, span = list(keys), int(slot_seconds * 1_000_000) * FAN
    fields = _fields(functions, keys)
    grouped = functions.withColumn("_run", F.col(SLOT) - F.pmod(F.col(SLOT), F.lit(span)))

    def compose(pdf):
        import pandas as pd

        pdf = pdf.sort_values("_slot")
        made = composed(zip(pdf["_starts"], pdf["_exits"]), gap)
        row = pdf.iloc[:1][keys + ["_run"]].copy()
        row["_starts"], row["_exits"] = (pd.Series([x], index=row.index) for x in made)
        return row

    def over_runs(pdf):
        import pandas as pd

        given = [s[0] for s in pdf["_start"] if s is not None]
        kept, entries = max(given, default=NO_TICK), []
        pdf = pdf[pdf["_start"].isna()].sort_values("_run")
        for s, e in zip(pdf["_starts"], pdf["_exits"]):
            entries.append([kept])
            kept = left(s, e, kept, gap)
        out = pdf[keys + ["_run"]].copy()
        out["_at"] = pd.Series(entries, index=out.index, dtype=object)
        return out

    def within(pdf):
        import numpy as np

        kept = int(next(a[0] for a in pdf["_at"] if a is not None))
        pdf = pdf[pdf["_at"].isna()].sort_values("_slot")
        passed = [kept]
        for s, e in zip(pdf["_starts"], pdf["_exits"]):
            passed.append(left(s, e, passed[-1], gap))
        out = pdf[keys].copy()
        # beside the entry row, which has no slot, numbers came as floats
        out["_slot"] = np.array([int(s[0]) for s in pdf["_slots"]], dtype="int64")
        out["_entry"], out["_leave"] = np.array(passed[:-1], dtype="int64"), np.array(passed[1:], dtype="int64")
        return out

    functions_of = "_starts array<long>, _exits array<long>"
    runs = grouped.groupBy(*keys, "_run").applyInPandas(compose, f"{fields}, _run long, {functions_of}").withColumn("_start", F.lit(None).cast("array<long>"))
    if starts is not None:
        given = starts.select(*keys, F.lit(0).cast("long").alias("_run"), F.lit(None).cast("array<long>").alias("_starts"), F.lit(None).cast("array<long>").alias("_exits"),
                              F.array("_start").alias("_start"))
        runs = runs.unionByName(given)
    entries = runs.groupBy(*keys).applyInPandas(over_runs, f"{fields}, _run long, _at array<long>")
    both = grouped.withColumn("_slots", F.array(SLOT)).unionByName(entries, allowMissingColumns=True)
    return both.groupBy(*keys, "_run").applyInPandas(within, f"{fields}, _slot long, _entry long, _leave long")


def replayed(slots: DataFrame, entries: DataFrame, keys: Sequence[str], gap: int) -> DataFrame:
    """Kept ticks of every slot (``_slot``, ``_tick``) from its gathered ticks and its ``_entry``."""
    keys = list(keys)

    def replay(pdf):
        import numpy as np
        import pandas as pd

        t = np.unique(np.concatenate([x for x in pdf["_ticks"] if x is not None]))
        at = int(np.searchsorted(t, int(pdf["_entry"].max()) + gap))
        kept = []
        while at < len(t):
            kept.append(t[at])
            at = int(np.searchsorted(t, t[at] + gap))
        # typed as objects, so that a slot without kept ticks does not hand back numbers for text
        out = pd.DataFrame({k: pd.Series([pdf[k].iloc[0]] * len(kept), dtype=object) for k in keys})
        out["_slot"] = np.full(len(kept), pdf["_slot"].iloc[0], dtype="int64")
        out["_tick"] = np.array(kept, dtype="int64")
        return out

    replayable = slots.unionByName(entries, allowMissingColumns=True)
    return replayable.groupBy(*keys, SLOT).applyInPandas(replay, f"{_fields(slots, keys)}, _slot long, _tick long")
