"""Repair of conversation structure: the cheapest edits after which a conversation's roles fit its grammar.

The grammar of role initials is ``(s?(ua)+)?``, an automaton of four states.  A conversation's rows
are kept (0), re-roled to user or assistant (3) or deleted (4, the only way for blank and repeated
rows); empty user and assistant turns can be inserted anywhere (3); a truncated row that is not
deleted adds 3.  Of equally cheap edit sequences the one whose initials are least in ASCII wins.

The search is a Viterbi recursion on vectors of costs still to come, one number a state, run
backwards over chunks of a conversation side by side.  Every chunk but the last starts from a
speculative vector, that of a conversation's end.  Vectors that differ only by a constant lead to
the same choices, and after a few rows most chunks reach the same vector, up to a constant,
whatever they started from: so a fix-up pass reruns a chunk from its successor's true vector only until it meets the stored
one.  Passes repeat until every chunk's last vector is its successor's first.  Chunks that never
converge (say, long runs of rows to be deleted) are settled after ``passes`` of them by min-plus
products of the chunks' cost matrices, composed by doubling.  The stitched vectors then drive the
trace: each chunk is traced from all four states, the four-way maps are composed by doubling, and
every chunk is traced once more from the state that the conversation reaches it in.

Cases: rows of equal turn are ordered by role, then text, null turns come first; null roles and
texts are empty; repeated rows are duplicates; a role that begins with neither s, u nor a, or is
empty, fits nowhere and is re-roled or deleted; null conv_ids are one conversation; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import stored
from fleetlens.operators.numbering import numbered

#: Distinct rows of a conversation in one chunk.
CHUNK_ROWS = 8_192
#: Fix-up passes before the rest is settled by matrices.
PASSES = 4
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
ENDED = ".!?"
#: White space that makes no text.
BLANK = " \t\n\x0b\x0c\r"
ROLES = ("user", "assistant")

#: Automaton: next state after an initial s, u, a; None where it does not fit.  States: begin, after s, after u, after a.
NEXT = ((1, 2, None), (None, 2, None), (None, None, 3), (None, 2, None))
#: The one role that can be inserted, or given to a row, in each state, and the state after it.
GIVEN = ((0, 2), (0, 2), (1, 3), (0, 2))
ACCEPTED = (0, 3)
NEVER = 1 << 40

#: A row's code: class of its initial (s 0, u 1, a 2, other 3), +4 if truncated, +8 if it must be deleted.
OTHER, CUT_SHORT, FORCED = 3, 4, 8


def normal(costs: list[int]) -> bytes:
    """A vector up to a constant."""
    least = min(costs)
    return bytes(c - least for c in costs)


def with_inserts(costs: list[int]) -> list[int]:
    """The vector once turns may be inserted first; two inserts lead from any state to any that can be reached."""
    for _ in range(2):
        costs = [min(c, INSERT + costs[GIVEN[s][1]]) for s, c in enumerate(costs)]
    return costs


#: Costs at the end of a conversation, by state.
END = normal(with_inserts([0 if s in ACCEPTED else NEVER for s in range(4)]))


def options(code: int, s: int) -> list[tuple[str, int, int | None, int]]:
    """Ways to use up a row in state ``s``: initial, cost, role given to the row, next state; in ASCII order."""
    out: list[tuple[str, int, int | None, int]] = [("D", DELETE, None, s)]
    if code < FORCED:
        extra = TRUNCATED if code & CUT_SHORT else 0
        kind = code & 3
        if kind != OTHER and NEXT[s][kind] is not None:
            out.append(("K", KEEP + extra, None, NEXT[s][kind]))
        out.append(("R", REROLE + extra, *GIVEN[s]))
    return out


@lru_cache(maxsize=None)
def before(code: int, after: bytes) -> bytes:
    """Vector before a row, from that after it."""
    return normal(with_inserts([min(cost + after[to] for _, cost, _, to in options(code, s)) for s in range(4)]))


@lru_cache(maxsize=None)
def choices(code: int | None, after: bytes, s: int) -> tuple[str, tuple[int | None, ...], int]:
    """Least edits up to and including a row (None: the end): initials, roles of what is inserted and given, next state."""
    edits, roles = "", []
    costs = list(after) if code is None else with_inserts([min(cost + after[to] for _, cost, _, to in options(code, q)) for q in range(4)])
    while True:
        if code is None and s in ACCEPTED:
            return edits, tuple(roles), s
        fitting = [o for o in options(code, s) if o[1] + after[o[3]] == costs[s]] if code is not None else []
        role, to = GIVEN[s]
        if INSERT + costs[to] == costs[s] and (not fitting or fitting[0][0] > "I"):
            edits, s = edits + "I", to
            roles.append(role)
            continue
        letter, _, role, to = fitting[0]
        return edits + letter, (*roles, role), to


def vectors(codes: bytes, end: bytes, known: bytes | None = None) -> bytes:
    """Vectors before each row and at the end, four bytes each; stops where it meets those ``known`` from another end."""
    at, out = end, [end]
    for i in range(len(codes) - 1, -1, -1):
        at = before(codes[i], at)
        if known is not None and known[4 * i:4 * i + 4] == at:
            return known[:4 * i] + b"".join([at, *reversed(out)])
        out.append(at)
    return b"".join(reversed(out))


def end_states(codes: bytes, vecs: bytes) -> list[int]:
    """State behind the last row, from each state before the first."""
    states = [0, 1, 2, 3]
    for i, code in enumerate(codes):
        after = vecs[4 * i + 4:4 * i + 8]
        states = [choices(code, after, s)[2] for s in states]
    return states


def matrix(codes: bytes) -> list[int]:
    """Least cost from each state before the rows to each behind them, inserts behind the last row left out."""
    rows = []
    for to in range(4):
        costs = [0 if s == to else NEVER for s in range(4)]
        for code in reversed(codes):
            costs = with_inserts([min(cost + costs[q] for _, cost, _, q in options(code, s)) for s in range(4)])
        rows.append(costs)
    return [min(rows[to][s], NEVER) for s in range(4) for to in range(4)]


def faulty(turns: DataFrame, partitions: int | None = None) -> DataFrame:
    """Distinct rows with their place ``ordinal`` in the conversation, the number of ``copies``, and ``fault`` of the first.

    ``fault`` is ``blank``, ``duplicate`` (role and text seen earlier), ``truncated`` or null; further
    copies are blank or duplicate.
    """
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    distinct = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    placed = numbered(distinct, ["turn", "role", "text"], ["conv_id"], partitions=partitions)
    digest = F.sha2("text", 256)
    first = placed.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), digest.alias("d")).agg(F.min("ordinal").alias("seen"))
    at = placed.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (digest == F.col("d"))).drop("c", "r", "d")
    trimmed = F.rtrim(F.col("text"), F.lit(BLANK))
    fault = (F.when(trimmed == "", "blank").when(F.col("seen") < F.col("ordinal"), "duplicate")
             .when(~F.substring(trimmed, -1, 1).isin(*ENDED), "truncated"))
    return at.withColumn("fault", fault).drop("seen")


def chunked(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """One row per chunk of a conversation: codes, ordinals' first, copies, whether it is the last, its neighbour's initial."""
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER)
    code = (kind + F.when(F.col("fault") == "truncated", CUT_SHORT).when(F.col("fault").isNotNull(), FORCED).otherwise(0)).cast("byte")
    listed = rows.select("conv_id", F.expr(f"(ordinal - 1) div {chunk_rows}").alias("chunk"), "ordinal", code.alias("code"), "copies")
    made = listed.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("ordinal", "code", "copies"))).alias("r"))
    order = Window.partitionBy("conv_id").orderBy("chunk")  # one small row per chunk
    slim = made.select("conv_id", "chunk", F.col("r.code").cast("array<int>").alias("codes"), F.col("r.copies").alias("copies"))
    ends = slim.select("conv_id", "chunk", (F.element_at("codes", -1) % 4).alias("final"))
    known = ends.select(F.col("conv_id").alias("c"), F.col("chunk").alias("k"), F.lag("final").over(order).alias("previous"),
                        F.lead("chunk").over(order).isNull().alias("last"), F.count("*").over(Window.partitionBy("conv_id")).alias("chunks"))
    return slim.join(known, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k"))).drop("c", "k")


def neighbour(chunks: DataFrame, other: DataFrame, step: int, columns: list[str]) -> DataFrame:
    """``chunks`` with ``columns`` of the chunk ``step`` further on in its conversation, under names that begin with ``of_``."""
    right = other.select(F.col("conv_id").alias("c"), (F.col("chunk") - step).alias("k"), *[F.col(x).alias(f"of_{x}") for x in columns])
    return chunks.join(right, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k")), "left").drop("c", "k")


def composed(maps: DataFrame, value: str, compose: Callable[[Column, Column], Column], step: int) -> DataFrame:
    """Replaces ``value`` of every chunk by its composition with those of all chunks in direction ``step``, by doubling."""
    reach, far = 1, maps.agg(F.max("chunk")).first()[0] or 0
    while reach <= far:
        both = neighbour(maps, maps, step * reach, [value])
        maps = stored(both.withColumn(value, F.when(F.col(f"of_{value}").isNull(), F.col(value)).otherwise(compose(F.col(value), F.col(f"of_{value}")))).drop(f"of_{value}"), "composed")
        reach *= 2
    return maps


def packed(codes: np.ndarray) -> bytes:
    return np.asarray(codes, np.uint8).tobytes()


@F.pandas_udf(T.BinaryType())
def first_vectors(codes: pd.Series) -> pd.Series:
    return pd.Series([vectors(packed(c), END) for c in codes], dtype=object)


@F.pandas_udf(T.BinaryType())
def rerun(codes: pd.Series, end: pd.Series, known: pd.Series) -> pd.Series:
    return pd.Series([vectors(packed(c), bytes(e), bytes(k)) for c, e, k in zip(codes, end, known)], dtype=object)


@F.pandas_udf(T.ArrayType(T.LongType()))
def matrices(codes: pd.Series) -> pd.Series:
    return pd.Series([matrix(packed(c)) for c in codes], dtype=object)


@F.pandas_udf(T.ArrayType(T.LongType()))
def product(first: pd.Series, then: pd.Series) -> pd.Series:
    out = []
    for a, b in zip(first, then):
        if a is None or b is None:
            out.append(None)
            continue
        x, y = np.reshape(a, (4, 4)), np.reshape(b, (4, 4))
        out.append(np.minimum((x[:, :, None] + y[None, :, :]).min(axis=1), NEVER).ravel().tolist())
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.BinaryType())
def costs_to_end(m: pd.Series) -> pd.Series:
    """Vector before the chunks that a matrix covers up to a conversation's end."""
    final = np.frombuffer(END, np.uint8).astype(np.int64)
    return pd.Series([None if x is None else normal(with_inserts((np.reshape(x, (4, 4)) + final).min(axis=1).tolist())) for x in m], dtype=object)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def states_after(codes: pd.Series, vecs: pd.Series) -> pd.Series:
    return pd.Series([end_states(packed(c), bytes(v)) for c, v in zip(codes, vecs)], dtype=object)


def head(vecs: str) -> Column:
    return F.substring(vecs, 1, 4)


def tail(vecs: str) -> Column:
    return F.substring(vecs, -4, 4)


def stitched(chunks: DataFrame, passes: int = PASSES) -> DataFrame:
    """Chunks with their true cost vectors ``vecs``."""
    state = stored(chunks.withColumn("vecs", first_vectors("codes")), "vectors")
    single, many = state.where("chunks = 1"), state.where("chunks > 1")
    if many.isEmpty():
        return state
    starts = lambda df: df.withColumn("v", head("vecs")).select("conv_id", "chunk", "v")
    for _ in range(passes):
        both = neighbour(many, starts(many), 1, ["v"])
        wrong = ~F.col("last") & (tail("vecs") != F.col("of_v"))
        if both.where(wrong).isEmpty():
            return single.unionByName(many)
        many = stored(both.withColumn("vecs", F.when(wrong, rerun("codes", F.coalesce("of_v", tail("vecs")), "vecs")).otherwise(F.col("vecs"))).drop("of_v"), "vectors")
    whole = composed(stored(many.select("conv_id", "chunk", matrices("codes").alias("m")), "matrices"), "m", product, 1)
    both = neighbour(many, whole.withColumn("v", costs_to_end("m")), 1, ["v"])
    return single.unionByName(stored(both.withColumn("vecs", rerun("codes", F.coalesce("of_v", tail("vecs")), "vecs")).drop("of_v"), "vectors"))


def entered(chunks: DataFrame) -> DataFrame:
    """Chunks with ``state``, in which their conversation reaches them."""
    single, many = chunks.where("chunks = 1").withColumn("state", F.lit(0)), chunks.where("chunks > 1")
    if many.isEmpty():
        return single
    maps = stored(many.select("conv_id", "chunk", states_after("codes", "vecs").alias("m")), "maps")
    # the state behind a chunk is its own map applied to what those before it lead to
    through = composed(maps, "m", lambda own, earlier: F.transform(earlier, lambda s: F.element_at(own, s + 1)), -1)
    reached = neighbour(many, through.select("conv_id", "chunk", F.col("m")[0].alias("s")), -1, ["s"])
    return single.unionByName(reached.withColumn("state", F.coalesce("of_s", F.lit(0))).drop("of_s"))


TRACED = "conv_id bigint, chunk bigint, edits array<string>, roles array<array<int>>, audit string, cost bigint, illegal bigint"


def traced(chunks: DataFrame) -> DataFrame:
    """Per chunk: least edits and given roles of every distinct row, their initials joined, cost, and the number of illegal neighbours."""
    legal = {(0, 1), (1, 2), (2, 1)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for conv, chunk, codes, copies, vecs, state, last, previous in zip(*(batch[c] for c in ("conv_id", "chunk", "codes", "copies", "vecs", "state", "last", "previous"))):
                edits, roles, s, cost, illegal = [], [], int(state), 0, 0
                before_it = None if pd.isna(previous) else int(previous)
                for i, (code, n) in enumerate(zip(codes, copies)):
                    code, n = int(code), int(n)
                    e, r, s = choices(code, bytes(vecs[4 * i + 4:4 * i + 8]), s)
                    if code & CUT_SHORT:
                        cost += TRUNCATED * (e[-1] != "D")
                    illegal += (before_it is not None and (before_it, code & 3) not in legal) + n - 1
                    before_it = code & 3
                    edits.append(e + "D" * (n - 1))
                    roles.append([-1 if x is None else x for x in r])
                if last:
                    e, r, s = choices(None, bytes(vecs[-4:]), s)
                    edits.append(e)
                    roles.append(list(r))
                audit = "".join(edits)
                cost += INSERT * audit.count("I") + DELETE * audit.count("D") + REROLE * audit.count("R")
                out.append((conv, chunk, edits, roles, audit, cost, illegal))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in TRACED.split(", ")]).astype({"conv_id": "Int64"})

    return chunks.mapInPandas(run, TRACED)


class Repair:
    """Repair of all conversations of ``turns`` (conv_id, turn, role, text).

    ``rows`` holds the distinct rows with their faults, ``chunks`` the traced chunks.
    """

    def __init__(self, turns: DataFrame, chunk_rows: int = CHUNK_ROWS, passes: int = PASSES, partitions: int | None = None):
        self.chunk_rows = chunk_rows
        self.rows = stored(faulty(turns, partitions), "rows")
        self.chunks = stored(traced(entered(stitched(stored(chunked(self.rows, chunk_rows), "chunks"), passes))), "traced")

    def edits(self) -> DataFrame:
        """One row per edit: ``conv_id``, ``place`` (ordinal of the row, that behind the last for inserts at the end), ``part``, ``edit``, ``role``, ``text``; of further copies, all deleted, none is listed."""
        steps = self.chunks.select("conv_id", "chunk", F.posexplode(F.arrays_zip("edits", "roles")).alias("i", "step"))
        steps = steps.select("conv_id", (F.col("chunk") * self.chunk_rows + F.col("i") + 1).alias("place"),
                             F.col("step.edits").alias("e"), F.posexplode(F.col("step.roles")).alias("part", "given"))
        steps = steps.select(F.col("conv_id").alias("c"), "place", "part", F.expr("substring(e, part + 1, 1)").alias("edit"), "given")
        role = F.when(F.col("given") == 0, ROLES[0]).when(F.col("given") == 1, ROLES[1])
        both = steps.join(self.rows, F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("place") == F.col("ordinal")), "left")
        return both.select(F.col("c").alias("conv_id"), "place", "part", "edit", F.coalesce(role, F.col("role")).alias("role"),
                           F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"))

    def repaired(self) -> DataFrame:
        """The turns of the repaired conversations: ``conv_id``, ``place``, ``part``, ``role``, ``text``, in the order of place and part."""
        return self.edits().where("edit <> 'D'").drop("edit")

    def summary(self) -> DataFrame:
        """Per conversation with rows: gaps, counts of faults and illegal neighbours, cost, audit, SHA-256 of the repaired ``role:text`` lines."""
        counted = self.rows.groupBy("conv_id").agg(
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("bigint").alias("gaps"),
            F.sum(F.when(F.col("fault") == "blank", F.col("copies")).otherwise(0)).alias("blank"),
            F.sum(F.when(F.col("fault") == "blank", 0).when(F.col("fault") == "duplicate", F.col("copies")).otherwise(F.col("copies") - 1)).alias("duplicate"),
            F.sum(F.when(F.col("fault") == "truncated", 1).otherwise(0)).cast("bigint").alias("truncated"))
        audits = self.chunks.groupBy(F.col("conv_id").alias("a")).agg(
            F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"),
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "audit"))), lambda x: x["audit"]), "").alias("audit"))
        hashes = digest(self.repaired()).withColumnRenamed("conv_id", "h")
        both = counted.join(audits, F.col("conv_id").eqNullSafe(F.col("a"))).drop("a")
        return (both.join(hashes, F.col("conv_id").eqNullSafe(F.col("h")), "left").drop("h")
                .withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))))


def digest(repaired: DataFrame) -> DataFrame:
    """SHA-256 of every conversation's newline-joined ``role:text``; rows come in order as a stream, a conversation in bounded memory."""
    schema = "conv_id bigint, repaired_sha256 string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, seen, state = None, False, None
        for batch in batches:
            done = []
            for conv, role, text in zip(batch["conv_id"], batch["role"], batch["text"]):
                conv = None if pd.isna(conv) else int(conv)
                if not seen or conv != now:
                    if seen:
                        done.append((now, state.hexdigest()))
                    now, seen, state = conv, True, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            yield pd.DataFrame(done, columns=["conv_id", "repaired_sha256"]).astype({"conv_id": "Int64"})
        if seen:
            yield pd.DataFrame([(now, state.hexdigest())], columns=["conv_id", "repaired_sha256"]).astype({"conv_id": "Int64"})

    return (repaired.repartition("conv_id").sortWithinPartitions("conv_id", "place", "part")
            .select("conv_id", "role", "text").mapInPandas(run, schema))


def damaged(turns: DataFrame) -> DataFrame:
    """The rows with the faults that repairs are tried on, by CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it the
    user's.  Nulls of any column become one space first, in the text that is hashed as well.
    """
    space = F.lit(" ")
    rows = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
                        F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))).alias("h"))
    way = F.col("h") % 20
    text = F.when(way == 1, "").when(way == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    changed = rows.where(way != 0).select("conv_id", "turn", F.when(way == 4, ROLES[0]).otherwise(F.col("role")).alias("role"), text.alias("text"),
                                          F.explode(F.array_repeat(F.lit(1), F.when(way == 3, 2).otherwise(1))).alias("again"))
    return changed.drop("again")
