"""Prefix trie of conversations, kept as a z-fast trie: compacted nodes in a hash table.

A conversation is a path of turns; every prefix has a fingerprint of 128 bits, made of running sums
of its turns' hashes, so that a conversation of any length is fingerprinted in pieces.  A compacted
node (root, branching, or the end of a conversation) of the depths (p, e] is stored under the
fingerprint of its handle, the prefix whose depth is the 2-fattest number in (p, e], that with most
trailing zeros.  A conversation's exit node is found by fat binary search: probe the 2-fattest
depth of what is left of its own depths; a hit raises the lower bound to that node's extent, a miss
lowers the upper one.  It may end at the node above, where the handle lies beyond the place at which the conversation leaves
the edge; that edge is told by its first turn.  All conversations of a batch search at once, one pair of joins a step, in
about log2(depth) steps.  Then the batch is inserted: only the turns below a conversation's last
fully matched node, and the edges that some conversation leaves midway, are looked at again; places that
branch or end a conversation become nodes.  At last the edges are expanded to one row a turn.

Sums over subtrees take log2(height) rounds of pointer doubling over the compacted nodes.

Cases: copies of a conversation are inserted once and counted; conversations without turns end
at the root; turns of equal number are ordered by role, then text; repeated rows are turns of their
own; null conv_ids are left out; extra columns are ignored; with no conversation there is no node, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import stored
from fleetlens.operators.numbering import numbered

#: Batches of conversations: one in so many, by a hash of the id, has been inserted after each.
BATCHES = (16, 1)
#: Turns whose running sums are taken in one task's window; sums of earlier pieces are carried on.
PIECE_TURNS = 4_096
ROOT = ""
LOW_HALF = 0xFFFFFFFF
EMPTY_HASH = hashlib.sha256().hexdigest()
#: Fixed values of the rebuilt conversations: every GROUP-th gives its first turns, fewer than SHARED, to those behind it.
GROUP, SHARED = 5, 9


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings, and all ids.

    Conversation c takes the first h turns of conversation c - c % 5 (h: CRC-32 of its decimal id modulo 9) in
    place of its own first h.  Returns ``conv_id``, ``depth`` (from 1), ``role``, ``text``; and ``conv_id`` of all, also those without turns.
    """
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = numbered(rows, ["turn", "role", "text"], ["conv_id"], "at")
    sizes = stored(placed.groupBy("conv_id").agg(F.count("*").alias("n")), "sizes")
    base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    plan = sizes.select("conv_id", (F.crc32(F.col("conv_id").cast("string")) % SHARED).alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    plan = plan.join(base, "base", "left").select("conv_id", "h", "base", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken"))
    first = placed.where(F.col("at") < SHARED).select(F.col("conv_id").alias("base"), F.col("at").alias("depth"), "role", "text")
    front = plan.where("taken > 0").join(first, "base").where("depth <= taken").select("conv_id", "depth", "role", "text")
    back = placed.join(plan.select("conv_id", "h", "taken"), "conv_id").where("at > h").select("conv_id", (F.col("taken") + F.col("at") - F.col("h")).alias("depth"), "role", "text")
    return front.unionByName(back), sizes.select("conv_id")


def paths(turns: DataFrame, piece_turns: int = PIECE_TURNS) -> DataFrame:
    """Per turn: ``conv_id``, ``depth``, ``key`` of the prefix that ends there, ``prev`` of the one before, and UTF-8 ``bytes`` of texts, ``upto`` with those before."""
    x, y = F.xxhash64("depth", "role", "text"), F.xxhash64(F.lit("second"), "depth", "role", "text")
    own = {"a": x.bitwiseAND(F.lit(LOW_HALF)), "b": F.shiftrightunsigned(x, 32), "c": y.bitwiseAND(F.lit(LOW_HALF)), "d": F.shiftrightunsigned(y, 32),
           "bytes": F.octet_length("text").cast("bigint")}
    rows = turns.select("conv_id", F.col("depth").cast("bigint").alias("depth"), F.expr(f"(depth - 1) div {piece_turns}").alias("piece"), *[v.alias(k) for k, v in own.items()])
    totals = rows.groupBy("conv_id", "piece").agg(*[F.sum(k).alias(k) for k in own])
    earlier = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("conv_id", "piece", *[F.sum(k).over(earlier).alias(f"before_{k}") for k in own]).where("before_a is not null")
    within = Window.partitionBy("conv_id", "piece").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.select("*", *[F.sum(k).over(within).alias(f"sum_{k}") for k in own]).join(carried, ["conv_id", "piece"], "left")
    upto = {k: F.col(f"sum_{k}") + F.coalesce(f"before_{k}", F.lit(0)) for k in own}
    key = F.md5(F.concat_ws(":", "depth", *[upto[k] for k in "abcd"]).cast("binary"))
    prev = F.md5(F.concat_ws(":", F.col("depth") - 1, *[upto[k] - F.col(k) for k in "abcd"]).cast("binary"))
    return summed.select("conv_id", "depth", key.alias("key"), F.when(F.col("depth") == 1, ROOT).otherwise(prev).alias("prev"), "bytes", upto["bytes"].alias("upto"))


def fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] with most trailing zeros."""
    return high.bitwiseAND(F.call_function("shiftleft", F.lit(-1).cast("bigint"), F.length(F.bin(low.bitwiseXOR(high))) - 1))


def on_path(df: DataFrame, path: DataFrame, rep: str, depth: str, **columns: str) -> DataFrame:
    """``df`` with columns of the prefix of conversation ``rep`` at ``depth``, where there is one."""
    side = path.select(F.col("conv_id").alias("_rep"), F.col("depth").alias("_depth"), *[F.col(c).alias(n) for n, c in columns.items()])
    return df.join(side, (F.col(rep) == F.col("_rep")) & (F.col(depth) == F.col("_depth")), "left").drop("_rep", "_depth")


def expanded(edges: DataFrame, path: DataFrame) -> DataFrame:
    """One row per turn of the edges (``rep``, ``top``, ``depth``), with its ``at``, ``key``, ``prev``, ``bytes``, ``upto``; long edges in pieces."""
    pieces = edges.withColumn("_piece", F.explode(F.sequence(F.expr(f"top div {PIECE_TURNS}"), F.expr(f"(depth - 1) div {PIECE_TURNS}"))))
    first = F.greatest(F.col("top") + 1, F.col("_piece") * PIECE_TURNS + 1)
    each = pieces.withColumn("at", F.explode(F.sequence(first, F.least(F.col("depth"), (F.col("_piece") + 1) * PIECE_TURNS)))).drop("_piece")
    side = path.select(F.col("conv_id").alias("rep"), F.col("depth").alias("at"), F.col("key").alias("at_key"), "prev", "bytes", "upto")
    return each.join(side, ["rep", "at"])


def located(nodes: DataFrame, batch: DataFrame, path: DataFrame) -> DataFrame:
    """Exit nodes: ``rep``, ``length``, ``base`` (depth of the last node matched whole) and ``edge`` (key of the node whose edge is left midway, or null)."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    handles = nodes.select(F.col("handle").alias("_handle"), F.col("key").alias("_key"), F.col("top").alias("_top"), F.col("depth").alias("_extent"))
    none = F.lit(0).cast("bigint")
    state = batch.select("rep", "length", none.alias("low"), F.least("length", F.lit(deepest)).alias("high"),
                         F.lit(None).cast("string").alias("hit"), none.alias("hit_top"), none.alias("extent"))
    for _ in range(int(deepest).bit_length()):
        probed = on_path(state.withColumn("_f", F.when(F.col("low") < F.col("high"), fattest(F.col("low"), F.col("high")))), path, "rep", "_f", _probe="key")
        met = probed.join(handles, F.col("_probe") == F.col("_handle"), "left")
        hit = F.col("_key").isNotNull()
        state = met.select(
            "rep", "length", F.when(hit, F.col("_extent")).otherwise(F.col("low")).alias("low"), F.when(F.col("_f").isNotNull() & ~hit, F.col("_f") - 1).otherwise(F.col("high")).alias("high"),
            F.coalesce("_key", "hit").alias("hit"), F.coalesce("_top", "hit_top").alias("hit_top"), F.coalesce("_extent", "extent").alias("extent"))
    ended = on_path(state, path, "rep", "extent", _there="key")
    whole = F.col("hit").isNull() | F.coalesce(F.col("_there") == F.col("hit"), F.lit(False))
    # a handle may lie beyond the place where the conversation leaves that edge, so the edge is told by its first turn
    based = ended.select("rep", "length", F.when(whole, F.col("extent")).otherwise(F.col("hit_top")).alias("base")).withColumn("_next", F.col("base") + 1)
    entries = nodes.select(F.col("entry").alias("_entry"), F.col("key").alias("edge"))
    return on_path(based, path, "rep", "_next", _first="key").join(entries, F.col("_first") == F.col("_entry"), "left").select("rep", "length", "base", "edge")


def inserted(nodes: DataFrame | None, batch: DataFrame, path: DataFrame) -> DataFrame:
    """The compacted nodes once the conversations of ``batch`` (``rep``, ``length``) are in.

    A node has its ``key``, its edge's depths (``top``, ``depth``], ``rep``, a conversation that it lies on, the
    fingerprint of its ``handle``, and ``entry``, that of the edge's first turn.
    """
    if nodes is None:
        exits = batch.withColumns({"base": F.lit(0).cast("bigint"), "edge": F.lit(None).cast("string")})
    else:
        exits = stored(located(nodes, batch, path), "exits")
    rows = (path.join(exits, path["conv_id"] == exits["rep"]).where("depth > base")
            .select("rep", "depth", "key", "prev", "base", (F.col("depth") == F.col("length")).alias("is_node")))
    if nodes is not None:
        left = exits.where("edge is not null").select(F.col("edge").alias("key")).distinct()
        split = nodes.join(left, "key", "left_semi")
        old = expanded(split.select("rep", "top", "depth", F.col("key").alias("node")), path)
        rows = rows.unionByName(old.select("rep", F.col("at").alias("depth"), F.col("at_key").alias("key"), "prev", F.col("top").alias("base"), (F.col("at_key") == F.col("node")).alias("is_node")))
    rows = stored(rows, "below")
    places = stored(rows.groupBy("key").agg(F.min("prev").alias("prev"), F.min("rep").alias("rep"), F.max("is_node").alias("is_node")), "places")
    forks = places.groupBy(F.col("prev").alias("key")).agg(F.count("*").alias("ways")).where("ways > 1").withColumn("fork", F.lit(True)).drop("ways")
    kept = places.join(forks, "key", "left").where("is_node or fork").select("key", F.col("rep").alias("chosen"))
    along = Window.partitionBy("rep").orderBy("depth")  # nodes of one conversation's path, not its turns
    # of a path whose edges are split here and there, the node above may be one that is not looked at again
    tops = rows.join(kept, "key").withColumn("top", F.greatest(F.lag("depth").over(along), F.col("base"))).where("rep = chosen")
    new = tops.groupBy("key").agg(F.min("top").alias("top"), F.min("depth").alias("depth"), F.min("rep").alias("rep"))
    new = new.withColumns({"_handle": fattest(F.col("top"), F.col("depth")), "_entry": F.col("top") + 1})
    new = on_path(on_path(new, path, "rep", "_handle", handle="key"), path, "rep", "_entry", entry="key").drop("_handle", "_entry")
    if nodes is not None:
        new = nodes.join(left, "key", "left_anti").unionByName(new)
    return stored(new, "nodes")


def summed(tree: DataFrame, values: dict[str, str]) -> DataFrame:
    """``key`` and each of ``values`` (name -> aggregate) over the subtree of every node of ``tree`` (``key``, ``parent``), by pointer doubling."""
    ways = {"sum": (F.sum, lambda a, b: a + F.coalesce(b, F.lit(0))), "min": (F.min, F.least)}
    now = stored(tree.select("key", F.when(F.col("parent") != ROOT, F.col("parent")).alias("up"), *values), "sums")
    while not now.where("up is not null").isEmpty():
        below = now.where("up is not null").groupBy(F.col("up").alias("key")).agg(*[ways[w][0](v).alias(f"below_{v}") for v, w in values.items()])
        above = now.select(F.col("key").alias("up"), F.col("up").alias("further"))
        now = stored(now.join(below, "key", "left").join(above, "up", "left").select(
            "key", F.col("further").alias("up"), *[ways[w][1](F.col(v), F.col(f"below_{v}")).alias(v) for v, w in values.items()]), "sums")
    return now.drop("up")


def joined_digest(ends: DataFrame) -> DataFrame:
    """``key`` and ``ends_sha256`` of its conversations' ids, ascending; they come as a stream, in bounded memory."""
    schema = "key string, ends_sha256 string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for batch in batches:
            done = []
            for key, conv in zip(batch["key"], batch["conv_id"]):
                if key != now:
                    if state:
                        done.append((now, state.hexdigest()))
                    now, state = key, hashlib.sha256(str(conv).encode())
                else:
                    state.update(f",{conv}".encode())
            yield pd.DataFrame(done, columns=["key", "ends_sha256"])
        if state:
            yield pd.DataFrame([(now, state.hexdigest())], columns=["key", "ends_sha256"])

    return ends.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id").mapInPandas(run, schema)


class ConversationTrie:
    """Trie of ``turns`` (``conv_id``, ``depth`` from 1, ``role``, ``text``); ``convs`` names all conversations, also those without turns."""

    def __init__(self, turns: DataFrame, convs: DataFrame, batches: tuple[int, ...] = BATCHES, piece_turns: int = PIECE_TURNS):
        every = stored(paths(turns, piece_turns), "paths")
        last = every.groupBy("conv_id").agg(F.max_by(F.struct("depth", "key"), "depth").alias("e"))
        self.ends = stored(convs.join(last, "conv_id", "left").select("conv_id", F.coalesce("e.depth", F.lit(0)).alias("length"), F.coalesce("e.key", F.lit(ROOT)).alias("key")), "ends")
        different = stored(self.ends.where("length > 0").groupBy("key").agg(F.min("conv_id").alias("rep"), F.min("length").alias("length")), "different")
        self.path = stored(every.join(different.select(F.col("rep").alias("conv_id")), "conv_id", "left_semi"), "path")
        self.nodes = None
        turn = F.xxhash64("rep")
        for k, one_in in enumerate(batches):
            seen = F.pmod(turn, F.lit(batches[k - 1])) == 0 if k else F.lit(False)
            self.nodes = inserted(self.nodes, different.where((F.pmod(turn, F.lit(one_in)) == 0) & ~seen).select("rep", "length"), self.path)

    def exits(self, turns: DataFrame, convs: DataFrame, piece_turns: int = PIECE_TURNS) -> DataFrame:
        """Exit nodes of other conversations: ``conv_id``, its ``length``, ``base``, the depth of the deepest node on its path, and ``edge``, the node whose edge it leaves midway."""
        path = paths(turns, piece_turns)
        sizes = convs.join(path.groupBy("conv_id").agg(F.max("depth").alias("n")), "conv_id", "left").select(F.col("conv_id").alias("rep"), F.coalesce("n", F.lit(0).cast("bigint")).alias("length"))
        return located(self.nodes, sizes, path).withColumnRenamed("rep", "conv_id")

    def expanded(self) -> DataFrame:
        """One row per distinct prefix, the root included, with the counts of its subtree."""
        here = self.ends.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("low"))
        tree = on_path(on_path(self.nodes.drop("handle", "entry"), self.path, "rep", "top", parent="key", bytes_top="upto"), self.path, "rep", "depth", bytes_end="upto")
        tree = tree.withColumns({"parent": F.coalesce("parent", F.lit(ROOT)), "bytes_top": F.coalesce("bytes_top", F.lit(0))})
        children = tree.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
        tree = stored(tree.join(children, "key", "left").join(here, "key", "left").withColumns(
            {"n_children": F.coalesce("n_children", F.lit(0)), "n": F.coalesce("n", F.lit(0))}).withColumn("leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint")), "tree")
        counts = stored(summed(tree, {"n": "sum", "low": "min", "leaves": "sum"}), "counts")
        full = stored(tree.drop("n", "low", "leaves").join(counts, "key").withColumn("saved", (F.col("n") - 1) * (F.col("bytes_end") - F.col("bytes_top"))), "full")
        full = stored(full.drop("saved").join(summed(full, {"saved": "sum"}), "key"), "full")
        spark = self.ends.sparkSession
        members, least = self.ends.agg(F.count("*"), F.min("conv_id")).first()
        tops, leaves, saved = full.where(F.col("parent") == ROOT).agg(F.count("*"), F.coalesce(F.sum("leaves"), F.lit(0)), F.coalesce(F.sum("saved"), F.lit(0))).first()
        hashes = joined_digest(self.ends)
        above = full.select(F.col("key").alias("parent"), F.col("low").alias("parent_low"))
        known = full.join(above, "parent", "left").withColumn("parent_low", F.coalesce("parent_low", F.lit(least)))
        rows = expanded(known, self.path).join(hashes, "key", "left")
        own = F.col("at") == F.col("depth")
        nodes = rows.select(
            F.col("low").alias("conv_id"), F.col("at").alias("depth"), F.when(F.col("at") == F.col("top") + 1, F.col("parent_low")).otherwise(F.col("low")).alias("parent_conv_id"),
            F.col("n").alias("n_convs"), F.when(own, F.col("n_children")).otherwise(1).cast("bigint").alias("n_children"), F.col("leaves").alias("n_leaves"),
            (F.col("saved") - (F.col("n") - 1) * (F.col("upto") - F.col("bytes") - F.col("bytes_top"))).alias("saved_tokens"),
            F.when(own, F.coalesce("ends_sha256", F.lit(EMPTY_HASH))).otherwise(EMPTY_HASH).alias("ends_sha256"))
        if not members:
            return nodes
        turnless = hashes.where(F.col("key") == ROOT).select("ends_sha256").first()
        root = spark.createDataFrame([(least, 0, None, members, tops, leaves if tops else 1, saved, turnless[0] if turnless else EMPTY_HASH)], nodes.schema)
        return nodes.unionByName(root)
