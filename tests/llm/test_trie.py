"""Conversation tries against prefixes listed one by one."""
import hashlib
import random
import zlib

import pytest

from fleetlens.llm import trie

TURNS = "conv_id long, depth long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(convs):
    """Expected rows from conv_id -> list of (role, text)."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {p: [] for p in members}
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def below(p):
        leaves, saved = (0 if children[p] else 1), (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        for q in children[p]:
            a, b = below(q)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    rows = []
    for p, who in members.items():
        ends = sorted(c for c in who if len(convs[c]) == len(p))
        rows.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), len(children[p]), *below(p), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(rows, key=str)


def built(spark, convs, **options):
    turns = spark.createDataFrame([(c, d + 1, *t) for c, turns in convs.items() for d, t in enumerate(turns)], TURNS)
    return trie.ConversationTrie(turns, spark.createDataFrame([(c,) for c in convs], "conv_id long"), **options)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def random_convs(seed, n, most, words=3):
    rnd = random.Random(seed)
    out = {}
    for c in range(n):
        start = list(out[rnd.choice(list(out))]) if out and rnd.random() < 0.8 else []
        out[c - 3] = start[:rnd.randrange(len(start) + 1)] + [("user", rnd.choice(["é", "b", "cc"][:words])) for _ in range(rnd.randrange(most))]
    return out


@pytest.mark.parametrize("batches,piece", [((1,), 4096), ((4, 2, 1), 2)])
def test_agrees_with_all_prefixes(spark, batches, piece):
    convs = random_convs(3, 70, 9)
    assert rows_of(built(spark, convs, batches=batches, piece_turns=piece).expanded()) == brute(convs)


def test_chain_copies_and_a_crowded_start(spark):
    """Every conversation the beginning of the next, copies of one, and many that share a long start."""
    convs = {i: [("user", f"t{d}") for d in range(i)] for i in range(24)}
    convs |= {100 + i: [("user", "same")] * 3 for i in range(20)}
    convs |= {200 + i: [("system", "start")] * 40 + [("user", str(i))] for i in range(20)}
    assert rows_of(built(spark, convs, batches=(8, 4, 2, 1), piece_turns=8).expanded()) == brute(convs)


def test_splits_far_apart_on_one_path(spark):
    """Two edges of an old path are split in one batch while the one between them is not."""
    long = [("user", f"t{d}") for d in range(12)]
    convs = {0: long, 1: long[:4] + [("user", "x")], 2: long[:8] + [("user", "y")]}
    later = {3: long[:2] + [("user", "p")], 4: long[:10] + [("user", "q")]}
    first = built(spark, convs, batches=(1,))
    both = built(spark, convs | later, batches=(1,))
    both.nodes = trie.inserted(first.nodes, spark.createDataFrame([(3, 3), (4, 11)], "rep long, length long"), both.path)
    assert rows_of(both.expanded()) == brute(convs | later)


def test_exit_nodes(spark):
    convs = {0: [("user", str(d)) for d in range(9)], 1: [("user", str(d)) for d in range(5)] + [("user", "x")]}
    made = built(spark, convs)
    node_at = {r["depth"]: r["key"] for r in made.nodes.where("rep = 0").collect()}
    asked = {10: convs[0][:5], 11: convs[0][:7], 12: convs[0] + [("user", "more")], 13: [("user", "other")], 14: convs[0][:2], 15: []}
    turns = spark.createDataFrame([(c, d + 1, *t) for c, ts in asked.items() for d, t in enumerate(ts)], TURNS)
    found = {r["conv_id"]: (r["base"], r["edge"]) for r in made.exits(turns, spark.createDataFrame([(c,) for c in asked], "conv_id long")).collect()}
    top = made.nodes.where("depth = 5").first()["key"]
    assert found == {10: (5, None), 11: (5, node_at[9]), 12: (9, None), 13: (0, None), 14: (0, top), 15: (0, None)}


def test_fattest(spark):
    pairs = [(a, b) for b in range(1, 40) for a in range(b)]
    df = spark.createDataFrame(pairs, "a long, b long")
    trailing = lambda x: (x & -x).bit_length()
    for r in df.select("a", "b", trie.fattest(df["a"], df["b"]).alias("f")).collect():
        assert r["f"] == max(range(r["a"] + 1, r["b"] + 1), key=trailing)


def test_rebuilt_conversations(spark):
    rnd = random.Random(5)
    rows = [(c, rnd.choice([t, None]), rnd.choice(["user", None]), rnd.choice(["a", "b", None])) for c in [*range(33), 41, 43] if c != 15 for t in range(rnd.randrange(1, 12))]
    rows += [(None, 1, "user", "lost"), (7, 3, "user", "twice"), (7, 3, "user", "twice")]
    turns, convs = trie.rebuilt(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {}
    for r in turns.orderBy("conv_id", "depth").collect():
        got.setdefault(r["conv_id"], []).append((r["depth"], r["role"], r["text"]))
    own = {}
    for c, t, r, x in sorted(((c, t, r or "", x or "") for c, t, r, x in rows if c is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2], r[3])):
        own.setdefault(c, []).append((r, x))
    want = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        want[c] = [(d + 1, *t) for d, t in enumerate(own.get(c - c % 5, [])[:h] + own[c][h:])]
    assert got == {c: t for c, t in want.items() if t} and {r[0] for r in convs.collect()} == set(own)


def test_only_turnless_and_empty(spark):
    assert rows_of(built(spark, {4: [], 2: []}).expanded()) == brute({4: [], 2: []})
    assert rows_of(built(spark, {}).expanded()) == []


def test_long_texts_and_extra_columns(spark):
    convs = {1: [("user", "word " * 200_000)], 2: [("user", "word " * 200_000), ("assistant", "")]}
    turns = spark.createDataFrame([(c, d + 1, *t, "x") for c, ts in convs.items() for d, t in enumerate(ts)], TURNS + ", key string")
    made = trie.ConversationTrie(turns, spark.createDataFrame([(1,), (2,)], "conv_id long"))
    assert rows_of(made.expanded()) == brute(convs)
