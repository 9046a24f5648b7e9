import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from fleetlens.llm import simhash as S


def slow_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t", "One", "A b C", "a b c d", "É Ä  a b c\x0bd\n e f", "x " * 5000, "a\x85b c d e"])
def test_fingerprint(text):
    assert S.fingerprint_of(text) == slow_print(text)


def linked(prints, budget):
    n = len(prints)
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def noisy(rng, n):
    base = [rng.getrandbits(64) for _ in range(n // 6)]
    flips = lambda: sum(1 << b for b in {rng.randrange(64) for _ in range(rng.randrange(7))})
    return [rng.choice(base) ^ flips() for _ in range(n)] + [0, (1 << 64) - 1]


@pytest.mark.parametrize("budget", [1, 4])
def test_forest_joins_what_brute_force_joins(budget):
    rng = random.Random(budget)
    values = np.unique(np.array(noisy(rng, 300), np.uint64))
    x, y = S.forest(values, 0, values, 0, True, budget)
    place = {int(v): i for i, v in enumerate(values)}
    label = list(range(len(values)))
    for a, b in zip(x, y):
        p, q = label[place[int(a)]], label[place[int(b)]]
        label = [min(p, q) if v in (p, q) else v for v in label]
    assert label == linked([int(v) for v in values], budget)


def test_links_over_many_nodes(spark):
    rng = random.Random(5)
    values = sorted(set(noisy(rng, 400)))
    prints = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")
    groups = {r["node"]: r["component"] for r in S.connected(S.fingerprint_links(prints, 4, node_cap=20)).collect()}
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    want = linked(values, 4)
    by = {}
    for s, w in zip(signed, want):
        by.setdefault(w, []).append(s)
    got = {}
    for s in signed:
        got.setdefault(groups.get(s, s), []).append(s)
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, got.values()))


def test_groups(docs_of):
    long = " ".join(f"w{i}" for i in range(3000))
    pairs = [(5, long), (3, long.replace("w17 ", "W17 ")), (9, long + " extra"), (7, None), (8, ""), (2, " "), (4, "other text"), (4, "other text"), (None, long), (None, "alone")]
    rows = S.near_duplicates(docs_of(pairs).withColumnRenamed("source", "fp")).collect()
    assert len(rows) == len(pairs)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"]) for r in rows if r["component_id"] is not None)
    assert got == [(False, 2, 2), (False, 3, 3), (False, 4, 4), (False, 4, 4), (False, 5, 3), (False, 7, 2), (False, 8, 2), (False, 9, 3), (True, 0, 3)]
    assert [r["doc_id"] for r in rows if r["component_id"] is None] == [None]


def test_empty(docs_of):
    assert S.near_duplicates(docs_of([])).count() == 0


def test_pairs_of_nodes_need_no_python_workers(spark, monkeypatch):
    """They reach Spark as an Arrow table, not as Python objects that workers turn into rows."""
    made = []
    create = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *args, **more: made.append(type(data)) or create(self, data, *args, **more))
    prints = spark.range(300).select((F.col("id") * 7919).alias("fp"))
    made.clear()
    links = S.fingerprint_links(prints, 1)
    assert made == [pa.Table]
    values = [7919 * i for i in range(300)]
    near = {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 1}
    assert {tuple(sorted(r)) for r in links.collect()} <= near
