import random

import numpy as np
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

import corpus_pipeline
from fleetlens.llm import near_copies as N, simhash
from fleetlens.llm.common import connected, few, held, stored


def jaccard(a, b):
    x, y = set(N.shingles_of(a).tolist()), set(N.shingles_of(b).tolist())
    return len(x & y) / len(x | y) if x | y else 1.0


def corpus(seed):
    """Planted copies with a few words replaced, a crowd of near copies and a passage that many documents hold."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(5000)]
    passage = [rng.choice(words) for _ in range(60)]
    texts = [[rng.choice(words) for _ in range(rng.randrange(3, 260))] + passage * (i % 3 == 0) for i in range(60)]
    crowd = [rng.choice(words) for _ in range(150)]
    texts += [crowd[:] for _ in range(30)] + [t[:] for t in texts[:40] for _ in range(2)]
    for t in texts[60:]:
        for _ in range(rng.randrange(0, 1 + max(1, len(t) // 40))):
            t[rng.randrange(len(t))] = rng.choice(words)
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def brute(pairs):
    label = {i: i for i, _ in pairs}
    for i, a in pairs:
        for j, b in pairs:
            if j < i and jaccard(a, b) >= 0.8:
                x, y = label[i], label[j]
                label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    return label


@pytest.mark.parametrize("rare_first", [True, False])
def test_groups_are_those_of_all_pairs(spark, docs_of, monkeypatch, rare_first):
    monkeypatch.setattr(N, "SAMPLE_ONE_IN", 1 if rare_first else 1 << 40)
    pairs = corpus(3)
    sims = [jaccard(a, b) for i, a in pairs for j, b in pairs if j < i]
    assert sum(0.8 <= s < 0.95 for s in sims) > 50 and sum(0.6 < s < 0.8 for s in sims) > 50
    assert {r["doc_id"]: r["component_id"] for r in N.near_copies(docs_of(pairs)).collect()} == brute(pairs)


def test_stage_drops_planted_copies(spark, docs_of):
    rng = random.Random(1)
    base = [f"w{rng.randrange(9000)}" for _ in range(400)]
    pairs = [(1, " ".join(base))]
    for k, edits in enumerate((2, 4, 6, 8, 30), 2):
        other = base[:]
        for i in range(edits):
            other[10 + i * (380 // edits)] = f"x{k}_{i}"
        pairs.append((k, " ".join(other)))
    sims = [jaccard(base_text, t) for base_text in [pairs[0][1]] for _, t in pairs[1:]]
    assert all(0.8 <= s < 0.98 for s in sims[:4]) and sims[4] < 0.6
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs_of(pairs), "").collect()) == [1, 6]


def test_odd_rows(docs_of):
    long = " ".join(f"v{i}" for i in range(90))
    pairs = [(5, None), (4, " \t"), (9, "One two"), (8, "one  TWO"), (7, "one two three"), (3, long), (3, "other text"), (2, long.upper()), (None, long), (11, "again " * 500), (10, "again " * 30)]
    got = sorted((r["doc_id"], r["component_id"]) for r in N.near_copies(docs_of(pairs)).collect())
    assert got == [(2, 2), (3, 2), (3, 3), (4, 4), (5, 4), (7, 7), (8, 8), (9, 8), (10, 10), (11, 10)]
    assert N.near_copies(docs_of([])).count() == 0


def test_sets_that_meet_in_different_groups(spark):
    """At each shingle the largest group's sets meet only those outside of it."""
    members = spark.createDataFrame([(7, k, c) for k, c in [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)]], "shingle long, key long, component long")
    owners = spark.createDataFrame([(1, 10, [0]), (2, 10, [7]), (3, 20, [0]), (4, 10, [0]), (5, 10, [0])], "key long, n int, parity array<long>")
    assert {tuple(r) for r in N.cross_pairs(members, owners, 0.8).collect()} == {(1, 4), (1, 5), (4, 5)}


def test_only_shared_shingles_are_dealt(spark, docs_of):
    pairs = corpus(4)
    rows = docs_of(pairs).select("doc_id", "text").repartition(7)
    batches = N.stored(N.batched_sets(rows, np.zeros(0, np.int64), 5, 0.8, 42), "batches")
    sets = {N.key_of(s, 42): s[:N.leading(len(s), 0.8)].tolist() for s in (N.shingles_of(t) for _, t in pairs)}
    times = {}
    for own in sets.values():
        for x in own:
            times[x] = times.get(x, 0) + 1
    expected = {(x, k) for k, own in sets.items() for x in own if times[x] > 1}
    got = {(r["shingle"], r["key"]) for r in N.shared_shingles(batches).collect()}
    assert expected <= got and all(x in sets[k] for x, k in got)
    assert len({g[0] for g in got if times[g[0]] == 1}) < len(times)


def test_parity_never_differs_more_than_the_sets():
    rng = np.random.default_rng(2)
    for n in (1, 5, 40, 900):
        a, b = (np.unique(rng.integers(-2**63, 2**63 - 1, n)) for _ in range(2))
        b = np.unique(np.concatenate((b[: n // 9], a[n // 9:])))
        bits = np.frombuffer(N.parity_of(a), np.uint8) ^ np.frombuffer(N.parity_of(b), np.uint8)
        assert np.bitwise_count(bits).sum() <= len(np.setxor1d(a, b))
    for n, m in ((700, 4000), (0, 1), (300, 300)):
        a, b = (np.unique(rng.integers(-2**63, 2**63 - 1, k)) for k in (n, m))
        fine = [N.parity_of(x, N.fine_bits(len(x))) for x in (a, b)]
        size = min(map(len, fine))
        apart = np.bitwise_count(N.folded(fine[0], size) ^ N.folded(fine[1], size)).sum()
        assert apart <= n + m and (N.folded(fine[1], 64) == np.frombuffer(N.parity_of(b), np.uint8)).all()
        assert n < 300 or apart > 0.2 * (n + m) * 0.8


def test_tries_of_fingerprints_link_sets_first(spark, docs_of, monkeypatch):
    owners = spark.createDataFrame([(5, 0), (3, 0), (9, 0b1111), (8, 0b11111), (4, -1)], "key long, fp long")
    got = {tuple(r) for r in N.print_pairs(owners).collect()}
    assert all(a < b for a, b in got) and {x for x in got if 4 in x} == set() and (3, 5) in got
    assert got == {(3, 5), (3, 8), (3, 9)}
    asked = []
    monkeypatch.setattr(N, "fingerprint_links", lambda prints, budget: asked.append((prints.count(), budget)) or simhash.fingerprint_links(prints, budget))
    pairs = corpus(5)
    assert {r["doc_id"]: r["component_id"] for r in N.near_copies(docs_of(pairs)).collect()} == brute(pairs)
    assert asked == [(len({simhash.majority(N.shingles_of(t).view("<u8")) for _, t in pairs}), 4)]


def test_small_links_become_few_files(spark):
    edges = spark.range(2000).selectExpr("id a", "id - id % 10 b")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        groups = connected(edges)
        assert len(groups.inputFiles()) <= spark.sparkContext.defaultParallelism
        assert {tuple(r) for r in groups.collect()} == {(i, i - i % 10) for i in range(2000)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_few_files_do_not_put_many_partitions_into_one_task(spark):
    """A task keeps what its sorts and joins took until it ends, so each makes one shuffle partition."""
    def attempt(batches):
        for batch in batches:
            yield batch[["k"]].assign(task=TaskContext.get().taskAttemptId())

    with held(spark, {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        made = spark.range(6000).groupBy((F.col("id") % 600).alias("k")).count().mapInPandas(attempt, "k long, task long")
        kept = stored(few(made, 600), "few")
        assert len(kept.inputFiles()) <= spark.sparkContext.defaultParallelism
        assert kept.count() == 600 and kept.select("task").distinct().count() == 60


def test_settings_hold_for_the_groups_only(spark, docs_of, monkeypatch):
    seen, names = [], list(N.SETTINGS)
    before = [spark.conf.get(n, None) for n in names]
    monkeypatch.setattr(N, "groups_of", lambda rows, *args: seen.append([spark.conf.get(n) for n in names]))
    N.near_copies(docs_of([(1, "a")]))
    assert seen == [list(N.SETTINGS.values())] and [spark.conf.get(n, None) for n in names] == before
