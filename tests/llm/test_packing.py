import random

import pytest

from fleetlens.llm import packing as P


def placed(rows, sizes):
    bins = {}
    for r in rows:
        assert r["capacity"] in sizes and 0 <= r["offset"] and r["offset"] + r["n_tokens"] <= r["capacity"]
        bins.setdefault(r["bin_id"], []).append(r)
    for members in bins.values():
        assert len({m["capacity"] for m in members}) == 1
        at = 0
        for m in sorted(members, key=lambda m: (m["offset"], m["offset"] + m["n_tokens"])):
            assert m["offset"] == at
            at += m["n_tokens"]
        assert members[0]["capacity"] == min(c for c in sizes if c >= at)
    return bins


def test_all_pieces_once_in_fitting_bins(docs_of):
    rng = random.Random(2)
    pairs = [(i, "é" * rng.randint(0, 90)) for i in range(150)] + [(7, "twice"), (7, "twice"), (900, None), (901, ""), (None, "x" * 1000)]
    sizes = (32, 64, 128)
    rows = P.packed(docs_of(pairs), capacities=(128, 32, 64), shard_pieces=50).collect()
    placed(rows, sizes)
    want = sorted((str(i), at, min(128, n - at)) for i, t in pairs for n in [len((t or "").encode())] for at in range(0, max(n, 1), 128))
    assert sorted((str(r["doc_id"]), r["start"], r["n_tokens"]) for r in rows) == want
    assert all(r["start"] == 128 * r["piece"] for r in rows)
    assert P.packed(docs_of([])).count() == 0


def slow_pack(lengths, sizes, quadratic):
    """The rule by plain search: least room that fits, oldest bin first; else the size of least promised cost."""
    bins, out = [], []
    for at, n in enumerate(lengths):
        if not n and bins:
            out.append((0, bins[0][1]))
            continue
        fits = [(cap - used, i) for i, (cap, used) in enumerate(bins) if cap - used >= n]
        if fits:
            i = min(fits)[1]
        else:
            def promised(cap):
                room = cap - n
                for x in sorted(set(lengths[at + 1:]) - {0}, reverse=True):
                    room -= min(lengths[at + 1:].count(x), room // x) * x
                return P.cost(cap, quadratic) / (cap - room)

            able = [c for c in sizes if c >= n]
            bins.append([min(able, key=lambda c: (promised(c), c)) if n else able[0], 0])
            i = len(bins) - 1
        out.append((i, bins[i][1]))
        bins[i][1] += n
    return [b for b, _ in out], [o for _, o in out], [min(c for c in sizes if c >= used) for _, used in bins]


@pytest.mark.parametrize("seed", range(6))
def test_pack_follows_the_rule(seed):
    rng = random.Random(seed)
    lengths = sorted((rng.choice([0, 1, 5, 16, 31, 32, 33, 60, 64, 100]) if rng.random() < 0.5 else rng.randint(0, 128) for _ in range(80)), reverse=True)
    for quadratic in (10 ** 9, 64):
        assert P.pack(lengths, (32, 64, 128), quadratic) == slow_pack(lengths, (32, 64, 128), quadratic)


def test_only_empty_pieces():
    assert P.pack([0, 0], (4, 8)) == ([0, 0], [0, 0], [4])
    assert P.pack([], (4, 8)) == ([], [], [])
