import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import substrings as S


def brute(texts, length):
    count = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            count[t[i:i + length]] = count.get(t[i:i + length], 0) + 1
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        runs = sum(a and not b for a, b in zip(gone, [False, *gone]))
        out.append((len(t), sum(gone), runs, bytes(b for b, g in zip(t, gone) if not g)))
    return sorted(out)


def texts_of(seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abc") for _ in range(60)) for _ in range(6)]
    out = ["", "é" * 30, "b" * 45]
    for _ in range(45):
        kind = rng.random()
        if kind < 0.1:
            out.append("a" * rng.randint(0, 80))
        elif kind < 0.2:
            out.append(rng.choice(out))
        else:
            out.append("".join(rng.choice(pool)[rng.randint(0, 20):rng.randint(30, 60)] if rng.random() < 0.7 else rng.choice("abcé") * rng.randint(1, 9) for _ in range(rng.randint(0, 8))))
    return out


@pytest.mark.parametrize("most_contexts, bucket", [(10 ** 6, 10 ** 6), (10 ** 6, 20), (2, 10)])
def test_against_brute_force(docs_of, most_contexts, bucket):
    texts = [*texts_of(most_contexts + bucket), None]
    docs = docs_of([(i if i % 7 else None, t) for i, t in enumerate(texts)])
    rows = S.without_repeats(docs, length=20, gram=6, most_contexts=most_contexts, bucket=bucket).withColumn("gone", S.removed(F.col("spans"))).collect()
    assert sorted((r["n_bytes"], r["gone"], len(r["spans"]), bytes(r["kept"])) for r in rows) == brute([(t or "").encode() for t in texts], 20)


def test_long_text_in_segments(docs_of, monkeypatch):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdef") for _ in range(300))
    body = lambda n: "".join(rng.choice("ghijkl") for _ in range(n))
    texts = [body(S.SEGMENT - 151) + "X" + passage + "Y" + body(2000), body(499) + "Z" + passage]
    rows = S.without_repeats(docs_of(list(enumerate(texts)))).orderBy("doc_id").collect()
    assert [[(s["start"], s["end"]) for s in r["spans"]] for r in rows] == [[(S.SEGMENT - 150, S.SEGMENT + 150)], [(500, 800)]]


def test_multikey_sort():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 500):
        m = rng.integers(0, 3, (n, 5)).astype(np.uint64)
        assert [tuple(r) for r in m[S.multikey_sort(m)]] == sorted(tuple(r) for r in m)


def test_empty(docs_of):
    assert S.without_repeats(docs_of([])).count() == 0
