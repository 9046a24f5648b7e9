"""Chunked byte-level BPE against the tokenizer library on whole texts."""
import hashlib
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetlens.llm import bpe

CODER = bpe.coder(bpe.read_vocabulary(), bpe.pattern())
WHOLE = tiktoken.Encoding("whole", pat_str=bpe.pattern(), mergeable_ranks=CODER.ranks, special_tokens={})
PARTS = ["a", "the", " ", "  ", "\n", "\t", "'", "'s", "'ll", "ll", "1", "23", ".", "!?", "é", "漢", "😀", " ", "x" * 70, "ab" * 45, "   \n\n", "<|endoftext|>"]


def expected(doc, text):
    ids = np.array(WHOLE.encode_ordinary(text or ""), "<u4").tobytes()
    data = (text or "").encode()
    return (doc, len(ids) // 4, hashlib.sha256(ids).hexdigest(), len(data), hashlib.sha256(data).hexdigest())


def texts(seed, n, most):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(most))) for _ in range(n)]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab e's\n\t1.é漢"), max_size=90))
def test_pieces_and_long_merges(text):
    assert np.frombuffer(CODER.encode(CODER.pieces(text)), "<u4").tolist() == WHOLE.encode_ordinary(text)
    for piece in CODER.pieces(text * 3):
        raw = piece.encode()
        ids = CODER.merged_long(raw)
        assert b"".join(CODER.bytes_of[i] for i in ids) == raw
        if raw not in CODER.ranks:
            assert ids == WHOLE.encode_ordinary(piece)


@pytest.mark.parametrize("chunk,overlap", [(40, 12), (60, 30), (7, 5)])
def test_chunks_agree_with_whole_texts(spark, chunk, overlap):
    rows = list(enumerate(texts(3, 120, 60)))
    rows += [(200, "z" * 500), (201, " " * 400 + "x"), (202, "'ll" * 100), (203, "a" * 39 + "'llama " * 30), (204, "\n" * 41 + " b"), (205, None), (206, ""),
             (207, "same text " * 9), (207, "same text " * 9), (None, "no id " * 20), (None, "short")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, chunk int")
    got = [tuple(r) for r in bpe.digests(*bpe.encoded(docs, chunk_chars=chunk, overlap=overlap)).collect()]
    assert sorted(got, key=str) == sorted((expected(*r) for r in rows), key=str)


def test_very_long_and_empty(spark):
    rows = [(1, "lorem ipsum " * 50_000), (2, "q" * 150_000), (3, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in bpe.digests(*bpe.encoded(docs)).collect())
    assert [g[1] for g in got] == [expected(*r)[1] for r in rows[:1]] + [len(CODER.merged_long(b"q" * 150_000)), 1]
    assert [g[4] for g in got] == [hashlib.sha256(t.encode()).hexdigest() for _, t in rows] and got[0] == expected(*rows[0])
    assert bpe.digests(*bpe.encoded(docs.limit(0))).collect() == []


def test_other_vocabulary_and_decoding(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.createDataFrame([(1, "naïve 漢字 text")], "doc_id long, text string")
    short, _ = bpe.encoded(docs, vocabulary=path)
    assert bytes(short.select(bpe.decoded(short["ids"], path).alias("b")).first()["b"]).decode() == "naïve 漢字 text"


def test_overlap_is_checked(spark):
    with pytest.raises(ValueError):
        bpe.encoded(spark.createDataFrame([], "doc_id long, text string"), chunk_chars=10, overlap=10)
