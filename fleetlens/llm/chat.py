"""Chat formatting by token-level assembly.

A turn is laid out as start, role, separator, text, end.  Role and text are encoded each by
itself; the three marks are spliced in as reserved ids above the vocabulary, so a text can never
produce one.  Control strings inside roles and texts are also escaped in the rendered form: in
``<|``, ``<\\|``, ``<\\\\|`` ... one more backslash is put behind the ``<``, which leaves no ``<|`` and
is undone by taking one away.  Assistant texts are under the loss mask, without the marks; the
mask is the prefix sum of +1 at their first token and -1 behind their last.

Turns are encoded where they lie, then brought together sorted by conversation and turn, and
assembled as a stream: a conversation of any length comes out in chunks of whole turns.

Cases: null roles and texts are empty; turns of equal number are ordered by role, then by a hash
of the text; null turns come first; a null conv_id is one conversation; repeated rows are turns of
their own; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the public byte-level vocabulary splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MARKS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>")
LEARNED_ROLE = "assistant"
#: A chunk is closed at the first turn that fills it to so many tokens.
CHUNK_TOKENS = 16_384
#: Chunks that are handed to Spark at once; a long one goes at once.
BATCH_CHUNKS = 256

CHUNKS = "conv_id bigint, chunk int, ids array<int>, loss array<boolean>"
TURNS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


@lru_cache(maxsize=2)
def tokenizer(vocabulary: bytes):
    """Encoding over a rank file's content; one per Python worker."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def sorted_rows(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def formatted(turns: DataFrame, vocabulary: str = VOCABULARY, learned_role: str = LEARNED_ROLE, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Token ids and loss mask of every conversation, in numbered chunks of whole turns.

    ``turns`` has the columns ``conv_id``, ``turn``, ``role``, ``text``.  The vocabulary (about
    1 MB) is read on the driver and sent with the tasks.
    """
    ranks = read_vocabulary(vocabulary)

    @F.pandas_udf("binary")
    def encode(texts: pd.Series) -> pd.Series:
        enc = tokenizer(ranks).encode_ordinary
        return pd.Series([np.array(enc(escape(t or "")), np.int32).tobytes() for t in texts])

    first = len(ranks.splitlines())
    start, separator, end = range(first, first + 3)
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.xxhash64("text").alias("tie"),
                        encode("role").alias("role_ids"), encode("text").alias("text_ids"))
    marks = [np.array([i], np.int32).tobytes() for i in (start, separator, end)]

    def assemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, chunk, conv, seen = [], 0, 0, None, False
        ready: list[tuple] = []

        def close() -> None:
            ids = np.frombuffer(b"".join(x for r, t, _ in held for x in (marks[0], r, marks[1], t, marks[2])), np.int32)
            steps = np.zeros(len(ids) + 1, np.int32)
            at = 0
            for r, t, learned in held:
                begin = at + len(r) // 4 + 2
                at = begin + len(t) // 4 + 1
                if learned:
                    steps[begin] += 1
                    steps[at - 1] -= 1
            ready.append((conv, chunk, ids, np.cumsum(steps)[:-1] > 0))

        def out() -> pd.DataFrame:
            frame = pd.DataFrame(ready, columns=["conv_id", "chunk", "ids", "loss"]).astype({"conv_id": "Int64"})
            ready.clear()
            return frame

        for batch in batches:
            for c, role, r, t in zip(batch["conv_id"], batch["role"], batch["role_ids"], batch["text_ids"]):
                c = None if pd.isna(c) else int(c)
                if held and (c != conv or size >= chunk_tokens):
                    close()
                    held, size, chunk = [], 0, chunk + 1
                    if len(ready[-1][2]) >= chunk_tokens or len(ready) >= BATCH_CHUNKS:
                        yield out()
                if not seen or c != conv:
                    conv, chunk, seen = c, 0, True
                held.append((r, t, role == learned_role))
                size += (len(r) + len(t)) // 4 + 3
        if held:
            close()
        if ready:
            yield out()

    return sorted_rows(rows, "turn", "role", "tie").select("conv_id", "role", "role_ids", "text_ids").mapInPandas(assemble, CHUNKS)


def read_back(chunks: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Digest of every conversation's turns and of the text under its loss mask, from ids and mask alone."""
    ranks = read_vocabulary(vocabulary)
    first = len(ranks.splitlines())

    class Conversation:
        def __init__(self, conv):
            self.conv, self.turns, self.loss, self.chars = conv, 0, 0, 0
            self.all, self.learned = hashlib.sha256(), hashlib.sha256()

        def add(self, ids: np.ndarray, loss: np.ndarray, decode) -> None:
            starts, separators, ends = (np.flatnonzero(ids == first + i) for i in range(3))
            for a, b, c in zip(starts.tolist(), separators.tolist(), ends.tolist()):
                role, text = decode(ids[a + 1:b].tolist()), decode(ids[b + 1:c].tolist())
                self.turns += 1
                self.chars += len(role) + len(text) + sum(map(len, MARKS))
                self.all.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
            edges = np.flatnonzero(np.diff(np.concatenate(([0], loss.astype(np.int8), [0]))))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                text = unescape(decode(ids[a:b].tolist()))
                self.loss += len(text)
                self.learned.update(text.encode())

        def row(self) -> tuple:
            return (self.conv, self.turns, self.all.hexdigest(), self.loss, self.learned.hexdigest(), self.chars)

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode, now = tokenizer(ranks).decode, None
        names = [f.split()[0] for f in TURNS.split(", ")]
        for batch in batches:
            done = []
            for c, ids, loss in zip(batch["conv_id"], batch["ids"], batch["loss"]):
                c = None if pd.isna(c) else int(c)
                if now is None or now.conv != c:
                    if now:
                        done.append(now.row())
                    now = Conversation(c)
                now.add(np.asarray(ids), np.asarray(loss, bool), decode)
            yield pd.DataFrame(done, columns=names).astype({"conv_id": "Int64"})
        if now:
            yield pd.DataFrame([now.row()], columns=names).astype({"conv_id": "Int64"})

    return sorted_rows(chunks, "chunk").mapInPandas(digest, TURNS)
