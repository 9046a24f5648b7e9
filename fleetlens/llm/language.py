"""Language identification by compression.

Each language gets a raw-content zstandard dictionary made from a bounded sample of labelled
texts.  A text is split into blocks, each block is compressed with every dictionary, and the
language with the fewest bytes over all blocks wins.  The relative margin to the second best is
the score; below ``least_margin`` the text is rejected (``rejected`` is true, the best language
is still named).

Cases: null texts and texts without a letter are ``und`` with score 0 and are rejected; if no
labelled row exists every text is ``und``; if one language exists it wins with score 1; ties go
to the first language by name; rows with a null label or null text train nothing; repeated texts
train once; an empty table gives an empty result.
"""

from __future__ import annotations


import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import smallest

#: Bound of the training sample: labelled texts per language, and characters taken of each.
SAMPLE_TEXTS = 400
SAMPLE_CHARS = 2000
#: Bytes of each dictionary and of each block.
DICTIONARY_BYTES = 96 * 1024
BLOCK_BYTES = 2048
LEVEL = 5
#: Texts whose margin is smaller are rejected.
LEAST_MARGIN = 0.01
UNDETERMINED = "und"
#: Characters other than letters, in runs.
NOT_LETTERS = regex.compile(r"\P{L}+")

RESULT = "struct<lang:string,score:double,rejected:boolean>"


def letters(text: str | None) -> str:
    """Lower-cased letters of a text, runs of anything else as one blank."""
    return NOT_LETTERS.sub(" ", (text or "").lower()).strip()


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_texts: int = SAMPLE_TEXTS,
          sample_chars: int = SAMPLE_CHARS, dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Dictionary content per language, from at most ``sample_texts`` pieces of distinct texts each, chosen by hash.

    The driver receives languages x ``sample_texts`` x ``sample_chars`` characters at most.
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    keyed = rows.select(F.col(lang).alias("lang"), F.xxhash64(F.col(text), F.lit(7)).alias("key"), F.substring(F.col(text), 1, sample_chars).alias("piece"))
    # languages x sample_texts keys at most, so they may be broadcast
    keys = smallest(keyed.select("lang", "key").distinct(), "lang", ["key"], sample_texts)
    chosen = keyed.join(F.broadcast(keys), ["lang", "key"]).groupBy("lang", "key").agg(F.min("piece").alias("piece"))
    pieces: dict[str, list[str]] = {}
    for row in chosen.orderBy("lang", "key").toLocalIterator():
        pieces.setdefault(row["lang"], []).append(letters(row["piece"]))
    share = {k: max(64, dictionary_bytes // len(v)) for k, v in pieces.items()}
    return {k: b" ".join(p.encode()[:share[k]] for p in v)[:dictionary_bytes] for k, v in sorted(pieces.items())}


class Classifier:
    """Compressors of all languages; built once per Python worker."""

    def __init__(self, content: dict[str, bytes], least_margin: float = LEAST_MARGIN):
        self.names, self.least_margin = list(content), least_margin
        self.compressors = []
        for data in content.values():
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        data = letters(text).encode("utf-8", "replace")
        if not data or not self.names:
            return UNDETERMINED, 0.0, True
        sizes = [0] * len(self.names)
        for at in range(0, len(data), BLOCK_BYTES):
            block = data[at:at + BLOCK_BYTES]
            for i, c in enumerate(self.compressors):
                sizes[i] += len(c.compress(block))
        if len(sizes) == 1:
            return self.names[0], 1.0, False
        best = min(range(len(sizes)), key=sizes.__getitem__)
        second = min(s for i, s in enumerate(sizes) if i != best)
        margin = (second - sizes[best]) / second
        return self.names[best], margin, margin < self.least_margin


def classify(text: Column, content: dict[str, bytes], least_margin: float = LEAST_MARGIN) -> Column:
    """Struct column ``lang``, ``score``, ``rejected`` of a text column."""
    built: list[Classifier] = []

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        if not built:
            built.append(Classifier(content, least_margin))
        return pd.DataFrame([built[0](t) for t in texts], columns=["lang", "score", "rejected"]).astype({"score": float, "rejected": bool})

    return run(text)


def held_out(doc_id: Column) -> Column:
    """Documents kept out of training: crc32 of the id as text leaves 2 when divided by 4 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", least_margin: float = LEAST_MARGIN) -> DataFrame:
    """``docs`` with a struct column ``language`` (replacing one of that name), trained on its rows that are not held out."""
    content = learn(docs.where(~held_out(F.col(doc_id))), text, lang)
    return docs.withColumn("language", classify(F.col(text), content, least_margin))
