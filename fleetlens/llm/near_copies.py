"""Groups of near copies: documents whose word shingles have a Jaccard similarity of ``similarity`` or more.

The sets' SimHash fingerprints are joined by the binary tries of :mod:`fleetlens.llm.simhash` first; the
pairs that these link are verified on whole sets and form the first groups.  Fingerprints of similar sets often
differ in more bits than tries can be walked with, so a second join completes the groups; it looks only at sets
that are in different ones.

That join is exact (up to 64-bit shingle hashes).  All shingle sets are put into one order, rare
shingles first; two sets of sufficient similarity share a shingle among the first
n - ceil(similarity * n) + 1 of each, so only those matter.  Texts are shingled once for this, and
their leading shingles stored in batches.  Most of them stand in one set only, so the batches first
exchange 32 bits of each: buckets of these bits send back one bit, whether another batch holds the
same.  Only shingles that may be shared are then dealt out with their sets.

Pairs that meet are verified on their whole sets before they are linked; those sets are
made anew, once, for the sets of such pairs only.  Each set's parity bits (of the number of its
shingles in each of PARITY_BITS classes) differ in no more places than the sets differ in shingles,
which drops most other pairs without a loss: 512 of them where sets meet, then more for larger sets.  Every set is first paired with the one centre it shares
most with, then with one centre of each shingle it shares; only sets that are then in different
groups meet each other, and at a shingle none of the largest group there meet
among themselves, so a crowd of near copies is not compared pair by pair.

The order comes from a sample of documents; it decides how much work there is, not the result.

Cases: texts with no word are copies of each other; a text shorter than a shingle is one shingle;
rows with a null id are in no group and left out; repeated rows are kept; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import connected, discard, few, held, stored
from fleetlens.llm.simhash import LOWER, fingerprint_links, majority

WORDS = 5
SIMILARITY = 0.8
#: One document in so many is looked at for common shingles, those that stand in COMMON_IN of them; at most MOST_COMMON are kept.
SAMPLE_ONE_IN = 16
COMMON_IN = 3
MOST_COMMON = 250_000
#: Leading shingles in one bucket of the exchange, about.
BUCKET_SHINGLES = 1_000_000
PARITY_BITS = 512
#: Bits in which the fingerprints of sets may differ that the tries bring together.
PRINT_BUDGET = 4
#: Most places of the bit map that picks the documents whose whole sets are needed, and places for each of them.
#: It is part of a plan, which the driver keeps as text too; a full map only makes sets that are then dropped.
MOST_PLACES, PLACES_EACH = 1 << 20, 16
EPSILON = 1e-9
#: Held while the groups are made.  Small partitions are joined by hash, not sorted: a sort takes a whole memory page for few rows, a join two.
#: Rows of batches are large, so their number does not bound what goes to a Python worker at once.
SETTINGS = {"spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "16m", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}

BATCHES = "batch long, doc_id array<long>, key array<long>, n array<int>, fp array<long>, parity array<binary>, counts array<int>, leads binary"
LOW_BITS = np.uint64(0xFFFFFFFF)


def leading(n: int, similarity: float) -> int:
    """How many of a set's first shingles matter."""
    return n - math.ceil(n * similarity - EPSILON) + 1 if n else 0


def shingles_of(text: str | None, words: int = WORDS, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not parts:
        return np.zeros(0, np.int64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = (starts[:-words + 1 or None], ends[words - 1:]) if len(parts) >= words else (starts[:1], ends[-1:])
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[s:e], seed) for s, e in zip(first.tolist(), last.tolist())], np.uint64).view(np.int64))


def parity_of(shingles: np.ndarray, bits: int = PARITY_BITS) -> bytes:
    """One bit per class of shingles: whether their number is odd."""
    return np.packbits(np.bincount(shingles & (bits - 1), minlength=bits) & 1).tobytes()


def fine_bits(n: int) -> int:
    """Classes of a set's own parity: two to four for each shingle, as those of unlike sets differ in half of their places."""
    return max(PARITY_BITS, 1 << (2 * n - 1).bit_length()) if n else PARITY_BITS


def folded(parity: bytes, size: int) -> np.ndarray:
    """The parity of fewer classes, in ``size`` bytes."""
    return np.bitwise_xor.reduce(np.frombuffer(parity, np.uint8).reshape(-1, size), axis=0)


def alike(pairs: DataFrame, owners: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` of sets whose own parities do not differ too much."""
    side = lambda c: owners.select(F.col("key").alias(c), F.col("n").alias(f"n_{c}"), F.col("fine").alias(f"fine_{c}"))

    @F.pandas_udf(T.BooleanType())
    def fits(x: pd.Series, y: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for a, b, total in zip(x, y, n):
            size = min(len(a), len(b))
            out.append(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum() <= total * ((1 - similarity) / (1 + similarity)) + EPSILON)
        return pd.Series(out, dtype=bool)

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(fits("fine_a", "fine_b", F.col("n_a") + F.col("n_b"))).select("a", "b")


def one_of(values: DataFrame) -> Column:
    """Whether ``doc_id`` may be among the one column of ``values``: never false for those, seldom true for others."""
    places = min(MOST_PLACES, 1 << (PLACES_EACH * values.count() + 1023).bit_length())
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(places))
    bits = np.zeros(places, bool)
    bits[values.select(place(values.columns[0]).alias("p")).distinct().toArrow()["p"].to_numpy()] = True
    packed, at = F.lit(np.packbits(bits).tobytes()), place("doc_id")
    # looked up in the JVM, so that no text waits beside a Python worker
    byte = F.conv(F.hex(F.substring(packed, F.lit(1) + F.shiftright(at, 3).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (F.lit(7) - at.bitwiseAND(F.lit(7))).cast("int")).bitwiseAND(F.lit(1)) == 1


def common_shingles(docs: DataFrame, text: Column, words: int, seed: int) -> np.ndarray:
    """Shingles of many sampled documents, the most common last."""
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles_of(t, words, seed) for t in texts], dtype=object)

    counts = (docs.where(F.pmod(F.xxhash64(text), F.lit(SAMPLE_ONE_IN)) == 0).select(F.explode(run(text)).alias("shingle"))
              .groupBy("shingle").count().where(F.col("count") >= COMMON_IN).orderBy(F.desc("count"), "shingle").limit(MOST_COMMON))
    return counts.select("shingle").toArrow()["shingle"].to_numpy()[::-1].copy()


def key_of(own: np.ndarray, seed: int) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), seed)).view(np.int64))


def batched_sets(rows: DataFrame, common: np.ndarray, words: int, similarity: float, seed: int) -> DataFrame:
    """The documents in batches: ids, digests, sizes, fingerprints and parities of their sets, and the leading shingles one set after the other."""
    by_value = np.argsort(common, kind="stable")
    sorted_common = common[by_value]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = TaskContext.get().partitionId() << 33
        for k, batch in enumerate(batches):
            keys, sizes, prints, parities, counts, leads = [], [], [], [], [], []
            for t in batch["text"]:
                own = shingles_of(t, words, seed)
                keys.append(key_of(own, seed))
                sizes.append(len(own))
                prints.append(int(np.uint64(majority(own)).view(np.int64)))
                parities.append(parity_of(own, fine_bits(len(own))))
                if len(sorted_common) and len(own):
                    at = np.minimum(np.searchsorted(sorted_common, own), len(sorted_common) - 1)
                    own = own[np.argsort(np.where(sorted_common[at] == own, by_value[at] + 1, 0), kind="stable")]
                leads.append(own[:leading(len(own), similarity)])
                counts.append(len(leads[-1]))
            if len(keys):
                yield pd.DataFrame({"batch": [first + k], "doc_id": [batch["doc_id"].to_numpy()], "key": [keys], "n": [sizes], "fp": [prints], "parity": [parities],
                                    "counts": [counts], "leads": [np.concatenate(leads).tobytes()]})

    return rows.mapInPandas(run, BATCHES)


def led(keys: np.ndarray, counts: np.ndarray, leads: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct sets of a batch: leading shingles with the places of their sets, and a mark for the first of equal sets."""
    shingles = np.frombuffer(leads, np.int64)
    own = np.zeros(len(keys), bool)
    own[np.unique(keys, return_index=True)[1]] = True
    place = np.repeat(np.arange(len(keys)), counts)
    return shingles[own[place]], place[own[place]], own


def split(shingles: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles by bucket: their order, how often each occurs, which each entry is, buckets, and 32 bits of each."""
    distinct, which, times = np.unique(shingles, return_inverse=True, return_counts=True)
    bits = distinct.view(np.uint64)
    return distinct, times, which, (bits % np.uint64(buckets)).astype(np.int64), ((bits // np.uint64(buckets)) & LOW_BITS).astype(np.uint32)


def shared_shingles(batches: DataFrame) -> DataFrame:
    """``shingle``, ``key`` of the leading shingles that may lead more than one set; those of one set only are left out but for chance."""
    total = batches.agg(F.sum(F.length("leads"))).first()[0] or 0
    buckets = max(1, total // (8 * BUCKET_SHINGLES))

    def bits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for batch, keys, counts, leads in zip(*(frame[c] for c in ("batch", "key", "counts", "leads"))):
                _, _, _, bucket, low = split(led(keys, counts, leads)[0], buckets)
                order = np.argsort(bucket, kind="stable")
                used, starts = np.unique(bucket[order], return_index=True)
                parts = np.split(low[order], starts[1:])
                yield pd.DataFrame({"bucket": used, "batch": batch, "low": [p.tobytes() for p in parts] if len(used) else []})

    def repeated(group: pd.DataFrame) -> pd.DataFrame:
        low = [np.frombuffer(b, np.uint32) for b in group["low"]]
        _, which, times = np.unique(np.concatenate(low), return_inverse=True, return_counts=True)
        marks = np.split(times[which] > 1, np.cumsum([len(v) for v in low])[:-1])
        return pd.DataFrame({"batch": group["batch"].to_numpy(), "bucket": group["bucket"].to_numpy(), "marks": [np.packbits(m).tobytes() for m in marks]})

    def deal(batch: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for keys, counts, leads in zip(batch["key"], batch["counts"], batch["leads"]):
            shingles, place, _ = led(keys, counts, leads)
            distinct, times, which, bucket, _ = split(shingles, buckets)
            shared = times > 1
            for b, m in zip(answers["bucket"], answers["marks"]):
                at = np.flatnonzero(bucket == b)
                shared[at] |= np.unpackbits(np.frombuffer(m, np.uint8))[:len(at)].astype(bool)
            kept = shared[which]
            out.append(pd.DataFrame({"shingle": shingles[kept], "key": np.asarray(keys)[place[kept]]}))
        return pd.concat(out) if out else pd.DataFrame({"shingle": np.zeros(0, np.int64), "key": np.zeros(0, np.int64)})

    exchange = batches.select("batch", "key", "counts", "leads").mapInPandas(bits, "bucket long, batch long, low binary")
    answers = exchange.groupBy("bucket").applyInPandas(repeated, "batch long, bucket long, marks binary")
    return batches.select("batch", "key", "counts", "leads").groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(deal, "shingle long, key long")


def close(n_a: str, n_b: str, parity_a: str, parity_b: str, similarity: float) -> Column:
    """Whether two sets can be similar, by their sizes and parities."""
    apart = F.aggregate(F.zip_with(parity_a, parity_b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)
    smaller, larger = F.least(n_a, n_b), F.greatest(n_a, n_b)
    return (smaller >= larger * similarity - EPSILON) & (apart <= (F.col(n_a) + F.col(n_b)) * ((1 - similarity) / (1 + similarity)) + EPSILON)


def print_pairs(owners: DataFrame, budget: int = PRINT_BUDGET) -> DataFrame:
    """Pairs ``a``, ``b`` of sets (``key``, ``fp``) that the tries of fingerprints link: the first set of every
    fingerprint with the others of it, and the first ones of fingerprints within ``budget`` bits, as spanning links."""
    prints = stored(few(owners.groupBy("fp").agg(F.min("key").alias("first")), owners.count()), "prints")
    of = lambda c: prints.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}"))
    linked = fingerprint_links(prints.select("fp"), budget).join(of("a"), "a").join(of("b"), "b")
    equal = owners.select("key", "fp").join(prints, "fp").where("key <> first")
    return (linked.select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"))
            .unionAll(equal.select(F.col("first").alias("a"), F.col("key").alias("b"))).distinct())


def centre_pairs(members: DataFrame, salt: int) -> DataFrame:
    """How many shingles (``times``) every set ``key`` shares with each ``centre``, where their groups differ."""
    centre = members.groupBy("shingle").agg(F.min(F.struct(F.xxhash64("key", F.lit(salt)).alias("h"), F.col("key").alias("centre"), F.col("component").alias("of_centre"))).alias("c"))
    met = members.join(centre, "shingle").where("component <> c.of_centre")
    return met.groupBy("key", "c.centre").agg(F.count("*").alias("times"))


def cross_pairs(members: DataFrame, owners: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``a``, ``b`` of sets in different groups that share a leading shingle and can be similar.

    At every shingle its largest group is told apart: each pair has at least one set outside of it.
    """
    sizes = members.groupBy("shingle", "component").agg(F.count("*").alias("c"))
    largest = sizes.groupBy("shingle").agg(F.max_by("component", F.struct("c", "component")).alias("largest"))
    side = members.join(owners.select("key", "n", "parity"), "key")
    outside = side.join(largest, "shingle").where("component <> largest").select("shingle", *[F.col(c).alias(f"{c}_b") for c in ("key", "component", "n", "parity")])
    met = side.join(outside, "shingle").where((F.col("component") != F.col("component_b")) & close("n", "n_b", "parity", "parity_b", similarity))
    return met.select(F.least("key", "key_b").alias("a"), F.greatest("key", "key_b").alias("b")).distinct()


class Sets:
    """Whole shingle sets of those sets that were asked for, each made once."""

    def __init__(self, rows: DataFrame, owners: DataFrame, words: int, seed: int):
        self.rows, self.owners, self.words, self.seed = rows, owners, words, seed
        self.total = owners.count()
        self.parts: list[DataFrame] = []

    def of(self, keys: DataFrame) -> DataFrame:
        """``key``, ``shingles`` of at least ``keys``."""
        words, seed = self.words, self.seed
        new = keys
        for part in self.parts:
            new = new.join(part.select("key"), "key", "left_anti")
        new = stored(few(new, self.total), "keys")
        if not self.parts or not new.isEmpty():
            @F.pandas_udf("key long, shingles array<long>")
            def whole(texts: pd.Series) -> pd.DataFrame:
                made = [shingles_of(t, words, seed) for t in texts]
                return pd.DataFrame({"key": [key_of(m, seed) for m in made], "shingles": made})

            texts = self.rows.where(one_of(self.owners.join(new, "key").select("doc_id")))
            made = texts.select(whole("text").alias("s")).select("s.*").join(new, "key", "left_semi")
            self.parts.append(stored(few(made.groupBy("key").agg(F.first("shingles").alias("shingles")), new.count(), 50_000), "sets"))
        discard(new)
        out = self.parts[0]
        for part in self.parts[1:]:
            out = out.unionAll(part)
        return out

    def discard(self) -> None:
        for part in self.parts:
            discard(part)


def verified(pairs: DataFrame, sets: Sets, similarity: float) -> DataFrame:
    """The ``pairs`` (stored, ``a`` and ``b``) whose whole sets are similar."""
    whole = sets.of(pairs.select(F.col("a").alias("key")).unionAll(pairs.select(F.col("b").alias("key"))).distinct())
    side = lambda c: whole.select(F.col("key").alias(c), F.col("shingles").alias(f"of_{c}"))
    overlap = F.size(F.array_intersect("of_a", "of_b"))
    near = overlap * (1 + similarity) >= (F.size("of_a") + F.size("of_b")) * similarity - EPSILON
    return pairs.join(side("a"), "a").join(side("b"), "b").where(near).select("a", "b")


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY, seed: int = 42) -> DataFrame:
    """Per row of ``docs`` that has an id: the id and ``component_id`` (smallest id reachable over pairs of near copies)."""
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    with held(docs.sparkSession, SETTINGS):
        return groups_of(rows, words, similarity, seed)


def groups_of(rows: DataFrame, words: int, similarity: float, seed: int) -> DataFrame:
    """``near_copies`` of ``rows`` (``doc_id``, ``text``) that have an id."""
    common = common_shingles(rows, F.col("text"), words, seed)
    batches = stored(batched_sets(rows, common, words, similarity, seed), "batches")
    members = stored(shared_shingles(batches).withColumn("component", F.col("key")), "members")
    labels = stored(batches.select(F.explode(F.arrays_zip("doc_id", "key")).alias("d")).select("d.doc_id", "d.key"), "labels")

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def coarse(parity: pd.Series) -> pd.Series:
        return pd.Series([folded(p, PARITY_BITS // 8).view(np.int64) for p in parity], dtype=object)

    known = batches.select(F.explode(F.arrays_zip("doc_id", "key", "n", "fp", "parity")).alias("d")).select("d.*")
    each = known.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("parity").alias("fine"))
    owners = stored(few(each, labels.count(), 100_000).withColumn("parity", coarse("fine")), "owners")
    discard(batches)
    of = lambda c: owners.select(F.col("key").alias(c), F.col("n").alias(f"n_{c}"), F.col("parity").alias(f"parity_{c}"))
    sets, links, groups = Sets(rows, owners, words, seed), None, None
    for turn in range(4):
        if turn < 3:
            if turn == 0:
                pairs = print_pairs(owners)
            else:
                met = centre_pairs(members, turn - 1)
                if turn == 1:  # only the centre that a set shares most with
                    met = met.groupBy("key").agg(F.max_by("centre", F.struct("times", "centre")).alias("centre"))
                pairs = met.select(F.least("key", "centre").alias("a"), F.greatest("key", "centre").alias("b")).distinct()
            pairs = pairs.join(of("a"), "a").join(of("b"), "b").where(close("n_a", "n_b", "parity_a", "parity_b", similarity)).select("a", "b")
        else:
            pairs = cross_pairs(members, owners, similarity)
        pairs = stored(few(alike(pairs, owners, similarity), sets.total, 100_000), "pairs")
        found = stored(few(verified(pairs, sets, similarity), pairs.count(), 100_000), "verified")
        discard(pairs)
        if turn == 3 and found.isEmpty():
            break
        links = found if links is None else links.unionAll(found)
        groups = connected(links, links.count())
        if turn < 3:  # what is left to meet: shingles whose sets are in several groups
            moved = members.drop("component").join(groups, F.col("key") == F.col("node"), "left").select("shingle", "key", F.coalesce("component", "key").alias("component"))
            mixed = moved.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("shingle")
            left = stored(few(moved.join(mixed, "shingle", "left_semi"), members.count()), "members")
            discard(members)
            members = left
    labelled = labels.join(groups, F.col("key") == F.col("node"), "left").select("doc_id", F.coalesce("component", "key").alias("component"))
    smallest = labelled.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    result = stored(few(labelled.join(smallest, "component").select("doc_id", "component_id"), labels.count()), "near_copies")
    for done in (members, labels, owners, sets):
        sets.discard() if done is sets else discard(done)
    return result
