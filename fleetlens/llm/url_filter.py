"""URL filters over a sorted digest array.

A rule is a host and a path (kept as one string, ``host/path``) with a verdict; it fits a url of
that host or a subdomain of it whose path starts with the rule's.  The longest fitting rule
wins; of equally long ones that with the longer host.  A url that no rule fits gets ``default``.

The rules' 64-bit xxhash keys are written as one sorted array with the full strings beside it.
Spark ships the files to every executor, where Python workers map them into memory: all
processes of a machine share the pages.  For a batch of urls the keys of all (host suffix, path
prefix) pairs that a rule could have are looked up in one binary search, and a hit counts only
if the stored string is equal.  A list of more than ``most_mapped`` rules is not shipped: the
same pairs are joined with the rules on the key and the string.

Cases: null urls and urls without ``://`` have an empty host and path and fit no rule; A-Z in
hosts are lower-cased, paths are taken as they are; repeated rules with one verdict are one rule,
contradicting ones block; repeated rows are judged each; extra columns are ignored; without
rules, or for an empty table, all (no) urls get ``default``.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 42
#: Most rules in the mapped array: 100 million take about 0.8 GB of keys and a few GB of strings on each machine's disk.
MOST_MAPPED = 100_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1)


class DigestArray:
    """Files of one rule list: sorted keys, verdicts, ends of the strings, and the strings."""

    PARTS = ("keys", "block", "ends", "text")

    def __init__(self, name: str, lengths: list[int], count: int):
        self.name, self.lengths, self.count, self.open = name, lengths, count, None

    def __getstate__(self):
        return {**self.__dict__, "open": None}

    @classmethod
    def build(cls, rules: DataFrame) -> DigestArray:
        """Write the array of ``rules`` (rule, path_length, blocks), and ship it to the executors.

        Rows stream through the driver in key order; it holds one partition of them at a time.
        """
        spark = rules.sparkSession
        folder, name = tempfile.mkdtemp(prefix="digests-"), uuid.uuid4().hex
        paths = {p: os.path.join(folder, f"{name}.{p}") for p in cls.PARTS}
        files = {p: open(path, "wb") for p, path in paths.items()}
        lengths, count, end = set(), 0, 0
        for row in rules.select("rule", "path_length", "blocks", F.xxhash64("rule").alias("key")).orderBy(F.col("key") < 0, "key").toLocalIterator():
            text = row["rule"].encode()
            end += len(text)
            files["keys"].write(np.array([row["key"]], np.int64).tobytes())
            files["block"].write(b"\1" if row["blocks"] else b"\0")
            files["ends"].write(np.array([end], np.int64).tobytes())
            files["text"].write(text)
            lengths.add(row["path_length"])
            count += 1
        for p in cls.PARTS:
            files[p].close()
            if count:
                spark.sparkContext.addFile(paths[p])
        return cls(name, sorted(lengths), count)

    def maps(self):
        if self.open is None:
            at = {p: SparkFiles.get(f"{self.name}.{p}") for p in self.PARTS}
            self.open = tuple(np.memmap(at[p], dtype=t, mode="r") for p, t in zip(self.PARTS, (np.uint64, np.uint8, np.int64, np.uint8)))
        return self.open

    def probe(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[bool | None]]:
        """The winning rule and whether it blocks, per url."""
        rules: list[str | None] = [None] * len(hosts)
        blocks: list[bool | None] = [None] * len(hosts)
        if not self.count:
            return rules, blocks
        keys, block, ends, text = self.maps()
        owner, wanted = [], []
        for i, (host, path) in enumerate(zip(hosts, paths)):
            for suffix, prefix in candidates(host, path, self.lengths):
                owner.append(i)
                wanted.append((suffix + prefix, len(suffix)))
        digests = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "replace"), SEED) for w, _ in wanted), np.uint64, len(wanted))
        first = np.searchsorted(keys, digests, side="left")
        best: dict[int, tuple[int, int]] = {}
        for k in np.flatnonzero((first < self.count) & (keys[np.minimum(first, self.count - 1)] == digests)):
            word, host_length = wanted[k]
            raw, at = word.encode("utf-8", "replace"), int(first[k])
            while at < self.count and keys[at] == digests[k]:
                begin = int(ends[at - 1]) if at else 0
                if bytes(text[begin:ends[at]]) == raw:
                    rank = (len(word), host_length)
                    if rank > best.get(owner[k], (-1, -1)):
                        best[owner[k]] = rank
                        rules[owner[k]], blocks[owner[k]] = word, bool(block[at])
                    break
                at += 1
        return rules, blocks


def candidates(host: str, path: str, lengths: list[int]):
    """All (host suffix at a label, path prefix of a length that rules have) pairs."""
    prefixes = [path[:n] for n in lengths if n <= len(path)]
    at = 0
    while host and prefixes:
        for prefix in prefixes:
            yield host[at:], prefix
        at = host.find(".", at) + 1
        if not at:
            break


def judged(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow", most_mapped: int = MOST_MAPPED) -> DataFrame:
    """Per row of ``pages``: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``.

    ``rules`` has the columns ``host``, ``path`` and ``verdict`` (allow or block).
    """
    clean = (rules.where("host is not null and path is not null and verdict in ('allow', 'block')")
             .select(F.concat(F.translate("host", UPPER, LOWER), "path").alias("rule"), F.length("path").alias("path_length"), (F.col("verdict") == "block").alias("blocks"))
             .groupBy("rule", "path_length").agg(F.max("blocks").alias("blocks")))
    urls = pages.select(F.col(page_id).alias("page_id"), F.coalesce(host_of(F.col(url)), F.lit("")).alias("host"), F.coalesce(path_of(F.col(url)), F.lit("")).alias("path"))
    word = F.when(F.col("blocks"), "block").when(~F.col("blocks"), "allow").otherwise(default)
    if clean.count() > most_mapped:
        return joined(urls, clean).select("page_id", "host", "path", "rule", word.alias("verdict"))
    array = DigestArray.build(clean)

    @F.pandas_udf("struct<rule:string,blocks:boolean>")
    def probe(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        found, blocks = array.probe(hosts.tolist(), paths.tolist())
        return pd.DataFrame({"rule": pd.Series(found, dtype=object), "blocks": pd.Series(blocks, dtype=object)})

    return (urls.withColumn("hit", probe("host", "path")).select("page_id", "host", "path", "hit.rule", "hit.blocks")
            .select("page_id", "host", "path", "rule", word.alias("verdict")))


def joined(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The same by a join: distinct (host, path) pairs, their candidate strings, and the longest rule of each."""
    lengths = [r[0] for r in rules.select("path_length").distinct().collect()]
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda p: p.isNotNull())
    pairs = (urls.select("host", "path").distinct().where("host <> ''")
             .select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
             .select("host", "path", F.length("suffix").alias("host_length"), F.explode("prefixes").alias("prefix"), "suffix")
             .select("host", "path", "host_length", F.concat("suffix", "prefix").alias("rule")))
    best = (pairs.join(rules, "rule").groupBy("host", "path")
            .agg(F.max_by(F.struct("rule", "blocks"), F.struct(F.length("rule"), "host_length")).alias("hit")))
    return urls.join(best, ["host", "path"], "left").select("page_id", "host", "path", "hit.rule", "hit.blocks")
