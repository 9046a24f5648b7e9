"""WARC archives and a merged external index of their captures.

Writing: one record per page, the html as payload of an HTTP response.  Of records with equal
payloads of at least ``least_bytes`` bytes, that with the smallest id is a ``response``; the
others are ``revisit`` records, which keep the HTTP header (with the full length) and the digest
but no payload.  The records are the rows of a text table whose line separator is the end of a
WARC record, so that Spark's own writer makes whole gzip archives, committed as any other table.

Index: every archive is parsed by itself and its captures are sorted by URL key and timestamp,
one run per archive.  All runs are cut at the same sampled splitters; the slices of one range
meet in one task, where a loser tree merges them.  ``range_no`` and ``place`` number the merged
captures in global order.  Splitters also cover archive and offset, so the captures of one url
may span ranges.

Cases: null html is an empty payload; smaller payloads are always responses; null ids and null
urls are kept (no header is written for them; the key of a missing url is empty, and a null id
never is the response for others unless no equal payload has an id); of a repeated row that is
the smallest, every copy is a response; CR, LF and % in urls are percent-encoded; extra columns
are ignored; an empty table gives no archive and an empty index.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import stored, tasks_for
from fleetlens.session import scratch_dir

LEAST_BYTES = 100
#: Records in one archive at most, and captures in one range of the merge, about.
ARCHIVE_RECORDS = 5000
RANGE_CAPTURES = 200_000
END = "\r\n\r\n"
CAPTURES = ("url_key string, captured string, archive string, offset bigint, length bigint, record_type string, page_id bigint, "
            "payload_bytes bigint, payload_digest string, refers_to bigint")
MERGED = f"{CAPTURES}, range_no int, place bigint"


def header(name: str, value: Column) -> Column:
    """One header line, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
                   captured: Column | None = None, least_bytes: int = LEAST_BYTES) -> None:
    """Write the archives of ``pages`` under ``path``; ``captured`` is a timestamp column."""
    body = F.coalesce(F.col(html), F.lit(""))
    when = F.coalesce(captured if captured is not None else F.timestamp_seconds(F.lit(0)), F.timestamp_seconds(F.lit(0)))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), body.alias("body"), F.sha2(body, 256).alias("digest"),
                        F.octet_length(body).cast("bigint").alias("size"), F.date_format(F.to_utc_timestamp(when, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"))
    first = (rows.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
             .where("copies > 1 and first is not null").select("digest", "first"))
    refers = F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    shown = rows.join(first, "digest", "left").withColumn("refers_to", refers)
    safe = F.replace(F.replace(F.replace(F.col("url"), F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    again = F.col("refers_to").isNotNull()
    block = F.octet_length(http) + F.when(again, F.lit(0)).otherwise(F.col("size"))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(again, "revisit").otherwise("response"), F.lit("\r\n"),
        header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))),
        header("WARC-Target-URI", safe), header("WARC-Date", F.col("date")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.when(again, header("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        F.lit("Content-Length: "), block.cast("string"), F.lit(END), http, F.when(again, F.lit("")).otherwise(F.col("body")))
    shown.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path)


def url_key(url: str | None) -> str:
    """Sort-friendly key: host labels in reverse, then path and query, all in lower case."""
    if not url or "://" not in url:
        return (url or "").lower()
    rest = url.split("://", 1)[1].split("#", 1)[0]
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    return (",".join(reversed(rest[:cut].lower().split("."))) + ")" + rest[cut:].lower())


def records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset and length in the uncompressed archive, WARC headers and block of every record, by their declared lengths.

    The archive is unpacked as it is read; one record is held at a time.
    """
    at = 0
    with gzip.open(io.BytesIO(data)) as raw:
        while first := raw.readline():
            if not first.startswith(b"WARC/"):
                raise ValueError(f"no WARC record at {at}")
            fields, size = {}, len(first) + 2
            while (line := raw.readline()) != b"\r\n":
                if not line.endswith(b"\r\n"):
                    raise ValueError(f"headers of the record at {at} do not end")
                name, value = line[:-2].decode("utf-8").split(": ", 1)
                fields[name] = value
                size += len(line)
            block = raw.read(int(fields["Content-Length"]))
            size += len(block)
            if len(block) != int(fields["Content-Length"]) or raw.read(4) != b"\r\n\r\n":
                raise ValueError(f"record at {at} does not end where it says")
            yield at, size, fields, block
            at += size + 4


def page_number(urn: str | None) -> int | None:
    return int(urn[len("<urn:page:"):-1]) if urn else None


def capture(archive: str, at: int, length: int, fields: dict[str, str], block: bytes) -> tuple:
    """Index entry of a record; the digest of a response is that of the payload read, and must be the declared one."""
    head, _, payload = block.partition(b"\r\n\r\n")
    declared = int(next(x.split(b": ")[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length: ")))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != declared):
        raise ValueError(f"{archive}: damaged record at {at}")
    url = fields.get("WARC-Target-URI")
    url = url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return (url_key(url), fields["WARC-Date"], archive, at, length, fields["WARC-Type"], page_number(fields.get("WARC-Record-ID")), declared, digest, page_number(fields.get("WARC-Refers-To")))


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """One sorted run of captures per archive."""
    names = [f.split()[0] for f in CAPTURES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, data in zip(batch["path"], batch["content"]):
                found = [capture(archive.rsplit("/", 1)[-1], *r) for r in records(data)]
                found.sort(key=lambda c: c[:4])
                yield nullable(pd.DataFrame(found, columns=names))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInPandas(run, CAPTURES)


def nullable(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.astype({"page_id": "Int64", "refers_to": "Int64"})


class LoserTree:
    """Tournament of k sorted iterators; inner nodes keep the loser, the top the winner."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.tree = [-1] * k
        for i in range(k):
            self.sift(i, building=True)

    def beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def sift(self, player: int, building: bool = False) -> None:
        node = (player + len(self.runs)) // 2
        while node:
            held = self.tree[node]
            if held < 0 and building:
                self.tree[node] = player
                return
            if self.beats(held, player):
                self.tree[node], player = player, held
            node //= 2
        self.tree[0] = player

    def __iter__(self) -> Iterator[tuple[tuple, int]]:
        while self.runs and self.heads[self.tree[0]] is not None:
            winner = self.tree[0]
            yield self.heads[winner], winner
            self.heads[winner] = next(self.runs[winner], None)
            self.sift(winner)


def merged_index(runs: DataFrame, range_captures: int = RANGE_CAPTURES) -> DataFrame:
    """All captures in global order of (url_key, captured, archive, offset), numbered by ``range_no`` and ``place``."""
    spark = runs.sparkSession
    total = runs.count()
    order = ("url_key", "captured", "archive", "offset")
    ranges = runs.repartitionByRange(tasks_for(spark, total, range_captures), *order).sortWithinPartitions("archive", *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        rows = pd.concat(held, ignore_index=True)
        keys = list(zip(*(rows[c].tolist() for c in order), range(len(rows))))
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i][2] != keys[i - 1][2]), len(keys)]
        tree = LoserTree([iter(keys[a:b]) for a, b in zip(cuts, cuts[1:])])
        out = rows.iloc[[key[-1] for key, _ in tree]].copy()
        out["place"] = range(len(out))
        yield nullable(out)

    numbered = ranges.withColumn("range_no", F.spark_partition_id())
    return numbered.mapInPandas(run, MERGED)


def capture_history(pages: DataFrame, captured: Column | None = None, **columns: str) -> DataFrame:
    """Write the archives of ``pages``, read them back, and merge their runs into one index."""
    spark = pages.sparkSession
    path = scratch_dir(spark, "archives")
    write_archives(pages, path, captured=captured, **columns)
    return merged_index(stored(capture_runs(spark, path), "runs"))
