import gzip
import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import warc as W

PAGES = "page_id long, url string, html string, payload_bytes string"


def test_records_and_index(spark, tmp_path):
    big, other = "<p>é</p>" * 20 + "\r\n\r\nWARC/1.1\r\n\r\n", "z" * 100
    rows = [(4, "http://B.org/x", big), (2, "http://a.b.org/y?q#f", big), (9, None, big), (3, "http://b.org/x", "small"), (8, "http://b.org/x", "small"), (5, "no scheme", None),
            (6, "http://c/%0D\r\n", ""), (7, "http://c/", other), (7, "http://c/", other), (None, "http://c/", other), (None, "http://d", "y" * 200), (10, "http://d", "y" * 99)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], PAGES)
    got = W.capture_history(pages, captured=F.timestamp_seconds(F.coalesce("page_id", F.lit(0)))).orderBy("range_no", "place").collect()

    def want(i, html):
        data = (html or "").encode()
        same = [j for j, _, h in rows if h == html and j is not None] if len(data) >= 100 else []
        first = min(same, default=None)
        again = first is not None and first != i
        return (i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None)

    key = lambda t: tuple((x is None, x) for x in t)
    assert sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got], key=key) == sorted([want(i, h) for i, _, h in rows], key=key)
    order = [(r["url_key"], r["captured"], r["archive"], r["offset"]) for r in got]
    assert order == sorted(order) and {r["url_key"] for r in got} >= {"org,b,a)/y?q", "org,b)/x", "", "c)/%0d\r\n"}


def test_archives_are_plain_warc_files(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<html>é"), (2, "http://b/", "")], "page_id long, url string, html string")
    W.write_archives(pages, str(tmp_path / "w"))
    files = sorted(Path(tmp_path / "w").glob("part-*"))
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert raw.count(b"WARC/1.1\r\n") == 2 and raw.endswith(b"\r\n\r\n")
    assert b"Content-Length: 8\r\n\r\n<html>\xc3\xa9\r\n\r\n" in raw
    runs = W.capture_runs(spark, str(tmp_path / "w")).collect()
    assert {r["page_id"] for r in runs} == {1, 2}


def test_records_are_read_as_a_stream():
    """Records lie where they say, over several gzip members; damaged archives are told."""
    parts = [b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n%s" % (len(x), x) for x in (b"", b"a\r\n\r\nWARC/1.1\r\n", b"z" * 3_000_000)]
    whole = b"".join(p + b"\r\n\r\n" for p in parts)
    got = list(W.records(gzip.compress(whole[:70]) + gzip.compress(whole[70:])))
    assert [whole[at:at + n] for at, n, _, _ in got] == parts and [len(b) for *_, b in got] == [0, 15, 3_000_000]
    for bad in (whole[:-1], whole[:20], b"x" + whole, whole + b"\r\n"):
        with pytest.raises(ValueError):
            list(W.records(gzip.compress(bad)))
    assert list(W.records(gzip.compress(b""))) == []


def test_empty(spark):
    assert W.capture_history(spark.createDataFrame([], PAGES)).count() == 0


def test_loser_tree():
    rng = random.Random(1)
    for k in range(0, 9):
        runs = [sorted(rng.randint(0, 20) for _ in range(rng.randint(0, 12))) for _ in range(k)]
        tree = W.LoserTree([iter([(x,) for x in r]) for r in runs]) if k else []
        assert [x for (x,), _ in tree] == sorted(sum(runs, []))
