import pytest

from fleetlens.llm import url_filter as U

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("x.com", "", "block"),
         ("dup.net", "/", "allow"), ("dup.net", "/", "block"), ("dup.net", "/", "block"), (None, "/", "block"), ("a.b", "/é", "block")]
URLS = ["http://www.Example.ORG/es/1?x", "http://example.org/en/12", "http://example.org/en/2", "https://notexample.org/es/", "ftp://a.com/de/x#y", "http://a.com/DE/", "http://com/fr/", "http://x.com",
        "http://y.x.com?q=/de/", "http://x.com/de/", "no scheme", None, "", "://", "http:///path", "http://org", "http://org.:80/", "a://b://c.org/", "http://dup.net/", "http://A.b/é/", "http://x.com/de/\nz", "http://www.Example.ORG/es/1?x"]


def by_hand(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[:min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fit = [(len(h + p), len(h), v == "block", h + p) for h, p, v in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], "allow" if not best or not best[2] else "block"


@pytest.mark.parametrize("most", [U.MOST_MAPPED, 3])
def test_against_plain_rules(spark, most):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id long, url string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r["page_id"]: tuple(r)[1:] for r in U.judged(pages, rules, most_mapped=most).collect()}
    assert got == {i: by_hand(u) for i, u in enumerate(URLS)}


def test_no_rules_and_no_pages(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a/")], "page_id long, url string")
    assert [tuple(r) for r in U.judged(pages, rules, default="block").collect()] == [(1, "a", "/", None, "block")]
    assert U.judged(pages.limit(0), rules).count() == 0


def test_equal_digests_are_told_apart_by_their_strings(monkeypatch, spark):
    array = U.DigestArray.build(spark.createDataFrame([("a/", 1, True), ("b/", 1, False)], "rule string, path_length int, blocks boolean"))
    keys, block, ends, text = array.maps()
    import numpy as np
    array.open = (np.full(2, 7, np.uint64), block, ends, text)
    monkeypatch.setattr(U.xxhash, "xxh64_intdigest", lambda *a: 7)
    assert array.probe(["b", "c", "a"], ["/", "/", "/"]) == (["b/", None, "a/"], [False, None, True])
