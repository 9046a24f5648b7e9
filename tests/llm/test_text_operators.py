"""Language identification, decontamination and secret scans."""
import random
import zlib

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import decontaminate as D
from fleetlens.llm import language as L
from fleetlens.llm import secrets as S

WORDS = {"en": "the and of to in is that with from which house water night", "de": "der und die das nicht mit ein auf sich haus wasser nacht",
         "fr": "le la les des une est dans pour maison avec eau nuit"}


def sentence(lang, rng, n):
    words = WORDS[lang].split()
    return " ".join(rng.choice(words) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    return [(i, lang, sentence(lang, rng, rng.randint(20, 120))) for i in range(150) for lang in [list(WORDS)[i % 3]]]


def test_languages_are_told_on_held_out_rows(spark, corpus):
    rows = [(i, t, lang) for i, lang, t in corpus] + [(1000, None, "en"), (1001, "", "de"), (1002, "12 -- 3", None), (None, corpus[0][2], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit(1))
    got = L.identify(df).select("doc_id", "source", "language.*", L.held_out(F.col("doc_id")).alias("held")).collect()
    assert len(got) == len(rows)
    truth = {i: lang for i, lang, _ in corpus}
    for r in got:
        assert r["held"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in (1000, 1001, 1002):
            assert (r["lang"], r["score"], r["rejected"]) == ("und", 0.0, True)
        elif r["doc_id"] is None:
            assert r["lang"] == "en"
        elif r["held"]:
            assert r["lang"] == truth[r["doc_id"]] and not r["rejected"]


def test_languages_without_labels(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert L.identify(df).select("language.lang", "language.rejected").collect() == [("und", True)]
    assert L.identify(df.limit(0)).count() == 0
    one = spark.createDataFrame([(i, "some text here", "xx") for i in range(8)], "doc_id long, text string, lang string")
    assert {tuple(r) for r in L.identify(one).select("language.lang", "language.score").collect()} == {("xx", 1.0)}


def distance_to_part(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    best = min(row)
    return best, row.index(best)


def test_myers():
    rng = random.Random(2)
    for _ in range(150):
        item = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 70)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 90)))
        masks = {}
        for i, ch in enumerate(item):
            masks[ch] = masks.get(ch, 0) | 1 << i
        assert D.myers(masks, len(item), text) == distance_to_part(item, text)


def test_leaks_against_brute_force(docs_of, spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("etaoin") for _ in range(rng.randint(1, 8)))
    items = [" ".join(word() for _ in range(rng.randint(8, 30))) for _ in range(8)]
    items += [items[0], "short", None]

    def edited(t):
        t = list(t)
        for _ in range(rng.randint(0, 2 + len(t) // 12)):
            at = rng.randrange(len(t))
            t[at:at + rng.randint(0, 1)] = rng.choice(["", "x", "yz"])
        return "".join(t)

    texts = [None, "", "   ", "Too SHORT, or not", "shorter shorts", items[1].upper() + "!!", *(" ".join([word() for _ in range(9)] + [edited(rng.choice(items[:8])) for _ in range(rng.randint(0, 3))] + [word()]) for _ in range(40))]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for block in (10 ** 6, 100):
        got = {(r["doc_id"], r["item_id"]): r["distance"] for r in D.leaks(docs_of(list(enumerate(texts))), bench, block_chars=block).collect()}
        want = {}
        for i, t in enumerate(texts):
            for j, x in enumerate(items):
                x = D.reduced(x)
                best = distance_to_part(x, D.reduced(t))[0] if x else 9
                if len(x) >= D.LEAST_CHARS and best <= len(x) // D.CHARS_PER_ERROR:
                    want[i, j] = best
                elif x and len(x) < D.LEAST_CHARS and f" {x} " in f" {D.reduced(t)} ":
                    want[i, j] = 0
        assert got == want and len(want) > 10
        clean = D.without_leaks(docs_of(list(enumerate(texts))), bench, block_chars=block)
        assert sorted(r["doc_id"] for r in clean.collect()) == sorted(set(range(len(texts))) - {i for i, _ in want})
        assert clean.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert D.leaks(docs_of([]), bench).count() == 0 and D.leaks(docs_of([(1, "x")]), bench.limit(0)).count() == 0


HEX = "0123456789abcdef"


def test_base_spans():
    key = "AKIA" + "A1" * 8
    text = f'api_KEY: "abc123" token=short token = tokens.are+long {key} {"ab1" * 8} {"a" * 23} AKIAX ſecret=abcdefg'
    found = [(text[s:e], k) for s, e, k, _ in S.base_spans(text)]
    assert found == [('api_KEY: "abc123', "assign"), ("token = tokens.are+long", "assign"), (key, "access"), ("ab1" * 8, "hex")]
    assert S.base_spans("password=token=abcdef")[0][:3] == (0, 21, "assign")


def test_learned_formats_are_found_and_prose_is_not(docs_of):
    rng = random.Random(1)
    token = lambda n: "".join(rng.choice(HEX) for _ in range(n))
    prose = lambda n: " ".join("".join(rng.choice("thousand") for _ in range(rng.randint(2, 24))) for _ in range(n))
    pairs = [(i, f"{prose(20)} secret = {token(40)} {prose(5)}") for i in range(120)]
    split = "_".join(token(10) for _ in range(2))
    pairs += [(500, f"{prose(9)} {split} {prose(9)}"), (501, prose(60)), (502, None), (503, ""), (504, "x" * 100_000)]
    docs = docs_of(pairs)
    model = S.learn(docs)
    got = {r["doc_id"]: r["s"] for r in docs.select("doc_id", S.scan(F.col("text"), model).alias("s")).collect()}
    texts = dict(pairs)
    for i in range(120):
        assert [texts[i][x["start"]:x["end"]] for x in got[i] if x["kind"] == "hex"] == [texts[i].split("secret = ")[1].split(" ")[0]]
    assert got[502] == got[503] == [] and not got[501]
    clean = {r["doc_id"]: r["c"] for r in docs.select("doc_id", S.redact(F.col("text"), model).alias("c")).collect()}
    assert clean[502] is None and clean[501] == texts[501]
    assert all("[SECRET]" in clean[i] and texts[i].split("secret = ")[1].split(" ")[0] not in clean[i] for i in range(120))
    assert S.learn(docs_of([])) == {} and S.spans_of("token=abcdefgh", S.judge({})) == [(0, 14, "assign")]


ALNUM = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def credentials(seed):
    rng = random.Random(seed)
    some = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    return lambda: [f"sk-live-{some(ALNUM, 24)}", f"ghp_{some(ALNUM, 36)}"], lambda n: " ".join(some("thousand", rng.randint(2, 24)) for _ in range(n))


def test_automata_tell_prefixes_layouts_and_lengths():
    fresh, _ = credentials(3)
    keys = [x for _ in range(120) for x in fresh()]
    rng = random.Random(4)
    names = ["".join(rng.choice("aeiourstlnmd") for _ in range(rng.randint(6, 24))) for _ in range(200)]
    a, b = S.Automaton(keys), S.Automaton(names)
    assert 5 < len(a.next) < 400 and len(b.next) < 400
    for _ in range(20):
        sk, ghp = fresh()
        assert a.score(sk) > b.score(sk) + 30 and a.score(ghp) > b.score(ghp) + 30
        assert a.score(sk) > a.score("ks" + sk[2:]) + 2 and a.score(ghp) > a.score(ghp[4:] + ghp[:4]) + 2
        assert a.score(sk) > a.score(sk + "a") + 2
    assert b.score("rememberednotions") > a.score("rememberednotions")


def test_planted_formats_are_found_unlabelled(docs_of):
    """Formats that stand behind keywords are found without one; so are parts beside a base span; prose stays."""
    fresh, prose = credentials(9)
    labelled = [(2 * i + j, f"{prose(12)} {word}{x}\" {prose(6)}") for i in range(90) for j, (word, x) in enumerate(zip(('secret = "', 'token: "'), fresh()))]
    planted = [(1000 + i, x) for i in range(6) for x in fresh()[i % 2:i % 2 + 1]]
    key = "AKIA" + "B3" * 8
    tail, (head, rest) = fresh()[1], fresh()
    beside = [(2000, f"{prose(5)} {key}/{tail} {prose(5)}"), (2001, f"{prose(5)} {head}={'0a' * 12}.{rest} {prose(5)}")]
    plain = [(3000 + i, prose(3000)) for i in range(20)] + [(3100, "x" * 50_000), (3101, None), (3102, "")]
    rows = labelled + [(i, f"{prose(10)} {x}, {prose(10)}") for i, x in planted] + beside + plain
    docs = docs_of(rows + rows[-2:] + rows[:3]).withColumn("kind", F.lit("x")).withColumn("value", F.lit(1))
    model = S.learn(docs)
    assert len(model["assign"].next) > 1 and len(model[S.OTHER].next) > 1
    got = {r["doc_id"]: r["s"] for r in docs.select("doc_id", S.scan(F.col("text"), model).alias("s")).collect()}
    texts = dict(rows)
    learned = lambda i: [texts[i][x["start"]:x["end"]] for x in got[i] if x["kind"] == "learned"]
    assert all(learned(i) == [x] for i, x in planted)
    assert learned(2000) == [tail] and learned(2001) == [head, rest]
    assert not any(got[3000 + i] for i in range(20)) and got[3101] == got[3102] == []
    assert not any(learned(i) for i, _ in labelled)
    assert S.learn(docs)["assign"].logs == model["assign"].logs
    assert S.learn(docs_of([])) == {}


def test_spans_against_brute_force():
    """Runs are walked character by character, and every token is judged by the automata themselves."""
    rng = random.Random(12)
    fresh, prose = credentials(2)
    model = {"assign": S.Automaton([x for _ in range(60) for x in fresh()]), S.OTHER: S.Automaton(prose(400).split())}
    secret = S.judge(model)
    pieces = [lambda: fresh()[0], lambda: fresh()[1], lambda: prose(1), lambda: "AKIA" + "C4" * 8, lambda: "0f" * 13, lambda: "token=abcdefg",
              lambda: rng.choice([" ", " ", "/", "..", "=", "-", ", ", "é"])]
    some = 0
    for _ in range(200):
        text = "".join(rng.choice(pieces)() for _ in range(rng.randint(0, 14)))
        base = S.base_spans(text)
        inside = [any(s <= i < e for s, e, _, _ in base) for i in range(len(text))]
        want, i = [(s, e, k) for s, e, k, _ in base], 0
        good = lambda i: i < len(text) and text[i] in ALNUM + "+/_.=-" and not inside[i]
        while i < len(text):
            j = i
            while good(j):
                j += 1
            a, b = i, j
            while a < b and text[a] not in ALNUM:
                a += 1
            while b > a and text[b - 1] not in ALNUM:
                b -= 1
            if b - a >= 6 and S.gain(text[a:b], model) > S.LEAST_GAIN:
                want.append((a, b, "learned"))
                some += 1
            i = max(j, i + 1)
        assert S.spans_of(text, secret) == sorted(want, key=lambda x: (x[0], S.KINDS.index(x[2])))
    assert some > 50


def test_language_needs_a_letter(docs_of):
    """Numerals and marks are no letters; ties go to one of the languages, long texts and a clashing column do no harm."""
    rows = [(1, "½ ² Ⅷ ٣"), (2, "́̈ 123"), (3, ""), (4, None), (5, "Ünïcode is fine here"), (6, "und so weiter " * 40_000)]
    content = {"de": b"der die das und so weiter oder nicht", "en": b"the and so on or not is fine here"}
    docs = docs_of(rows).withColumn("language", F.lit("x"))
    got = {r["doc_id"]: r["v"] for r in docs.select("doc_id", L.classify(F.col("text"), content).alias("v")).collect()}
    assert all((got[i]["lang"], got[i]["score"]) == ("und", 0.0) for i in (1, 2, 3, 4))
    assert got[6]["lang"] == "de" and got[5]["lang"] in content and 0 <= got[5]["score"] <= 1
