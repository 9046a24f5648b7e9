"""Conversation repair against a search over whole edit sequences."""
import hashlib
import random
import re

import pytest

from fleetlens.llm import structure

SCHEMA = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256().hexdigest()


def brute(rows):
    """Expected summary of one conversation from (turn, role, text) rows: least (cost, audit) over all edits, kept per exact role string state."""
    rows = sorted(((t, r or "", x or "") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(structure.BLANK)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    def key(initials):  # what matters of a role string: whether it can go on, and how
        for k, shape in enumerate([r"", r"s", r"s?(ua)*u", r"s?(ua)+"]):
            if re.fullmatch(shape, initials):
                return k
        return None

    def put(into, initials, cost, audit, lines):
        k = key(initials)
        if k is not None and (k not in into or (cost, audit) < into[k][:2]):
            into[k] = (cost, audit, lines, initials[-4:] if len(initials) > 4 and key(initials[-4:]) == k else initials)
            return True
        return False

    def insert(states):
        again = True
        while again:
            again = False
            for cost, audit, lines, initials in list(states.values()):
                for r in ("user", "assistant"):
                    again |= put(states, initials + r[0], cost + 3, audit + "I", lines + [f"{r}:"])
        return states

    now = insert({0: (0, "", [], "")})
    for (_, role, text), fault in zip(rows, faults):
        then = {}
        for cost, audit, lines, initials in now.values():
            put(then, initials, cost + 4, audit + "D", lines)
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                if role:
                    put(then, initials + role[0], cost + extra, audit + "K", lines + [f"{role}:{text}"])
                for r in ("user", "assistant"):
                    put(then, initials + r[0], cost + 3 + extra, audit + "R", lines + [f"{r}:{text}"])
        now = insert(then)
    cost, audit, lines, _ = min(v for k, v in now.items() if k in (0, 3))
    turns = [t for t, _, _ in rows if t is not None]
    firsts = [r[:1] for _, r, _ in rows]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def repaired(spark, rows, **options):
    out = structure.Repair(spark.createDataFrame(rows, SCHEMA), **options).summary().collect()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r["conv_id"]: tuple(r[n] for n in names) for r in out}


def by_conv(rows):
    out = {}
    for c, *rest in rows:
        out.setdefault(c, []).append(tuple(rest))
    return out


def random_rows(seed, convs, most):
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "what", "is it?", "", "  \t", None, "well...", "cut off in the mid"]
    return [(c, rnd.choice([t, t, None, t + 2]), rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rnd.choice(texts) or rnd.choice([None, ""]))
            if rnd.random() < 0.5 else (c, t, ("user", "assistant")[t % 2], f"turn {t}.") for c in range(convs) for t in range(rnd.randrange(most))]


@pytest.mark.parametrize("options", [{}, {"chunk_rows": 3, "partitions": 5}, {"chunk_rows": 2, "passes": 0}])
def test_agrees_with_the_search(spark, options):
    rows = random_rows(7, 60, 14) + [(-1, *r[1:]) for r in random_rows(8, 1, 2)] + [(None, 1, "user", "Hi."), (None, 1, "user", "Hi.")]
    expected = {c: brute(r) for c, r in by_conv(rows).items()}
    assert repaired(spark, rows, **options) == expected


@pytest.mark.parametrize("role", ["tool", "system", "user"])
def test_chunks_that_never_converge(spark, role):
    """Rows that fit nowhere alternate between two vectors, and repeated rows leave a vector as it is."""
    odd = [(1, i, role, f"{i}.") for i in range(41)]
    repeated = [(2, 0, "user", "a.")] + [(2, i, "assistant", "b.") for i in range(1, 40)] + [(2, 40, "user", "c.")]
    rows = odd + repeated
    expected = {c: brute(r) for c, r in by_conv(rows).items()}
    for passes in (0, 1, 30):
        assert repaired(spark, rows, chunk_rows=4, passes=passes) == expected


def test_edits_and_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Again?"), (1, 2, "assistant", "So"), (2, 0, "assistant", "Yes.")]
    fixed = structure.Repair(spark.createDataFrame(rows, SCHEMA))
    steps = [tuple(r) for r in fixed.edits().orderBy("conv_id", "place", "part").collect()]
    assert [s for s in steps if s[0] == 2] == [(2, 1, 0, "I", "user", ""), (2, 1, 1, "K", "assistant", "Yes.")]
    assert "".join(s[3] for s in steps if s[0] == 1) == brute([r[1:] for r in rows[:3]])[6]
    roles = [(r["conv_id"], r["role"][0]) for r in fixed.repaired().orderBy("conv_id", "place", "part").collect()]
    assert all(re.fullmatch("(s?(ua)+)?", "".join(x for c, x in roles if c == conv)) for conv in (1, 2))


def test_empty_long_and_extra_columns(spark):
    assert repaired(spark, []) == {}
    long = "word " * 200_000 + "."
    df = spark.createDataFrame([(5, 0, "user", long, 1), (5, 1, "assistant", "Ok.", 2)], SCHEMA + ", ordinal int")
    row = structure.Repair(df).summary().first()
    assert row["audit"] == "KK" and row["repaired_sha256"] == hashlib.sha256(f"user:{long}\nassistant:Ok.".encode()).hexdigest()


def test_fix_up_stops_where_vectors_meet():
    codes = bytes([1, 2, 1, 2, 0, 1, 2, 3, 1, 2] * 20)
    first = structure.vectors(codes, structure.END)
    other = structure.vectors(codes, structure.before(8 | 1, structure.before(0, structure.END)))
    assert structure.vectors(codes, other[-4:], first) == other and other[:4] == first[:4] and other != first


def test_damage(spark):
    import zlib
    rows = [(c, t, "assistant", "One. Two!") for c in range(30) for t in range(5)] + [(None, None, None, None)]
    got = by_conv([tuple(r) for r in structure.damaged(spark.createDataFrame(rows, SCHEMA)).collect()])
    want = []
    for c, t, r, x in rows:
        way = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", x or " "
        new = (c, t, "user" if way == 4 else r, "" if way == 1 else re.sub("[.!?]", "", x) if way == 2 else x)
        want += [] if way == 0 else [new] * (2 if way == 3 else 1)
    want = by_conv(want)
    assert {c: sorted(v, key=str) for c, v in got.items()} == {c: sorted(v, key=str) for c, v in want.items()}
