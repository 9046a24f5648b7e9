"""Secret scans with probabilistic automata inferred from labelled credentials.

Base patterns find assignments, access keys and long hex strings.  Their values are the labelled
credentials: a bounded sample per kind becomes a prefix tree over character classes, whose
statistically compatible states are merged into a probabilistic automaton.  Two states are compatible
if their classes, characters and ends differ by no more than Hoeffding bounds (as in ALERGIA), in
all states below them too; of several, the one that explains the rows below best is taken, and
a credential state with fewer than ``LEAST_ROWS`` rows always falls to the one that does.  A state's characters and a kind's lengths
are smoothed frequencies.  A sample of the other tokens gives a background automaton by the same
method.  Every token outside the base spans is scored, and the parts outside of tokens that base spans
touch: the log-likelihood under the best credential automaton minus that under the background must
exceed ``least_gain``.

Cases: null and empty texts have no spans; with no labelled credential, or no other token to
compare with, the method adds nothing; repeated values train once; equal starts are ordered by
kind; a learned span never overlaps a base span; extra columns are kept by ``redact`` and
ignored by ``scan``; empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import nsmallest

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import smallest

#: Bound of the training sample: distinct tokens per kind, chosen by hash, and characters of each.
SAMPLE_TOKENS = 500
#: The same for the tokens of the background, whose formats are more.
SAMPLE_OTHERS = 2_000
SAMPLE_CHARS = 64
#: Shortest token that is scored, as in the base rule for assignments.
LEAST_TOKEN = 6
#: Log-likelihood gain over the background that makes a token a secret.
LEAST_GAIN = 20.0
#: Chance that states of one distribution are held apart; a larger value merges less.
ALPHA = 0.5
#: Rows that a credential state of its own needs; with fewer it falls to the state that explains them best.
#: A background state needs one, so that formats that are rare but plain stay plain.
LEAST_ROWS = 8
#: Rows that the smoothed frequencies of characters and of lengths start from.
PRIOR_CHARS = 4.0
PRIOR_LENGTHS = 4.0
#: Judged tokens that a task remembers, and the characters of the longest of them.
REMEMBERED = 1 << 16
REMEMBERED_CHARS = 64

KINDS = ("assign", "access", "hex", "learned")
OTHER = "other"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A run of credential characters from its first letter or digit to its last.
TOKEN = re.compile(r"[A-Za-z0-9][A-Za-z0-9+/_.=-]{%d,}[A-Za-z0-9]" % (LEAST_TOKEN - 2))
#: Character classes and their sizes.
CLASSES = {"0": 10, "a": 6, "g": 20, "A": 26} | dict.fromkeys("+/_.=-", 1)

SPANS = "array<struct<kind:string,start:int,end:int>>"
LABELLED = "kind string, value string, key long"


def kind_of(c: str) -> str:
    """Class of a character: 0 digit, a hex letter, g other lower-case letter, A upper-case letter, else itself."""
    return "0" if c.isdigit() else "a" if "a" <= c <= "f" else "g" if "g" <= c <= "z" else "A" if "A" <= c <= "Z" else c


CLASS_TABLE = str.maketrans({c: kind_of(c) for c in map(chr, range(128))})
ALPHABET = [(c, kind_of(c)) for c in map(chr, range(128)) if kind_of(c) in CLASSES]


def symbols(token: str) -> str:
    """Classes of the characters of a token."""
    return token.translate(CLASS_TABLE)


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, credential) of the base patterns, by start, then kind."""
    found = [(m.start(), m.end(), 0, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), m.end(), 2, m[0]) for m in HEX.finditer(text)]
    return [(s, e, KINDS[k], v) for s, e, k, v in sorted(found)]


def other_tokens(text: str, base: list[tuple[int, int, str, str]]) -> list[tuple[int, int, bool]]:
    """Tokens outside the base spans, without punctuation at their ends: start, end, and whether the token is whole.

    Of a token that base spans touch, every part between them is one of its own.
    """
    out, at, done, n = [], 0, 0, len(base)
    for m in TOKEN.finditer(text):
        start, end = m.span()
        while at < n and base[at][1] <= start:
            at += 1
        if at == n or base[at][0] >= end:
            out.append((start, end, True))
            continue
        done = start
        for begin, stop, _, _ in [*base[at:touching(base, at, end)], (end, end, "", "")]:
            if begin > done:
                out += [(*part.span(), False) for part in TOKEN.finditer(text, done, begin)]
            done = max(done, stop)
    return out


def touching(base: list[tuple[int, int, str, str]], at: int, end: int) -> int:
    """The first base span from ``at`` on that begins at ``end`` or later."""
    while at < len(base) and base[at][0] < end:
        at += 1
    return at


class Automaton:
    """Deterministic probabilistic automaton: per state the next states, class and character counts, and ends."""

    def __init__(self, samples: list[str], alpha: float = ALPHA, least_rows: int = LEAST_ROWS):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[Counter] = [Counter()]
        self.chars: list[Counter] = [Counter()]
        self.ends: list[int] = [0]
        self.lengths = Counter(min(len(w), SAMPLE_CHARS) for w in samples)
        for word in samples:
            state = 0
            for ch, kind in zip(word, symbols(word)):
                self.count[state][kind] += 1
                self.chars[state][ch] += 1
                if kind not in self.next[state]:
                    self.next[state][kind] = len(self.next)
                    self.next.append({})
                    self.count.append(Counter())
                    self.chars.append(Counter())
                    self.ends.append(0)
                state = self.next[state][kind]
            self.ends[state] += 1
        overall = sum(self.count, Counter())
        every = overall.total() + len(CLASSES)
        self.overall = {kind: (overall[kind] + 1) / every for kind in CLASSES}
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge(least_rows)
        self.logs = [{ch: math.log(self.likely(s, ch, kind)) for ch, kind in ALPHABET} for s in range(len(self.next))]

    def total(self, s: int) -> int:
        return self.ends[s] + self.count[s].total()

    def likely(self, s: int, ch: str, kind: str) -> float:
        """Smoothed frequency of a character: its own count, that of its class, and the class over all states."""
        n = self.count[s].total()
        of_class = (self.count[s][kind] + self.overall[kind]) / (n + 1) / CLASSES[kind]
        return (self.chars[s][ch] + PRIOR_CHARS * of_class) / (n + PRIOR_CHARS)

    def compatible(self, a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            n, m = self.total(a), self.total(b)
            if not n or not m:
                continue
            most = self.bound * (n ** -0.5 + m ** -0.5)
            if self.bound * m ** -0.5 >= 1:
                continue  # the states below have no more rows, so no difference counts there either
            if abs(self.ends[a] / n - self.ends[b] / m) > most:
                return False
            for counts in (self.count, self.chars):
                if any(abs(counts[a][ch] / n - counts[b][ch] / m) > most for ch in counts[a].keys() | counts[b].keys()):
                    return False
            stack += [(self.next[a][ch], self.next[b][ch]) for ch in self.next[a].keys() & self.next[b].keys()]
        return True

    def fit(self, a: int, b: int) -> float:
        """Log-likelihood, from state ``a``, of the rows under ``b``."""
        stack, total = [(a, b)], 0.0
        while stack:
            a, b = stack.pop()
            total += sum(k * math.log(self.likely(a, ch, kind_of(ch))) for ch, k in self.chars[b].items())
            stack += [(self.next[a].get(ch, a), t) for ch, t in self.next[b].items()]
        return total

    def fold(self, a: int, b: int) -> None:
        """Add the tree under ``b`` to state ``a``."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            self.ends[a] += self.ends[b]
            self.count[a].update(self.count[b])
            self.chars[a].update(self.chars[b])
            for ch, child in self.next[b].items():
                if ch in self.next[a]:
                    stack.append((self.next[a][ch], child))
                else:
                    self.next[a][ch] = child

    def _merge(self, least_rows: int) -> None:
        red = [0]
        while True:
            fringe = [(s, ch, t) for s in red for ch, t in sorted(self.next[s].items()) if t not in red]
            if not fringe:
                break
            parent, ch, blue = max(fringe, key=lambda f: (self.total(f[2]), -f[2]))
            able = red if self.total(blue) < least_rows else [r for r in red if self.compatible(r, blue)]
            if able:
                into = able[0] if len(able) == 1 else max(able, key=lambda r: (self.fit(r, blue), -r))
                self.next[parent][ch] = into
                self.fold(into, blue)
            else:
                red.append(blue)
        place = {s: i for i, s in enumerate(red)}
        self.next = [{c: place[t] for c, t in self.next[s].items()} for s in red]
        self.count, self.chars, self.ends = [self.count[s] for s in red], [self.chars[s] for s in red], [self.ends[s] for s in red]

    def score(self, word: str) -> float:
        """Log-likelihood of a token: its characters, state by state, and its length; an unseen class stays in its state."""
        state, total = 0, 0.0
        for ch, kind in zip(word, symbols(word)):
            total += self.logs[state][ch]
            state = self.next[state].get(kind, state)
        seen = self.lengths[min(len(word), SAMPLE_CHARS)] + PRIOR_LENGTHS / SAMPLE_CHARS
        return total + math.log(seen / (self.lengths.total() + PRIOR_LENGTHS))


def labelled_tokens(docs: DataFrame, text: str = "text", most: int = SAMPLE_OTHERS) -> DataFrame:
    """Credentials by kind and other tokens of all texts, with the hash that they are chosen by.

    A batch hands on its distinct tokens of the smallest hashes only: no other can be among the smallest of all.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: dict[str, set[str]] = {}
            for t in batch["text"]:
                t = t or ""
                base = base_spans(t)
                for _, _, kind, value in base:
                    found.setdefault(kind, set()).add(value[:SAMPLE_CHARS])
                found.setdefault(OTHER, set()).update(t[s:min(e, s + SAMPLE_CHARS)] for s, e, whole in other_tokens(t, base) if whole)
            rows = []
            for kind, values in found.items():
                keyed = ((xxhash.xxh64_intdigest(v.encode(), seed=42), v) for v in values)
                rows += [(kind, v, key - (1 << 63)) for key, v in nsmallest(most, keyed)]
            yield pd.DataFrame(rows, columns=["kind", "value", "key"])

    return docs.select(F.col(text).alias("text")).mapInPandas(run, LABELLED)


def learn(docs: DataFrame, text: str = "text", sample_tokens: int = SAMPLE_TOKENS, sample_others: int = SAMPLE_OTHERS) -> dict[str, Automaton]:
    """Automata per kind from all documents' labelled tokens; at most so many distinct ones of each kind reach the driver."""
    most = max(sample_tokens, sample_others)
    tokens = labelled_tokens(docs, text, most).distinct()
    rows = smallest(tokens, "kind", ["key", "value"], most).orderBy("kind", "key", "value").collect()
    samples: dict[str, list[str]] = {}
    for r in rows:
        samples.setdefault(r["kind"], []).append(r["value"])
    others = samples.pop(OTHER, [])[:sample_others]
    model = {k: Automaton(sorted(v[:sample_tokens])) for k, v in samples.items()}
    return model | ({OTHER: Automaton(sorted(others), least_rows=1)} if others else {})


def gain(token: str, model: dict[str, Automaton]) -> float:
    """Best credential log-likelihood over that of the background."""
    if OTHER not in model or len(model) < 2:
        return -math.inf
    return max(a.score(token) for k, a in model.items() if k != OTHER) - model[OTHER].score(token)


def judge(model: dict[str, Automaton], least_gain: float = LEAST_GAIN) -> Callable[[str], bool]:
    """Whether the gain of a token is large enough.

    No state gives a character more than its best state does; where that bound is too small already, the
    automata are not walked.  Short tokens that came lately are remembered.
    """
    if OTHER not in model or len(model) < 2:
        return lambda token: False
    states = [logs for k, a in model.items() if k != OTHER for logs in a.logs]
    best = {ch: max(logs[ch] for logs in states) for ch, _ in ALPHABET}.__getitem__
    other = model[OTHER].score

    def plain(token: str) -> bool:
        return sum(map(best, token)) - other(token) > least_gain and gain(token, model) > least_gain

    known = lru_cache(REMEMBERED)(plain)
    return lambda token: known(token) if len(token) <= REMEMBERED_CHARS else plain(token)


def spans_of(text: str | None, secret: Callable[[str], bool]) -> list[tuple[int, int, str]]:
    """All spans of a text by start, then kind; ``secret`` judges the tokens outside the base spans."""
    text = text or ""
    base = base_spans(text)
    spans = [(s, e, k) for s, e, k, _ in base]
    spans += [(s, e, "learned") for s, e, _ in other_tokens(text, base) if secret(text[s:e])]
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2])))


def scan(text: Column, model: dict[str, Automaton], least_gain: float = LEAST_GAIN) -> Column:
    """Array column of the spans (kind, start, end) of a text column, in code points."""
    @F.pandas_udf(SPANS)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        secret = judge(model, least_gain)
        for texts in parts:
            yield pd.Series([[{"kind": k, "start": s, "end": e} for s, e, k in spans_of(t, secret)] for t in texts], dtype=object)

    return run(text)


def redact(text: Column, model: dict[str, Automaton], least_gain: float = LEAST_GAIN, mark: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones as one, replaced by ``mark``; null stays null."""
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        secret = judge(model, least_gain)
        for texts in batches:
            out = []
            for t in texts:
                at, parts = 0, []
                for s, e, _ in spans_of(t, secret):
                    if s >= at:
                        parts += [t[at:s], mark]
                    at = max(at, e)
                out.append(t if not parts else "".join(parts) + t[at:])
            yield pd.Series(out, dtype=object)

    return run(text)
