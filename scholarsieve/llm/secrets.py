"""Secret scans by grammar inference.

The base rules (assignments of secrets, access keys, long hexadecimal runs) label credentials. From a bounded
sample of them a prefix-tree of character classes is grown and its statistically compatible states are merged
(ALERGIA, Hoeffding bound) into a probabilistic automaton of credential formats. Every candidate token is scored by its
log-likelihood under the automaton minus that under the ordinary text of the corpus: character pairs counted over all
texts outside base spans, with steady letter case, repeated characters and running numbers likely. Tokens above
`THRESHOLD` are added as spans of kind "format", whatever classes they hold; words in capitals, rules of one character,
numbers and dates are likely as ordinary text, so likelihood rejects them. Tokens are learnt and scored whole, dots
inside included. Base spans always stay; added spans never overlap one.

Nulls and edge cases: a null text is empty; empty texts have no spans; no labelled credential in the sample
means that nothing is added; rows with equal doc_ids each give a row; an empty table gives no rows; other columns
are ignored.
"""
from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scholarsieve.llm.common import BLOCK_BYTES, stored

# The base rules and their least lengths.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "format")

#: Tokens with the dots inside them; shorter matches are left out.
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_.=-]{{{LEAST_ASSIGN}}})[A-Za-z0-9+/_=-]+(?:\.[A-Za-z0-9+/_=-]+)*")
SAMPLE = 5000  # labelled credentials that the automaton is inferred from
ALPHA = 0.05
THRESHOLD = math.log(1e6)  # one token in a million is a credential
SWITCH = 0.05  # chance that the letter case changes inside a word
REPEAT = 0.1  # chance that a character is the one before once more
DIGITS = 30  # counts that a digit after a digit has beforehand


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base rules."""
    spans = []
    if "=" in text or ":" in text:
        spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


_CLASS = {**{c: "a" for c in "abcdef"}, **{c: "z" for c in "ghijklmnopqrstuvwxyz"}, **{c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"},
          **{c: "0" for c in "0123456789"}, **{c: "-" for c in "+/_.=-"}}


class _Classes(dict):
    def __missing__(self, code):
        return "?"


_TABLE = _Classes({ord(c): name for c, name in _CLASS.items()})


_SIZE = Counter(_CLASS.values())
#: Symbols of ordinary text: folded letters, digits as one, six marks, and all else, which parts tokens.
_PAIR = np.full(256, 33, np.int64)
_PAIR[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = _PAIR[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = np.arange(26)
_PAIR[[ord(c) for c in "0123456789"]] = 26
_PAIR[[ord(c) for c in "+/_.=-"]] = [27, 28, 29, 30, 31, 32]
_APART, _DIGIT, _DOT, _WIDE = 33, 26, 30, 34


def symbols(token: str) -> str:
    """The class of every character."""
    return token.translate(_TABLE)


class Automaton:
    """Probabilistic automaton merged from the prefix tree of labelled tokens.

    The rest of a token that no other shares is kept as text and grown on demand: a state seen once is compatible with
    every other (the bound is above 1), so long tokens cost no states of their own.
    """

    def __init__(self, tokens: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[Counter] = [Counter()]  # symbols leaving a state; "" = end
        self.rest: dict[int, tuple[str, int]] = {}  # state -> classes of its only token, and the place from where they aren't grown
        for token in sorted(tokens):
            self._add(0, symbols(token), 0)
        self.root = math.sqrt(math.log(2 / alpha) / 2)
        self._merge()

    def _leaf(self, classes: str, at: int) -> int:
        self.next.append({})
        self.count.append(Counter())
        self.rest[len(self.next) - 1] = (classes, at)
        return len(self.next) - 1

    def _grow(self, state: int) -> None:
        """Make the next symbol of an ungrown rest an edge."""
        if state in self.rest:
            classes, at = self.rest.pop(state)
            s = classes[at:at + 1]
            self.count[state][s] += 1
            if s:
                self.next[state][s] = self._leaf(classes, at + 1)

    def _add(self, state: int, classes: str, at: int) -> None:
        """Count the rest of a token from a state on."""
        while True:
            self._grow(state)
            s = classes[at:at + 1]
            self.count[state][s] += 1
            if not s:
                return
            at += 1
            if s not in self.next[state]:
                self.next[state][s] = self._leaf(classes, at)
                return
            state = self.next[state][s]

    def _total(self, state: int) -> int:
        return 1 if state in self.rest else self.count[state].total()

    def _differ(self, a: int, b: int) -> bool:
        n, m = self.count[a].total(), self.count[b].total()
        if not n or not m:
            return False
        bound = self.root * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        return any(abs(self.count[a][s] / n - self.count[b][s] / m) > bound for s in self.count[a].keys() | self.count[b].keys())

    def _compatible(self, a: int, b: int) -> bool:
        pairs = [(a, b)]
        seen = set()
        while pairs:
            x, y = pairs.pop()
            if x == y or (x, y) in seen:
                continue
            seen.add((x, y))
            if self._total(x) <= 1 or self._total(y) <= 1:
                continue  # no evidence, here or further on
            if self._differ(x, y):
                return False
            pairs += [(self.next[x][s], self.next[y][s]) for s in self.next[x].keys() & self.next[y].keys()]
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Add the subtree `tree` to state `into`."""
        pairs = [(into, tree)]
        while pairs:
            x, y = pairs.pop()
            if y in self.rest:
                self._add(x, *self.rest.pop(y))
                continue
            self._grow(x)
            self.count[x].update(self.count[y])
            for s, child in self.next[y].items():
                if s in self.next[x]:
                    pairs.append((self.next[x][s], child))
                else:
                    self.next[x][s] = child

    def _merge(self) -> None:
        red = [0]
        blue = [(0, s) for s in sorted(self.next[0])]
        while blue:
            # The best supported edge first, so that counts are large where choices are made.
            blue.sort(key=lambda e: (-self._total(self.next[e[0]][e[1]]), e))
            state, s = blue.pop(0)
            child = self.next[state][s]
            if child in red:
                continue
            target = next((r for r in red if self._compatible(r, child)), None)
            if target is None:
                red.append(child)
                blue += [(child, t) for t in sorted(self.next[child])]
            else:
                self.next[state][s] = target
                self._fold(target, child)
                blue = [(r, t) for r in red for t in sorted(self.next[r]) if self.next[r][t] not in red]
        # Only the merged states remain.
        name = {state: i for i, state in enumerate(red)}
        self.next = [{s: name[t] for s, t in self.next[r].items()} for r in red]
        self.count = [self.count[r] for r in red]
        # Per state, what each symbol adds and where it leads; the last state is for symbols never seen.
        lost = len(red)
        self.steps = [{s: (math.log((c[s] + 0.5) / (c.total() + 3.5)), to.get(s, lost)) for s in (*"azA0-?", "")}
                      for c, to in zip([*self.count, Counter()], [*self.next, {}])]

    def score(self, token: str) -> float:
        """Mean log-likelihood per symbol, add-half smoothed over the six classes and the end."""
        state, total = 0, 0.0
        classes = symbols(token)
        for s in classes:
            more, state = self.steps[state][s]
            total += more
        return (total + self.steps[state][""][0]) / (len(classes) + 1)


class Ordinary:
    """Likelihood of a token as ordinary text, from counts of neighbouring symbols (`_PAIR`)."""

    def __init__(self, pairs: dict[int, int]):
        counts = np.full((_WIDE, _WIDE), 0.5)
        counts[_DIGIT, _DIGIT] += DIGITS
        for pair, n in pairs.items():
            counts[divmod(pair, _WIDE)] += n
        self.chance = (counts / counts.sum(1, keepdims=True)).tolist()

    def score(self, token: str) -> float:
        before, last, inside, total = _APART, "", 0, 0.0
        for c in token:
            now = int(_PAIR[ord(c)])
            p = self.chance[before][now]
            if now < _DIGIT:
                # The first letter of a word has either case; so has the second after a capital.
                either = inside == 0 or (inside == 1 and last.isupper())
                p *= 0.5 if either else 1 - SWITCH if c.isupper() == last.isupper() else SWITCH
            elif now == _DIGIT:
                p /= 10
            inside = inside + 1 if now < _DIGIT else 0
            total += math.log((1 - REPEAT) * p + (REPEAT if c == last else 0.0))
            before, last = now, c
        return total + math.log(self.chance[before][_APART])


class Model:
    def __init__(self, tokens: list[str], pairs: dict[int, int], alpha: float = ALPHA, threshold: float = THRESHOLD):
        self.automaton = Automaton(tokens, alpha) if tokens else None
        self.ordinary = Ordinary(pairs)
        self.threshold = threshold

    def is_secret(self, token: str) -> bool:
        """Whether the format explains the token's characters better than ordinary text does, by `threshold`."""
        if self.automaton is None:
            return False
        classes = symbols(token)
        format_ = self.automaton.score(token) * (len(classes) + 1) - sum(n * math.log(_SIZE[s]) for s, n in Counter(classes).items())
        return format_ - self.ordinary.score(token) > self.threshold

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        base = base_spans(text)
        added = []
        for m in CANDIDATE.finditer(text):
            if m.end() - m.start() >= LEAST_ASSIGN and not any(a < m.end() and m.start() < b for a, _, b in base) and self.is_secret(m.group()):
                added.append((m.start(), 3, m.end()))
        return sorted(base + added)


def written(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _pairs(texts: list[str]) -> np.ndarray:
    """Counts of neighbouring symbols; texts are apart from each other, however they are batched.

    A dot that ends a sentence parts tokens; only dots inside tokens count as dots.
    """
    codes = _PAIR[np.frombuffer(("\n" + "\n".join(texts) + "\n").encode(), np.uint8)]
    codes[:-1][(codes[:-1] == _DOT) & (codes[1:] == _APART)] = _APART
    return np.bincount(codes[:-1] * _WIDE + codes[1:], minlength=_WIDE * _WIDE)


def _gathered(batches):
    """One row per credential that the base rules find, with a hash that orders the sample, and the symbol pairs of the rest."""
    for batch in batches:
        values, plain, size = [], [], 0
        total = np.zeros(_WIDE * _WIDE, np.int64)
        for text in batch.column(0):
            text = text.as_py() or ""
            end_before, rest = 0, []
            for start, kind, end in base_spans(text):
                found = text[start:end]
                values.append(ASSIGN.match(found)[2] if kind == 0 else found)
                rest.append(text[end_before:start])
                end_before = max(end_before, end)
            plain.append("\n".join([*rest, text[end_before:]]))
            size += len(text)
            if size > BLOCK_BYTES:
                total += _pairs(plain)
                plain, size = [], 0
        total += _pairs(plain)
        order = [int.from_bytes(hashlib.md5(v.encode()).digest()[:7], "big") for v in values]
        seen = np.flatnonzero(total)
        nothing = [None] * len(seen)
        yield pa.RecordBatch.from_arrays([pa.array(values + nothing, pa.string()), pa.array(order + nothing, pa.int64()),
                                          pa.array([None] * len(values) + seen.tolist(), pa.int32()), pa.array([None] * len(values) + total[seen].tolist(), pa.int64())],
                                         names=["value", "place", "pair", "n"])


def learn(docs: DataFrame, sample: int = SAMPLE, alpha: float = ALPHA, threshold: float = THRESHOLD) -> Model:
    """Infer the automaton from at most `sample` distinct labelled credentials, chosen by hash from all documents."""
    found = stored(docs.select("text").mapInArrow(_gathered, "value string, place long, pair int, n long"), "secrets-gathered")
    values = found.where("value IS NOT NULL").groupBy("value").agg(F.min("place").alias("place")).orderBy("place", "value").limit(sample).select("value")
    pairs = found.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("n"))  # at most 34 x 34 rows
    return Model([r[0] for r in values.collect()], dict(pairs.collect()), alpha, threshold)


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, base and all spans as arrays of (kind, start, end) in code points, end exclusive."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def find(batches):
        for batch in batches:
            found = [model.spans(text.as_py() or "") for text in batch.column(1)]
            rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans] for spans in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, span)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(find, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts per base kind, the hash of the base spans, and all spans, in the contract's form."""
    def of(kind):
        return F.filter("spans", lambda s: s["kind"] == kind)

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return scanned.select("doc_id", *(F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]),
                          F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "format")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
