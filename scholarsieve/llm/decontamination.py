"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters may differ by k = floor(n * tolerance) edits. Cut into k + 1 pieces, at least one
piece survives k edits unchanged, so exact piece hits (one Aho-Corasick pass per document) find every place;
each is verified with Myers' bit-parallel distance over the window that the item can cover there.
Items and texts are compared in a plain form: lower case, runs of everything but letters and digits as a blank.

Items are sent to the tasks in blocks of at most `BLOCK_CHARS` characters, a proven bound: a larger benchmark
makes several passes over the documents, whatever its size.

Nulls and edge cases: null or empty texts match nothing; items whose plain form has fewer than `least` letters
and digits must stand unchanged between word edges (no errors are allowed there), and items without any are ignored;
equal items each report their own id; rows with equal
doc_ids give one row per item with the smallest distance; null doc_ids are reported as such. Extra columns
are ignored by `matches` and kept by `clean`.
"""
from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scholarsieve.llm.common import small_enough, stored

TOLERANCE = 0.1
LEAST = 20
BLOCK_CHARS = 4_000_000

_GAP = re.compile(r"[\W_]+")


def plain(text: str | None) -> str:
    return _GAP.sub(" ", (text or "").lower()).strip()


def budget(length: int, tolerance: float = TOLERANCE) -> int:
    return int(length * tolerance)


def cut(text: str, pieces: int) -> list[tuple[int, str]]:
    """(start, piece) of `pieces` nearly equal pieces."""
    n = len(text)
    ends = [n * (i + 1) // pieces for i in range(pieces)]
    return [(a, text[a:b]) for a, b in zip([0, *ends], ends)]


def best_distance(pattern: str, text: str, most: int) -> int:
    """Smallest edit distance of the pattern to any substring of the text, or most + 1 (Myers, bit-parallel)."""
    m = len(pattern)
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    ones, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = ones, 0, m, m
    for c in text:
        eq = where.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | (ones & ~(xh | plus)), plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            best = min(best, score)
        ph, mh = ph << 1 & ones, mh << 1 & ones
        plus, minus = mh | (ones & ~(xv | ph)), ph & xv
    return min(best, most + 1)


class Matcher:
    """Finds items in plain texts.

    A piece hit is first tried on its family of two or three neighbouring pieces: if an item occurs with at most
    k errors, some family of m pieces holds an unchanged piece and has at most m - 1 errors in all (the families'
    budgets plus one sum up to the item's). Then a half of some other piece of the family, too, stands unchanged
    near its place, which a substring test rejects at once. Only hits whose family passes reach the whole item.
    """

    def __init__(self, items: list[tuple[int, str]], tolerance: float = TOLERANCE):
        self.items = items
        # Short items come with a blank at both ends.
        self.most = [0 if text.startswith(" ") else budget(len(text), tolerance) for _, text in items]
        self.pieces: dict[str, list[tuple]] = {}
        for i, (_, text) in enumerate(items):
            cuts = cut(text, self.most[i] + 1)
            for j, (start, piece) in enumerate(cuts):
                family = self._family(j, len(cuts))
                first, last = cuts[family[0]][0], cuts[family[-1]][0] + len(cuts[family[-1]][1])
                others = tuple((cuts[o][0] - start, len(cuts[o][1]), *self._halves(cuts[o][1])) for o in family if o != j)
                self.pieces.setdefault(piece, []).append((i, start, text[first:last], start - first, len(family) - 1, others))
        self.machine = ahocorasick.Automaton()
        for piece in self.pieces:
            self.machine.add_word(piece, (len(piece), self.pieces[piece]))
        if self.pieces:
            self.machine.make_automaton()

    @staticmethod
    def _family(j: int, n: int) -> list[int]:
        """Pieces 0-1, 2-3, ...; of an odd number the last three are one family."""
        first = min(j // 2 * 2, max(0, (n // 2 - 1) * 2))
        return list(range(first, n if first + 3 >= n else first + 2))

    @staticmethod
    def _halves(piece: str) -> tuple[str, str]:
        return piece[:len(piece) // 2], piece[len(piece) // 2:]

    def search(self, text: str) -> dict[int, int]:
        """Item index -> smallest distance, for the items within their budget somewhere in the plain text."""
        spans: dict[int, list[tuple[int, int]]] = {}
        if not self.pieces:
            return {}
        for end, (length, uses) in self.machine.iter(text):
            at = end + 1 - length
            for i, start, family, offset, errors, others in uses:
                for shift, size, left, right in others:
                    near = text[max(0, at + shift - 2):at + shift + size + 2]
                    if left in near or right in near:
                        break
                else:
                    if others:
                        continue
                if others:
                    near = text[max(0, at - offset - errors):at - offset + len(family) + errors]
                    if family not in near and best_distance(family, near, errors) > errors:
                        continue
                begin = at - start  # where the item begins if nothing is inserted or lost before
                spans.setdefault(i, []).append((begin - self.most[i], begin + len(self.items[i][1]) + self.most[i]))
        found = {}
        for i, windows in spans.items():
            pattern, most = self.items[i][1], self.most[i]
            merged: list[list[int]] = []
            for a, b in sorted(windows):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            for a, b in merged:
                window = text[max(0, a):b]
                distance = 0 if pattern in window else best_distance(pattern, window, most)
                if distance <= most and distance < found.get(i, most + 1):
                    found[i] = distance
                if found.get(i) == 0:
                    break
        return found


def _searcher(items, tolerance):
    def search(batches):
        matcher = Matcher(items, tolerance)
        ids = [item for item, _ in items]
        for batch in batches:
            docs, hits, distances = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for i, distance in matcher.search(f" {plain(text.as_py())} ").items():
                    docs.append(doc)
                    hits.append(ids[i])
                    distances.append(distance)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(hits, pa.int64()), pa.array(distances, pa.int32())], names=["doc_id", "item_id", "distance"])
    return search


def item_blocks(benchmark: DataFrame, least: int = LEAST, block_chars: int = BLOCK_CHARS):
    """Plain items in blocks of bounded size; the driver holds one block at a time."""
    block: list[tuple[int, str]] = []
    held = 0
    for row in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        text = plain(row.text)
        letters = len(text) - text.count(" ")
        if not letters:
            continue
        if letters < least:
            text = f" {text} "
        if block and held + len(text) > block_chars:
            yield block
            block, held = [], 0
        block.append((row.item_id, text))
        held += len(text)
    yield block


def matches(docs: DataFrame, benchmark: DataFrame, tolerance: float = TOLERANCE, least: int = LEAST) -> DataFrame:
    """(doc_id, item_id, distance) of every document that holds an item within its error budget."""
    found = None
    for block in item_blocks(benchmark, least):
        part = docs.select("doc_id", "text").mapInArrow(_searcher(block, tolerance), "doc_id long, item_id long, distance int")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any item, all columns kept; a null doc_id is judged with all null doc_ids."""
    hit = stored(matches(docs, benchmark, **options).select("doc_id").distinct(), "contaminated")
    return docs.alias("docs").join(small_enough(hit, 16).alias("hits"), F.col("docs.doc_id").eqNullSafe(F.col("hits.doc_id")), "left_anti").select("docs.*")
