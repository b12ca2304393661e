import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from scholarsieve.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
ROW = T.StructType([T.StructField(c, T.StringType()) for c in ("text", "lang", "source")])


def brute(rows, least, top=50):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = TERM.findall((text or "").translate(lower))
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    found = set()
    for lang in {g[0] for g in counts}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        groups = {s: c for (l, s), c in counts.items() if l == lang}

        def prices(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        whole = prices(sum(groups.values(), Counter()))
        price = {s: prices(c) for s, c in groups.items()}
        for s in groups:
            pairs = [(sum(abs(price[s][t] - price[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(price[s][t] - whole[t], t) for t in kept if groups[s][t] and price[s][t] > whole[t]]
            for part, some in (("pair", pairs), ("term", terms)):
                some.sort(key=lambda x: (-x[0], x[1].encode()))
                found |= {(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(some, 1) if part == "pair" or rank <= top}
    return found


def check(spark, rows, least=3, **options):
    got = divergence.audit(spark.createDataFrame(rows, ROW).repartition(3), least_docs=least, **options)
    found = [(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows, least)
    return found


def texts(seed, groups, docs, words):
    rng = random.Random(seed)
    return [(" ".join(f"w{chr(97 + int(rng.paretovariate(0.6)) % 26)}{chr(97 + rng.randrange(words))}" for _ in range(rng.randrange(30))), lang, f"s{rng.randrange(groups)}")
            for lang in ("en", "de") for _ in range(docs)]


def test_matches_plain_counts(spark):
    rows = texts(1, 13, 120, 20) + [(None, "en", "none"), ("", "xx", "a"), ("solo", "xx", None), (None, None, None), ("Ünï-CODE ÄÖ éE 東京", "en", "s1")] + [
        ("Ünï", "en", "s2")] * 4
    found = check(spark, rows)
    assert {r for r in found if r[0] == "xx"} == {("xx", "a", "pair", "", 0, 1), ("xx", "", "pair", "a", 0, 1)}


@pytest.mark.parametrize("cells, band", [(1, 8), (40, 8), (40, 16)])
def test_blocks_and_bands_do_not_change_the_sums(spark, monkeypatch, cells, band):
    monkeypatch.setattr(divergence, "BLOCK_CELLS", cells)
    monkeypatch.setattr(divergence, "BAND", band)
    check(spark, texts(2, 21, 60, 6))


def test_one_hot_source_and_repeated_rows(spark):
    rows = texts(3, 5, 60, 8)
    check(spark, [(t, "en", "hot") for t, *_ in rows] * 2 + rows)


def test_empty_and_clashing_names(spark):
    empty = spark.createDataFrame([], ROW)
    assert divergence.audit(empty).count() == 0
    extra = spark.createDataFrame([("a b", "en", "x"), ("a", "en", "y")], ROW)
    for name in ("term", "n", "docs", "price", "block", "kept", "total", "rank", "part", "item", "value"):
        extra = extra.withColumn(name, F.lit(1))
    got = {(r.source, r.part, r.item) for r in divergence.audit(extra, least_docs=1).collect()}
    assert ("x", "pair", "y") in got and ("y", "term", "a") in got


def test_long_texts_are_counted_whole(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SLICE_BYTES", 50)
    monkeypatch.setattr(divergence, "HELD_TERMS", 20)
    check(spark, texts(4, 3, 30, 5) + [(" ".join(["tail"] * 500), "en", "s0")] * 3)


@pytest.mark.parametrize("groups, width, filled", [(1, 1, 1.0), (3, 0, 0.0), (9, 40, 0.2), (40, 9, 0.05), (70, 300, 0.01), (16, 64, 1.0)])
def test_tree_distances_are_those_of_the_dense_matrix(monkeypatch, groups, width, filled):
    rng = np.random.default_rng(groups)
    zero = rng.integers(1, 1000, groups)
    dense = np.repeat(zero[:, None], width, axis=1)
    row, column = np.nonzero(rng.random((groups, width)) < filled)
    value = rng.integers(1, 10**9, len(row))
    dense[row, column] = value
    for band, frontier in ((8, 7), (16, 1 << 17), (1024, 100)):
        monkeypatch.setattr(divergence, "BAND", band)
        monkeypatch.setattr(divergence, "FRONTIER", frontier)
        tree = divergence.QuadTree(row, column, value, zero, width)
        seen = set()
        for first, second, found in divergence.joint_distances(tree, width):
            for i in range(found.shape[0]):
                for j in range(found.shape[1]):
                    a, b = first + i, second + j
                    if a < b:
                        seen.add((a, b))
                        assert found[i, j] == np.abs(dense[a] - dense[b]).sum()
        assert len(seen) == groups * (groups - 1) // 2


def test_zero_quadrants_have_no_nodes():
    tree = divergence.QuadTree(np.array([0]), np.array([999]), np.array([7]), np.ones(4, np.int64), 1000)
    assert all((rank >= 0).sum() == 1 for rank in tree.ranks) and tree.zero_leaf == 1
