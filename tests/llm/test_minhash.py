import random
import re

import numpy as np

from scholarsieve.llm import common, minhash


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words)} - {()} if len(words) < width else {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def classes(texts, width):
    sets, parent = {i: shingles(t, width) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in texts}


def families(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = {}
    for doc in range(n):
        kind = rng.random()
        if kind < 0.6 and texts:
            words = (texts[rng.choice(list(texts))] or "x").split()
            for _ in range(rng.randrange(0, max(1, len(words) // 12) + 1)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts[doc * 7] = " ".join(words)
        else:
            texts[doc * 7] = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 90)))
    return {**texts, 10_001: None, 10_003: "", 10_005: " \t\n", 10_006: "One", 10_008: "one", 10_009: "two"}


def test_signatures_estimate_similarity_with_low_variance():
    rng = np.random.default_rng(0)
    base = common.mix(rng.integers(0, 2**62, 600, dtype=np.uint64))
    for shared in (0.5, 0.8):
        a, b = np.sort(base[:400]), np.sort(np.concatenate([base[:int(400 * 2 * shared / (1 + shared))], base[400:400 + 400 - int(400 * 2 * shared / (1 + shared))]]))
        got = minhash.super_minhash(np.concatenate([a, b]), np.array([0, 400, 800]), 256)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((got[0] == got[1]).mean() - true) < 0.09
        assert np.isfinite(got).all()


def test_each_rank_of_an_element_is_a_permutation():
    got = minhash.super_minhash(np.array([12345], np.uint64), np.array([0, 1]), 64)[0]
    assert sorted(np.floor(got)) == list(range(64))


def test_links_match_brute_force(documents):
    for seed, width in ((1, 2), (2, 5)):
        texts = families(seed)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(documents(texts), width=width).collect()}
        assert got == classes(texts, width)


def test_a_family_without_a_common_centre_is_compared_in_blocks(documents):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for doc in range(40):
        words = list(base)
        for k in range(3 + doc % 4):
            words[rng.randrange(60)] = f"x{doc}-{k}"
        texts[doc] = " ".join(words)
    # One slot per band: all of the family share buckets, though many pairs are below the threshold.
    for block in (256, 7):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(documents(texts), width=2, bands=24, rows=1, block_docs=block).collect()}
        assert got == classes(texts, 2)


def test_links_among_sets_match_brute_force():
    rng = np.random.default_rng(5)
    for sides in (1, 2):
        sets = [np.unique(rng.integers(0, 60, rng.integers(1, 60)).astype(np.uint64)) for _ in range(80)]
        side = np.arange(80) % sides == 1
        forest = minhash.links_among(sets, side, 60, columns=16)
        want = {(i, j) for i in range(80) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j])) and (sides == 1 or side[i] != side[j])}

        def groups(edges):
            label = list(range(80))
            for _ in range(80):
                for i, j in edges:
                    label[i] = label[j] = min(label[i], label[j])
            return label

        assert all((max(e), min(e)) in want for e in forest) and groups(forest) == groups(want)


def test_one_of_each_group_stays_with_all_columns(documents):
    texts = {4: "a b c d e f g h", 2: "a b c d e f g h", 9: "q r s t u v", 11: None, 12: None}
    docs = documents(texts)
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 9, 11, 12]


def test_null_ids_and_empty_tables(documents):
    docs = documents([(None, "a b c", "s"), (1, "a b c", "s")])
    assert sorted(map(str, (tuple(r) for r in minhash.near_duplicates(docs, width=2).collect()))) == ["(1, 2, 1)", "(None, 2, None)"]
    assert minhash.keep_one(docs).count() == 2
    assert minhash.near_duplicates(docs.limit(0), width=2).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 60)] + [(7, 7), (None, 3), (5000, 4000), (4000, 5000)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{1000 + i: 1000 for i in range(60)}, 4000: 4000, 5000: 4000}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
