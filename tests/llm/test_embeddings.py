import math
import random

import numpy as np

from scholarsieve.llm import embeddings


def brute(rows):
    """(links, component) by all pairs."""
    sound = lambda v, label: label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    parent = {i: i for i, _, _ in rows}
    links = dict.fromkeys(parent, 0)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, v, a in rows:
        for j, w, b in rows:
            if i < j and a == b and sound(v, a) and sound(w, b) and len(v) == len(w):
                v_, w_ = np.array(v, np.float32).astype(float), np.array(w, np.float32).astype(float)
                if v_ @ w_ / (np.linalg.norm(v_) * np.linalg.norm(w_)) >= 0.98:
                    links[i] += 1
                    links[j] += 1
                    x, y = sorted((find(i), find(j)))
                    parent[y] = x
    return {i: (links[i], find(i)) for i in parent}


def vectors(seed=1, n=300, dim=16):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(25)]
    rows = []
    for i in range(n):
        spread = rng.choice([0.0, 0.02, 0.05, 0.08, 1.0])
        rows.append((i * 3, [x + spread * rng.gauss(0, 1) for x in rng.choice(centres)], rng.randrange(3) if rng.random() < 0.95 else None))
    bad = [None, [], [0.0] * dim, [None] + [1.0] * (dim - 1), [float("nan")] + [1.0] * (dim - 1), [float("inf")] + [1.0] * (dim - 1), [1.0] * 5, [2.0] * 5]
    return rows + [(9_000 + k, v, 0) for k, v in enumerate(bad)]


def test_links_and_components_match_brute_force(spark):
    rows = vectors()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    for options in ({}, {"shard_rows": 20, "block_rows": 30}):
        got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(table, **options).collect()}
        assert got == brute(rows)


def test_recall_of_the_graph_against_brute_force():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 32))
    points = centres[rng.integers(0, 60, 1500)] + 0.06 * rng.normal(size=(1500, 32))
    unit = points / np.linalg.norm(points, axis=1)[:, None]
    found, beam = embeddings.search(embeddings.Graph(unit), points, points, beam=8)
    true = unit @ unit.T >= 0.98
    assert sum(map(len, found)) >= 0.9 * true.sum() and all(true[i, ids].all() for i, ids in enumerate(found))


def test_beams_widen_to_hold_all_links():
    rng = np.random.default_rng(1)
    points = np.ones(24) + 0.01 * rng.normal(size=(400, 24))
    found, _ = embeddings.search(embeddings.Graph(points / np.linalg.norm(points, axis=1)[:, None]), points, points[:50], beam=8)
    assert all(len(ids) == 400 for ids in found)


def test_null_ids_repeats_and_empty_tables(spark):
    table = spark.createDataFrame([(None, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (6, [1.0, 0.001], 1)], "vec_id long, embedding array<float>, label int")
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(table).collect())
    assert got == [("5", 2, 5, True), ("5", 2, 5, True), ("6", 2, 5, False), ("None", 0, None, None)]
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


def test_blocks_without_links_in_their_audit_are_still_audited():
    rng = np.random.default_rng(5)
    points = rng.normal(size=(3000, 64))
    points /= np.linalg.norm(points, axis=1)[:, None]
    queries = points[:1000] + 0.16 / np.sqrt(64) * rng.normal(size=(1000, 64))
    audited = np.unique(np.linspace(0, 999, embeddings.AUDIT_ROWS).astype(int))
    queries[audited] = rng.normal(size=(len(audited), 64))  # links are rare, and none is audited
    true = queries / np.linalg.norm(queries, axis=1)[:, None] @ points.T >= 0.98
    assert not true[audited].any() and true.sum() > 900
    found, beam = embeddings.search(embeddings.Graph(points), points, queries, beam=4)
    assert beam > 4 and sum(map(len, found)) >= 0.999 * true.sum()


def test_labels_of_thousands_through_the_graph(spark):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(2000, 6))
    points = np.concatenate([points, points[:1500] * 1.5 + 0.02 * rng.normal(size=(1500, 6))]).astype(np.float32)
    unit = points.astype(float) / np.linalg.norm(points.astype(float), axis=1)[:, None]
    true = unit @ unit.T >= 0.98
    # The beam path answers here: a search of one shard stays below the width of a whole scan.
    shard = points[:3000].astype(float)
    _, beam = embeddings.search(embeddings.Graph(unit[:3000]), shard, points[3000:].astype(float))
    assert beam * embeddings.FULL_SHARE < 3000
    table = spark.createDataFrame([(i, [float(x) for x in p], 1) for i, p in enumerate(points)], "vec_id long, embedding array<float>, label int").repartition(3)
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(table).collect()}
    assert sum(got.values()) >= 0.999 * (true.sum() - len(points)) and all(got[i] <= true[i].sum() - 1 for i in got)


def test_vectors_without_structure_stay_with_narrow_beams():
    rng = np.random.default_rng(8)
    points = rng.normal(size=(5000, 64))
    points[2500:3500] = points[:1000] + 0.15 * rng.normal(size=(1000, 64))
    unit = points / np.linalg.norm(points, axis=1)[:, None]
    true = unit @ unit.T >= 0.98
    found, beam = embeddings.search(embeddings.Graph(unit), points, points)
    assert beam <= 256  # their nearest vectors but links are far, and no beam holds all of these
    assert sum(map(len, found)) >= 0.99 * true.sum() and all(true[i, ids].all() for i, ids in enumerate(found))
