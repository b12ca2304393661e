import re

from pyspark.sql import functions as F

from scholarsieve.llm import mixing


def filled(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by resharing the excess until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total >= most * sizes[s]}
        if not full:
            target.update({s: left * weight[s] / total for s in open_})
            break
        for s in full:
            target[s] = float(most * sizes[s])
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_match_repeated_resharing(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 30}, {"z": 5, None: 50, "é": 7, "A": 900, "b": 1}, {"x": 0, "y": 0}, {"one": 7}):
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(frame).collect()}
        assert got.keys() == sizes.keys()
        for s, t in filled(sizes).items():
            assert abs(got[s] - t) < 1e-6, (sizes, s)


def test_mix_repeats_documents_and_keeps_columns(spark, documents):
    rows = [(i, "w " * (i % 7), "hot" if i % 3 else f"s{i % 5}") for i in range(300)] + [(300, None, None), (301, "a b", None), (301, "a b", None), (None, "x", "hot")]
    docs = documents(rows).withColumn("_copies", F.lit(1))
    counted = mixing.copies(docs).collect()
    assert len(counted) == len(rows)
    assert all(0 <= r._mix_copies <= 2 and r._mix_size == words(r.text) for r in counted)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r._mix_copies for r in counted)
    taken = {}
    for r in counted:
        taken.setdefault(r.source, [r._mix_target, 0])[1] += r._mix_copies * r._mix_size
    assert abs(taken["hot"][1] - taken["hot"][0]) < 0.25 * taken["hot"][0]
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, mixed.collect()))


def test_empty_table(documents, spark):
    assert mixing.mix(documents({1: "a"}).limit(0)).count() == 0


def test_no_python_on_the_main_path(documents):
    plan = mixing.mix(documents({1: "a b", 2: "c"}))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
