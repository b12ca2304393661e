import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from scholarsieve.llm import filter_audit

LABELS = "doc_id long, quality int, toxic int"


def brute(docs, labels):
    """Every order applied to every document in turn."""
    first = {}
    for doc, text, _ in docs:
        if doc is not None:
            first[text or ""] = min(doc, first.get(text or "", doc))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    per_part = defaultdict(list)
    for doc, text, source in docs:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text):
            fails.add("C")
        if any(c in text for c in "#$%&*|"):
            fails.add("D")
        if doc is not None and doc > first[text]:
            fails.add("E")
        per_part[source or ""].append((fails, doc in good, doc in toxic))
    rows = {}
    for part, members in per_part.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                c = Counter(kept=0)
                for fails, is_good, is_toxic in members:
                    gone = fails & set(order[:step - 1])
                    c["kept"] += not gone and letter not in fails
                    here = not gone and letter in fails
                    c["removed"] += here
                    c["redundant"] += bool(gone) and letter in fails
                    c["unique_fails"] += fails == {letter}
                    c["good_lost"] += here and is_good
                    c["toxic_lost"] += here and is_toxic
                shapley[letter] += c["removed"]
                rows[part, "".join(order), step] = c
        for (p, order, step), c in rows.items():
            if p == part:
                c["shapley"] = shapley[order[step - 1]]
    return rows


def check(spark, documents, docs, labels):
    got = filter_audit.audit(documents(docs), spark.createDataFrame(labels, LABELS))
    found = {(r.part, r.filter_order, r.step): {c: r[c] for c in (*filter_audit.MEASURES, "shapley")} for r in got.collect()}
    assert found == {key: {c: row[c] for c in (*filter_audit.MEASURES, "shapley")} for key, row in brute(docs, labels).items()}
    return found


def test_matches_every_order_applied_in_turn(spark, documents):
    long = " ".join(f"w{i}" for i in range(220))
    texts = ["", None, "short", long, long + " #", "SHOUT " + long, "a " * 250, "A| " * 300, long, "short", "é" * 10, " \t\n", "a b"]
    docs = [(i, t, s) for i, (t, s) in enumerate(zip(texts * 2, ["x", None, "y", "", "x"] * 6))]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 22)] + [(None, 1, 1), (3, None, None), (3, 0, 1), (900, 1, 1)]
    found = check(spark, documents, docs, labels)
    assert len(found) == 3 * 600


def test_copies_with_repeated_and_null_ids(spark, documents):
    docs = [(5, "same", "a"), (5, "same", "a"), (5, "same", "b"), (7, "same", "a"), (None, "same", "a"), (None, "same", "a"), (5, "other", "a"), (2, "other", "b")]
    check(spark, documents, docs, [(5, 1, 0), (5, 1, 0), (7, 0, 1)])


def test_one_text_in_most_rows(spark, documents):
    docs = [(i, "hot" if i % 3 else f"text {i}", f"s{i % 4}") for i in range(300)]
    check(spark, documents, docs, [(i, 1, i % 2) for i in range(0, 300, 7)])


def test_empty_tables_and_clashing_names(spark, documents):
    labels = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(documents([(1, "a", "s")]).limit(0), labels).count() == 0
    docs = documents([(1, "a b", "s"), (2, "a b", "s")])
    for name in ("part", "mask", "digest", "n", "good", "toxic", "low", "firsts", "quality"):
        docs = docs.withColumn(name, F.lit("x"))
    assert filter_audit.audit(docs, labels.withColumn("good", F.lit(1)).withColumn("text", F.lit("t"))).where("removed > 0").count() > 0


@pytest.mark.parametrize("count", [1, 2**40, 2**62])
def test_wide_fields_do_not_overflow(count):
    table = filter_audit.integers(3)
    fields = filter_audit.unpack(count * table[0b101, True, False], 3, 6)
    order = list(permutations(range(3))).index((2, 1, 0))
    assert fields[order, :, 0].tolist() == [0, 0, 0] and fields[order, :, 1].tolist() == [count, 0, 0]
    assert fields[order, :, 2].tolist() == [0, 0, count] and fields[order, :, 4].tolist() == [count, 0, 0]
    assert set(fields.ravel().tolist()) <= {0, count}


def test_a_part_beyond_the_fields_is_an_error():
    import pyarrow as pa
    group = pa.table({"mask": pa.array([0, 1], pa.int32()), "good": [False, False], "toxic": [False, False], "n": [2**62, 2**62]})
    with pytest.raises(OverflowError):
        filter_audit._auditor("ABC")((pa.scalar("p"),), group)
