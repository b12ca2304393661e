import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from scholarsieve.llm import toxicity


def corpus(n=700, seed=2):
    rng = random.Random(seed)
    words = [a + b for a in "ba ke lo mi nu ro sa ti".split() for b in "dan ner tol vik sum per".split()]
    texts, labels = {}, {}
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(rng.randrange(1, 5)):
                text[rng.randrange(len(text))] = rng.choice(["idiot", "Moron!", "zugg" + rng.choice(words), "zugg" + rng.choice(words)])
        texts[i], labels[i] = " ".join(text), int(toxic if rng.random() > 0.03 else not toxic)
        if toxic is not bool(labels[i]):
            labels[i] = labels[i]
    truth = {i: any(w in t.lower() for w in ("idiot", "moron", "zugg")) for i, t in texts.items()}
    return texts, labels, truth


def test_held_out_accuracy_with_noisy_labels(spark, documents):
    texts, labels, truth = corpus()
    docs, marks = documents(texts), spark.createDataFrame([(i, 1, v) for i, v in labels.items() if i % 5 < 4], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, marks)
    rows = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert rows.keys() == texts.keys()
    for i, r in rows.items():
        assert r.held_out is (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    out = [i for i, r in rows.items() if r.held_out]
    assert sum(rows[i].predicted == truth[i] for i in out) >= 0.97 * len(out)
    kept = toxicity.clean(docs.withColumn("score", F.lit(1)), model)
    assert kept.columns == [*docs.columns, "score"] and {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if not r.predicted}


def test_held_out_labels_are_never_read(spark, documents):
    texts, labels, _ = corpus(200)
    docs = documents(texts)
    held = [i for i in texts if zlib.crc32(str(i).encode()) % 5 == 0]
    both = [spark.createDataFrame([(i, 1, (1 - v) if flip and i in held else v) for i, v in labels.items()], "doc_id long, quality int, toxic int") for flip in (False, True)]
    first, second = (sorted((r.doc_id, r.score) for r in toxicity.score(docs, toxicity.learn(docs, b)).collect()) for b in both)
    assert first == second


def test_label_model_learns_accuracies_without_truth():
    rng = np.random.default_rng(0)
    truth = rng.random(2000) < 0.4
    votes = np.zeros((2000, 6))
    for j, accuracy in enumerate((0.9, 0.85, 0.8, 0.75, 0.6)):
        right = rng.random(2000) < accuracy
        votes[:, j] = np.where(rng.random(2000) < 0.8, np.where(truth == right, 1, -1), 0)
    votes[:, 5] = votes[:, 4]  # an echo of the worst voter
    posterior = toxicity.label_model(votes)
    assert ((posterior >= 0.5) == truth).mean() > 0.9


def test_no_labels_nulls_and_empty_tables(spark, documents):
    docs = documents([(1, None, "s"), (2, "", "s"), (3, "You idiot, you moron", "s"), (None, "fine", None), (3, "fine", "s")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, none)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 5 and sorted(r.predicted for r in rows) == [0, 0, 0, 0, 1]
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    assert toxicity.score(docs.limit(0), model).count() == 0
    labels = spark.createDataFrame([(None, 1, 1), (3, 1, None), (3, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.learn(docs, labels)).count() == 5
