"""Toxicity by weak supervision.

Voters: a fixed lexicon of insults, stems induced from labelled rows, and patterns (shouting, second person
next to a hit, repeated hits, the noisy human label). On a bounded sample of labelled rows a generative label
model estimates every voter's accuracy by expectation maximisation and the correlations of voters within each
class; a voter's say is divided by how much it repeats others. The posterior labels train a linear classifier
(logistic regression) on the hits of lexicon and stems, which then scores every document.

`SAMPLE` bounds the labelled rows of each class used for fitting (chosen by a hash of doc_id). Everything else
covers all rows. Labels, lang, source and doc_id are never inputs of a score.

Nulls and edge cases: null and empty texts are scored by the intercept; no labelled rows leave the fixed lexicon
with its default weights; rows with equal doc_ids each get a row (labels of an id are reduced to their maximum);
a null doc_id is never labelled and not held out; an empty table gives no rows. Extra columns are kept by `clean`.
"""
from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Common insults that vote without any label.
LEXICON = ("idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "worthless", "pathetic", "disgusting",
           "dumb", "imbecile", "filthy", "vermin", "jerk", "bastard", "garbage", "freak")
SAMPLE = 3000
STEM_LENGTHS = (3, 4, 5, 6, 7)
MOST_STEMS = 300
LEAST_EVIDENCE = 16.0  # log-likelihood ratio that a stem needs, so that chance finds none among some 100,000 stems
ROUNDS = 50

_WORD = re.compile(r"\w+")
_SECOND = re.compile(r"\b(?:you|your|du|dein|tu|vous|ton|su)\b")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass
class Model:
    """Linear classifier over the distinct voters that a text hits and the number of hits."""
    weights: dict[str, float]  # lexicon words and stems (stems end in *)
    per_hit: float
    intercept: float

    def __post_init__(self):
        self.whole = {w: v for w, v in self.weights.items() if not w.endswith("*")}
        self.stems = {w[:-1]: v for w, v in self.weights.items() if w.endswith("*")}
        self.lengths = sorted({len(s) for s in self.stems})
        self.known: dict[str, tuple[str, ...]] = {}

    def hits(self, word: str) -> tuple[str, ...]:
        found = self.known.get(word)
        if found is None:
            found = ((word,) if word in self.whole else ()) + tuple(word[:n] + "*" for n in self.lengths if word[:n] in self.stems and len(word) >= n)
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[word] = found
        return found

    def score(self, text: str) -> float:
        all_hits = [h for w in words_of(text) for h in self.hits(w)]
        return _squash(self.intercept + sum(self.weights[h] for h in set(all_hits)) + self.per_hit * np.log1p(len(all_hits)))


def _squash(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def label_model(votes: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Posterior probability of class 1 for rows of votes in {1 toxic, -1 clean, 0 abstain}.

    Dawid-Skene with abstention: P(vote | class) per voter by EM, started from the votes' majority. Voters that
    agree beyond what their accuracies explain are correlated; each voter's log-likelihood counts 1 / (1 + the
    sum of its positive residual correlations), estimated once within the classes of a first fit.
    """
    rows, voters = votes.shape
    post = np.clip(0.5 + 0.5 * np.sign(votes.sum(axis=1)) * 0.9, 0.05, 0.95)
    post[votes.any(axis=1) == 0] = 0.05
    say = np.ones(voters)
    for fit in range(2):
        for _ in range(rounds):
            prior = np.clip(post.mean(), 0.01, 0.99)
            logits = np.full(rows, np.log(prior / (1 - prior)))
            for value in (1, 0, -1):
                cast = (votes == value).astype(float)
                toxic = (post @ cast + 0.5) / (post.sum() + 1.5)
                clean = ((1 - post) @ cast + 0.5) / ((1 - post).sum() + 1.5)
                logits += cast @ (say * np.log(toxic / clean))
            new = _squash(logits)
            done = np.abs(new - post).max() < 1e-6
            post = new
            if done:
                break
        if fit == 0 and voters > 1:
            residual = np.zeros((voters, voters))
            for weight in (post, 1 - post):
                if weight.sum() < 2:
                    continue
                mean = weight @ votes / weight.sum()
                centred = (votes - mean) * np.sqrt(weight)[:, None]
                spread = np.sqrt((centred ** 2).sum(axis=0)) + 1e-9
                residual = np.maximum(residual, (centred / spread).T @ (centred / spread))
            np.fill_diagonal(residual, 0)
            say = 1 / (1 + np.where(residual > 0.2, residual, 0).sum(axis=1))
    return post


def fit_linear(features: np.ndarray, target: np.ndarray, ridge: float = 0.3, rounds: int = 25) -> np.ndarray:
    """Weights of a logistic regression on soft targets (Newton steps); the last one is the intercept."""
    x = np.hstack([features, np.ones((len(features), 1))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = _squash(x @ w)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty), x.T @ (target - p) - penalty * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most `sample` labelled training rows per class."""
    by_id = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    order = F.xxhash64("doc_id")
    picked = by_id.where("toxic = 1").orderBy(order, "doc_id").limit(sample).unionByName(by_id.where("toxic = 0").orderBy(order, "doc_id").limit(sample))
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic")


def _stem_rows(batches):
    """Distinct stems and words of each text with its label, as counts per batch."""
    for batch in batches:
        seen: dict[str, list[int]] = {}
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
            distinct = set(words_of(text.as_py()))
            for stem in {w[:n] + "*" for w in distinct for n in STEM_LENGTHS if len(w) >= n} | distinct:
                seen.setdefault(stem, [0, 0])[toxic] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([v[0] for v in seen.values()], pa.int64()),
                                          pa.array([v[1] for v in seen.values()], pa.int64())], names=["stem", "clean", "toxic"])


def induce_stems(rows: DataFrame) -> list[str]:
    """Words and stems that the labelled rows show almost only in toxic texts; the shortest of each family."""
    counts = rows.groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in counts}
    if not n.get(0) or not n.get(1):
        return []
    base = n[1] / (n[0] + n[1])
    share = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    evidence = F.col("toxic") * F.log(share / base) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    strong = (rows.select("text", "toxic").mapInArrow(_stem_rows, "stem string, clean long, toxic long").groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
              .where((F.col("toxic") / n[1] >= 20 * F.col("clean") / n[0]) & (evidence >= LEAST_EVIDENCE))
              .orderBy(F.desc(evidence), F.length("stem"), "stem").limit(4 * MOST_STEMS).collect())
    chosen: dict[str, int] = {}
    for stem, _, toxic in sorted(((r["stem"], r["clean"], r["toxic"]) for r in strong), key=lambda r: (len(r[0].rstrip("*")), r[0])):
        bare = stem.rstrip("*")
        parent = next((chosen[bare[:k] + "*"] for k in STEM_LENGTHS if bare[:k] + "*" in chosen and bare[:k] + "*" != stem), 0)
        if parent < toxic:  # a shorter stem that is as pure covers it
            chosen[stem] = toxic
    return sorted(chosen, key=lambda s: (-chosen[s], s))[:MOST_STEMS]


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most 2 * `sample` labelled rows; their hits, not their texts, come to the driver."""
    rows = training_rows(docs, labels, sample)
    voters = list(dict.fromkeys([*LEXICON, *induce_stems(rows)]))
    probe = Model(dict.fromkeys(voters, 0.0), 0.0, 0.0)
    index = {v: i for i, v in enumerate(voters)}

    def vote(batches):
        for batch in batches:
            found, numbers, patterns = [], [], []
            for text in batch.column(0):
                text = text.as_py()
                words = words_of(text)
                hits = [h for w in words for h in probe.hits(w)]
                found.append(sorted({index[h] for h in hits}))
                numbers.append(len(hits))
                letters = [c for c in text if c.isalpha()]
                shouting = len(letters) > 40 and sum(c.isupper() for c in letters) > 0.6 * len(letters)
                second = bool(hits) and bool(_SECOND.search(text.lower()))
                patterns.append([int(shouting), int(second), int(len(hits) > 2), -int(not hits)])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), pa.array(numbers, pa.int32()), pa.array(patterns, pa.list_(pa.int32())), batch.column(1)],
                                             names=["found", "hits", "patterns", "toxic"])

    seen = rows.select("text", "toxic").mapInArrow(vote, "found array<int>, hits int, patterns array<int>, toxic int").collect()
    default = Model(dict.fromkeys(LEXICON, 4.0), 1.0, -3.0)
    if len({r["toxic"] for r in seen}) < 2:
        return default
    features = np.zeros((len(seen), len(voters)))
    for i, r in enumerate(seen):
        features[i, r["found"]] = 1
    # The human label votes as well: a good but noisy voter, entered twice so that it outweighs one lexicon entry.
    human = np.array([1 if r["toxic"] else -1 for r in seen], float)[:, None]
    votes = np.hstack([features, np.array([r["patterns"] for r in seen], float), human, human])
    posterior = label_model(votes)
    linear = np.hstack([features, np.log1p([[r["hits"]] for r in seen])])
    w = fit_linear(linear, posterior)
    return Model({v: float(max(w[i], 0.0)) for v, i in index.items()}, float(w[-2]), float(w[-1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    def judge(batches):
        for batch in batches:
            scores = np.array([model.score(text.as_py() or "") for text in batch.column(1)], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    return (docs.select("doc_id", "text").mapInArrow(judge, "doc_id long, score double")
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")))


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that score below 0.5, all columns kept; one narrow pass."""
    @F.pandas_udf("boolean")
    def toxic(texts):
        return texts.map(lambda t: model.score(t or "") >= 0.5)

    return docs.where(~toxic("text"))
