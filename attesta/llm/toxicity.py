"""Severity of toxic language by cumulative-link ordinal regression on sparse text features.

P(grade > k) = sigmoid(w.x - t_k): one weight vector for all thresholds. Features are words and word beginnings of
four to eight letters, chosen by how strongly they go with toxic labels. Labels only say toxic or not, so the grade
of a toxic training text is 1 or 2: the half with more signs of it (the sum of its features' values) is the severe one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.words import slices

MARKS = ".,;:!?\"'()[]{}<>*#$%&|"
TRAINING_ROWS, FEATURES = 10_000, 512


def _features(word: str) -> list[str]:
    return [word, *(word[:k] + "^" for k in range(4, min(9, len(word))))]


def _words(text: str | None) -> list[str]:
    return [c for w in (text or "").lower().split() if (c := w.strip(MARKS))]


@dataclass
class Severity:
    """A fitted model: weights of the features and of log word count, and ascending thresholds."""

    weights: dict[str, float]
    length: float
    thresholds: list[float]

    def scorer(self) -> _Scorer:
        return _Scorer(self)


class _Scorer:
    def __init__(self, model: Severity):
        self.model, self.index = model, {f: k for k, f in enumerate(model.weights)}
        self.weights = np.array(list(model.weights.values()))
        self.known: dict[str, tuple[int, ...]] = {}

    def counts(self, text: str | None) -> tuple[Counter, int]:
        """(how often each feature occurs, words)."""
        words, found = _words(text), Counter()
        known = self.known
        if len(known) > 1 << 18:
            known.clear()
        for w in words:
            hit = known.get(w)
            if hit is None:
                hit = known[w] = tuple(self.index[f] for f in _features(w) if f in self.index)
            if hit:
                found.update(hit)
        return found, len(words)

    def above(self, text: str | None) -> np.ndarray:
        """P(grade > k) for each threshold."""
        found, n = self.counts(text)
        score = sum(self.weights[k] * np.log1p(c) for k, c in found.items()) + self.model.length * np.log1p(n)
        return 1 / (1 + np.exp(np.clip(np.array(self.model.thresholds) - score, -50, 50)))


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """About `rows` labelled texts at most, by hash of the id."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long")).agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(rows / n * (1 << 20)))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(known, "doc_id")


def _chosen(sample: DataFrame, features: int, least: float) -> list[str]:
    """Features that go with toxic labels, by likelihood ratio."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                seen[bool(toxic)].update({f for w in set(_words(text)) for f in _features(w)})
            names = list(seen[0].keys() | seen[1].keys())
            yield pa.record_batch([pa.array(names, pa.string()), *(pa.array([s[f] for f in names], pa.int64()) for s in seen)], ["feature", "clean", "toxic"])

    totals = {bool(r.toxic): r.n for r in sample.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    b, a = totals.get(False, 0), totals.get(True, 0)
    if not a or not b:
        return []
    found = sample.select("text", F.col("toxic").cast("long")).mapInArrow(run, "feature string, clean long, toxic long")
    found = found.groupBy("feature").agg(F.sum("clean").alias("y"), F.sum("toxic").alias("x")).where((F.col("x") >= 3) & (F.col("x") * b > 2 * F.col("y") * a))
    part = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    x, y, share = F.col("x"), F.col("y"), (F.col("x") + F.col("y")) / (a + b)
    ratio = 2 * (part(x, share * a) + part(y, share * b) + part(a - x, (1 - share) * a) + part(b - y, (1 - share) * b))
    best = found.withColumn("ratio", ratio).where(F.col("ratio") >= least).orderBy(F.desc("ratio"), "feature").limit(features)
    got = {r.feature: (r.x, r.y) for r in best.select("feature", "x", "y").collect()}
    # A feature says nothing new if a shorter beginning occurs in as many texts of both kinds.
    return sorted(f for f in got if not any(got.get(f.rstrip("^")[:k] + "^") == got[f] for k in range(4, len(f.rstrip("^")))))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, features: int = FEATURES, least: float = 20.0, ridge: float = 1.0, steps: int = 30) -> Severity:
    """Learn from at most about `rows` rows of `labels` (doc_id, toxic) and their texts.

    Rows without id, label or text are left out and repeated labels count once, as the most toxic. Where a class is
    missing or no feature reaches a likelihood ratio of `least`, the model gives every text the share of toxic labels.
    """
    sample = _sample(docs, labels, rows).where("text is not null").select("text", F.col("toxic").cast("long").alias("toxic"))
    names = _chosen(sample, features, least)
    empty = Severity({f: 0.0 for f in names}, 0.0, [0.0, 0.0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = empty.scorer()
        for batch in slices(batches):
            found = [scorer.counts(t) for t in batch.column("text").to_pylist()]
            counts = pa.array([[list(kv) for kv in sorted(c.items())] for c, _ in found], pa.list_(pa.list_(pa.int32())))
            yield pa.record_batch([batch.column("toxic"), pa.array([n for _, n in found], pa.int64()), counts], ["toxic", "n", "counts"])

    got = sample.mapInArrow(run, "toxic long, n long, counts array<array<int>>").collect()
    toxic = np.array([r.toxic > 0 for r in got], bool)
    share = (toxic.sum() + 0.5) / (len(toxic) + 1)
    if not names or toxic.all() or not toxic.any():
        return Severity({}, 0.0, [float(np.log((1 - share) / share)), 50.0])
    x = np.zeros((len(got), len(names) + 1))
    hits = np.zeros(len(got))
    for i, r in enumerate(got):
        for k, c in r.counts:
            x[i, k] = np.log1p(c)
        hits[i] = x[i].sum()
        x[i, -1] = np.log1p(r.n)
    grade = np.where(toxic, 1 + (hits > np.median(hits[toxic])), 0)
    above = np.stack([grade > 0, grade > 1], axis=1).astype(float)
    # Newton's method on the convex loss of both cuts together: weights, then the two thresholds.
    size = x.shape[1]
    cuts = [np.hstack((x, np.tile([-1.0, 0.0], (len(x), 1)))), np.hstack((x, np.tile([0.0, -1.0], (len(x), 1))))]
    rate = (above.sum(0) + 0.5) / (len(x) + 1)
    p = np.concatenate((np.zeros(size), np.log((1 - rate) / rate)))
    shrink = np.concatenate((np.full(size, ridge), [1e-6, 1e-6]))
    for _ in range(steps):
        g, h = shrink * p, np.diag(shrink)
        for k, z in enumerate(cuts):
            chance = 1 / (1 + np.exp(-np.clip(z @ p, -50, 50)))
            g = g + z.T @ (chance - above[:, k])
            h = h + z.T @ (z * (chance * (1 - chance))[:, None])
        move = np.linalg.solve(h, g)
        p = p - move * min(1.0, 5.0 / max(1e-12, np.abs(move).max()))
        if np.abs(move).max() < 1e-6:
            break
    return Severity(dict(zip(names, p[: len(names)].tolist())), float(p[len(names)]), [float(p[-2]), float(max(p[-2:]))])


def severity(docs: DataFrame, model: Severity, least: float = 0.35) -> DataFrame:
    """(doc_id, severity, grade, toxic) of every row of `docs` (doc_id, text, any others).

    severity is the expected grade, from 0 to 2; grade the likeliest one; toxic means at least `least`. Null and empty
    texts are judged as texts without words; null ids and repeated rows like any other row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in slices(batches):
            above = np.array([scorer.above(t) for t in batch.column("text").to_pylist()])
            grade = np.argmax(np.stack([1 - above[:, 0], above[:, 0] - above[:, 1], above[:, 1]], axis=1), axis=1)
            yield pa.record_batch([batch.column("doc_id"), pa.array(above.sum(1)), pa.array(grade.astype(np.int32))], ["doc_id", "severity", "grade"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, severity double, grade int").withColumn("toxic", F.col("severity") >= least)


def civil(docs: DataFrame, model: Severity, least: float = 0.35) -> DataFrame:
    """The rows of `docs` whose expected severity is below `least`, with all their columns.

    Null and empty texts are judged as texts without words; repeated rows alike. An empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in slices(batches):
            stay = [bool(scorer.above(t).sum() < least) for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
