"""Toxicity by a factorization machine over hashed terms.

The terms of a text are the beginnings (5 to 10 characters; the whole of a shorter word) of its distinct words,
lower-cased and without punctuation at their ends, so that inflected forms share a term. Terms are hashed to 2^18 buckets. Of these the machine takes the
ones that a chi-square test finds most dependent on the label, each as 0 or 1. A score is
sigmoid(bias + sum of weights + sum over pairs of <v_i, v_j>): the pairs are what an additive model misses, such as
an insult that counts for more next to the mention of a group.

It is fitted on at most `per_class` labelled rows a class (a documented bound); their chi-square counts are summed in
Spark, and the fit itself is a few hundred steps of gradient descent over rows of a few integers. Scoring is one pass
without a shuffle, with a model of bounded size in a broadcast variable.

Defined results: a null text counts as empty, and the score of a text without any known term is the bias; repeated
rows are scored alike; texts are read whole; without training rows every score is 0.5; an
empty table gives an empty result. Only the named columns are read; the result has the columns of docs and `score`.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import load, parts_of, staged
from .labelled import fit_sample, fold

BUCKETS = 1 << 18
STEMS = (5, 6, 7, 8, 10)
#: Bounds of the fit: rows a class, and buckets that the machine takes.
PER_CLASS = 8192
FEATURES = 1024
FACTORS = 8
#: Words that a task remembers; beyond that it starts anew. Their terms, several times as many, are hashed instead.
MEMO = 250_000
#: Text that is read at a time.
PART_BYTES = 2 << 20
_ENDS = string.punctuation + "«»„“”‘’…¡¿"


def bucket(term: str) -> int:
    return xxhash.xxh64_intdigest(term) % BUCKETS


class TermIndex:
    """Maps texts to their distinct terms' places among the chosen buckets (all buckets if none are given).

    Words without a term among the chosen, nearly all of them, are remembered as a set and taken off a text's words
    in one set difference.
    """

    def __init__(self, chosen: np.ndarray | None = None):
        self.place = None if chosen is None else {int(b): i for i, b in enumerate(chosen)}
        self.blank: set[str] = set()
        self.known: dict[str, tuple[int, ...]] = {}

    def _stem(self, term: str) -> int:
        return bucket(term) if self.place is None else self.place.get(bucket(term), -1)

    def _learn(self, word: str) -> tuple[int, ...]:
        bare = word.strip(_ENDS)
        at = {self._stem(bare if len(bare) <= n else bare[:n] + "*") for n in STEMS} - {-1} if bare else set()
        if not at:
            self.blank.add(word)
        else:
            self.known[word] = tuple(at)
        return tuple(at)

    def terms(self, text: str | None) -> list[int]:
        if len(self.blank) + len(self.known) > MEMO:
            self.blank, self.known = set(), {}
        known, found = self.known, set()
        for word in set((text or "").lower().split()) - self.blank:
            found.update(known.get(word) or self._learn(word))
        return sorted(found)


@dataclass
class FactorizationMachine:
    """chosen: the buckets it knows; bias, w (weights) and v (factors) of each."""

    chosen: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def score(self, rows: list[list[int]]) -> np.ndarray:
        out = np.full(len(rows), self.bias)
        for r, places in enumerate(rows):
            if places:
                v = self.v[places]
                out[r] += self.w[places].sum() + 0.5 * (np.square(v.sum(0)) - np.square(v).sum(0)).sum()
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit_machine(chosen: np.ndarray, rows: list[list[int]], y: np.ndarray, factors: int = FACTORS, epochs: int = 30, batch: int = 256, rate: float = 0.02, decay: float = 1e-4, seed: int = 1) -> FactorizationMachine:
    """Adam on the log loss, both classes weighing half; the same rows give the same machine."""
    n, rng = len(chosen), np.random.default_rng(seed)
    if not len(y) or not n:
        return FactorizationMachine(chosen, 0.0, np.zeros(n), np.zeros((n, factors)))
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    theta = [np.zeros(1), np.zeros(n), rng.normal(0, 0.01, (n, factors))]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            x = np.zeros((len(part), n))
            for i, r in enumerate(part):
                x[i, rows[r]] = 1
            summed = x @ theta[2]
            z = theta[0] + x @ theta[1] + 0.5 * (np.square(summed) - x @ np.square(theta[2])).sum(1)
            g = weight[part] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
            gx = x.T @ g
            grads = [g.sum(keepdims=True), gx + decay * theta[1], x.T @ (g[:, None] * summed) - gx[:, None] * theta[2] + decay * theta[2]]
            step += 1
            for k, d in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.999 * second[k] + 0.001 * d * d
                theta[k] -= rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return FactorizationMachine(chosen, float(theta[0][0]), theta[1], theta[2])


def _term_rows(sample: DataFrame) -> DataFrame:
    ship(sample.sparkSession)

    def of(batches):
        index = TermIndex()
        for batch in batches:
            yield pa.record_batch([pa.array([index.terms(t) for t in batch.column(0).to_pylist()], pa.list_(pa.int32())), batch.column(1)], names=["terms", "y"])

    return sample.mapInArrow(of, "terms array<int>, y int")


def fit(sample: DataFrame, features: int = FEATURES, **how) -> FactorizationMachine:
    """The machine of a sample with columns text, y; the sample must be bounded."""
    rows = staged(_term_rows(sample), "toxicity-terms")
    n, positive = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    counts = rows.select(F.explode("terms").alias("bucket"), "y").groupBy("bucket").agg(F.count(F.lit(1)).alias("df"), F.sum("y").alias("hits"))
    expected = F.col("df") * F.lit(positive / max(1, n))
    spread = expected * F.lit(1 - positive / max(1, n)) * (1 - F.col("df") / F.lit(max(1, n) + 1))
    ranked = counts.where("df >= 3").select("bucket", (F.pow(F.col("hits") - expected, 2) / (spread + 1e-9)).alias("chi"))
    chosen = np.array(sorted(r.bucket for r in ranked.orderBy(F.desc("chi"), "bucket").limit(features).collect()), np.int64)
    place = {int(b): i for i, b in enumerate(chosen)}
    small = rows.select(F.array_sort(F.array_intersect("terms", F.array(*map(F.lit, chosen.tolist())) if len(chosen) else F.expr("array()").cast("array<int>"))).alias("terms"), "y")
    known = sorted((r.terms, r.y) for r in small.collect())
    return fit_machine(chosen, [[place[b] for b in t] for t, _ in known], np.array([y for _, y in known], float), **how)


def score(docs: DataFrame, machine: FactorizationMachine, text_col: str = "text") -> DataFrame:
    """docs with `score`, from one pass over the whole texts."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    kept = [c for c in docs.columns if c != "score"]
    at = kept.index(text_col)

    def of(batches):
        model = sent.value
        index = TermIndex(model.chosen)
        for batch in (part for b in batches for part in parts_of(b, PART_BYTES, at)):
            found = model.score([index.terms(t) for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*kept, "score"])

    rows = docs.select(*kept)
    return rows.mapInArrow(of, rows.withColumn("score", F.lit(0.0)).schema)


def toxicity(docs: DataFrame, labels: DataFrame, train, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", per_class: int = PER_CLASS) -> DataFrame:
    """docs with `score`, the machine being fitted on the labels that train (a condition on labels) admits."""
    sample = fit_sample(docs, labels, label_col, train, per_class, id_col, text_col)
    return score(docs, fit(sample), text_col)


def op3_toxicity(spark, sf_dir):
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    found = toxicity(docs.select("doc_id", "text"), labels, fold("doc_id", 3) != 1)
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
