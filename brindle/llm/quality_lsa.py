"""Document quality by nearest-neighbour voting among latent-semantic vectors of labelled documents.

The terms of a text are, for each of its words, the word's shape (runs of upper-case letters, lower-case letters,
digits and single marks) and its first three characters, and, for the whole text, how much its words and lines repeat
and how long it is. Terms are hashed to `DIMENSIONS` columns and weighted by log(1 + count) and inverse document
frequency; a singular value decomposition of the labelled rows' matrix turns them into vectors of `RANK` numbers.

The labelled vectors are at most `per_class` a class (a documented bound), so they are broadcast. Every document is
compared with each of them: exact cosine products in double precision in blocks of documents, no index and no
candidates. The `NEIGHBOURS` nearest vote, weighted by a power of the similarity, and the score is label 1's share.
Similarities count to `PLACES` decimal places, and all labelled rows as near as the last of the nearest vote too, so
that neither the order of rows nor the last bits of a product decide.

Defined results: a null text counts as empty; a text without terms has a vector all the same (of its length), and so
a score; repeated rows are scored alike; texts are read whole; without training rows every score is 0.5; an empty
table gives an empty result. Only the named columns are read; the result has the columns of docs and `score`.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import load
from .labelled import fit_sample, fold

DIMENSIONS = 2048
RANK = 48
PER_CLASS = 3072
NEIGHBOURS = 15
#: How steeply a neighbour's vote falls with its distance.
SHARPNESS = 8
#: Decimal places to which a similarity counts.
PLACES = 9
BLOCK = 512
#: Words that a task remembers; beyond that it starts anew.
MEMO = 400_000
_SHAPES = ((re.compile(r"[^\W\d_a-zß-öø-ÿ]+"), "A"), (re.compile(r"[^\W\d_A]+"), "a"), (re.compile(r"\d+"), "0"))


def column_of(term: str) -> int:
    return xxhash.xxh64_intdigest(term) % DIMENSIONS


def shape(word: str) -> str:
    for pattern, sign in _SHAPES:
        word = pattern.sub(sign, word)
    return word[:6]


class TermCounter:
    """Columns and weighted counts of a text's terms."""

    def __init__(self):
        self.memo: dict[str, tuple[int, int]] = {}

    def _learn(self, word: str) -> tuple[int, int]:
        found = self.memo[word] = (column_of("s:" + shape(word)), column_of("w:" + word[:3].lower()))
        return found

    def vector(self, text: str | None) -> np.ndarray:
        if len(self.memo) > MEMO:
            self.memo = {}
        text = text or ""
        row, lines = text.split(), text.split("\n")
        words, n = Counter(row), len(row)
        out = np.zeros(DIMENSIONS, np.float32)
        memo, learn = self.memo, self._learn
        for word, count in words.items():
            a, b = memo.get(word) or learn(word)
            out[a] += count
            out[b] += count
        out = np.log1p(out * (100 / max(n, 1)))
        for term in (f"length:{n.bit_length()}", f"distinct:{int(10 * len(words) / max(n, 1))}", f"lines:{int(10 * len(set(lines)) / len(lines))}", f"echoes:{int(10 * sum(map(eq, row, row[1:])) / max(n, 1))}"):
            out[column_of(term)] += 3
        return out


@dataclass
class QualityModel:
    """weights (of columns), basis (columns x rank), vectors (normalised, of labelled rows), y (their labels)."""

    weights: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    y: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        z = (x * self.weights).astype(np.float64) @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Exact cosines with all labelled vectors, then the nearest vote."""
        if not len(self.y):
            return np.full(len(x), 0.5)
        cosines = np.round(self.project(x) @ self.vectors.T, PLACES)
        k = min(NEIGHBOURS, len(self.y))
        last = np.partition(cosines, len(self.y) - k, axis=1)[:, len(self.y) - k]
        row, near = np.nonzero(cosines >= last[:, None])
        weight = np.clip(cosines[row, near], 1e-3, 1) ** SHARPNESS
        return np.bincount(row, weight * self.y[near], len(x)) / np.bincount(row, weight, len(x))


def fit_model(x: np.ndarray, y: np.ndarray, rank: int = RANK, seed: int = 1) -> QualityModel:
    """The decomposition of the rows by a randomised range finder with two power steps."""
    n = len(x)
    weights = np.log((1 + n) / (1 + (x > 0).sum(0))).astype(np.float32) + np.float32(0.1)
    weighted = x * weights
    basis = np.linalg.qr(weighted.T @ np.random.default_rng(seed).normal(size=(n, rank + 8)).astype(np.float32))[0] if n else np.zeros((x.shape[1], rank + 8), np.float32)
    for _ in range(2 * bool(n)):
        basis = np.linalg.qr(weighted.T @ (weighted @ basis))[0]
    inner = weighted @ basis
    values, turn = np.linalg.eigh(inner.T @ inner)
    basis = basis.astype(np.float64) @ turn[:, np.argsort(-values)[:rank]]
    model = QualityModel(weights, basis, np.zeros((0, rank), np.float32), y.astype(float))
    model.vectors = model.project(x)
    return model


def fit(sample: DataFrame, rank: int = RANK) -> QualityModel:
    """The model of a sample with columns text, y; the sample must be bounded."""

    ship(sample.sparkSession)

    def of(batches):
        counter = TermCounter()
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                rows = [counter.vector(t) for t in part.column(0).to_pylist()]
                at_rows = [np.flatnonzero(r).astype(np.int16) for r in rows]
                yield pa.record_batch([pa.array([i.tobytes() for i in at_rows], pa.binary()), pa.array([r[i].tobytes() for r, i in zip(rows, at_rows)], pa.binary()), part.column(1)], names=["at", "x", "y"])

    rows = sorted((bytes(r.at), bytes(r.x), r.y) for r in sample.mapInArrow(of, "at binary, x binary, y int").toLocalIterator())
    x = np.zeros((len(rows), DIMENSIONS), np.float32)
    for i, (at, values, _) in enumerate(rows):
        x[i, np.frombuffer(at, np.int16)] = np.frombuffer(values, np.float32)
    return fit_model(x, np.array([y for _, _, y in rows], float), rank)


def score(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """docs with `score`, from one pass over the whole texts."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != "score"]
    at = kept.index(text_col)

    def of(batches):
        known, counter = sent.value, TermCounter()
        for batch in batches:
            for start in range(0, len(batch), BLOCK):
                part = batch.slice(start, BLOCK)
                x = np.stack([counter.vector(t) for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(known.score(x).astype(float))], names=[*kept, "score"])

    rows = docs.select(*kept)
    return rows.mapInArrow(of, rows.withColumn("score", F.lit(0.0)).schema)


def quality(docs: DataFrame, labels: DataFrame, train, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", per_class: int = PER_CLASS) -> DataFrame:
    """docs with `score`, the model being fitted on the labels that train (a condition on labels) admits."""
    return score(docs, fit(fit_sample(docs, labels, label_col, train, per_class, id_col, text_col)), text_col)


def op5_quality_knn(spark, sf_dir):
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    found = quality(docs.select("doc_id", "text"), labels, fold("doc_id", 4) != 2)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
