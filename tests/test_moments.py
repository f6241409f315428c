"""Frechet distances, k-means and bins against plain numpy on the given vectors."""

import numpy as np
import pytest

from brindle.operators.moments import assigned, frechet, gaussian, k_means, moments, usable
from brindle.plans import moment_queries
from brindle.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    return np.array([r.vec_id for r in rows]), np.array([r.label for r in rows]), np.array([r.embedding for r in rows], float)


def plain_frechet(x, y):
    a, b = np.cov(x.T), np.cov(y.T)
    values = np.linalg.eigvals(a @ b)
    return ((x.mean(0) - y.mean(0)) ** 2).sum() + np.trace(a) + np.trace(b) - 2 * np.sqrt(np.maximum(values.real, 0)).sum()


def test_frechet_distances(spark, vectors):
    _, labels, x = vectors
    names = sorted(set(labels))
    got = {r.label: r for r in QUERIES["frechet_distance"](spark, SF).collect()}
    assert sorted(got) == names
    for i, name in enumerate(names):
        mine = x[labels == name]
        assert got[name].n == len(mine)
        assert got[name].to_all == pytest.approx(plain_frechet(mine, x), abs=1e-4)
        assert got[name].to_next == pytest.approx(plain_frechet(mine, x[labels == names[(i + 1) % len(names)]]), abs=1e-4)


def test_frechet_of_gaussians():
    assert frechet((np.zeros(2), np.eye(2)), (np.array([3.0, 4.0]), 4 * np.eye(2))) == pytest.approx(25 + 2)
    assert frechet(*[gaussian(4, np.array([4.0]), np.array([10.0]))] * 2) == pytest.approx(0)


def test_moments_of_odd_rows(spark):
    rows = [("a", [1.0, 2.0]), ("a", [3.0, -1.0]), (None, [1.0, 1.0]), ("b", None), ("b", [1.0]), ("b", [float("nan"), 1.0]), ("b", [None, 1.0]), ("b", [])]
    kept, width = usable(spark.createDataFrame(rows, "g string, v array<double>").repartition(3), "v")
    got = {r.g: (r.n, r.sums, r.products) for r in moments(kept, "g", "v", width).collect()}
    assert got == {"a": (2, [4.0, 1.0], [10.0, -1.0, -1.0, 5.0]), None: (1, [1.0, 1.0], [1.0, 1.0, 1.0, 1.0])}
    assert usable(kept.where("false"), "v")[1] == 0


def test_bins(spark, vectors):
    ids, labels, x = vectors
    centres = x[np.argsort(ids)[: moment_queries.BINS]].copy()
    for _ in range(moment_queries.ROUNDS):
        at = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.array([x[at == k].mean(0) if (at == k).any() else centres[k] for k in range(len(centres))])
    at = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    got = {r.label: r for r in QUERIES["different_bins"](spark, SF).collect()}
    for name in set(labels):
        mine, most, different = labels == name, 0.0, 0
        for k in set(at):
            p, q, pooled = (at[mine] == k).mean(), (at[~mine] == k).mean(), (at == k).mean()
            z = abs(p - q) / np.sqrt(pooled * (1 - pooled) * (1 / mine.sum() + 1 / (~mine).sum()))
            most, different = max(most, z), different + (z > 1.959964)
        assert (got[name].n, got[name].different) == (mine.sum(), different) and got[name].most == pytest.approx(most, abs=1e-3)


def test_k_means_keeps_empty_centres(spark):
    frame = spark.createDataFrame([([float(i % 2), 0.0],) for i in range(10)], "v array<double>")
    centres = k_means(frame, "v", np.array([[0.1, 0.0], [0.9, 0.0], [50.0, 50.0]]), 3)
    assert centres.tolist() == [[0.0, 0.0], [1.0, 0.0], [50.0, 50.0]]
    assert {r.bin for r in assigned(frame, "v", centres, []).collect()} == {0, 1}
