"""Queries on sets of vectors: Frechet distances and bins whose shares differ."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..operators.moments import assigned, frechet, gaussian, k_means, moments, usable
from ..sources.views import table
from .registry import query

#: Bins of the comparison by bins, rounds of k-means, and the level at which shares differ.
BINS, ROUNDS, LEVEL = 16, 8, 0.05
#: Labels that are compared each with all; what comes to the driver grows with labels, not with rows.
MOST_LABELS = 1000


@query()
def frechet_distance(spark, sf_dir):
    """The Frechet distance of each label's vectors to all vectors, and to those of the label after it (the first after the last)."""
    rows, width = usable(table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("label"), "embedding").where("label is not null"), "embedding")
    labels = sorted(moments(rows, "label", "embedding", width).limit(MOST_LABELS).collect(), key=lambda r: r.label)
    sets = [(r.n, np.array(r.sums), np.array(r.products)) for r in labels]
    whole = gaussian(*(sum(s[i] for s in sets) for i in range(3))) if sets else None
    found = [gaussian(*s) for s in sets]
    out = [(r.label, r.n, round(frechet(found[i], whole), 6), round(frechet(found[i], found[(i + 1) % len(found)]), 6)) for i, r in enumerate(labels)]
    return spark.createDataFrame(out, "label long, n long, to_all double, to_next double")


@query()
def different_bins(spark, sf_dir):
    """The number of statistically different bins of each label: k-means bins of all vectors, and in each bin a test of two shares.

    The first centres are the vectors of the least ids. A bin counts as different if the shares of the label's vectors and of
    all others in it differ by a two-sided test at LEVEL.
    """
    rows, width = usable(table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), "embedding").where("label is not null"), "embedding")
    first = np.array([r.embedding for r in rows.orderBy("vec_id", "embedding").limit(BINS).collect()], np.float64).reshape(-1, max(width, 1))
    centres = k_means(rows, "embedding", first, ROUNDS) if len(first) else np.zeros((1, 1))
    counts = assigned(rows, "embedding", centres, ["label"]).groupBy("label", "bin").agg(F.count(F.lit(1)).alias("c"))
    sizes = counts.groupBy("label").agg(F.sum("c").alias("n"))
    bins = counts.groupBy("bin").agg(F.sum("c").alias("in_bin"))
    total = sizes.agg(F.sum("n").alias("total"))
    grid = sizes.join(F.broadcast(bins), F.lit(True)).join(F.broadcast(total), F.lit(True)).join(counts, ["label", "bin"], "left").withColumn("c", F.coalesce("c", F.lit(0)))  # BINS rows a label
    rest, pooled = F.col("total") - F.col("n"), F.col("in_bin") / F.col("total")
    gap = F.col("c") / F.col("n") - (F.col("in_bin") - F.col("c")) / rest
    z = F.abs(gap) / F.sqrt(pooled * (1 - pooled) * (1 / F.col("n") + 1 / rest))
    differs = F.coalesce(z > _quantile(1 - LEVEL / 2), F.lit(False))
    return grid.groupBy("label").agg(F.first("n").alias("n"), F.count_if(differs).alias("different"), F.round(F.count_if(differs) / F.count(F.lit(1)), 6).alias("share"), F.round(F.max(z), 4).alias("most"))


def _quantile(share: float) -> float:
    """The quantile of the normal distribution, by bisection of its distribution function."""
    low, high = -10.0, 10.0
    while high - low > 1e-12:
        middle = (low + high) / 2
        low, high = (middle, high) if (1 + math.erf(middle / math.sqrt(2))) / 2 < share else (low, middle)
    return (low + high) / 2
