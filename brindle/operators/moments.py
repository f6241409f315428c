"""Second moments of vectors by group, the Frechet distance of two sets, and Lloyd's k-means; the work on rows is Spark's."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def usable(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """The rows whose vectors have only finite components and the table's commonest length, and that length (0: none)."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = rows.where(F.coalesce(finite, F.lit(False)) & (F.size(vector) > 0))
    first = whole.groupBy(F.size(vector).alias("width")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "width").first()
    width = first.width if first else 0
    return whole.where(F.size(vector) == width), width


def moments(rows: DataFrame, group: str, vector: str, width: int) -> DataFrame:
    """group, n, sums, products: the count, the component sums and the summed outer products (row by row) of each group.

    Each task adds up its own rows by group; what is shuffled is one entry a group, task and matrix entry, whose sums
    combine again. A group's result is one row of width * (width + 1) + 1 numbers, however many vectors it has.
    """
    ship(rows.sparkSession)

    def of(batches):
        sums, kind = {}, None
        for batch in batches:
            kind = batch.schema.field(0).type
            keys, x = batch.column(0), _matrix(batch.column(1), width)
            for key in pa.compute.unique(keys).to_pylist():
                at = pa.compute.fill_null(pa.compute.equal(keys, key), False).to_numpy(zero_copy_only=False) if key is not None else pa.compute.is_null(keys).to_numpy(zero_copy_only=False)
                mine = x[at]
                got = np.concatenate([[len(mine)], mine.sum(0), (mine.T @ mine).ravel()])
                sums[key] = sums[key] + got if key in sums else got
        for key, got in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(got), kind), pa.array(np.arange(len(got), dtype=np.int32)), pa.array(got)], names=[group, "i", "v"])

    parts = rows.select(group, vector).mapInArrow(of, f"{group} {dict(rows.dtypes)[group]}, i int, v double")
    merged = parts.groupBy(group, "i").agg(F.sum("v").alias("v")).groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("m"))
    return merged.select(group, F.col("m")[0].cast("long").alias("n"), F.slice("m", F.lit(2), F.lit(width)).alias("sums"), F.slice("m", F.lit(width + 2), F.lit(width * width)).alias("products"))


def gaussian(n: float, sums: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance (of a sample, by n - 1) from moments."""
    mean = sums / n
    return mean, (products.reshape(len(sums), -1) - n * np.outer(mean, mean)) / max(n - 1, 1)


def root(matrix: np.ndarray) -> np.ndarray:
    values, axes = np.linalg.eigh((matrix + matrix.T) / 2)
    return (axes * np.sqrt(np.maximum(values, 0))) @ axes.T


def frechet(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The Frechet distance of two Gaussians; the root of the product of covariances through symmetric roots alone."""
    half = root(a[1])
    cross = np.sqrt(np.maximum(np.linalg.eigvalsh(half @ b[1] @ half), 0)).sum()
    return float(((a[0] - b[0]) ** 2).sum() + np.trace(a[1]) + np.trace(b[1]) - 2 * cross)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The place of the nearest centre of each row, the first of equals."""
    return ((centres * centres).sum(1)[None] - 2 * x @ centres.T).argmin(1)


def assigned(rows: DataFrame, vector: str, centres: np.ndarray, keep: list[str]) -> DataFrame:
    """The columns named and bin: each row's nearest centre. Centres are k rows, sent with the task."""
    ship(rows.sparkSession)
    width = centres.shape[1]

    def of(batches):
        for batch in batches:
            bins = [pa.array(nearest(_matrix(part.column(0), width), centres).astype(np.int32)) for at in range(0, len(batch), 4096) for part in [batch.slice(at, 4096)]]
            if bins:
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.concat_arrays(bins)], names=[*keep, "bin"])

    kinds = dict(rows.dtypes)
    return rows.select(vector, *keep).mapInArrow(of, ", ".join([*(f"{c} {kinds[c]}" for c in keep), "bin int"]))


def k_means(rows: DataFrame, vector: str, first: np.ndarray, rounds: int) -> np.ndarray:
    """Centres after so many rounds of Lloyd's algorithm; a centre without rows stays. A round is one pass and k sums."""
    centres = np.array(first, np.float64)
    for _ in range(rounds):
        binned = assigned(rows.withColumn("_v", F.col(vector)), vector, centres, ["_v"])
        moved = centres.copy()
        for r in binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col("_v")[i].cast("double")).alias(f"s{i}") for i in range(centres.shape[1]))).collect():  # k rows
            moved[r.bin] = np.array(r[2:]) / r.n
        if (moved == centres).all():
            break
        centres = moved
    return centres
