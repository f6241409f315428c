"""Exact coded sizes of frames under linear prediction of many orders, for whole batches of frames at a time in Arrow tasks.

The same numbers as `autocorrelation`, `levinson`, `integer_weights`, `residuals` and `rice_k` give as expressions, step by
step in the same order, so that doubles round alike. An expression folds one list after another; here a step is done for
a block of frames, which pays where a frame has thousands of products.

Defined results: a null sample predicts as zero, its own residual isn't coded but counts in the mean, as in the SQL; a
frame of nulls alone has no sizes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.entropy import PHI
from ..functions.lpc import SHIFT
from ..session import ship

#: Frames of a block, whose arrays stay in a core's cache.
BLOCK = 256
#: Predictions beyond this fail, as they do as expressions; terms may pass it, since sums that fit are right modulo 2^64.
LARGEST = 1 << 62


def lag_sums(xs: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """xs: frames as rows, zeros behind their ends. Samples whose sums might pass 62 bits are shifted right first, as in autocorrelation."""
    peak = np.maximum(xs.max(1).astype(np.float64), -xs.min(1).astype(np.float64))
    excess = np.ceil(np.log2(peak + 1)) + np.ceil((np.log2(np.maximum(sizes, 1)) - 62) / 2)
    if (excess > 0).any():
        xs = np.where(excess[:, None] > 0, np.floor(xs / np.exp2(np.maximum(excess, 0))[:, None]).astype(np.int64), xs)
    return np.stack([(xs[:, j:] * xs[:, : xs.shape[1] - j]).sum(1) if j < xs.shape[1] else np.zeros(len(xs), np.int64) for j in range(most + 1)], 1)


def solved_orders(lags: np.ndarray, most: int):
    """The weights of each order from 1 to most, a row a frame, by the Levinson-Durbin recursion."""
    lags, a = lags.astype(np.float64), np.zeros((len(lags), 0))
    error = lags[:, 0].copy()
    for m in range(1, most + 1):
        left = lags[:, m].copy()
        for j in range(1, m):
            left -= a[:, j - 1] * lags[:, m - j]
        k = np.where(error > 0, left / np.where(error > 0, error, 1), 0.0)
        a = np.concatenate([a - k[:, None] * a[:, ::-1], k[:, None]], 1)
        error = error * (1 - k * k)
        yield a


def rice_parameter(mean: np.ndarray) -> np.ndarray:
    at = np.maximum(mean, PHI)
    return np.where(mean < PHI, 0, 1 + np.trunc(np.log2(math.log(PHI - 1) / np.log(at / (at + 1)))).astype(np.int64))


def _predictions(xs: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The weighted sums of the samples before each that is behind the warm-up."""
    order, width = weights.shape[1], xs.shape[1]
    sums, product = np.zeros((len(xs), width - order), xs.dtype), np.empty((len(xs), width - order), xs.dtype)
    for j in range(1, order + 1):
        sums += np.multiply(xs[:, order - j : width - j], weights[:, j - 1 : j], out=product)
    return sums


def residual_bits(xs: np.ndarray, coded: np.ndarray, sizes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Bits of each frame's residuals behind the warm-up, in Rice codes of the parameter that their mean gives; coded: which
    samples have a residual. Frames must be longer than the order."""
    order = weights.shape[1]
    sums = _predictions(xs, weights)
    far = np.abs(xs).max(1).astype(np.float64) * np.abs(weights).astype(np.float64).sum(1) >= LARGEST
    if far.any() and np.abs(_predictions(xs[far].astype(np.float64), weights[far])).max() >= LARGEST:
        raise OverflowError("a prediction passes 62 bits")
    e = xs[:, order:] - (sums >> SHIFT)
    if np.abs(e).max() >= LARGEST >> 8:
        raise OverflowError("a residual passes 54 bits")
    z = np.where(coded[:, order:], np.where(e >= 0, 2 * e, -2 * e - 1), 0)
    count = sizes - order
    k = rice_parameter(z.sum(1).astype(np.float64) / count)
    return (z >> k[:, None]).sum(1).astype(np.int64) + count * (1 + k)


def order_bits(frames: DataFrame, orders: range, each: int, key: str = "track_id", xs: str = "xs") -> DataFrame:
    """key, size (samples of a frame), bits (a number for each of the orders, null if the frame isn't longer than it), least.

    A size is `each` bits for an order's warm-up sample and weight, and the residuals in Rice codes. A row a frame."""
    ship(frames.sparkSession)

    def of(batches):
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                lists = part.column(1).combine_chunks() if isinstance(part.column(1), pa.ChunkedArray) else part.column(1)
                sizes, values = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()
                held = np.arange(max(sizes.max(initial=0), max(orders) + 1)) < sizes[:, None]
                samples, coded = np.zeros(held.shape, np.int64), np.zeros(held.shape, bool)
                samples[held] = values.fill_null(0).to_numpy(zero_copy_only=False)
                coded[held] = values.is_valid().to_numpy(zero_copy_only=False)
                bits, known = np.zeros((len(part), len(orders)), np.int64), np.zeros((len(part), len(orders)), bool)
                for order, a in enumerate(solved_orders(lag_sums(samples, sizes, max(orders)), max(orders)), 1):
                    if order in orders:
                        known[:, orders.index(order)] = longer = (sizes > order) & coded[:, order:].any(1)
                        weights = np.floor(a[longer] * (1 << SHIFT) + 0.5).astype(np.int64)
                        if longer.any():
                            bits[longer, orders.index(order)] = order * each + residual_bits(samples[longer], coded[longer], sizes[longer], weights)
                least = np.where(known, bits, np.iinfo(np.int64).max).min(1)
                flat = pa.array(bits.ravel(), mask=~known.ravel())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * len(orders)), flat), pa.array(least, mask=~known.any(1))], names=[key, "size", "bits", "least"])

    return frames.select(key, xs).mapInArrow(of, f"{key} {dict(frames.dtypes)[key]}, size long, bits array<bigint>, least long")
