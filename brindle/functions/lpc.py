"""Linear prediction as expressions over arrays of samples: lags, Levinson-Durbin, integer coefficients, residuals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .quant import zigzag

#: Bits that integer coefficients have after the point.
SHIFT = 10


def autocorrelation(xs: Column, most: int) -> Column:
    """The sums of x[i] x[i - j] for j from 0 to most, zero where a list is no longer than j.

    Samples so large that a sum might pass 62 bits are shifted right first, all of a list alike: weights don't depend on scale.
    """
    peak = F.greatest(F.array_max(xs).cast("double"), -F.array_min(xs).cast("double"))
    excess = F.ceil(F.log2(peak + 1)) + F.ceil((F.log2(F.size(xs).cast("double")) - 62) / 2)
    fitting = F.when(excess > 0, F.transform(xs, lambda x: F.floor(x / F.pow(F.lit(2.0), excess)).cast("long"))).otherwise(xs)

    def lags(x: Column) -> Column:
        size = F.size(x)
        behind = lambda j: F.zip_with(F.slice(x, j + 1, F.greatest(size - j, F.lit(0))), F.slice(x, F.lit(1), F.greatest(size - j, F.lit(0))), lambda a, b: a * b)
        return F.transform(F.sequence(F.lit(0), F.lit(most)), lambda j: F.aggregate(behind(j), F.lit(0).cast("long"), lambda s, t: s + t))

    return F.transform(F.array(fitting), lags)[0]


def levinson(lags: Column, most: int) -> Column:
    """An array of (a, error) for each order from 1 to most: the weights of x[n-1], x[n-2], ... that predict x[n] best.

    The Levinson-Durbin recursion as a fold over orders; an order whose predecessor leaves no error adds a zero weight.
    """
    state = "struct<a: array<double>, error: double, orders: array<struct<a: array<double>, error: double>>>"

    def step(s: Column, m: Column) -> Column:
        earlier = F.zip_with(s["a"], F.reverse(F.slice(lags, F.lit(2), m - 1)), lambda a, r: a * r.cast("double"))
        left = F.aggregate(earlier, F.element_at(lags, m + 1).cast("double"), lambda t, x: t - x)
        k = F.when(s["error"] > 0, left / s["error"]).otherwise(F.lit(0.0))

        def next_state(k: Column) -> Column:
            a = F.concat(F.zip_with(s["a"], F.reverse(s["a"]), lambda p, q: p - k * q), F.array(k))
            return F.struct(a.alias("a"), (s["error"] * (1 - k * k)).alias("error"))

        found = F.transform(F.array(k), next_state)[0]
        return F.transform(F.array(found), lambda f: F.struct(f["a"].alias("a"), f["error"].alias("error"), F.concat(s["orders"], F.array(f)).alias("orders")))[0].cast(state)

    none = F.struct(F.array().cast("array<double>").alias("a"), F.element_at(lags, 1).cast("double").alias("error"), F.array().cast("array<struct<a: array<double>, error: double>>").alias("orders")).cast(state)
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), none, step, lambda s: s["orders"])


def integer_weights(a: Column) -> Column:
    return F.transform(a, lambda w: F.floor(w * (1 << SHIFT) + 0.5).cast("long"))


def residuals(xs: Column, weights: Column) -> Column:
    """Zigzag residuals after the warm-up: x[n] less the weighted samples before it, shifted back to whole numbers."""
    order, left = F.size(weights), F.size(xs) - F.size(weights)
    zeros = F.array_repeat(F.lit(0).cast("long"), F.greatest(left, F.lit(0)))
    # lag by lag over whole lists: one step for each weight, not one for each sample
    onto = lambda sums, j: F.zip_with(sums, F.slice(xs, order - j + 1, left), lambda s, x: s + F.element_at(weights, j) * x)
    weighted = F.when(order > 0, F.aggregate(F.sequence(F.lit(1), order), zeros, onto)).otherwise(zeros)
    found = F.zip_with(F.slice(xs, order + 1, left), weighted, lambda x, s: zigzag(x - F.shiftright(s, SHIFT)))
    return F.when(left > 0, found).otherwise(F.array().cast("array<bigint>"))
