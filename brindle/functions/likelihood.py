"""Likelihoods and samples of logistic mixtures and Student's t as expressions, stable in the tails."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps that log-gamma's argument is raised by before the series is taken: eight digits more than a double shows.
RAISED = 8


def softplus(x: Column) -> Column:
    """ln(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log(1 + F.exp(-F.abs(x)))


def log_sum_exp(terms: Sequence[Column]) -> Column:
    most = F.greatest(*terms)
    total = F.exp(terms[0] - most)
    for t in terms[1:]:
        total = total + F.exp(t - most)
    return most + F.log(total)


def log_gamma(z: Column) -> Column:
    """ln of the gamma function for z > 0: Stirling's series at z + RAISED, less the logarithms of the steps up."""
    w, product = z + RAISED, z
    for i in range(1, RAISED):
        product = product * (z + i)
    # Bernoulli numbers B2k over 2k (2k - 1).
    series = 1 / (12 * w) - 1 / (360 * F.pow(w, F.lit(3))) + 1 / (1260 * F.pow(w, F.lit(5))) - 1 / (1680 * F.pow(w, F.lit(7)))
    return (w - 0.5) * F.log(w) - w + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def log_logistic_between(low: Column, high: Column) -> Column:
    """ln(sigmoid(high) - sigmoid(low)) for low < high, as ln sigmoid(high) + ln sigmoid(-low) + ln(1 - exp(low - high))."""
    return -softplus(-high) - softplus(low) + F.log(1 - F.exp(low - high))


def logistic_mixture_nll(level: Column, levels: int, logits: Sequence[Column], means: Sequence[Column], scales: Sequence[Column]) -> Column:
    """-ln of the probability of a level (0 to levels - 1, evenly over [-1, 1]) under a mixture of logistics cut into levels.

    The lowest level has all that lies below it, the highest all that lies above, so levels' probabilities add up to one.
    """
    half = 1.0 / (levels - 1)
    x = level * (2 * half) - 1
    terms = []
    for logit, mean, scale in zip(logits, means, scales):
        high, low = (x - mean + half) / scale, (x - mean - half) / scale
        inside = F.when(level == 0, -softplus(-high)).when(level == levels - 1, -softplus(low)).otherwise(log_logistic_between(low, high))
        terms.append(logit + inside)
    return log_sum_exp(logits) - log_sum_exp(terms)


def student_t_nll(x: Column, mean: Column, scale: Column, freedom: Column) -> Column:
    gap = F.pow((x - mean) / scale, F.lit(2))
    return log_gamma(freedom / 2) - log_gamma((freedom + 1) / 2) + 0.5 * F.log(freedom * math.pi) + F.log(scale) + (freedom + 1) / 2 * F.log(1 + gap / freedom)


def uniform(*parts: Column | str) -> Column:
    """A number in (0, 1) from a counter: 48 bits of the MD5 of the parts, so that any engine and any rerun draws the same."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *(F.col(p).cast("string") if isinstance(p, str) else p for p in parts))), 1, 12), 16, 10).cast("long") + 0.5) / float(1 << 48)


def logistic_mixture_sample(choice: Column, place: Column, levels: int, logits: Sequence[Column], means: Sequence[Column], scales: Sequence[Column]) -> Column:
    """The level drawn by two uniform numbers: a component by its weight, then its inverse distribution function."""
    total, upto, drawn = log_sum_exp(logits), F.lit(0.0), None
    odds = F.log(place) - F.log(1 - place)
    for logit, mean, scale in zip(logits, means, scales):
        upto = upto + F.exp(logit - total)
        value = mean + scale * odds
        drawn = F.when(choice < upto, value) if drawn is None else drawn.when(choice < upto, value)
    drawn = drawn.otherwise(means[-1] + scales[-1] * odds)
    return F.least(F.greatest(F.floor((drawn + 1) / 2 * (levels - 1) + 0.5), F.lit(0)), F.lit(levels - 1)).cast("long")


def student_t_sample(u: Column, v: Column, mean: Column, scale: Column, freedom: Column) -> Column:
    """A draw by two uniform numbers: a radius by its inverse distribution function, and an angle."""
    return mean + scale * F.sqrt(freedom * (F.pow(u, -2 / freedom) - 1)) * F.cos(2 * math.pi * v)
