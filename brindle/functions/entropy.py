"""Exact sizes of entropy-coded samples, as expressions and aggregates: no encoder runs to learn a size."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PHI = (1 + math.sqrt(5)) / 2


def rice_k(mean: Column) -> Column:
    """The best Rice parameter for values of this mean, from the golden-ratio formula."""
    k = 1 + F.log2(F.lit(math.log(PHI - 1)) / F.log(mean / (mean + 1))).cast("long")
    return F.when(mean < PHI, F.lit(0)).otherwise(k).cast("long")


RICE_K_SQL = f"CASE WHEN mean < {PHI!r} THEN 0 ELSE 1 + CAST(trunc(log2({math.log(PHI - 1)!r} / ln(mean / (mean + 1)))) AS BIGINT) END"


def rice_bits(quotients: Column, count: Column, k: Column | int) -> Column:
    """Bits of count values whose quotients (z >> k) add up to quotients."""
    return quotients + count * (1 + (k if isinstance(k, Column) else F.lit(k)))


def bytes_of(bits: Column) -> Column:
    return F.ceil(bits / 8).cast("long")


def verbatim_bytes(count: Column, itemsize: int = 4) -> Column:
    return 1 + count * itemsize


def quotient_sums(z: Column, most: int) -> list[Column]:
    """sum(z >> k) for each k up to most, in one pass over the rows."""
    return [F.sum(F.shiftright(z, k)).alias(f"q{k}") for k in range(most + 1)]


def best_of(most: int, count: Column) -> Column:
    """(bits, k) of the cheapest parameter, the least of equals, from the sums of quotient_sums."""
    return F.array_min(F.array(*(F.struct(rice_bits(F.col(f"q{k}"), count, k).alias("bits"), F.lit(k).cast("long").alias("k")) for k in range(most + 1))))
