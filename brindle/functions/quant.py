"""Scalar functions on samples: zigzag, mu-law, quantisation and bit splits, all as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def zigzag(x: Column | str) -> Column:
    x = _c(x)
    return F.when(x >= 0, 2 * x).otherwise(-2 * x - 1)


def unzigzag(z: Column | str) -> Column:
    z = _c(z)
    return F.when(z % 2 == 0, F.shiftright(z, 1)).otherwise(-F.shiftright(z + 1, 1))


def mu_law(x: Column | str, bits: int = 8) -> Column:
    """The compressed amplitude; the small constant inside the magnitude is part of the definition."""
    x, mu = _c(x), float(2**bits - 1)
    return F.signum(x) * F.log1p(mu * F.abs(x + 1e-8)) / math.log1p(mu)


def mu_law_inverse(y: Column | str, bits: int = 8) -> Column:
    y, mu = _c(y), float(2**bits - 1)
    return F.signum(y) * (F.pow(F.lit(1.0 + mu), F.abs(y)) - 1) / mu


def min_max(x: Column, least: Column, most: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return low + (high - low) * (x - least) / (most - least + 1e-6)


def quantize(x: Column, bits: int) -> Column:
    return F.floor(x * (2**bits - 0.01) + 0.005).cast("long")


def dequantize(q: Column, bits: int) -> Column:
    return q / F.lit(2.0**bits / 2) - 1


def pcm_unsigned(x: Column | str, bits: int = 16) -> Column:
    return F.least(F.greatest(F.floor((_c(x) + 1) / 2 * 2**bits).cast("long"), F.lit(0)), F.lit(2**bits - 1)).cast("long")


def to_fixed(x: Column | str, bits: int = 16) -> Column:
    """Clips to [-1, 1) and rounds half to even."""
    scale = float(2 ** (bits - 1))
    return F.rint(F.least(F.greatest(_c(x), F.lit(-1.0)), F.lit(1 - 1 / scale)) * scale).cast("long")


def to_float(x: Column | str, bits: int = 16) -> Column:
    return _c(x) / F.lit(float(2 ** (bits - 1)))


def msb(q: Column | str, bits: int, of: int = 16) -> Column:
    return F.shiftright(_c(q), of - bits).bitwiseAND(2**bits - 1)


def lsb(q: Column | str, bits: int) -> Column:
    return _c(q).bitwiseAND(2**bits - 1)


def joined(high: Column, low: Column, low_bits: int) -> Column:
    return F.shiftleft(high, low_bits).bitwiseOR(low)


def bits_for(v: Column | str) -> Column:
    """ceil(log2(v + 1)) by counting binary digits, so powers of two don't depend on rounding."""
    v = _c(v)
    return F.when(v > 0, F.length(F.bin(v))).otherwise(0).cast("long")


def audio_scale(peak: Column | str) -> Column:
    """The least power of two with a whole number of bytes that holds samples of this magnitude."""
    return F.pow(F.lit(2.0), 8 * F.ceil((F.log2(_c(peak).cast("double")) + 1) / 8) - 1).cast("long")
