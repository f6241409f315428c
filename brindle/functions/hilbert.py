"""The Hilbert curve as an expression: the place of a point of a square grid on the curve, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hilbert_place(x: Column, y: Column, bits: int) -> Column:
    """The place on the curve of a point with coordinates of so many bits; the curve's turns as a fold over pairs of bits."""
    most = (1 << bits) - 1
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(s: Column, level: Column) -> Column:
        # one quadrant further down: its number goes to d, and the rest is turned so that the curve looks the same in it
        at = F.struct(s["x"].alias("x"), s["y"].alias("y"), s["d"].alias("d"), _bit(s["x"], level).alias("right"), _bit(s["y"], level).alias("up"))
        return F.transform(F.array(at), _turned)[0]

    def _turned(a: Column) -> Column:
        d = a["d"] * 4 + (3 * a["right"]).bitwiseXOR(a["up"])
        flipped = lambda v: F.when(a["right"] == 1, most - v).otherwise(v)
        swap = a["up"] == 0
        return F.struct(F.when(swap, flipped(a["y"])).otherwise(a["x"]).alias("x"), F.when(swap, flipped(a["x"])).otherwise(a["y"]).alias("y"), d.alias("d"))

    levels = F.array(*(F.lit(b) for b in range(bits - 1, -1, -1)))
    return F.aggregate(levels, start, step, lambda s: s["d"])


def _bit(v: Column, level: Column) -> Column:
    return F.call_function("shiftright", v, level).bitwiseAND(F.lit(1).cast("long"))
