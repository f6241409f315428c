"""Resampling of tracks by a ratio of small whole numbers, with taps in a table by phase."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbering import with_neighbours

#: Zero crossings of the sinc on either side.
CROSSINGS = 6


def reach(up: int, down: int) -> int:
    """Input samples on either side of an output sample that have a weight."""
    return math.ceil(CROSSINGS * max(1.0, down / up))


def taps(up: int, down: int) -> list[tuple[int, list[float]]]:
    """(phase, weights of the input samples from reach before to reach after): a sinc at the lower of both rates, under a
    raised cosine. A phase is how far an output sample lies behind an input sample, in parts of 1 / up."""
    cut, wide = min(1.0, up / down), reach(up, down)
    out = []
    for phase in range(up):
        row = []
        for offset in range(-wide, wide + 1):
            t = phase / up - offset
            sinc = 1.0 if t == 0 else math.sin(math.pi * cut * t) / (math.pi * cut * t)
            row.append(cut * sinc * (0.5 + 0.5 * math.cos(math.pi * t / wide)) if abs(t) < wide else 0.0)
        out.append((phase, row))
    return out


def resampled(wave: DataFrame, up: int, down: int, x: str = "x") -> DataFrame:
    """track_id, m, y: sample m lies at m * down / up samples of the input. Beyond a track's ends there are zeros.

    An input sample meets its neighbours in a block with a halo, makes the output samples that lie from it to the next one,
    and these get their weights by phase from the table of taps (up rows, broadcast). Nothing is summed over a shuffle.
    """
    spark, wide = wave.sparkSession, reach(up, down)

    def around(w):
        return {"_near": F.array(*(F.lag(x, -k, 0).over(w) for k in range(-wide, wide + 1)))}

    near = with_neighbours(wave, around, wide, wide)
    first, last = F.ceil(F.col("n") * up / down).cast("long"), (F.ceil((F.col("n") + 1) * up / down) - 1).cast("long")
    made = near.withColumn("m", F.explode(F.when(first <= last, F.sequence(first, last)))).withColumn("phase", (F.col("m") * down - F.col("n") * up).cast("int"))
    table = spark.createDataFrame(taps(up, down), "phase int, taps array<double>")
    y = F.aggregate(F.zip_with("_near", "taps", lambda v, t: v * t), F.lit(0.0), lambda s, v: s + v)
    return made.join(F.broadcast(table), "phase").select("track_id", "m", y.alias("y"))
