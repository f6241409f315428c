"""Frames, overlapping windows and fixed predictors over ordered samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.quant import zigzag
from .numbering import with_neighbours

#: Samples that are decoded one after the other from the state in which their frame begins.
FIR_FRAME = 128


def framed(wave: DataFrame, size: int) -> DataFrame:
    """wave with frame (number) and i (place in the frame)."""
    return wave.withColumn("frame", F.expr(f"n div {size}")).withColumn("i", F.col("n") % size)


def overlapping(wave: DataFrame, size: int, overlap: int) -> DataFrame:
    """A row for each window that holds a sample: win, at (place in the window). Windows start every size - overlap."""
    hop = size - overlap
    first = F.greatest(F.ceil((F.col("n") - size + 1) / hop).cast("long"), F.lit(0))
    rows = wave.withColumn("win", F.explode(F.sequence(first, F.expr(f"n div {hop}"))))
    return rows.withColumn("at", F.col("n") - F.col("win") * hop)


def fixed_residual(x: Column, order: int, window) -> Column:
    """The residual of the polynomial predictor of this order; null within its warm-up."""
    lags = [F.lag(x, j).over(window) for j in range(1, order + 1)]
    # Binomial coefficients with alternating signs.
    weights = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))[order]
    for w, lagged in zip(weights, lags):
        x = x - w * lagged
    return x


def residual_frames(wave: DataFrame, size: int = 64, order: int = 2) -> DataFrame:
    """track_id, frame, i, n, z: the zigzag residuals of each frame after its warm-up."""
    rows = framed(wave, size)
    window = Window.partitionBy("track_id", "frame").orderBy("n")
    rows = rows.withColumn("e", fixed_residual(F.col("x"), order, window)).where(F.col("i") >= order)
    return rows.select("track_id", "frame", "i", "n", zigzag("e").alias("z"))


def residual_sql(wave: str, size: int = 64) -> str:
    """The same with order 2, as common table expressions ending in res(track_id, frame, i, n, z)."""
    return f"""{wave}, fr AS (SELECT *, n // {size} AS frame, n % {size} AS i FROM wave),
    e AS (SELECT *, x - 2 * lag(x, 1) OVER w + lag(x, 2) OVER w AS e FROM fr WINDOW w AS (PARTITION BY track_id, frame ORDER BY n)),
    res AS (SELECT track_id, frame, i, n, CASE WHEN e >= 0 THEN 2 * e ELSE -2 * e - 1 END AS z FROM e WHERE i >= 2)"""


def _predicted(before: list[Column], weights: list[int], shift: int) -> Column:
    return F.shiftright(sum((w * x for w, x in zip(weights, before)), F.lit(0).cast("long")), shift)


def fir_encoded(wave: DataFrame, weights: list[int], shift: int, size: int = FIR_FRAME) -> DataFrame:
    """track_id, frame, start (the samples before the frame, latest first; zeros before a track), codes (n, residual, and
    the sample itself in raw where it has no residual, since it or one of those before it is null), in order."""
    before = [f"x{j}" for j in range(1, len(weights) + 1)]
    rows = with_neighbours(wave, lambda w: {b: F.lag("x", j, 0).over(w) for j, b in enumerate(before, 1)}, len(weights))
    rows = rows.withColumn("residual", F.col("x") - _predicted([F.col(b) for b in before], weights, shift))
    raw = F.when(F.col("residual").isNull(), F.col("x")).alias("raw")
    codes = F.array_sort(F.collect_list(F.struct("n", "residual", raw))).alias("codes")
    return framed(rows, size).groupBy("track_id", "frame").agg(F.min_by(F.array(*before), "n").alias("start"), codes)


def fir_decoded(frames: DataFrame, weights: list[int], shift: int) -> DataFrame:
    """track_id, n, residual, x: the samples that the frames of fir_encoded give, each frame from its start and codes alone.

    The shift rounds every prediction, so the inverse is no affine map and blocks can't be composed as in `recurrence.solved`.
    """
    state = lambda made: [made["state"][j] for j in range(len(weights))]

    def onto(made: Column, code: Column) -> Column:
        x = F.when(code["residual"].isNull(), code["raw"]).otherwise(code["residual"] + _predicted(state(made), weights, shift))
        return F.struct(F.array(x, *state(made)[:-1]).alias("state"), F.concat(made["xs"], F.array(x)).alias("xs"))

    begun = F.struct(F.col("start").alias("state"), F.array().cast("array<bigint>").alias("xs"))
    xs = F.aggregate("codes", begun, onto, lambda made: made["xs"])
    samples = frames.withColumn("xs", xs).select("track_id", F.explode(F.arrays_zip("codes", "xs")).alias("s"))
    return samples.select("track_id", "s.codes.n", "s.codes.residual", F.col("s.xs").alias("x"))


def stereo_schemes(wave: DataFrame) -> DataFrame:
    """Long form of the four decorrelations: scheme (0 left/right, 1 left/side, 2 right/side, 3 mid/side), ch, x."""
    l, r = F.col("l"), F.col("r")
    pairs = [(l, r), (l, r - l), (r, l - r), (F.shiftright(l + r, 1), l - r)]
    rows = [F.struct(F.lit(s).cast("long").alias("scheme"), F.lit(c).cast("long").alias("ch"), x.alias("x")) for s, pair in enumerate(pairs) for c, x in enumerate(pair)]
    others = [c for c in wave.columns if c not in ("l", "r")]
    return wave.select(*others, F.explode(F.array(*rows)).alias("s")).select(*others, "s.*")


SCHEMES_SQL = """schemes AS (SELECT track_id, n, unnest([0, 0, 1, 1, 2, 2, 3, 3]) AS scheme, unnest([0, 1, 0, 1, 0, 1, 0, 1]) AS ch, unnest([l, r, l, r - l, r, l - r, (l + r) >> 1, l - r]) AS x FROM wave)"""
