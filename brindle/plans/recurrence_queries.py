"""Queries on linear recurrences: samples from residuals, and filters that feed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.numbering import with_neighbours
from ..operators.recurrence import solved
from ..sources.views import MONO_SQL, wave_mono
from .registry import query

# Weights of the second and third fixed predictors, for the samples before.
ORDERS = {2: [2, -1], 3: [3, -3, 1]}


@query(f"""WITH RECURSIVE {MONO_SQL}, e AS (SELECT track_id, n, x - 2 * lag(x, 1, 0) OVER w + lag(x, 2, 0) OVER w AS e2, x - 3 * lag(x, 1, 0) OVER w + 3 * lag(x, 2, 0) OVER w - lag(x, 3, 0) OVER w AS e3 FROM wave WINDOW w AS (PARTITION BY track_id ORDER BY n)),
    y AS (SELECT track_id, n, e2, e3, e2 AS a1, 0::HUGEINT AS a2, e3 AS b1, 0::HUGEINT AS b2, 0::HUGEINT AS b3 FROM e WHERE n = 0 UNION ALL SELECT e.track_id, e.n, e.e2, e.e3, e.e2 + 2 * a1 - a2, a1, e.e3 + 3 * b1 - 3 * b2 + b3, b1, b2 FROM y JOIN e ON e.track_id = y.track_id AND e.n = y.n + 1)
    SELECT track_id, n, 2 AS taps, CAST(e2 AS BIGINT) AS e, CAST(a1 AS BIGINT) AS x FROM y UNION ALL SELECT track_id, n, 3, CAST(e3 AS BIGINT), CAST(b1 AS BIGINT) FROM y""")
def iir_inverse(spark, sf_dir):
    """Residuals of the second and third order over whole tracks, and the samples rebuilt from the residuals alone."""
    out = []
    for taps, weights in ORDERS.items():
        e = lambda w, weights=weights: F.col("x") - sum((a * F.lag("x", j, 0).over(w) for j, a in enumerate(weights, 1)), F.lit(0))
        residuals = with_neighbours(wave_mono(spark, sf_dir), lambda w, e=e: {"e": e(w)}, taps).select("track_id", "n", "e")
        back = solved(residuals, weights)
        out.append(residuals.join(back, ["track_id", "n"]).select("track_id", "n", F.lit(taps).alias("taps"), "e", "x"))
    return out[0].unionByName(out[1])


@query(f"""WITH RECURSIVE {MONO_SQL}, y AS (SELECT track_id, n, x, 0.05::DOUBLE * x AS y1, 0::DOUBLE AS y2 FROM wave WHERE n = 0 UNION ALL SELECT w.track_id, w.n, w.x, 0.05::DOUBLE * w.x + 1.6::DOUBLE * y1 + (-0.65)::DOUBLE * y2, y1 FROM y JOIN wave w ON w.track_id = y.track_id AND w.n = y.n + 1)
    SELECT track_id, n, x, round(y1, 4) AS y FROM y""")
def iir_lowpass(spark, sf_dir):
    """A second-order filter with real weights that feeds back: y[n] = 0.05 x[n] + 1.6 y[n-1] - 0.65 y[n-2]."""
    wave = wave_mono(spark, sf_dir)
    filtered = solved(wave.select("track_id", "n", (F.lit(0.05) * F.col("x")).alias("e")), [1.6, -0.65])
    return wave.join(filtered.withColumnRenamed("x", "y"), ["track_id", "n"]).select("track_id", "n", "x", F.round("y", 4).alias("y"))
