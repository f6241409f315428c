"""Queries on resampling and on orders of a plane."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hilbert import hilbert_place
from ..operators.resample import reach, resampled
from ..session import fresh_path
from ..sources.views import FLOAT_SQL, MONO_SQL, table, wave_float, wave_mono
from .registry import query


def _resample_sql(up: int, down: int) -> str:
    cut, wide = min(1.0, up / down), reach(up, down)
    return f"""SELECT track_id, m, round(sum(x * CASE WHEN abs(t) < {wide} THEN {cut!r}::DOUBLE * (CASE WHEN t = 0 THEN 1 ELSE sin(pi() * {cut!r}::DOUBLE * t) / (pi() * {cut!r}::DOUBLE * t) END) * (0.5 + 0.5 * cos(pi() * t / {wide})) ELSE 0 END), 4) + 0 AS y
    FROM (SELECT o.track_id, o.m, i.x, o.m * {down} / {up} - i.n AS t FROM (SELECT l.track_id, unnest(range((l.len * {up} + {down} - 1) // {down})) AS m FROM l) o JOIN wave i ON i.track_id = o.track_id AND i.n BETWEEN o.m * {down} // {up} - {wide} AND o.m * {down} // {up} + {wide}) GROUP BY ALL"""


@query(f"WITH {MONO_SQL}, l AS (SELECT track_id, count(*) AS len FROM wave GROUP BY ALL) SELECT '3:2' AS ratio, * FROM ({_resample_sql(3, 2)}) UNION ALL SELECT '1:2', * FROM ({_resample_sql(1, 2)})")
def resample_ratios(spark, sf_dir):
    """Tracks at three halves and at half of their rate."""
    wave = wave_mono(spark, sf_dir)
    one = lambda up, down: resampled(wave, up, down).select(F.lit(f"{up}:{down}").alias("ratio"), "track_id", "m", (F.round("y", 4) + 0).alias("y"))
    return one(3, 2).unionByName(one(1, 2))


def _hilbert_sql(points: str, bits: int) -> str:
    """points has x and y; h(x, y, d) in the end."""
    most = (1 << bits) - 1
    return f"""g AS (SELECT DISTINCT x, y FROM {points}), s AS (SELECT x AS ox, y AS oy, x, y, 0::BIGINT AS d, {bits - 1} AS level FROM g UNION ALL
    SELECT ox, oy, CASE WHEN up = 0 THEN CASE WHEN rt = 1 THEN {most} - y ELSE y END ELSE x END, CASE WHEN up = 0 THEN CASE WHEN rt = 1 THEN {most} - x ELSE x END ELSE y END, 4 * d + xor(3 * rt, up), level - 1 FROM (SELECT *, (x >> level) & 1 AS rt, (y >> level) & 1 AS up FROM s WHERE level >= 0)),
    h AS (SELECT ox AS x, oy AS y, d FROM s WHERE level = -1)"""


@query(f"WITH RECURSIVE {FLOAT_SQL}, p AS (SELECT track_id, n, n % 8 AS x, n // 8 AS y, round(x, 6) AS v FROM wave WHERE n < 64), {_hilbert_sql('p', 3)} SELECT track_id, n, v AS x, d AS hilbert FROM p JOIN h USING (x, y)")
def hilbert_permute(spark, sf_dir):
    """Where each of the 64 places of an 8 x 8 grid goes along a Hilbert curve, on which neighbours stay neighbours."""
    n = F.col("n")
    return wave_float(spark, sf_dir).where("n < 64").select("track_id", "n", F.round("x", 6).alias("x"), hilbert_place(n % 8, F.expr("n div 8"), 3).alias("hilbert"))


BITS = 12
#: The box of the range scan: days, and suppliers.
BOX = ((400, 1400), (3, 60))


@query(f"WITH RECURSIVE p AS (SELECT datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS x, l_suppkey AS y, l_quantity AS q FROM lineitem), {_hilbert_sql('p', BITS)} SELECT d >> 14 AS region, count(*) AS rows, CAST(sum(q) AS BIGINT) AS quantity, min(p.x) AS first_day, max(p.x) AS last_day, min(p.y) AS first_supplier, max(p.y) AS last_supplier FROM p JOIN h ON h.x = p.x AND h.y = p.y WHERE p.x BETWEEN {BOX[0][0]} AND {BOX[0][1]} AND p.y BETWEEN {BOX[1][0]} AND {BOX[1][1]} GROUP BY region")
def hilbert_range_scan(spark, sf_dir):
    """Line items laid out by day and supplier along a Hilbert curve, then read by a box of both: files hold small squares of
    the plane, so their least and greatest values of both columns tell which of them the box needs."""
    rows = table(spark, sf_dir, "lineitem").select(F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")).cast("long").alias("x"), F.col("l_suppkey").alias("y"), F.col("l_quantity").alias("q"))
    path = fresh_path(spark, "hilbert")
    laid = rows.withColumn("d", hilbert_place(F.col("x"), F.col("y"), BITS))
    laid.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "d").sortWithinPartitions("d").write.parquet(path)
    (a, b), (c, e) = BOX
    box = spark.read.parquet(path).where(F.col("x").between(a, b) & F.col("y").between(c, e))
    ends = [f("x" if "day" in name else "y").alias(name) for f, name in ((F.min, "first_day"), (F.max, "last_day"), (F.min, "first_supplier"), (F.max, "last_supplier"))]
    return box.groupBy(F.shiftright("d", 14).alias("region")).agg(F.count(F.lit(1)).alias("rows"), F.sum("q").cast("long").alias("quantity"), *ends)
