"""Queries on linear prediction: Levinson-Durbin by frame, and the order whose exact coded size is least."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.entropy import RICE_K_SQL, rice_k
from ..functions.lpc import SHIFT, autocorrelation, integer_weights, levinson, residuals
from ..operators.frames import framed
from ..operators.prediction import order_bits
from ..sources.views import MONO_SQL, STEREO_SQL, wave_mono, wave_stereo
from .registry import query

#: Bits of a warm-up sample and of a weight.
SAMPLE_BITS, WEIGHT_BITS = 32, 16


def frame_arrays(wave: DataFrame, size: int, x: str = "x") -> DataFrame:
    """track_id, frame, xs of each frame; a frame is one row, so its size bounds what a task folds."""
    rows = framed(wave, size).groupBy("track_id", "frame").agg(F.array_sort(F.collect_list(F.struct("i", F.col(x).alias("x")))).alias("s"))
    arrays = rows.select("track_id", "frame", F.transform("s", lambda s: s["x"]).alias("xs"))
    # a frame is much work for few bytes: adaptive execution would put many into one task
    return arrays.repartition(2 * int(wave.sparkSession.conf.get("spark.sql.shuffle.partitions")), "track_id", "frame")


def order_sizes(frames: DataFrame, orders: range) -> DataFrame:
    """track_id, frame, m, weights, bits: the exact size of a frame coded with each order that is shorter than it.

    A size is the warm-up, the weights, and the residuals in Rice codes of the parameter that their mean gives.
    """
    most = max(orders)
    solved = frames.withColumn("orders", levinson(autocorrelation(F.col("xs"), most), most))
    none = F.struct(F.lit(0).alias("m"), F.array().cast("array<bigint>").alias("weights"))
    some = F.transform("orders", lambda o: F.struct(F.size(o["a"]).alias("m"), integer_weights(o["a"]).alias("weights")))
    spread = solved.select("track_id", "frame", "xs", F.explode(F.concat(F.array(none), some)).alias("o")).select("track_id", "frame", "xs", "o.*")
    spread = spread.where((F.col("m") >= min(orders)) & (F.col("m") < F.size("xs")))
    coded = rice_coded(spread.select("track_id", "frame", F.col("m").cast("long").alias("m"), "weights", "xs"))
    return coded.select("track_id", "frame", "m", "weights", (F.col("m") * (SAMPLE_BITS + WEIGHT_BITS) + F.col("bits")).alias("bits"))


def rice_coded(candidates: DataFrame) -> DataFrame:
    """candidates with bits in place of xs: the residuals that weights leave of xs, in Rice codes of the parameter that their mean gives."""
    others = [c for c in candidates.columns if c != "xs"]
    coded = candidates.select(*others, residuals(F.col("xs"), F.col("weights")).alias("z"))
    total = F.aggregate("z", F.lit(0).cast("long"), lambda s, z: s + z)
    coded = coded.withColumn("count", F.size("z").cast("long")).withColumn("k", rice_k(total / F.size("z")).cast("int"))
    # quotients by a power of two, which is what the shift by a column is
    quotients = F.aggregate(F.expr("transform(z, v -> shiftright(v, k))"), F.lit(0).cast("long"), lambda s, q: s + q)
    return coded.select(*others, (quotients + F.col("count") * (1 + F.col("k"))).alias("bits"))


def _levinson_sql(wave: str, x: str, size: int, most: int) -> str:
    return f"""{wave}, fr AS (SELECT track_id, n // {size} AS frame, list({x} ORDER BY n) AS xs FROM wave GROUP BY ALL),
    r AS (SELECT track_id, frame, xs, list_transform(range(0, {most + 1}), lambda j: coalesce(CAST(list_sum(list_transform(range(j, len(xs)), lambda i: xs[i + 1] * xs[i - j + 1])) AS BIGINT), 0)) AS r FROM fr),
    lev AS (SELECT track_id, frame, xs, r, 0 AS m, []::DOUBLE[] AS a, r[1]::DOUBLE AS error FROM r UNION ALL
      SELECT track_id, frame, xs, r, m, list_append(list_transform(range(1, m), lambda j: a[j] - k * a[m - j]), k), error * (1 - k * k) FROM
      (SELECT track_id, frame, xs, r, m + 1 AS m, a, error, CASE WHEN error > 0 THEN list_reduce(list_prepend(r[m + 2]::DOUBLE, list_transform(range(1, m + 1), lambda j: a[j] * r[m + 1 - j + 1]::DOUBLE)), lambda s, t: s - t) / error ELSE 0 END AS k FROM lev WHERE m < {most}))"""


def _sizes_sql(wave: str, x: str, size: int, orders: range) -> str:
    return f"""WITH RECURSIVE {_levinson_sql(wave, x, size, max(orders))},
    w AS (SELECT track_id, frame, xs, m, list_transform(a, lambda w: CAST(floor(w * {1 << SHIFT} + 0.5) AS BIGINT)) AS w FROM lev WHERE m >= {min(orders)} AND m < len(xs)),
    e AS (SELECT track_id, frame, m, xs, w, unnest(range(m, len(xs))) AS n FROM w),
    d AS (SELECT track_id, frame, m, w, xs[n + 1] - (coalesce(CAST(list_sum(list_transform(range(1, m + 1), lambda j: w[j] * xs[n - j + 1])) AS BIGINT), 0) >> {SHIFT}) AS e FROM e),
    z AS (SELECT track_id, frame, m, w, CASE WHEN e >= 0 THEN 2 * e ELSE -2 * e - 1 END AS z FROM d),
    k AS (SELECT track_id, frame, m, sum(z) / count(*) AS mean, count(*) AS c FROM z GROUP BY ALL), kk AS (SELECT *, {RICE_K_SQL} AS k FROM k),
    b AS (SELECT track_id, frame, m, CAST(m * {SAMPLE_BITS + WEIGHT_BITS} + sum(z >> k) + any_value(c) * (1 + any_value(k)) AS BIGINT) AS bits, any_value(w) AS w FROM z JOIN kk USING (track_id, frame, m) GROUP BY track_id, frame, m)"""


@query(f"""WITH RECURSIVE {_levinson_sql(MONO_SQL, 'x', 64, 4)} SELECT track_id, frame, m AS taps, array_to_string(list_transform(a, lambda w: CAST(floor(w * 100000 + 0.5) AS BIGINT)), ' ') AS weights, round(error / greatest(r[1], 1), 6) AS share FROM lev WHERE m > 0""")
def lpc_levinson(spark, sf_dir):
    """The weights of orders 1 to 4 of each frame (in hundred-thousandths), and the share of its energy that they leave."""
    frames = frame_arrays(wave_mono(spark, sf_dir), 64).withColumn("r", autocorrelation(F.col("xs"), 4))
    rows = frames.select("track_id", "frame", "r", F.explode(levinson(F.col("r"), 4)).alias("o"))
    shown = F.array_join(F.transform("o.a", lambda w: F.floor(w * 100000 + 0.5).cast("string")), " ")
    return rows.select("track_id", "frame", F.size("o.a").alias("taps"), shown.alias("weights"), F.round(F.col("o.error") / F.greatest(F.col("r")[0], F.lit(1)), 6).alias("share"))


@query(f"{_sizes_sql(MONO_SQL, 'x', 64, range(0, 9))} SELECT track_id, frame, CAST(arg_min(m, bits * 100 + m) AS BIGINT) AS best, min(bits) AS bits, arg_min(array_to_string(w, ' '), bits * 100 + m) AS weights FROM b GROUP BY track_id, frame")
def lpc_order_search(spark, sf_dir):
    """The order from 0 to 8 of each frame whose exact coded size is least, the least of equals, and its weights."""
    sizes = order_sizes(frame_arrays(wave_mono(spark, sf_dir), 64), range(0, 9))
    best = sizes.groupBy("track_id", "frame").agg(F.min(F.struct("bits", "m", "weights")).alias("b"))
    return best.select("track_id", "frame", F.col("b.m").alias("best"), F.col("b.bits").alias("bits"), F.array_join(F.col("b.weights").cast("array<string>"), " ").alias("weights"))


@query(f"{_sizes_sql(STEREO_SQL, 'l', 128, range(5, 21))}, t AS (SELECT track_id, m, CAST(sum(bits) AS BIGINT) AS bits FROM b GROUP BY ALL), best AS (SELECT track_id, frame, min(bits) AS bits FROM b GROUP BY ALL), bt AS (SELECT track_id, CAST(sum(bits) AS BIGINT) AS chosen FROM best GROUP BY ALL) SELECT track_id, m, bits, chosen, round(bits / chosen, 6) AS over FROM t JOIN bt USING (track_id)")
def lpc_sizes_by_order(spark, sf_dir):
    """What a track's left channel takes with each single order from 5 to 20, and with the best one for each frame."""
    orders = range(5, 21)
    frames = frame_arrays(wave_stereo(spark, sf_dir).select("track_id", "n", "l").where("track_id is not null"), 128, "l")
    sums = [F.sum(F.col("bits")[i]).alias(f"b{m}") for i, m in enumerate(orders)]
    tracks = order_bits(frames, orders, SAMPLE_BITS + WEIGHT_BITS).groupBy("track_id").agg(*sums, F.max("size").alias("longest"), F.sum("least").alias("chosen"))
    each = F.array(*(F.struct(F.lit(m).cast("long").alias("m"), F.col(f"b{m}").alias("bits")) for m in orders))
    rows = tracks.select("track_id", "longest", "chosen", F.explode(each).alias("s")).where("s.m < longest")
    return rows.select("track_id", "s.m", "s.bits", "chosen", F.round(F.col("s.bits") / F.col("chosen"), 6).alias("over"))


#: Bits of a subframe's type and order, and of its Rice parameter.
TYPE_BITS, RICE_BITS, MOST_TAPS = 8, 8, 8
# Binomial coefficients with alternating signs, the weights of the polynomial predictors.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
_FIXED_SQL = ", ".join(f"({m}, [{', '.join(str(w << SHIFT) for w in weights)}]::BIGINT[])" for m, weights in enumerate(FIXED))
_SUBFRAMES_SQL = f"""WITH RECURSIVE {_levinson_sql(MONO_SQL, 'x', 64, MOST_TAPS)},
    w AS (SELECT track_id, frame, xs, 'lpc' AS kind, m, m * {SAMPLE_BITS + WEIGHT_BITS} AS head, list_transform(a, lambda w: CAST(floor(w * {1 << SHIFT} + 0.5) AS BIGINT)) AS w FROM lev WHERE m > 0 AND m < len(xs)
      UNION ALL SELECT track_id, frame, xs, 'fixed', f.m, f.m * {SAMPLE_BITS}, f.w FROM r, (VALUES {_FIXED_SQL}) f(m, w) WHERE f.m < len(xs)),
    e AS (SELECT track_id, frame, kind, m, head, xs, w, unnest(range(m, len(xs))) AS n FROM w),
    d AS (SELECT track_id, frame, kind, m, head, xs[n + 1] - (coalesce(CAST(list_sum(list_transform(range(1, m + 1), lambda j: w[j] * xs[n - j + 1])) AS BIGINT), 0) >> {SHIFT}) AS e FROM e),
    z AS (SELECT track_id, frame, kind, m, head, CASE WHEN e >= 0 THEN 2 * e ELSE -2 * e - 1 END AS z FROM d),
    k AS (SELECT track_id, frame, kind, m, sum(z) / count(*) AS mean FROM z GROUP BY ALL), kk AS (SELECT *, {RICE_K_SQL} AS k FROM k),
    b AS (SELECT track_id, frame, kind, m, CAST({TYPE_BITS + RICE_BITS} + any_value(head) + sum((z >> k) + 1 + k) AS BIGINT) AS bits FROM z JOIN kk USING (track_id, frame, kind, m) GROUP BY track_id, frame, kind, m
      UNION ALL SELECT track_id, frame, 'verbatim', 0, {TYPE_BITS} + {SAMPLE_BITS} * len(xs) FROM r
      UNION ALL SELECT track_id, frame, 'constant', 0, {TYPE_BITS + SAMPLE_BITS} FROM r WHERE list_min(xs) = list_max(xs))"""


def subframe_sizes(frames: DataFrame) -> DataFrame:
    """track_id, frame, kind, m, bits: the exact size of a frame as each type of subframe that can hold it.

    A constant is one sample, verbatim samples are stored whole; fixed predictors store their warm-up, linear prediction
    its weights too, and both store their residuals in Rice codes. All candidates of a frame come from its one row.
    """
    solved = frames.withColumn("orders", levinson(autocorrelation(F.col("xs"), MOST_TAPS), MOST_TAPS))
    fixed = [F.struct(F.lit("fixed").alias("kind"), F.array(*(F.lit(w << SHIFT).cast("long") for w in weights)).cast("array<bigint>").alias("weights"), F.lit(SAMPLE_BITS).alias("each")) for weights in FIXED]
    linear = F.transform("orders", lambda o: F.struct(F.lit("lpc").alias("kind"), integer_weights(o["a"]).alias("weights"), F.lit(SAMPLE_BITS + WEIGHT_BITS).alias("each")))
    spread = solved.select("track_id", "frame", "xs", F.explode(F.concat(F.array(*fixed), linear)).alias("o")).select("track_id", "frame", "xs", "o.*").withColumn("m", F.size("weights").cast("long"))
    predicted = rice_coded(spread.where(F.col("m") < F.size("xs"))).select("track_id", "frame", "kind", "m", (TYPE_BITS + RICE_BITS + F.col("m") * F.col("each") + F.col("bits")).alias("bits"))
    stored = F.array(
        F.struct(F.lit("verbatim").alias("kind"), F.lit(0).cast("long").alias("m"), (TYPE_BITS + SAMPLE_BITS * F.size("xs")).cast("long").alias("bits")),
        F.struct(F.when(F.array_min("xs") == F.array_max("xs"), "constant").alias("kind"), F.lit(0).cast("long").alias("m"), F.lit(TYPE_BITS + SAMPLE_BITS).cast("long").alias("bits")),
    )
    return predicted.unionByName(frames.select("track_id", "frame", F.explode(stored).alias("o")).select("track_id", "frame", "o.*").where("kind is not null"))


@query(f"{_SUBFRAMES_SQL} SELECT track_id, frame, kind, CAST(m AS BIGINT) AS m, bits FROM b QUALIFY row_number() OVER (PARTITION BY track_id, frame ORDER BY bits, kind, m) = 1")
def subframe_choice(spark, sf_dir):
    """The type of subframe that holds each frame in the fewest bits: constant, fixed, linear prediction or verbatim."""
    sizes = subframe_sizes(frame_arrays(wave_mono(spark, sf_dir), 64))
    best = sizes.groupBy("track_id", "frame").agg(F.min(F.struct("bits", "kind", "m")).alias("b"))
    return best.select("track_id", "frame", "b.kind", "b.m", "b.bits")


@query(f"{_SUBFRAMES_SQL}, s AS (SELECT track_id, frame, kind, min(bits) AS bits FROM b GROUP BY ALL), v AS (SELECT track_id, frame, bits AS raw FROM s WHERE kind = 'verbatim'), t AS (SELECT track_id, frame, kind, least(bits, raw) AS bits, raw, min(bits) OVER (PARTITION BY track_id, frame) AS least FROM s JOIN v USING (track_id, frame)) SELECT kind, count(*) AS frames, CAST(sum(bits) AS BIGINT) AS bits, round(sum(bits) / sum(raw), 6) AS share, count(*) FILTER (bits = least) AS wins FROM t GROUP BY kind")
def sizes_by_subframe_type(spark, sf_dir):
    """What the frames that a type can hold take with it (verbatim where that is less), and in how many it is the smallest."""
    sizes = subframe_sizes(frame_arrays(wave_mono(spark, sf_dir), 64)).groupBy("track_id", "frame", "kind").agg(F.min("bits").alias("bits"))
    # a frame's types are four at most: one array holds them
    frames = sizes.groupBy("track_id", "frame").agg(F.collect_list(F.struct("kind", "bits")).alias("s"), F.min("bits").alias("least"), F.max(F.when(F.col("kind") == "verbatim", F.col("bits"))).alias("raw"))
    each = frames.select("least", "raw", F.explode("s").alias("s")).select("least", "raw", F.col("s.kind").alias("kind"), F.least("s.bits", "raw").alias("bits"))
    return each.groupBy("kind").agg(F.count(F.lit(1)).alias("frames"), F.sum("bits").alias("bits"), F.round(F.sum("bits") / F.sum("raw"), 6).alias("share"), F.count_if(F.col("bits") == F.col("least")).alias("wins"))
