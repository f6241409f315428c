"""Queries on coded sizes: Rice parameters and sizes, partitions, predictors, decorrelation and the choice among them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.entropy import RICE_K_SQL, best_of, bytes_of, quotient_sums, rice_bits, rice_k, verbatim_bytes
from ..functions.quant import unzigzag, zigzag
from ..operators.frames import SCHEMES_SQL, fixed_residual, framed, residual_frames, residual_sql, stereo_schemes
from ..operators.numbering import with_neighbours
from ..sources.views import MONO_SQL, STEREO_SQL, table, wave_mono, wave_stereo
from .registry import query

RES = residual_sql(MONO_SQL)
MOST_K = 15


def _sizes(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, c, mean, k, payload of each group of z."""
    # the rows come by track, so this window needs no shuffle of its own, and one sum is left where k is known
    rows = rows.withColumn("mean", F.avg("z").over(Window.partitionBy(*keys))).withColumn("k", rice_k(F.col("mean")))
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"), F.first("mean").alias("mean"), F.first("k").alias("k"), F.sum(F.expr("shiftright(z, cast(k as int))")).alias("q"))
    payload = F.when(F.col("k") > 0, bytes_of(rice_bits(F.col("q"), F.col("c"), F.col("k")))).otherwise(verbatim_bytes(F.col("c")))
    return sums.select(*keys, "c", "mean", "k", payload.alias("payload"))


def _sizes_sql(source: str, keys: str) -> str:
    """sized(keys, c, mean, k, payload)."""
    return f"""mu AS (SELECT {keys}, count(*) AS c, avg(z) AS mean FROM {source} GROUP BY {keys}),
    kk AS (SELECT *, {RICE_K_SQL} AS k FROM mu),
    sized AS (SELECT {keys}, any_value(c) AS c, any_value(mean) AS mean, any_value(k) AS k, CASE WHEN any_value(k) > 0 THEN CAST(ceil(sum((z >> k) + 1 + k) / 8.0) AS BIGINT) ELSE 1 + 4 * any_value(c) END AS payload
      FROM {source} JOIN kk USING ({keys}) GROUP BY {keys})"""


SUMMARY_SQL = """CAST(sum(raw) AS BIGINT) AS raw_size, CAST(sum(comp) AS BIGINT) AS compressed_size, round(sum(raw) / sum(comp), 6) AS overall_rate, round(avg(raw / comp), 6) AS mean_rate,
    round(median(raw / comp), 6) AS median_rate, round(stddev_pop(raw / comp), 6) AS std_rate, round(max(raw / comp), 6) AS max_rate, round(min(raw / comp), 6) AS min_rate"""


def summary(raw: str = "raw", comp: str = "comp") -> list:
    """Totals, the ratio of sums, and six statistics of the per-track ratios (population deviation)."""
    rate = F.col(raw) / F.col(comp)
    stats = [("mean", F.avg), ("median", F.median), ("std", F.stddev_pop), ("max", F.max), ("min", F.min)]
    return [F.sum(raw).cast("long").alias("raw_size"), F.sum(comp).cast("long").alias("compressed_size"), F.round(F.sum(raw) / F.sum(comp), 6).alias("overall_rate"), *(F.round(f(rate), 6).alias(f"{name}_rate") for name, f in stats)]


def track_sizes(spark, sf_dir) -> DataFrame:
    frames = _sizes(residual_frames(wave_mono(spark, sf_dir)), "track_id", "frame")
    return frames.groupBy("track_id").agg(F.sum(4 * (F.col("c") + 2)).alias("raw"), F.sum(9 + F.col("payload")).alias("comp"))


TRACKS_SQL = f"{RES}, {_sizes_sql('res', 'track_id, frame')}, tracks AS (SELECT track_id, sum(4 * (c + 2)) AS raw, sum(9 + payload) AS comp FROM sized GROUP BY track_id)"


@query(f"WITH {TRACKS_SQL} SELECT {SUMMARY_SQL} FROM tracks")
def rice_eval_mono(spark, sf_dir):
    return track_sizes(spark, sf_dir).agg(*summary())


@query(f"WITH {MONO_SQL}, z AS (SELECT *, CASE WHEN x >= 0 THEN 2 * x ELSE -2 * x - 1 END AS z FROM (SELECT track_id, n, x - 20000 AS x FROM wave)) SELECT track_id, n, x, z, CASE WHEN z % 2 = 0 THEN z // 2 ELSE -((z + 1) // 2) END AS back FROM z")
def zigzag_roundtrip(spark, sf_dir):
    rows = wave_mono(spark, sf_dir).withColumn("x", F.col("x") - 20000).withColumn("z", zigzag("x"))
    return rows.withColumn("back", unzigzag("z"))


@query(f"WITH {RES}, {_sizes_sql('res', 'track_id, frame')} SELECT track_id, frame, c, round(mean, 6) AS mean_z, k, payload FROM sized")
def optimal_rice_k_per_frame(spark, sf_dir):
    found = _sizes(residual_frames(wave_mono(spark, sf_dir)), "track_id", "frame")
    return found.select("track_id", "frame", "c", F.round("mean", 6).alias("mean_z"), "k", "payload")


@query(f"WITH {RES} SELECT track_id, k, CAST(ceil(sum((z >> k) + 1 + k) / 8.0) AS BIGINT) AS size FROM res, range(0, {MOST_K + 1}) t(k) GROUP BY track_id, k")
def rice_size_fixed_k_grid(spark, sf_dir):
    sums = residual_frames(wave_mono(spark, sf_dir)).groupBy("track_id").agg(F.count(F.lit(1)).alias("c"), *quotient_sums(F.col("z"), MOST_K))
    grid = F.array(*(F.struct(F.lit(k).cast("long").alias("k"), bytes_of(rice_bits(F.col(f"q{k}"), F.col("c"), k)).alias("size")) for k in range(MOST_K + 1)))
    return sums.select("track_id", F.explode(grid).alias("g")).select("track_id", "g.*")


@query(f"WITH {RES}, b AS (SELECT track_id, frame, k, sum((z >> k) + 1 + k) AS bits FROM res, range(0, {MOST_K + 1}) t(k) GROUP BY ALL) SELECT track_id, frame, CAST(min(bits) AS BIGINT) AS bits, arg_min(k, bits * 100 + k) AS k FROM b GROUP BY track_id, frame")
def best_k_exhaustive(spark, sf_dir):
    sums = residual_frames(wave_mono(spark, sf_dir)).groupBy("track_id", "frame").agg(F.count(F.lit(1)).alias("c"), *quotient_sums(F.col("z"), MOST_K))
    return sums.select("track_id", "frame", best_of(MOST_K, F.col("c")).alias("b")).select("track_id", "frame", "b.*")


@query(f"WITH {RES}, {_sizes_sql('res', 'track_id, frame')} SELECT track_id, frame, 1 + 4 * c AS verbatim, payload AS rice, CASE WHEN payload < 1 + 4 * c THEN 'rice' ELSE 'verbatim' END AS chosen FROM sized")
def verbatim_vs_rice(spark, sf_dir):
    found = _sizes(residual_frames(wave_mono(spark, sf_dir)), "track_id", "frame").withColumn("verbatim", verbatim_bytes(F.col("c")))
    return found.select("track_id", "frame", "verbatim", F.col("payload").alias("rice"), F.when(F.col("payload") < F.col("verbatim"), "rice").otherwise("verbatim").alias("chosen"))


@query(f"WITH {RES}, p AS (SELECT track_id, frame, i // 16 AS part, z FROM res), {_sizes_sql('p', 'track_id, frame, part')} SELECT track_id, CAST(sum(1 + payload) AS BIGINT) AS size, count(*) AS parts FROM sized GROUP BY track_id")
def partitioned_rice_size(spark, sf_dir):
    parts = _sizes(residual_frames(wave_mono(spark, sf_dir)).withColumn("part", F.expr("i div 16")), "track_id", "frame", "part")
    return parts.groupBy("track_id").agg(F.sum(1 + F.col("payload")).alias("size"), F.count(F.lit(1)).alias("parts"))


@query(f"""WITH {residual_sql(MONO_SQL, 256)}, b AS (SELECT track_id, frame, o, i // (256 >> o) AS part, k, sum((z >> k) + 1 + k) AS bits FROM res, range(0, 5) s(o), range(0, {MOST_K}) t(k) GROUP BY ALL),
    p AS (SELECT track_id, frame, o, part, min(bits) + 4 AS bits FROM b GROUP BY ALL), f AS (SELECT track_id, frame, o, CAST(sum(bits) AS BIGINT) AS bits FROM p GROUP BY ALL)
    SELECT track_id, frame, min(bits) AS bits, arg_min(o, bits * 10 + o) AS partition_order FROM f GROUP BY ALL""")
def flac_partition_search(spark, sf_dir):
    """Sums of the finest partitions merge upward; each order then pays 4 bits a partition for its parameter."""
    finest = 4
    rows = residual_frames(wave_mono(spark, sf_dir), 256).withColumn("fine", F.expr(f"i div {256 >> finest}"))
    sums = rows.groupBy("track_id", "frame", "fine").agg(F.count(F.lit(1)).alias("c"), *quotient_sums(F.col("z"), MOST_K - 1))
    orders = sums.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(finest)))).withColumn("part", F.expr(f"shiftright(fine, {finest} - o)"))
    merged = orders.groupBy("track_id", "frame", "o", "part").agg(F.sum("c").alias("c"), *(F.sum(f"q{k}").alias(f"q{k}") for k in range(MOST_K)))
    cost = merged.groupBy("track_id", "frame", "o").agg(F.sum(best_of(MOST_K - 1, F.col("c"))["bits"] + 4).alias("bits"))
    best = F.min(F.struct("bits", F.col("o").cast("long").alias("partition_order")))
    return cost.groupBy("track_id", "frame").agg(best.alias("b")).select("track_id", "frame", "b.*")


@query(f"WITH {STEREO_SQL}, ms AS (SELECT *, (l + r) >> 1 AS mid, l - r AS side FROM wave) SELECT track_id, n, mid, side, mid + ((side + 1) >> 1) AS left_back, mid - (side >> 1) AS right_back FROM ms")
def midside_decorrelate(spark, sf_dir):
    rows = wave_stereo(spark, sf_dir).select("track_id", "n", F.shiftright(F.col("l") + F.col("r"), 1).alias("mid"), (F.col("l") - F.col("r")).alias("side"))
    return rows.withColumn("left_back", F.col("mid") + F.shiftright(F.col("side") + 1, 1)).withColumn("right_back", F.col("mid") - F.shiftright("side", 1))


def scheme_sizes(spark, sf_dir, size: int = 64) -> DataFrame:
    """track_id, frame, scheme, ch, size: adaptive Rice with a parameter byte."""
    rows = framed(stereo_schemes(wave_stereo(spark, sf_dir)), size).withColumn("z", zigzag("x"))
    return _sizes(rows, "track_id", "frame", "scheme", "ch").withColumn("size", 1 + F.col("payload"))


SCHEME_SIZES_SQL = f"{STEREO_SQL}, {SCHEMES_SQL}, zz AS (SELECT track_id, n // 64 AS frame, scheme, ch, CASE WHEN x >= 0 THEN 2 * x ELSE -2 * x - 1 END AS z FROM schemes), {_sizes_sql('zz', 'track_id, frame, scheme, ch')}, totals AS (SELECT track_id, frame, CAST(scheme AS BIGINT) AS scheme, CAST(sum(1 + payload) AS BIGINT) AS size FROM sized GROUP BY ALL)"


@query(f"WITH {SCHEME_SIZES_SQL} SELECT track_id, scheme, CAST(sum(size) AS BIGINT) AS size FROM totals GROUP BY ALL")
def stereo_scheme_sizes(spark, sf_dir):
    return scheme_sizes(spark, sf_dir).groupBy("track_id", "scheme").agg(F.sum("size").alias("size"))


@query(f"WITH {SCHEME_SIZES_SQL} SELECT track_id, frame, min(size) AS size, arg_min(scheme, size * 10 + scheme) AS scheme FROM totals GROUP BY ALL")
def best_scheme_per_frame(spark, sf_dir):
    totals = scheme_sizes(spark, sf_dir).groupBy("track_id", "frame", "scheme").agg(F.sum("size").alias("size"))
    return totals.groupBy("track_id", "frame").agg(F.min(F.struct("size", "scheme")).alias("b")).select("track_id", "frame", "b.*")


@query(f"WITH {SCHEME_SIZES_SQL}, t AS (SELECT track_id, scheme, sum(size) AS size FROM totals WHERE scheme IN (0, 3) GROUP BY ALL) SELECT track_id, CAST(min(size) AS BIGINT) AS size, arg_min(scheme, size * 10 + scheme) = 3 AS mid_side FROM t GROUP BY ALL")
def global_midside_choice(spark, sf_dir):
    totals = scheme_sizes(spark, sf_dir).where(F.col("scheme").isin(0, 3)).groupBy("track_id", "scheme").agg(F.sum("size").alias("size"))
    return totals.groupBy("track_id").agg(F.min(F.struct("size", "scheme")).alias("b")).select("track_id", "b.size", (F.col("b.scheme") == 3).alias("mid_side"))


@query(f"""WITH {MONO_SQL}, e AS (SELECT track_id, n, x AS e0, x - lag(x, 1) OVER w AS e1, x - 2 * lag(x, 1) OVER w + lag(x, 2) OVER w AS e2, x - 3 * lag(x, 1) OVER w + 3 * lag(x, 2) OVER w - lag(x, 3) OVER w AS e3,
    x - 4 * lag(x, 1) OVER w + 6 * lag(x, 2) OVER w - 4 * lag(x, 3) OVER w + lag(x, 4) OVER w AS e4 FROM wave WINDOW w AS (PARTITION BY track_id ORDER BY n))
    SELECT track_id, {', '.join(f'CAST(sum(abs(e{o})) FILTER (n >= 4) AS BIGINT) AS sum{o}' for o in range(5))} FROM e GROUP BY track_id""")
def fixed_predictor_orders(spark, sf_dir):
    rows = with_neighbours(wave_mono(spark, sf_dir), lambda w: {f"e{o}": fixed_residual(F.col("x"), o, w) for o in range(5)}, 4)
    return rows.groupBy("track_id").agg(*(F.sum(F.when(F.col("n") >= 4, F.abs(f"e{o}"))).alias(f"sum{o}") for o in range(5)))


@query(f"WITH {MONO_SQL} SELECT track_id, n // 4 AS frame, count(DISTINCT x // 10000) = 1 AS constant, CASE WHEN count(DISTINCT x // 10000) = 1 THEN 5 ELSE 1 + 4 * count(*) END AS size FROM wave GROUP BY ALL")
def constant_subframes(spark, sf_dir):
    """Short frames of coarse samples, so that constant ones occur; size is a tag byte and one sample, or all."""
    coarse = F.expr("x div 10000")
    constant = F.min(coarse) == F.max(coarse)
    rows = framed(wave_mono(spark, sf_dir), 4).groupBy("track_id", "frame")
    return rows.agg(constant.alias("constant"), F.when(constant, F.lit(5).cast("long")).otherwise(1 + 4 * F.count(F.lit(1))).alias("size"))


@query(f"WITH {MONO_SQL}, c AS (SELECT a.track_id, l.lag, CAST(sum(a.x * b.x) AS BIGINT) AS r FROM wave a, range(0, 9) l(lag), wave b WHERE b.track_id = a.track_id AND b.n = a.n - l.lag GROUP BY ALL) SELECT * FROM c")
def autocorrelation_lags(spark, sf_dir):
    rows = with_neighbours(wave_mono(spark, sf_dir), lambda w: {f"x{j}": F.lag("x", j).over(w) for j in range(9)}, 8)
    sums = rows.groupBy("track_id").agg(*(F.sum(F.col("x") * F.col(f"x{j}")).alias(f"r{j}") for j in range(9)))
    long = sums.select("track_id", F.explode(F.array(*(F.struct(F.lit(j).cast("long").alias("lag"), F.col(f"r{j}").alias("r")) for j in range(9)))).alias("c"))
    return long.select("track_id", "c.*").where("r is not null")


@query(f"WITH {TRACKS_SQL}, d AS (SELECT tracks.*, n_name AS dataset FROM tracks JOIN customer ON c_custkey = track_id JOIN nation ON c_nationkey = n_nationkey) SELECT dataset, {SUMMARY_SQL} FROM d GROUP BY dataset")
def eval_summary_by_dataset(spark, sf_dir):
    """The evaluation summary for each data set: the exact Rice sizes of its tracks, by the nation of the track's owner."""
    owners = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return track_sizes(spark, sf_dir).join(owners, F.col("track_id") == F.col("c_custkey")).groupBy(F.col("n_name").alias("dataset")).agg(*summary())


@query(f"WITH {TRACKS_SQL} SELECT round(sum(raw) / sum(comp), 6) AS ratio_of_sums, round(avg(raw / comp), 6) AS mean_of_ratios, round(avg(comp / raw), 6) AS mean_compressed_fraction FROM tracks")
def overall_vs_mean_rate(spark, sf_dir):
    return track_sizes(spark, sf_dir).agg(F.round(F.sum("raw") / F.sum("comp"), 6).alias("ratio_of_sums"), F.round(F.avg(F.col("raw") / F.col("comp")), 6).alias("mean_of_ratios"), F.round(F.avg(F.col("comp") / F.col("raw")), 6).alias("mean_compressed_fraction"))


@query(f"""WITH {RES}, {_sizes_sql('res', 'track_id, frame')}, b AS (SELECT track_id, count(*) AS frames, sum(8) AS metadata_bits, sum(64) AS estimator_bits, sum(8 * payload) AS entropy_bits FROM sized GROUP BY ALL)
    SELECT track_id, frames, CAST(metadata_bits AS BIGINT) AS metadata_bits, CAST(estimator_bits AS BIGINT) AS estimator_bits, CAST(entropy_bits AS BIGINT) AS entropy_bits, round(entropy_bits / (metadata_bits + estimator_bits + entropy_bits), 6) AS entropy_proportion FROM b""")
def bit_budget(spark, sf_dir):
    """What each track's bits are spent on."""
    frames = _sizes(residual_frames(wave_mono(spark, sf_dir)), "track_id", "frame")
    sums = frames.groupBy("track_id").agg(F.count(F.lit(1)).alias("frames"), F.sum(F.lit(8)).alias("metadata_bits"), F.sum(F.lit(64)).alias("estimator_bits"), F.sum(8 * F.col("payload")).alias("entropy_bits"))
    return sums.withColumn("entropy_proportion", F.round(F.col("entropy_bits") / (F.col("metadata_bits") + F.col("estimator_bits") + F.col("entropy_bits")), 6))
