"""Queries on bits, headers and the sizes of codecs: codes and their inverses, predictors, choices among subframe types."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.entropy import RICE_K_SQL, bytes_of, rice_bits, rice_k
from ..functions.quant import zigzag
from ..operators.frames import fir_decoded, fir_encoded, fixed_residual, framed, residual_sql
from ..sources.views import MONO_SQL, table, wave_mono
from .codec_queries import TRACKS_SQL, track_sizes
from .registry import query


@query("SELECT b AS bits, CAST(1 << (b - 1) AS BIGINT) AS zero, CAST((1 << b) + (1 << (16 - b)) AS BIGINT) AS vocabulary FROM (SELECT unnest(range(1, 17)) AS b)")
def zero_level_vocabulary(spark, sf_dir):
    """The code of silence at each bit depth, and the size of a vocabulary of leading and trailing bits."""
    rows = spark.range(1, 17).withColumnRenamed("id", "bits")
    return rows.select("bits", F.expr("shiftleft(1L, cast(bits - 1 as int))").alias("zero"), F.expr("shiftleft(1L, cast(bits as int)) + shiftleft(1L, cast(16 - bits as int))").alias("vocabulary"))


@query(f"WITH {MONO_SQL}, m AS (SELECT track_id, n // 64 AS frame, greatest(max(abs(x)), 1) AS most FROM wave GROUP BY ALL), s AS (SELECT *, CAST(ceil((log2(most) + 1) / 8) AS BIGINT) AS b FROM m) SELECT track_id, frame, most, CAST(1::BIGINT << (8 * b - 1) AS BIGINT) AS scale, b - 1 AS code FROM s")
def audio_scale_code(spark, sf_dir):
    """The least scale of whole bytes that holds a frame, as a number, as its two-bit code and back."""
    most = F.greatest(F.max(F.abs("x")), F.lit(1).cast("long"))
    rows = framed(wave_mono(spark, sf_dir), 64).groupBy("track_id", "frame").agg(most.alias("most"))
    rows = rows.withColumn("first", F.pow(F.lit(2), 8 * F.ceil((F.log2("most") + 1) / 8) - 1))
    code = (F.floor((F.log2("first") + 1) / 8) - 1).cast("long")
    return rows.select("track_id", "frame", "most", F.pow(F.lit(2), 8 * (code + 1) - 1).cast("long").alias("scale"), code.alias("code"))


@query("SELECT p_partkey, lpad(bin(p_partkey), CAST(8 * ceil(length(bin(p_partkey)) / 8.0) AS INT), '0') AS bits, p_partkey AS back, CAST(ceil(length(bin(p_partkey)) / 8.0) AS BIGINT) AS bytes FROM part")
def bits_left_padded(spark, sf_dir):
    """Numbers as bits with zeros on the left up to whole bytes, and back."""
    raw = F.bin("p_partkey")
    size = (F.ceil(F.char_length(raw) / 8) * 8).cast("int")
    rows = table(spark, sf_dir, "part").withColumn("bits", F.lpad(raw, size, F.lit("0")))
    return rows.select("p_partkey", "bits", F.conv("bits", 2, 10).cast("long").alias("back"), F.expr("cast(char_length(bits) div 8 as bigint)").alias("bytes"))


#: The two-bit types of a coder's byte, whose other six bits hold its parameter.
CODER_TYPES = ("verbatim", "naive_rice", "adaptive_rice", "partitioned_rice")


@query("SELECT p_partkey, ['verbatim', 'naive_rice', 'adaptive_rice', 'partitioned_rice'][1 + p_partkey % 4] AS coder, CASE WHEN p_partkey % 2 = 1 THEN p_size % 16 END AS parameter, CAST((p_partkey % 4) * 64 + CASE WHEN p_partkey % 2 = 1 THEN p_size % 16 ELSE 0 END AS BIGINT) AS header, CASE WHEN p_partkey % 4 = 3 THEN CAST(1 << (p_size % 16 + 8) AS BIGINT) END AS partition FROM part")
def coder_byte(spark, sf_dir):
    """A coder and its parameter as one byte and back; a partitioned coder's parameter is the power of its partition."""
    kind = F.element_at(F.array(*map(F.lit, CODER_TYPES)), (F.col("p_partkey") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"), F.when(F.col("p_partkey") % 2 == 1, F.col("p_size") % 16).alias("k"))
    index = F.array_position(F.array(*map(F.lit, CODER_TYPES)), F.col("kind")) - 1
    written = rows.select("p_partkey", F.shiftleft(index, 6).bitwiseOR(F.coalesce("k", F.lit(0))).cast("long").alias("header"))
    back = written.select("p_partkey", "header", F.element_at(F.array(*map(F.lit, CODER_TYPES)), (F.shiftright("header", 6) + 1).cast("int")).alias("coder"), F.col("header").bitwiseAND(63).cast("int").alias("low"))
    parameter = F.when(F.col("coder").isin("naive_rice", "partitioned_rice"), F.col("low"))
    return back.select("p_partkey", "coder", parameter.alias("parameter"), "header", F.when(F.col("coder") == "partitioned_rice", F.pow(F.lit(2), F.col("low") + 8).cast("long")).alias("partition"))


_ORDERS_SQL = f"{MONO_SQL}, fr AS (SELECT *, n // 64 AS frame, n % 64 AS i FROM wave), e AS (SELECT track_id, frame, i, x AS e0, x - lag(x, 1) OVER w AS e1, x - 2 * lag(x, 1) OVER w + lag(x, 2) OVER w AS e2, x - 3 * lag(x, 1) OVER w + 3 * lag(x, 2) OVER w - lag(x, 3) OVER w AS e3, x - 4 * lag(x, 1) OVER w + 6 * lag(x, 2) OVER w - 4 * lag(x, 3) OVER w + lag(x, 4) OVER w AS e4 FROM fr WINDOW w AS (PARTITION BY track_id, frame ORDER BY n)), o AS (SELECT track_id, frame, unnest([0, 1, 2, 3, 4]) AS o, unnest([e0, e1, e2, e3, e4]) AS e FROM e), q AS (SELECT track_id, frame, o, CASE WHEN e >= 0 THEN 2 * e ELSE -2 * e - 1 END AS z FROM o WHERE e IS NOT NULL), mo AS (SELECT track_id, frame, o, count(*) AS c, avg(z) AS mean FROM q GROUP BY ALL), ko AS (SELECT *, {RICE_K_SQL} AS k FROM mo), so AS (SELECT track_id, frame, o, 4 * o + 1 + CAST(ceil(sum((z >> k) + 1 + k) / 8.0) AS BIGINT) AS size FROM q JOIN ko USING (track_id, frame, o) GROUP BY track_id, frame, o)"


def order_sizes(spark, sf_dir):
    """track_id, frame, o, size: warm-up samples, an order byte and the Rice-coded residuals of each fixed order."""
    rows = framed(wave_mono(spark, sf_dir), 64)
    window = Window.partitionBy("track_id", "frame").orderBy("n")
    rows = rows.select("track_id", "frame", *(fixed_residual(F.col("x"), o, window).alias(f"e{o}") for o in range(5)))
    long = rows.select("track_id", "frame", F.posexplode(F.array(*(F.col(f"e{o}") for o in range(5)))).alias("o", "e")).where("e is not null")
    long = long.withColumn("z", zigzag("e")).withColumn("mean", F.avg("z").over(Window.partitionBy("track_id", "frame", "o"))).withColumn("k", rice_k(F.col("mean")).cast("int"))
    sums = long.groupBy("track_id", "frame", "o").agg(F.count(F.lit(1)).alias("c"), F.first("k").cast("long").alias("k"), F.sum(F.expr("shiftright(z, k)")).alias("q"))
    return sums.select("track_id", "frame", F.col("o").cast("long").alias("o"), (4 * F.col("o") + 1 + bytes_of(rice_bits(F.col("q"), F.col("c"), F.col("k")))).alias("size"))


@query(f"WITH {_ORDERS_SQL} SELECT track_id, frame, CAST(arg_min(o, so.size * 10 + o) AS BIGINT) AS o, min(so.size) AS size FROM so GROUP BY track_id, frame")
def predictor_order_search(spark, sf_dir):
    """The fixed predictor's order that codes each frame in the fewest bytes."""
    best = F.min(F.struct("size", "o")).alias("b")
    return order_sizes(spark, sf_dir).groupBy("track_id", "frame").agg(best).select("track_id", "frame", "b.o", "b.size")


_TYPES_SQL = f"{residual_sql(MONO_SQL, 16)}, ty AS (SELECT track_id, frame, sum(abs(x)) AS a, min(x // 10000) = max(x // 10000) AS flat, count(*) AS c FROM fr GROUP BY ALL), rz AS (SELECT track_id, frame, sum((z + 1) // 2) AS b FROM res GROUP BY ALL), kinds AS (SELECT track_id, frame, c, CASE WHEN flat THEN 'constant' WHEN b < a THEN 'fixed' ELSE 'verbatim' END AS kind FROM ty LEFT JOIN rz USING (track_id, frame))"


def subframe_types(spark, sf_dir):
    """track_id, frame, c, kind: constant where all (coarse) samples are equal, fixed where second differences are smaller, else verbatim."""
    rows = framed(wave_mono(spark, sf_dir), 16)
    e = fixed_residual(F.col("x"), 2, Window.partitionBy("track_id", "frame").orderBy("n"))
    coarse = F.expr("x div 10000")
    sums = rows.withColumn("e", e).groupBy("track_id", "frame").agg(F.sum(F.abs("x")).alias("a"), F.sum(F.abs("e")).alias("b"), (F.min(coarse) == F.max(coarse)).alias("flat"), F.count(F.lit(1)).alias("c"))
    kind = F.when(F.col("flat"), "constant").when(F.col("b") < F.col("a"), "fixed").otherwise("verbatim")
    return sums.select("track_id", "frame", "c", kind.alias("kind"))


@query(f"WITH {_TYPES_SQL}, s AS (SELECT track_id, count(*) AS frames, {', '.join(f'''count(*) FILTER (kind = '{k}') AS {k}''' for k in ('constant', 'fixed', 'verbatim'))} FROM kinds GROUP BY track_id) SELECT {', '.join(f'round(avg({k} / frames), 6) AS {k}' for k in ('constant', 'fixed', 'verbatim'))}, round(sum(constant) / sum(frames), 6) AS overall_constant FROM s")
def subframe_type_shares(spark, sf_dir):
    """The mean over tracks of the share of each type of subframe, and one share over all."""
    kinds = ("constant", "fixed", "verbatim")
    tracks = subframe_types(spark, sf_dir).groupBy("track_id").agg(F.count(F.lit(1)).alias("frames"), *(F.count_if(F.col("kind") == k).alias(k) for k in kinds))
    return tracks.agg(*(F.round(F.avg(F.col(k) / F.col("frames")), 6).alias(k) for k in kinds), F.round(F.sum("constant") / F.sum("frames"), 6).alias("overall_constant"))


@query(f"WITH {_TYPES_SQL} SELECT track_id, frame, kind, CAST(CASE kind WHEN 'constant' THEN 2 + 1 + 4 WHEN 'fixed' THEN 2 + 1 + 8 + 4 * greatest(c - 2, 0) ELSE 2 + 1 + 4 * c END AS BIGINT) AS size, CAST(8 * CASE kind WHEN 'constant' THEN 7 WHEN 'fixed' THEN 11 + 4 * greatest(c - 2, 0) ELSE 3 + 4 * c END + 1 AS BIGINT) AS bits_stereo FROM kinds")
def codec_sizes(spark, sf_dir):
    """A subframe's size by its type: two bytes for the number of samples, one for the type, warm-up and the rest; and in
    bits with the flag that a pair of channels has."""
    c = F.col("c")
    size = F.when(F.col("kind") == "constant", F.lit(7).cast("long")).when(F.col("kind") == "fixed", 11 + 4 * F.greatest(c - 2, F.lit(0))).otherwise(3 + 4 * c)
    return subframe_types(spark, sf_dir).select("track_id", "frame", "kind", size.alias("size"), (8 * size + 1).alias("bits_stereo"))


@query(f"WITH {TRACKS_SQL}, r AS (SELECT 8 * comp / (raw / 4.0 / 44100) / 1000 AS bitrate FROM tracks) SELECT round(avg(bitrate), 4) AS mean, round(median(bitrate), 4) AS median_, round(stddev_pop(bitrate), 4) AS std, round(max(bitrate), 4) AS most, round(min(bitrate), 4) AS least, (SELECT round(8 * sum(comp) / (sum(raw) / 4.0 / 44100) / 1000, 4) FROM tracks) AS overall FROM r")
def bitrate_statistics(spark, sf_dir):
    """Kilobits a second of each coded track: five statistics over tracks and the rate over all."""
    rate = lambda comp, raw: 8 * comp / (raw / 4 / 44100) / 1000
    b = rate(F.col("comp"), F.col("raw"))
    stats = (("mean", F.avg), ("median_", F.median), ("std", F.stddev_pop), ("most", F.max), ("least", F.min))
    return track_sizes(spark, sf_dir).agg(*(F.round(f(b), 4).alias(n) for n, f in stats), F.round(rate(F.sum("comp"), F.sum("raw")), 4).alias("overall"))


@query("SELECT p_partkey, CAST(p_size % 8 AS BIGINT) AS code, CAST(1 << (p_size % 8) AS BIGINT) AS batch FROM part")
def batch_size_code(spark, sf_dir):
    """Batch sizes of powers of two as three-bit codes and back."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr("shiftleft(1L, p_size % 8)").alias("size")).withColumn("code", F.log2("size").cast("long"))
    return rows.select("p_partkey", "code", F.pow(F.lit(2), "code").cast("long").alias("batch"))


@query(f"WITH {MONO_SQL}, t AS (SELECT track_id, count(*) AS n, count(*) FILTER (x < -32768 OR x > 32767) AS outside, count(*) % 16 AS left_over, max(n) + 1 = count(*) AS gapless FROM wave GROUP BY ALL) SELECT track_id, n, outside, left_over, gapless, CASE WHEN NOT gapless THEN 'samples missing' WHEN outside > 0 THEN 'out of range' WHEN left_over > 0 THEN 'not a multiple of the block' ELSE 'ok' END AS verdict FROM t")
def data_validation(spark, sf_dir):
    """What is wrong with each track, if anything: gaps, samples out of range, a length that blocks don't divide."""
    rows = wave_mono(spark, sf_dir).groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("x").between(-32768, 32767)).alias("outside"), (F.max("n") + 1).alias("end"))
    rows = rows.select("track_id", "n", "outside", (F.col("n") % 16).alias("left_over"), (F.col("end") == F.col("n")).alias("gapless"))
    verdict = F.when(~F.col("gapless"), "samples missing").when(F.col("outside") > 0, "out of range").when(F.col("left_over") > 0, "not a multiple of the block").otherwise("ok")
    return rows.withColumn("verdict", verdict)


@query("SELECT doc_id, CASE WHEN a > 0 AND b > 0 THEN CAST(b - 1 AS BIGINT) END AS size FROM (SELECT doc_id, a, CASE WHEN a > 0 THEN instr(substr(text, a + 2), 'in') ELSE 0 END AS b FROM (SELECT doc_id, text, instr(text, 'th') AS a FROM documents WHERE text IS NOT NULL))")
def marker_search(spark, sf_dir):
    """How many characters lie between the first marker (th) and the next (in); null where one is missing."""
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", F.instr("text", "th").alias("a"))
    rows = rows.select("doc_id", "a", F.when(F.col("a") > 0, F.expr("locate('in', text, a + 2)")).otherwise(0).alias("b"))
    return rows.select("doc_id", F.when((F.col("a") > 0) & (F.col("b") > 0), (F.col("b") - F.col("a") - 2).cast("long")).alias("size"))


@query(f"WITH {residual_sql(MONO_SQL)}, f AS (SELECT least((z + 1) // 2 // 1000, 63) AS m, count(*) AS c FROM res GROUP BY ALL), g AS (SELECT unnest(range(64)) AS m) SELECT g.m AS magnitude, round(coalesce(c, 0) / (SELECT sum(c) FROM f), 8) AS probability FROM g LEFT JOIN f USING (m)")
def probabilities_on_grid(spark, sf_dir):
    """Probabilities of magnitudes on a grid of 64, zero where none occurs."""
    e = fixed_residual(F.col("x"), 2, Window.partitionBy("track_id", "frame").orderBy("n"))
    rows = framed(wave_mono(spark, sf_dir), 64).withColumn("e", e).where("i >= 2")
    folded = rows.groupBy(F.least(F.expr("abs(e) div 1000"), F.lit(63)).alias("m")).agg(F.count(F.lit(1)).alias("c"))
    grid = spark.range(64).withColumnRenamed("id", "m").join(folded, "m", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    total = F.sum("c").over(Window.partitionBy(F.lit(1)))  # 64 rows
    return grid.select(F.col("m").alias("magnitude"), F.round(F.col("c") / total, 8).alias("probability"))


@query(f"WITH {MONO_SQL}, p AS (SELECT track_id, n, x, (12 * lag(x, 1, 0) OVER w - 6 * lag(x, 2, 0) OVER w + lag(x, 3, 0) OVER w) >> 3 AS p FROM wave WINDOW w AS (PARTITION BY track_id ORDER BY n)) SELECT track_id, n, x - p AS residual, x AS back FROM p")
def fir_prediction(spark, sf_dir):
    """Residuals of a prediction from three samples with weights in eighths, and the samples decoded from them, frame by frame."""
    weights, shift = [12, -6, 1], 3
    coded = fir_encoded(wave_mono(spark, sf_dir), weights, shift)
    return fir_decoded(coded, weights, shift).select("track_id", "n", "residual", F.col("x").alias("back"))
