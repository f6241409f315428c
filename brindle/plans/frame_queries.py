"""Queries on framing, overlap, interleaving, quantisation and byte tokens."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import quant
from ..operators.frames import framed, overlapping
from ..operators.numbering import running_sum, with_length
from ..sources.views import FLOAT_SQL, MONO_SQL, STEREO_SQL, wave_float, wave_mono, wave_stereo
from .registry import query

LIST = "string_agg(CAST(x AS VARCHAR), ',' ORDER BY n)"


def _samples() -> F.Column:
    return F.expr("transform(array_sort(collect_list(struct(n, x))), s -> s.x)")


def _joined(c) -> F.Column:
    return F.array_join(c.cast("array<string>"), ",")


@query(f"WITH {MONO_SQL} SELECT track_id, n // 32 AS frame, count(*) AS c, {LIST} AS samples FROM wave GROUP BY ALL")
def frames_tumbling(spark, sf_dir):
    return framed(wave_mono(spark, sf_dir), 32).groupBy("track_id", "frame").agg(F.count(F.lit(1)).alias("c"), _joined(_samples()).alias("samples"))


@query(f"WITH {MONO_SQL}, o AS (SELECT track_id, n, x, unnest(range(greatest(0, CAST(ceil((n - 31) / 24.0) AS BIGINT)), n // 24 + 1)) AS win FROM wave) SELECT track_id, win, count(*) AS c, CAST(sum(x) AS BIGINT) AS total, CAST(min(n - win * 24) AS BIGINT) AS first_at FROM o GROUP BY ALL")
def frames_overlap(spark, sf_dir):
    return overlapping(wave_mono(spark, sf_dir), 32, 8).groupBy("track_id", "win").agg(F.count(F.lit(1)).alias("c"), F.sum("x").alias("total"), F.min("at").alias("first_at"))


@query(f"WITH {MONO_SQL}, t AS (SELECT track_id, n, x, CASE WHEN n < 28 THEN 0 ELSE (n - 4) // 24 END AS win FROM wave), m AS (SELECT track_id, max(n) // 24 AS last FROM wave GROUP BY ALL) SELECT track_id, n, x, least(win, last) AS win FROM t JOIN m USING (track_id)")
def overlap_trim(spark, sf_dir):
    """Each sample once, from the window that keeps it when windows give up half of each overlap."""
    rows = overlapping(with_length(wave_mono(spark, sf_dir)), 32, 8)
    rows = rows.withColumn("final", F.expr("(len - 1) div 24"))
    head = (F.col("win") == 0) | (F.col("at") >= 4)
    tail = (F.col("win") == F.col("final")) | (F.col("at") < 28)
    return rows.where(head & tail).select("track_id", "n", "x", "win")


@query(f"WITH {MONO_SQL}, c AS (SELECT track_id, n // 50 AS clip, {LIST} AS samples, count(*) AS kept FROM wave GROUP BY ALL) SELECT track_id, clip, kept, samples || repeat(',0', CAST(50 - kept AS INT)) AS samples FROM c")
def clip_partition_pad(spark, sf_dir):
    clips = framed(wave_mono(spark, sf_dir), 50).groupBy("track_id", F.col("frame").alias("clip")).agg(F.count(F.lit(1)).alias("kept"), _samples().alias("s"))
    padded = F.concat("s", F.array_repeat(F.lit(0).cast("long"), (50 - F.col("kept")).cast("int")))
    return clips.select("track_id", "clip", "kept", _joined(padded).alias("samples"))


@query(f"WITH {STEREO_SQL} SELECT track_id, 2 * n AS pos, l AS x FROM wave UNION ALL SELECT track_id, 2 * n + 1, r FROM wave")
def interleave_temporal(spark, sf_dir):
    pair = F.array(F.struct((2 * F.col("n")).alias("pos"), F.col("l").alias("x")), F.struct((2 * F.col("n") + 1).alias("pos"), F.col("r").alias("x")))
    return wave_stereo(spark, sf_dir).select("track_id", F.explode(pair).alias("p")).select("track_id", "p.*")


@query(f"""WITH {STEREO_SQL}, s AS (SELECT *, count(*) OVER (PARTITION BY track_id) AS len FROM wave), b AS (SELECT *, least(100, len) AS bn FROM s), c AS (SELECT *, n // bn AS blk, least(bn, len - bn * (n // bn)) AS lb FROM b)
    SELECT track_id, 2 * bn * blk + (n - bn * blk) AS pos, l AS x FROM c UNION ALL SELECT track_id, 2 * bn * blk + lb + (n - bn * blk), r FROM c""")
def interleave_block_n(spark, sf_dir):
    rows = with_length(wave_stereo(spark, sf_dir)).withColumn("bn", F.least(F.lit(100).cast("long"), "len"))
    rows = rows.withColumn("blk", F.expr("n div bn")).withColumn("at", F.col("n") - F.col("bn") * F.col("blk")).withColumn("lb", F.least(F.col("bn"), F.col("len") - F.col("bn") * F.col("blk")))
    base = 2 * F.col("bn") * F.col("blk") + F.col("at")
    pair = F.array(F.struct(base.alias("pos"), F.col("l").alias("x")), F.struct((base + F.col("lb")).alias("pos"), F.col("r").alias("x")))
    return rows.select("track_id", F.explode(pair).alias("p")).select("track_id", "p.*")


MU = "CAST(sign(x) AS DOUBLE) * ln(1 + 255.0 * abs(x + 1e-8)) / ln(256.0)"


@query(f"WITH {FLOAT_SQL} SELECT track_id, n, round({MU}, 6) AS y, CAST(trunc({MU} * 127) AS BIGINT) AS q FROM wave")
def mu_law_compress(spark, sf_dir):
    y = quant.mu_law("x")
    return wave_float(spark, sf_dir).select("track_id", "n", F.round(y, 6).alias("y"), (y * 127).cast("long").alias("q"))


@query(f"WITH {FLOAT_SQL}, y AS (SELECT track_id, n, x, {MU} AS y FROM wave) SELECT track_id, n, round(x, 5) + 0.0 AS x, round(CAST(sign(y) AS DOUBLE) * (pow(256.0, abs(y)) - 1) / 255.0, 5) + 0.0 AS back FROM y")
def mu_law_roundtrip(spark, sf_dir):
    return wave_float(spark, sf_dir).select("track_id", "n", F.round("x", 5).alias("x"), F.round(quant.mu_law_inverse(quant.mu_law("x")), 5).alias("back"))


@query(f"WITH {FLOAT_SQL}, m AS (SELECT *, min(x) OVER (PARTITION BY track_id) AS lo, max(x) OVER (PARTITION BY track_id) AS hi FROM wave), s AS (SELECT track_id, n, (x - lo) / (hi - lo + 1e-6) AS s FROM m) SELECT track_id, n, round(s, 6) AS scaled, CAST(floor(s * 255.99 + 0.005) AS BIGINT) AS q FROM s")
def minmax_quantize(spark, sf_dir):
    track = Window.partitionBy("track_id")
    scaled = quant.min_max(F.col("x"), F.min("x").over(track), F.max("x").over(track))
    return wave_float(spark, sf_dir).select("track_id", "n", scaled.alias("s")).select("track_id", "n", F.round("s", 6).alias("scaled"), quant.quantize(F.col("s"), 8).alias("q"))


@query(f"WITH {FLOAT_SQL}, q AS (SELECT track_id, n, CAST(floor((x + 1) / 2 * 255.99 + 0.005) AS BIGINT) AS q FROM wave) SELECT track_id, n, q, round(q / 128.0 - 1, 6) AS back FROM q")
def linear_quantize(spark, sf_dir):
    rows = wave_float(spark, sf_dir).select("track_id", "n", quant.quantize((F.col("x") + 1) / 2, 8).alias("q"))
    return rows.withColumn("back", F.round(quant.dequantize(F.col("q"), 8), 6))


PCM = "least(greatest(CAST(floor((x + 1) / 2 * 65536) AS BIGINT), 0), 65535)"


@query(f"WITH {FLOAT_SQL}, q AS (SELECT track_id, n, {PCM} AS q FROM wave) SELECT track_id, n, q, (q >> 8) & 255 AS msb, q & 255 AS lsb FROM q")
def pcm_quantize_msb_lsb(spark, sf_dir):
    rows = wave_float(spark, sf_dir).select("track_id", "n", quant.pcm_unsigned("x").alias("q"))
    return rows.select("track_id", "n", "q", quant.msb("q", 8).alias("msb"), quant.lsb("q", 8).alias("lsb"))


@query(f"WITH {FLOAT_SQL}, q AS (SELECT track_id, n, {PCM} AS q FROM wave) SELECT track_id, count(*) AS c, bool_and(((((q >> 8) & 255) << 8) | (q & 255)) = q) AS same, CAST(sum(((q >> 8) & 255) << 8) AS BIGINT) AS coarse FROM q GROUP BY track_id")
def msb_lsb_recombine(spark, sf_dir):
    rows = wave_float(spark, sf_dir).select("track_id", quant.pcm_unsigned("x").alias("q"))
    high, low = quant.msb("q", 8), quant.lsb("q", 8)
    return rows.groupBy("track_id").agg(F.count(F.lit(1)).alias("c"), F.bool_and(quant.joined(high, low, 8) == F.col("q")).alias("same"), F.sum(F.shiftleft(high, 8)).alias("coarse"))


@query(f"WITH {FLOAT_SQL}, q AS (SELECT track_id, n, CAST(floor((x + 1) / 2 * 16777216) AS BIGINT) AS q FROM wave) SELECT track_id, 3 * n + j AS pos, (q >> (16 - 8 * j)) & 255 AS token FROM q, range(0, 3) t(j)")
def byte_tokens_3(spark, sf_dir):
    rows = wave_float(spark, sf_dir).select("track_id", "n", quant.pcm_unsigned("x", 24).alias("q"))
    tokens = rows.select("track_id", "n", F.posexplode(F.array(*(F.shiftright("q", s).bitwiseAND(255) for s in (16, 8, 0)))).alias("j", "token"))
    return tokens.select("track_id", (3 * F.col("n") + F.col("j")).alias("pos"), "token")


@query(f"WITH {FLOAT_SQL}, q AS (SELECT track_id, n, {PCM} AS q FROM wave) SELECT track_id, 4 * n + j AS pos, ((q >> (12 - 4 * j)) & 15) + 16 * j AS token FROM q, range(0, 4) t(j)")
def nibble_tokens_4(spark, sf_dir):
    """Four nibbles a sample, each with an alphabet of its own."""
    rows = wave_float(spark, sf_dir).select("track_id", "n", quant.pcm_unsigned("x").alias("q"))
    tokens = rows.select("track_id", "n", F.posexplode(F.array(*(F.shiftright("q", s).bitwiseAND(15) for s in (12, 8, 4, 0)))).alias("j", "t"))
    return tokens.select("track_id", (4 * F.col("n") + F.col("j")).alias("pos"), (F.col("t") + 16 * F.col("j")).alias("token"))


@query(f"WITH {STEREO_SQL}, p AS (SELECT track_id, max(greatest(abs(l), abs(r))) AS peak FROM wave GROUP BY ALL) SELECT track_id, peak, CAST(pow(2, 8 * ceil((log2(peak) + 1) / 8) - 1) AS BIGINT) AS scale, CAST(length(bin(peak)) AS BIGINT) AS bits FROM p")
def optimal_audio_scale(spark, sf_dir):
    peaks = wave_stereo(spark, sf_dir).groupBy("track_id").agg(F.max(F.greatest(F.abs("l"), F.abs("r"))).alias("peak"))
    return peaks.select("track_id", "peak", quant.audio_scale("peak").alias("scale"), quant.bits_for("peak").alias("bits"))


@query(f"WITH {MONO_SQL} SELECT track_id, n, (x - 20000) + 32768 AS biased, ((x - 20000) + 32768) & 255 AS low, (((x - 20000) + 32768) >> 8) & 255 AS high FROM wave")
def pcm_bytes_bias(spark, sf_dir):
    rows = wave_mono(spark, sf_dir).select("track_id", "n", (F.col("x") - 20000 + 32768).alias("biased"))
    return rows.select("*", F.col("biased").bitwiseAND(255).alias("low"), F.shiftright("biased", 8).bitwiseAND(255).alias("high"))


@query(f"WITH {FLOAT_SQL} SELECT track_id, n, CAST(round_even(least(greatest(x, -1), 1 - 1 / 32768.0) * 32768, 0) AS BIGINT) AS fixed, round(CAST(round_even(least(greatest(x, -1), 1 - 1 / 32768.0) * 32768, 0) AS BIGINT) / 32768.0, 8) AS back FROM wave")
def fixed_float_roundtrip(spark, sf_dir):
    rows = wave_float(spark, sf_dir).select("track_id", "n", quant.to_fixed("x").alias("fixed"))
    return rows.withColumn("back", F.round(quant.to_float("fixed"), 8))


@query(f"WITH {MONO_SQL} SELECT track_id, n, round(avg(x) OVER w, 6) AS running_mean, CAST(sum(x) OVER w AS BIGINT) AS running_sum FROM wave WINDOW w AS (PARTITION BY track_id ORDER BY n ROWS UNBOUNDED PRECEDING)")
def running_pool(spark, sf_dir):
    rows = running_sum(wave_mono(spark, sf_dir), "x", "running_sum")
    return rows.select("track_id", "n", F.round(F.col("running_sum") / (F.col("n") + 1), 6).alias("running_mean"), "running_sum")


@query(f"WITH {MONO_SQL} SELECT track_id, n // 4 AS n, x FROM wave WHERE n % 4 = 0")
def stride_decimate(spark, sf_dir):
    return wave_mono(spark, sf_dir).where("n % 4 = 0").select("track_id", F.expr("n div 4").alias("n"), "x")


@query(f"WITH {MONO_SQL} SELECT track_id, n, n // 10 AS segment, CAST(sum(x % 2) OVER (PARTITION BY track_id, n // 10) AS BIGINT) AS weight FROM wave")
def packed_weights(spark, sf_dir):
    rows = wave_mono(spark, sf_dir).withColumn("segment", F.expr("n div 10"))
    return rows.select("track_id", "n", "segment", F.sum(F.col("x") % 2).over(Window.partitionBy("track_id", "segment")).alias("weight"))


@query(f"WITH {MONO_SQL}, l AS (SELECT *, count(*) OVER (PARTITION BY track_id) AS len FROM wave) SELECT track_id, (n + 5) % len AS pos, x FROM l")
def circular_roll(spark, sf_dir):
    rows = with_length(wave_mono(spark, sf_dir))
    return rows.select("track_id", F.pmod(F.col("n") + 5, "len").alias("pos"), "x")


@query(f"WITH {MONO_SQL}, s AS (SELECT track_id, n // 16 AS sub, count(*) AS c, CAST(sum(x) AS BIGINT) AS total FROM wave GROUP BY ALL) SELECT track_id, sub // 4 AS frame, count(*) AS subframes, CAST(sum(c) AS BIGINT) AS c, string_agg(CAST(total AS VARCHAR), ',' ORDER BY sub) AS totals FROM s GROUP BY ALL")
def frame_regroup(spark, sf_dir):
    subs = framed(wave_mono(spark, sf_dir), 16).groupBy("track_id", F.col("frame").alias("sub")).agg(F.count(F.lit(1)).alias("c"), F.sum("x").alias("total"))
    totals = F.expr("transform(array_sort(collect_list(struct(sub, total))), s -> s.total)")
    return subs.groupBy("track_id", F.expr("sub div 4").alias("frame")).agg(F.count(F.lit(1)).alias("subframes"), F.sum("c").alias("c"), _joined(totals).alias("totals"))


@query(f"""WITH {FLOAT_SQL} SELECT track_id, n, round(x, 6) AS x,
    {' | '.join(f'(((n >> {b}) & 1) << {5 - b})' for b in range(6))} AS bit_reversed, (n % 8) * 8 + n // 8 AS transposed, CASE WHEN (n // 8) % 2 = 0 THEN n ELSE (n // 8) * 8 + 7 - n % 8 END AS snake FROM wave WHERE n < 64""")
def scan_order_permute(spark, sf_dir):
    """Where each of the 64 places of an 8 x 8 grid goes: bits reversed, transposed, and in a snake."""
    n = F.col("n")
    reverse = F.shiftright(F.col("n"), 0).bitwiseAND(0)
    for b in range(6):
        reverse = reverse.bitwiseOR(F.shiftleft(F.shiftright(n, b).bitwiseAND(1), 5 - b))
    row = F.expr("n div 8")
    snake = F.when(row % 2 == 0, n).otherwise(row * 8 + 7 - n % 8)
    return wave_float(spark, sf_dir).where("n < 64").select("track_id", "n", F.round("x", 6).alias("x"), reverse.alias("bit_reversed"), ((n % 8) * 8 + row).alias("transposed"), snake.alias("snake"))


@query(f"WITH {FLOAT_SQL}, q AS (SELECT {PCM} AS q FROM wave), c AS (SELECT q >> 8 AS msb, q & 255 AS lsb, count(*) AS c FROM q GROUP BY ALL) SELECT msb, arg_max(lsb, c * 1000 - lsb) AS lsb, CAST(sum(c) AS BIGINT) AS samples FROM c GROUP BY msb")
def lsb_mode_model(spark, sf_dir):
    """The most frequent low byte for each high byte, the least of equals."""
    q = quant.pcm_unsigned("x")
    counts = wave_float(spark, sf_dir).select(quant.msb(q, 8).alias("msb"), quant.lsb(q, 8).alias("lsb")).groupBy("msb", "lsb").agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy("msb").agg(F.max_by("lsb", F.struct("c", -F.col("lsb"))).alias("lsb"), F.sum("c").alias("samples"))
