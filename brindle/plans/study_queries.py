"""Queries that chain operators: padded windows, statistics that skip what isn't a number, patches, inverses, comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.quant import zigzag
from ..operators.frames import stereo_schemes
from ..operators.numbering import with_neighbours
from ..session import kept
from ..sources.views import FLOAT_SQL, MONO_SQL, RUNS_SQL, STEREO_SQL, runs, table, wave_float, wave_mono, wave_stereo
from .registry import query


@query(f"WITH {MONO_SQL}, p AS (SELECT track_id, n + 8 AS n, x FROM wave UNION ALL SELECT track_id, i AS n, 0 AS x FROM (SELECT DISTINCT track_id FROM wave), range(0, 8) t(i)), w AS (SELECT track_id, n // 24 - k AS win, n - 24 * (n // 24 - k) AS pl, x FROM p, range(0, 2) t(k) WHERE n // 24 - k >= 0 AND n - 24 * (n // 24 - k) < 32) SELECT track_id, win, count(*) AS size, CAST(sum(x) AS BIGINT) AS total, CAST(sum(CASE WHEN pl >= 8 THEN x ELSE 0 END) AS BIGINT) AS kept FROM w GROUP BY track_id, win")
def overlap_left_pad(spark, sf_dir):
    """Windows of 32 every 24 over tracks with eight zeros before them; each sample is kept in one window, past its first eight."""
    rows = wave_mono(spark, sf_dir)
    pad = rows.select("track_id").distinct().select("track_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("n"), F.lit(0).cast("long").alias("x"))
    padded = rows.select("track_id", (F.col("n") + 8).alias("n"), "x").union(pad)
    wins = padded.withColumn("win", F.explode(F.expr("array(n div 24, n div 24 - 1)"))).withColumn("at", F.col("n") - 24 * F.col("win")).where("win >= 0 and at < 32")
    return wins.groupBy("track_id", "win").agg(F.count(F.lit(1)).alias("size"), F.sum("x").alias("total"), F.sum(F.when(F.col("at") >= 8, F.col("x")).otherwise(0)).alias("kept"))


@query(f"WITH {FLOAT_SQL}, m AS (SELECT track_id, n, CASE WHEN (track_id + n) % 9 = 0 THEN 'nan'::DOUBLE ELSE x END AS x FROM wave), s AS (SELECT n, avg(x) AS mean, stddev_samp(x) AS deviation FROM m WHERE track_id % 5 <> 0 AND NOT isnan(x) GROUP BY n) SELECT track_id, count(*) FILTER (NOT isnan(m.x)) AS known, round(sum((x - mean) / deviation) FILTER (NOT isnan(m.x)), 5) AS total, round(max((x - mean) / deviation) FILTER (NOT isnan(m.x)), 5) AS most FROM m JOIN s USING (n) GROUP BY track_id")
def zscore_skipping_nan(spark, sf_dir):
    """Features standardized by the sample deviation of the training rows, what isn't a number counting for nothing."""
    x = F.when((F.col("track_id") + F.col("n")) % 9 == 0, float("nan")).otherwise(F.col("x"))
    rows = wave_float(spark, sf_dir).withColumn("x", F.nanvl(x, F.lit(None).cast("double")))
    stats = rows.where("track_id % 5 <> 0").groupBy("n").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("deviation"))
    z = (F.col("x") - F.col("mean")) / F.col("deviation")
    return rows.join(stats, "n").groupBy("track_id").agg(F.count("x").alias("known"), F.round(F.sum(z), 5).alias("total"), F.round(F.max(z), 5).alias("most"))


@query("SELECT event_id, month(ts)::INT AS month, day(ts)::INT AS day, (dayofweek(ts) + 6)::INT % 7 AS weekday, hour(ts)::INT AS hour, (minute(ts) // 15)::INT AS quarter, (hour(ts) * 4 + minute(ts) // 15)::INT AS slot FROM events")
def quarter_hour_features(spark, sf_dir):
    """Whole-number features of time stamps: month, day, weekday (Monday is 0), hour, quarter of the hour and of the day."""
    quarter = F.floor(F.minute("ts") / 15).cast("int")
    return table(spark, sf_dir, "events").select("event_id", F.month("ts").alias("month"), F.day("ts").alias("day"), F.weekday("ts").alias("weekday"), F.hour("ts").alias("hour"), quarter.alias("quarter"), (F.hour("ts") * 4 + quarter).alias("slot"))


@query(f"WITH {STEREO_SQL}, s AS (SELECT track_id, n, unnest([0, 1, 2, 3]) AS scheme, l, r FROM wave) SELECT track_id, n, scheme, l AS left_back, r AS right_back FROM s")
def stereo_inverses(spark, sf_dir):
    """The two channels out of each of the four decorrelations."""
    pairs = stereo_schemes(wave_stereo(spark, sf_dir)).groupBy("track_id", "n", "scheme").agg(F.max(F.when(F.col("ch") == 0, F.col("x"))).alias("a"), F.max(F.when(F.col("ch") == 1, F.col("x"))).alias("b"))
    a, b, s = F.col("a"), F.col("b"), F.col("scheme")
    left = F.when(s == 0, a).when(s == 1, a).when(s == 2, a + b).otherwise(a + F.shiftright(b + 1, 1))
    right = F.when(s == 0, b).when(s == 1, a + b).when(s == 2, a).otherwise(a - F.shiftright(b, 1))
    return pairs.select("track_id", "n", s.cast("int").alias("scheme"), left.alias("left_back"), right.alias("right_back"))


@query("WITH p AS (SELECT l_suppkey AS image, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_discount, l_shipdate) - 1 AS i, l_quantity AS r, l_linenumber * 20 AS g, l_discount * 1000 AS b FROM lineitem), g AS (SELECT image, i // 16 AS y, i % 16 AS x, CAST(floor(round((r + g + b) / 3, 6)) AS BIGINT) AS grey FROM p) SELECT image, y // 4 AS row, x // 8 AS col, count(*) AS pixels, CAST(sum(grey * ((y % 4) * 8 + x % 8 + 1)) AS BIGINT) AS checksum FROM g GROUP BY ALL")
def image_patches(spark, sf_dir):
    """Images 16 pixels wide as grey means of three channels, cut into tiles of eight by four."""
    i = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_shipdate")) - 1
    mean = F.floor(F.round((F.col("l_quantity") + F.col("l_linenumber") * 20 + F.col("l_discount") * 1000) / 3, 6)).cast("long")
    pixels = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("image"), i.cast("long").alias("i"), mean.alias("grey"))
    pixels = pixels.select("image", F.expr("i div 16").alias("y"), (F.col("i") % 16).alias("x"), "grey")
    weight = (F.col("y") % 4) * 8 + F.col("x") % 8 + 1
    return pixels.groupBy("image", F.expr("y div 4").alias("row"), F.expr("x div 8").alias("col")).agg(F.count(F.lit(1)).alias("pixels"), F.sum(F.col("grey") * weight).alias("checksum"))


_CENTS = "CAST(round(rate * 100) AS BIGINT)"


@query(f"WITH {RUNS_SQL}, l AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY dataset, priority, status ORDER BY ts DESC, run_id DESC) = 1), n AS (SELECT count(DISTINCT status) AS n FROM l), c AS (SELECT dataset, priority FROM l GROUP BY ALL HAVING count(DISTINCT status) = (SELECT n FROM n)), k AS (SELECT l.* FROM l JOIN c USING (dataset, priority)), m AS (SELECT dataset, status, CAST(sum({_CENTS}) // count(*) AS BIGINT) AS mean, count(*) AS n FROM k GROUP BY ALL) SELECT dataset, status, mean, n, mean = max(mean) OVER (PARTITION BY dataset) AS best FROM m")
def comparison_report(spark, sf_dir):
    """The latest result of each path and configuration, over the paths that all configurations have, with the best marked."""
    key = ["dataset", "priority", "status"]
    latest = runs(spark, sf_dir).groupBy(*key).agg(F.max_by(F.round(F.col("rate") * 100).cast("long"), F.struct("ts", "run_id")).alias("cents"))
    latest = kept(latest, "latest")
    common = latest.groupBy("dataset", "priority").agg(F.count(F.lit(1)).alias("c")).join(latest.agg(F.count_distinct("status").alias("n")), F.col("c") == F.col("n")).select("dataset", "priority")
    means = latest.join(common, ["dataset", "priority"], "left_semi").groupBy("dataset", "status").agg(F.expr("sum(cents) div count(1)").alias("mean"), F.count(F.lit(1)).alias("n"))
    return means.withColumn("best", F.col("mean") == F.max("mean").over(Window.partitionBy("dataset")))


@query("WITH a AS (SELECT o_custkey AS worker, 'f' || o_orderkey % 500 AS filename, 1 + o_orderkey % 5 AS score, o_orderpriority AS method FROM orders), bad AS (SELECT worker FROM a GROUP BY worker HAVING count(DISTINCT score) = 1), g AS (SELECT method, filename, avg(score) AS s, count(*) AS n FROM a WHERE worker NOT IN (SELECT worker FROM bad) GROUP BY ALL) SELECT method, count(*) AS files, CAST(sum(n) AS BIGINT) AS ratings, round(avg(s), 6) AS mos, round(1.96 * stddev_samp(s) / sqrt(count(*)), 6) AS ci FROM g GROUP BY method")
def listening_study(spark, sf_dir):
    """Opinion scores: workers who always answer alike are left out, files are averaged first, then methods with their interval."""
    answers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("worker"), F.concat(F.lit("f"), (F.col("o_orderkey") % 500).cast("string")).alias("filename"), (1 + F.col("o_orderkey") % 5).alias("score"), F.col("o_orderpriority").alias("method"))
    bad = answers.groupBy("worker").agg((F.min("score") == F.max("score")).alias("same")).where("same").select("worker")
    files = answers.join(bad, "worker", "left_anti").groupBy("method", "filename").agg(F.avg("score").alias("s"), F.count(F.lit(1)).alias("n"))
    return files.groupBy("method").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("ratings"), F.round(F.avg("s"), 6).alias("mos"), F.round(1.96 * F.stddev_samp("s") / F.sqrt(F.count(F.lit(1))), 6).alias("ci"))


@query(f"WITH {FLOAT_SQL}, q AS (SELECT track_id, n, least(greatest(CAST(floor((x + 1) / 2 * 65536) AS BIGINT), 0), 65535) AS q FROM wave), b AS (SELECT track_id, bits, q, ((q >> bits) << bits) | (1 << (bits - 1)) AS middle, ((q >> bits) << bits) | (abs(q * 40503 + n) % (1 << bits)) AS dithered FROM q, (SELECT unnest([2, 4, 8]) AS bits)) SELECT bits, count(*) AS n, round(avg(pow((q - middle) / 32768.0::DOUBLE, 2)), 12) AS mse_middle, round(avg(pow((q - dithered) / 32768.0::DOUBLE, 2)), 12) AS mse_dithered, CAST(sum(abs(q - middle)) AS BIGINT) AS off FROM b GROUP BY bits")
def dithering_study(spark, sf_dir):
    """Errors when so many low bits are lost and their middle, or noise, is put in their place."""
    q = F.least(F.greatest(F.floor((F.col("x") + 1) / 2 * 65536).cast("long"), F.lit(0)), F.lit(65535))
    rows = wave_float(spark, sf_dir).select("n", q.alias("q"), F.explode(F.array(*map(F.lit, (2, 4, 8)))).alias("bits"))
    size = F.expr("shiftleft(1L, bits)")
    high = F.expr("shiftleft(shiftright(q, bits), bits)")
    rows = rows.withColumn("middle", high + F.expr("shiftleft(1L, bits - 1)")).withColumn("dithered", high + F.abs(F.col("q") * 40503 + F.col("n")) % size)
    mse = lambda c: F.round(F.avg(F.pow((F.col("q") - F.col(c)) / 32768, F.lit(2))), 12)
    return rows.groupBy("bits").agg(F.count(F.lit(1)).alias("n"), mse("middle").alias("mse_middle"), mse("dithered").alias("mse_dithered"), F.sum(F.abs(F.col("q") - F.col("middle"))).alias("off"))


@query(f"WITH {MONO_SQL}, d AS (SELECT track_id, n // 256 AS chunk, x - lag(x, 1, 0) OVER (PARTITION BY track_id ORDER BY n) AS e FROM wave), z AS (SELECT track_id, chunk, CASE WHEN e >= 0 THEN 2 * e ELSE -2 * e - 1 END AS z FROM d), c AS (SELECT track_id, chunk, count(*) AS samples, CAST(sum(length(bin(z))) AS BIGINT) AS bits FROM z GROUP BY ALL) SELECT chunk, CAST(sum(samples) AS BIGINT) AS samples, round(sum(bits) / sum(samples), 6) AS bits_per_sample, round(avg(bits / samples), 6) AS mean_over_tracks, count(*) AS tracks FROM c GROUP BY chunk")
def rate_by_position(spark, sf_dir):
    """Bits that differences need, by how far into a track they lie: over all samples and as a mean over tracks."""
    rows = with_neighbours(wave_mono(spark, sf_dir), lambda w: {"e": F.col("x") - F.lag("x", 1, 0).over(w)}, 1).select("track_id", F.expr("n div 256").alias("chunk"), zigzag("e").alias("z"))
    chunks = rows.groupBy("track_id", "chunk").agg(F.count(F.lit(1)).alias("samples"), F.sum(F.char_length(F.bin("z"))).alias("bits"))
    return chunks.groupBy("chunk").agg(F.sum("samples").alias("samples"), F.round(F.sum("bits") / F.sum("samples"), 6).alias("bits_per_sample"), F.round(F.avg(F.col("bits") / F.col("samples")), 6).alias("mean_over_tracks"), F.count(F.lit(1)).alias("tracks"))
