"""Queries that sample, generate and deal rows. Draws come from checksums of keys, so reruns and engines agree."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.draws import weighted_draws
from ..operators.numbering import numbered, with_length
from ..sources.views import MONO_SQL, STEREO_SQL, table, wave_mono, wave_stereo
from .registry import query


def draw(key, seed: int, below: int):
    """A whole number from 0 to below - 1 (below at most 2^32), from an MD5 of a key and a seed."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}"))), 1, 8), 16, 10).cast("long"), F.lit(below))


def draw_sql(key: str, seed: int, below: int | str) -> str:
    return f"CAST('0x' || substr(md5({key} || '-{seed}'), 1, 8) AS BIGINT) % {below}"


@query(f"{'SELECT event_id, ' + draw_sql('event_id', 7, 1000)} AS draw FROM events WHERE {draw_sql('event_id', 7, 1000)} < 200")
def seeded_sample(spark, sf_dir):
    """A fifth of the rows, the same ones for a seed wherever they lie."""
    return table(spark, sf_dir, "events").select("event_id", draw(F.col("event_id"), 7, 1000).alias("draw")).where("draw < 200")


@query(f"WITH {MONO_SQL} SELECT track_id, n, row_number() OVER (PARTITION BY track_id ORDER BY {draw_sql('n', 3, 1 << 32)}, md5(n || '-3'), n) - 1 AS place FROM wave")
def seeded_shuffle(spark, sf_dir):
    """All samples of each track in an order that a seed gives; places go by ranges of hashes, so a track is many tasks' work."""
    key = F.md5(F.concat(F.col("n").cast("string"), F.lit("-3")))
    rows = wave_mono(spark, sf_dir).select("track_id", "n", draw(F.col("n"), 3, 1 << 32).alias("lead"), key.alias("h"))
    return numbered(rows, "track_id", ["lead", "h", "n"], "place").select("track_id", "n", "place")


@query(f"WITH {MONO_SQL} SELECT track_id, count(*) AS n, CAST(sum(x) AS BIGINT) AS total FROM wave WHERE n < 40 GROUP BY track_id")
def head_truncation(spark, sf_dir):
    """The first seconds of each track, at twenty samples a second."""
    return wave_mono(spark, sf_dir).where(F.col("n") < 2 * 20).groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"))


@query("SELECT p_partkey, unnest(range(1 + p_size % 4)) AS copy FROM part")
def upsample(spark, sf_dir):
    """Each file as often as its factor says."""
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(F.expr("sequence(0L, p_size % 4)")).alias("copy"))


_WEIGHTS_SQL = "w AS (SELECT l_suppkey AS item, CAST(count(*) AS BIGINT) AS weight FROM lineitem GROUP BY ALL), c AS (SELECT item, weight, CAST(sum(weight) OVER (ORDER BY item) AS BIGINT) AS upto FROM w)"


@query(f"WITH {_WEIGHTS_SQL}, d AS (SELECT o_orderkey AS slot, {draw_sql('o_orderkey', 5, '(SELECT max(upto) FROM c)')} AS u FROM orders) SELECT slot, item FROM d JOIN c ON u >= upto - weight AND u < upto")
def weighted_sample(spark, sf_dir):
    """A draw with replacement for each order: suppliers, by the number of their line items."""
    weights = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("item")).agg(F.count(F.lit(1)).alias("weight"))
    slots = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("slot"))
    return weighted_draws(slots, weights, lambda total: F.pmod(F.conv(F.substring(F.md5(F.concat(F.col("slot").cast("string"), F.lit("-5"))), 1, 8), 16, 10).cast("long"), total)).select("slot", "item")


@query(f"WITH s AS (SELECT s_suppkey, s_nationkey AS g, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier), p AS (SELECT user_id % 25 AS g, row_number() OVER (PARTITION BY user_id % 25 ORDER BY event_id) - 1 AS p, event_id FROM events) SELECT p.g AS grp, event_id, p // 4 AS chunk, p % 4 AS k, s_suppkey FROM p JOIN s ON s.g = p.g AND s.i = p % s.n")
def cyclic_chunks(spark, sf_dir):
    """Every event of a group takes the next supplier of it, from the first again after the last; chunks of four."""
    slots = numbered(table(spark, sf_dir, "events").select((F.col("user_id") % 25).alias("grp"), "event_id"), "grp", ["event_id"], "p")
    items = with_length(numbered(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("grp"), "s_suppkey"), "grp", ["s_suppkey"], "i"), "size", "grp")
    sizes = items.select("grp", "size").distinct()
    found = slots.join(sizes, "grp").withColumn("i", F.col("p") % F.col("size")).drop("size").join(items, ["grp", "i"])
    return found.select("grp", "event_id", F.expr("p div 4").alias("chunk"), (F.col("p") % 4).alias("k"), "s_suppkey")


@query(f"SELECT i, {draw_sql('i', 1, 256)} AS noise, CASE WHEN i % 32 < 10 THEN {draw_sql('i', 2, 8)} + 1 ELSE 0 END AS copying, CASE WHEN i % 32 >= 4 THEN {draw_sql('(i - 4)', 1, 256)} ELSE 0 END AS delayed, ({draw_sql('i', 3, 32)} < 2)::INT AS marked FROM (SELECT unnest(range(4096)) AS i)")
def synthetic_sequences(spark, sf_dir):
    """Generated sequences of 32: noise bytes, symbols to copy after blanks, noise delayed by four, marks to add at."""
    i = F.col("i")
    rows = spark.range(4096).withColumnRenamed("id", "i")
    return rows.select("i", draw(i, 1, 256).alias("noise"), F.when(i % 32 < 10, draw(i, 2, 8) + 1).otherwise(0).alias("copying"), F.when(i % 32 >= 4, draw(i - 4, 1, 256)).otherwise(0).alias("delayed"), (draw(i, 3, 32) < 2).cast("int").alias("marked"))


@query(f"WITH {STEREO_SQL}, z AS (SELECT track_id, count(*) AS n FROM wave GROUP BY ALL), t AS (SELECT track_id, n, {draw_sql('track_id', 1, 'greatest(n - 31, 1)')} AS start, {draw_sql('track_id', 2, 2)} AS pick, {draw_sql('track_id', 3, 2)} AS swap FROM z) SELECT wave.track_id, wave.n - start AS i, CASE pick WHEN 0 THEN l ELSE r END AS mono, CASE swap WHEN 0 THEN l ELSE r END AS first FROM wave JOIN t USING (track_id) WHERE wave.n >= start AND wave.n < start + 32")
def random_crop(spark, sf_dir):
    """A crop of 32 samples of each track, one of its channels, and a coin for the channels' order."""
    rows = wave_stereo(spark, sf_dir)
    sizes = rows.groupBy("track_id").agg(F.count(F.lit(1)).alias("size"))
    track = F.col("track_id")
    start = F.pmod(F.conv(F.substring(F.md5(F.concat(track.cast("string"), F.lit("-1"))), 1, 8), 16, 10).cast("long"), F.greatest(F.col("size") - 31, F.lit(1)))
    picked = sizes.select("track_id", start.alias("start"), draw(track, 2, 2).alias("pick"), draw(track, 3, 2).alias("swap"))
    cut = rows.join(picked, "track_id").where("n >= start and n < start + 32")
    return cut.select("track_id", (F.col("n") - F.col("start")).alias("i"), F.when(F.col("pick") == 0, F.col("l")).otherwise(F.col("r")).alias("mono"), F.when(F.col("swap") == 0, F.col("l")).otherwise(F.col("r")).alias("first"))
