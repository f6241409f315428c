"""Queries that prepare sequences for training: streams, chunks with resets, windows, padding, packing, detokenizing."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.draws import cumulative
from ..operators.numbering import numbered, with_length, with_neighbours
from ..session import kept
from ..sources.views import MONO_SQL, table, wave_mono
from .registry import query

#: Tokens of a conversation's turns: the words of its texts, numbered over the conversation.
TURNS_SQL = "turns AS (SELECT conv_id, turn, list_filter(string_split(lower(coalesce(text, '')), ' '), lambda x: x <> '') AS words FROM conversations)"


def turns(spark, sf_dir):
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), " "), lambda x: x != "")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("words"))


@query(f"WITH {MONO_SQL}, c AS (SELECT track_id, n // 32 AS chunk, n % 32 + 3 AS slot, x FROM wave UNION ALL SELECT track_id, n // 32 + 1, n % 32 - 29, x FROM wave WHERE n % 32 >= 29), s AS (SELECT track_id, max(n) // 32 AS last FROM wave GROUP BY ALL) SELECT c.track_id, chunk, chunk = 0 AS reset, count(*) AS carried, CAST(sum(x * (slot + 1)) AS BIGINT) AS checksum FROM c JOIN s ON s.track_id = c.track_id AND chunk <= last GROUP BY c.track_id, chunk")
def tbptt_chunks(spark, sf_dir):
    """Chunks of 32 samples with the three before them carried over; the first has zeros there and a reset flag."""
    rows = with_length(wave_mono(spark, sf_dir)).withColumn("last", F.expr("(len - 1) div 32"))
    own = F.struct(F.expr("n div 32").alias("chunk"), (F.col("n") % 32 + 3).alias("slot"))
    after = F.struct(F.expr("n div 32 + 1").alias("chunk"), (F.col("n") % 32 - 29).alias("slot"))
    at = F.when(F.col("n") % 32 >= 29, F.array(own, after)).otherwise(F.array(own))
    spread = rows.select("track_id", "x", "last", F.explode(at).alias("at")).select("track_id", "x", "last", "at.*").where("chunk <= last")
    return spread.groupBy("track_id", "chunk").agg((F.first("chunk") == 0).alias("reset"), F.count(F.lit(1)).alias("carried"), F.sum(F.col("x") * (F.col("slot") + 1)).alias("checksum"))


@query(f"WITH {MONO_SQL}, w AS (SELECT track_id, n, list(x) OVER s AS seq, list(x) OVER l AS label, list(x) OVER p AS pred FROM wave WINDOW s AS (PARTITION BY track_id ORDER BY n ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING), l AS (PARTITION BY track_id ORDER BY n ROWS BETWEEN 4 FOLLOWING AND 7 FOLLOWING), p AS (PARTITION BY track_id ORDER BY n ROWS BETWEEN 8 FOLLOWING AND 11 FOLLOWING)) SELECT track_id, n, array_to_string(seq, ' ') AS seq, array_to_string(label, ' ') AS label, array_to_string(pred, ' ') AS pred FROM w WHERE len(pred) = 4")
def forecast_window_arrays(spark, sf_dir):
    """For each start: eight samples, the last four of them again as labels, and the four to forecast."""
    shown = lambda w, a, b: F.array_join(F.collect_list("x").over(w.rowsBetween(a, b)), " ")
    columns = lambda w: {"seq": shown(w, 0, 7), "label": shown(w, 4, 7), "pred": shown(w, 8, 11), "end": F.lead("n", 11).over(w)}
    return with_neighbours(wave_mono(spark, sf_dir), columns, 0, 11).where("end is not null").select("track_id", "n", "seq", "label", "pred")


@query(f"WITH {MONO_SQL}, z AS (SELECT track_id, count(*) // 4 AS step FROM wave GROUP BY ALL), s AS (SELECT track_id, n // step AS stream, n % step AS pos, x FROM wave JOIN z USING (track_id) WHERE n < 4 * step) SELECT track_id, stream, pos, x AS token, lead(x) OVER w AS target, pos // 16 AS batch, CAST(sum(x) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS BIGINT) AS context FROM s WINDOW w AS (PARTITION BY track_id, stream ORDER BY pos)")
def lm_streams(spark, sf_dir):
    """Each track trimmed to four streams of equal length, with targets one ahead, batches of 16 and their context."""
    rows = with_length(wave_mono(spark, sf_dir)).withColumn("step", F.expr("len div 4")).where("n < 4 * step")
    rows = rows.select("track_id", F.expr("n div step").alias("stream"), (F.col("n") % F.col("step")).alias("pos"), "x")
    columns = lambda w: {"target": F.lead("x").over(w), "context": F.sum("x").over(w.rowsBetween(-4, -1))}
    near = with_neighbours(rows.withColumn("key", F.struct("track_id", "stream")), columns, 4, 1, "key", "pos")
    return near.select("track_id", "stream", "pos", F.col("x").alias("token"), "target", F.expr("pos div 16").alias("batch"), "context")


@query(f"WITH {TURNS_SQL}, t AS (SELECT conv_id, turn, len(words) AS n FROM turns), p AS (SELECT conv_id, turn, n, CAST(coalesce(sum(n + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM t) SELECT conv_id, turn, start // 64 AS slot, start % 64 AS place, (start + n) // 64 - start // 64 + 1 AS slots FROM p")
def stream_packing(spark, sf_dir):
    """Sentences laid end to end (with an end mark each) into slots of 64 tokens."""
    before = F.sum(F.col("n") + 1).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    rows = turns(spark, sf_dir).select("conv_id", "turn", F.size("words").cast("long").alias("n")).withColumn("start", F.coalesce(before, F.lit(0)))
    return rows.select("conv_id", "turn", F.expr("start div 64").alias("slot"), (F.col("start") % 64).alias("place"), F.expr("(start + n) div 64 - start div 64 + 1").alias("slots"))


@query(f"WITH {MONO_SQL}, z AS (SELECT track_id, count(*) AS n FROM wave GROUP BY ALL), o AS (SELECT track_id, CAST(sum(n) OVER (ORDER BY track_id) - n AS BIGINT) AS start, CAST(sum(n) OVER () AS BIGINT) AS total FROM z) SELECT (start + n) // 100 AS slice, count(*) AS size, CAST(sum(x) AS BIGINT) AS total, min(track_id) AS first, max(track_id) AS last FROM wave JOIN o USING (track_id) WHERE (start + n) // 100 < o.total // 100 GROUP BY slice")
def concat_and_slice(spark, sf_dir):
    """All tracks laid end to end and cut into slices of 100; what is left over is dropped."""
    rows = wave_mono(spark, sf_dir)
    sizes = kept(rows.groupBy("track_id").agg(F.count(F.lit(1)).alias("size")), "sizes")
    starts = cumulative(sizes, "track_id", "size").select("track_id", F.col("low").alias("start"))
    total = F.broadcast(sizes.agg(F.sum("size").alias("all")))
    placed = rows.join(starts, "track_id").join(total, F.lit(True)).withColumn("slice", F.expr("(start + n) div 100")).where("slice < all div 100")
    return placed.groupBy("slice").agg(F.count(F.lit(1)).alias("size"), F.sum("x").alias("total"), F.min("track_id").alias("first"), F.max("track_id").alias("last"))


@query(f"WITH {TURNS_SQL}, v AS (SELECT w, row_number() OVER (ORDER BY n DESC, w) + 1 AS id FROM (SELECT w, count(*) AS n FROM (SELECT unnest(words) AS w FROM turns) GROUP BY w) WHERE n >= 3), t AS (SELECT conv_id, turn, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM turns) SELECT conv_id, turn, string_agg(coalesce(v.id, 1)::VARCHAR, ' ' ORDER BY i) AS ids, string_agg(coalesce(v.w, '<unk>'), ' ' ORDER BY i) AS words FROM t LEFT JOIN v ON t.w = v.w GROUP BY conv_id, turn")
def detokenize(spark, sf_dir):
    """Words to ids of a vocabulary (with 1 for unknown ones) and back again."""
    rows = turns(spark, sf_dir).select("conv_id", "turn", F.posexplode("words").alias("i", "w"))
    counts = rows.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("w", (-F.col("n")).alias("less"), F.lit(0).alias("all"))
    # ranks in two levels; the word stands beside its id, so that ids needn't be joined a second time (most are few ids)
    vocabulary = numbered(counts, "all", ["less", "w"], "rank").select("w", (F.col("rank") + 2).alias("id"), F.col("w").alias("word"))
    back = rows.join(vocabulary, "w", "left").select("conv_id", "turn", "i", F.coalesce("id", F.lit(1)).alias("id"), F.coalesce("word", F.lit("<unk>")).alias("word"))
    packed = back.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("i", "id", "word"))).alias("v"))
    return packed.select("conv_id", "turn", F.array_join(F.col("v.id").cast("array<string>"), " ").alias("ids"), F.array_join("v.word", " ").alias("words"))


@query(f"WITH {TURNS_SQL}, t AS (SELECT conv_id, turn, [length(w) FOR w IN words] AS v, len(words) AS n FROM turns), p AS (SELECT *, CAST(pow(2, ceil(log2(greatest(n, 1)))) AS BIGINT) AS size FROM t) SELECT conv_id, turn, n, size, array_to_string(v || [0 FOR i IN range(size - n)], ' ') AS padded, array_to_string(v[2:] || [-100 FOR i IN range(size - greatest(n - 1, 0))], ' ') AS labels FROM p")
def pad_power_of_two(spark, sf_dir):
    """Sequences padded to a power of two, with labels one ahead and -100 where there is none, and their lengths."""
    rows = turns(spark, sf_dir).select("conv_id", "turn", F.transform("words", F.char_length).alias("v"), F.size("words").cast("long").alias("n"))
    rows = rows.withColumn("size", F.pow(F.lit(2), F.ceil(F.log2(F.greatest("n", F.lit(1))))).cast("long"))
    gap = (F.col("size") - F.col("n")).cast("int")
    shown = lambda x: F.array_join(x.cast("array<string>"), " ")
    padded = F.concat("v", F.array_repeat(F.lit(0), gap))
    labels = F.concat(F.expr("slice(v, 2, size(v))"), F.array_repeat(F.lit(-100), (F.col("size") - F.greatest(F.col("n") - 1, F.lit(0))).cast("int")))
    return rows.select("conv_id", "turn", "n", "size", shown(padded).alias("padded"), shown(labels).alias("labels"))


@query(f"WITH {TURNS_SQL} SELECT conv_id, turn, array_to_string(['<s>'] || words[1:14] || ['</s>'], ' ') AS tokens, least(len(words), 14) + 2 AS n FROM turns")
def truncate_bos_eos(spark, sf_dir):
    """At most 16 tokens, a beginning and an end mark among them."""
    cut = F.slice("words", 1, 14)
    return turns(spark, sf_dir).select("conv_id", "turn", F.array_join(F.concat(F.array(F.lit("<s>")), cut, F.array(F.lit("</s>"))), " ").alias("tokens"), (F.size(cut) + 2).cast("long").alias("n"))


@query(f"WITH {TURNS_SQL}, t AS (SELECT conv_id, turn, [length(w) FOR w IN words] AS v FROM turns) SELECT conv_id, turn, array_to_string((v || [0 FOR i IN range(12)])[1:12], ' ') AS batch, array_to_string((v || [coalesce(v[-1], 0) FOR i IN range(12)])[1:12], ' ') AS held FROM t")
def pad_or_truncate(spark, sf_dir):
    """Lists of exactly twelve: cut, or filled with zeros, or with their last value (zero where a list is empty)."""
    rows = turns(spark, sf_dir).select("conv_id", "turn", F.transform("words", F.char_length).alias("v"))
    shown = lambda fill: F.array_join(F.slice(F.concat("v", F.array_repeat(fill, 12)), 1, 12).cast("array<string>"), " ")
    return rows.select("conv_id", "turn", shown(F.lit(0)).alias("batch"), shown(F.coalesce(F.try_element_at("v", F.lit(-1)), F.lit(0))).alias("held"))


@query(f"WITH {MONO_SQL}, s AS (SELECT track_id, avg(x) AS mean, stddev_pop(x) AS deviation FROM wave GROUP BY ALL), z AS (SELECT wave.track_id, n, x, (x - mean) / deviation AS z FROM wave JOIN s USING (track_id) WHERE deviation > 0), f AS (SELECT *, lag(z) OVER (PARTITION BY track_id ORDER BY n) AS forecast FROM z) SELECT f.track_id, round(avg(abs(z - forecast) * deviation), 3) AS mae, round(avg(abs(x - (forecast * deviation + mean))), 3) AS back FROM f JOIN s USING (track_id) WHERE forecast IS NOT NULL GROUP BY f.track_id")
def destandardize(spark, sf_dir):
    """Forecasts of standardized series brought back to each series' own scale, where the error is taken from the samples themselves."""
    rows = wave_mono(spark, sf_dir)
    stats = rows.groupBy("track_id").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("deviation")).where("deviation > 0")
    scaled = rows.join(stats, "track_id").withColumn("z", (F.col("x") - F.col("mean")) / F.col("deviation"))
    scaled = with_neighbours(scaled, lambda w: {"forecast": F.lag("z").over(w)}, 1).where("forecast is not null")
    forecast = F.col("forecast") * F.col("deviation") + F.col("mean")
    return scaled.groupBy("track_id").agg(F.round(F.avg(F.abs(F.col("z") - F.col("forecast")) * F.col("deviation")), 3).alias("mae"), F.round(F.avg(F.abs(F.col("x") - forecast)), 3).alias("back"))


@query("SELECT vec_id, label, array_to_string([(i = label)::INT FOR i IN range(10)], '') AS onehot FROM embeddings")
def one_hot(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (i == F.col("label")).cast("int").cast("string")), "").alias("onehot"))
