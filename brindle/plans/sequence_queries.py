"""Queries on vocabularies, shifted targets, forecasting windows, splits and event-time windows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import fresh_path
from ..operators.numbering import with_neighbours
from ..sources.views import MONO_SQL, table, wave_mono
from ..streaming.expiring import first_seen, idle_closed, rocks_db
from ..streaming.windows import carried, latest_state, run_to_end, sessions, stream_of, windowed
from .registry import query

TOKENS = r"tok AS (SELECT doc_id, unnest(string_split_regex(trim(lower(text), ' '), ' +')) AS token FROM documents WHERE text IS NOT NULL)"


def tokens(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.explode(F.split(F.trim(F.lower("text")), " +")).alias("token"))


@query(f"WITH {TOKENS}, c AS (SELECT token, count(*) AS c FROM tok GROUP BY token HAVING count(*) >= 2) SELECT token, c, row_number() OVER (ORDER BY c DESC, token) + 1 AS id FROM c ORDER BY c DESC, token LIMIT 1000")
def vocab_build(spark, sf_dir):
    """The thousand most frequent tokens (the size of the vocabulary), after two special ids."""
    counts = tokens(spark, sf_dir).groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c >= 2")
    top = counts.orderBy(F.desc("c"), "token").limit(1000)
    return top.withColumn("id", (F.row_number().over(Window.orderBy(F.desc("c"), "token")) + 1).cast("long"))


@query(f"WITH {TOKENS}, c AS (SELECT token, count(*) AS c FROM tok GROUP BY token HAVING count(*) >= 2), v AS (SELECT token, row_number() OVER (ORDER BY c DESC, token) + 1 AS id FROM c ORDER BY c DESC, token LIMIT 1000) SELECT doc_id, count(*) AS n, CAST(sum(coalesce(id, 1)) AS BIGINT) AS id_sum, count(*) FILTER (id IS NULL) AS unknown FROM tok LEFT JOIN v USING (token) GROUP BY doc_id")
def numericalize(spark, sf_dir):
    """Token ids by a join with the vocabulary, whose size is bounded, so it is broadcast; 1 is unknown."""
    rows = tokens(spark, sf_dir).join(F.broadcast(vocab_build(spark, sf_dir).select("token", "id")), "token", "left")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("id", F.lit(1))).alias("id_sum"), F.count_if(F.col("id").isNull()).alias("unknown"))


@query("SELECT conv_id, turn, trim(regexp_replace(translate(text, '()[]', '    '), ' +', ' ', 'g'), ' ') AS tokens FROM conversations WHERE text IS NOT NULL")
def listops_tokenize(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("text is not null")
    return rows.select("conv_id", "turn", F.trim(F.regexp_replace(F.translate("text", "()[]", "    "), " +", " ")).alias("tokens"))


@query("SELECT conv_id, turn, length(text) AS x, coalesce(lead(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, role, text), -1) AS target FROM conversations")
def lm_shift_targets(spark, sf_dir):
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_last("turn"), F.asc_nulls_last("role"), F.asc_nulls_last("text"))
    size = F.length("text").cast("long")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", size.alias("x"), F.coalesce(F.lead(size).over(order), F.lit(-1)).alias("target"))


@query(f"WITH {MONO_SQL} SELECT track_id, n, coalesce(lag(x) OVER (PARTITION BY track_id ORDER BY n), 0) AS x, x AS y FROM wave")
def autoregressive_lag(spark, sf_dir):
    rows = with_neighbours(wave_mono(spark, sf_dir), lambda w: {"before": F.lag("x", 1, 0).over(w)}, 1)
    return rows.select("track_id", "n", F.col("before").alias("x"), F.col("x").alias("y"))


@query(f"WITH {MONO_SQL} SELECT track_id, n, CAST(sum(x) OVER (PARTITION BY track_id ORDER BY n ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS BIGINT) AS context, CAST(sum(x) OVER (PARTITION BY track_id ORDER BY n ROWS BETWEEN 8 FOLLOWING AND 11 FOLLOWING) AS BIGINT) AS target FROM wave QUALIFY count(*) OVER (PARTITION BY track_id) - n >= 12")
def forecast_windows(spark, sf_dir):
    """A window for each start that has a whole context of eight samples and a target of four."""
    columns = lambda w: {"context": F.sum("x").over(w.rowsBetween(0, 7)), "target": F.sum("x").over(w.rowsBetween(8, 11)), "end": F.lead("n", 11).over(w)}
    return with_neighbours(wave_mono(spark, sf_dir), columns, 0, 11).where("end is not null").select("track_id", "n", "context", "target")


@query("SELECT event_id, round(second(ts) / 59.0 - 0.5, 6) AS second, round(minute(ts) / 59.0 - 0.5, 6) AS minute, round(hour(ts) / 23.0 - 0.5, 6) AS hour, round((isodow(ts) - 1) / 6.0 - 0.5, 6) AS weekday, round((day(ts) - 1) / 30.0 - 0.5, 6) AS day, round((dayofyear(ts) - 1) / 365.0 - 0.5, 6) AS dayofyear, round((month(ts) - 1) / 11.0 - 0.5, 6) AS month, round((weekofyear(ts) - 1) / 52.0 - 0.5, 6) AS week, CAST(minute(ts) // 15 AS BIGINT) AS quarter FROM events")
def time_features(spark, sf_dir):
    scaled = lambda c, n, name: F.round(c / F.lit(float(n)) - 0.5, 6).alias(name)
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select(
        "event_id", scaled(F.second(ts), 59, "second"), scaled(F.minute(ts), 59, "minute"), scaled(F.hour(ts), 23, "hour"), scaled(F.weekday(ts), 6, "weekday"), scaled(F.dayofmonth(ts) - 1, 30, "day"),
        scaled(F.dayofyear(ts) - 1, 365, "dayofyear"), scaled(F.month(ts) - 1, 11, "month"), scaled(F.weekofyear(ts) - 1, 52, "week"), F.expr("cast(minute(ts) div 15 as long)").alias("quarter"),
    )


@query("WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events WHERE event_id % 10 < 7) SELECT event_id, round((value - m) / s, 6) AS z FROM events, s")
def zscore_train_only(spark, sf_dir):
    """Fitted on seven tenths of the rows (the training split of the operator), applied to all."""
    events = table(spark, sf_dir, "events").select("event_id", "value")
    stats = events.where("event_id % 10 < 7").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return events.join(F.broadcast(stats), F.lit(True)).select("event_id", F.round((F.col("value") - F.col("m")) / F.col("s"), 6).alias("z"))


@query(f"WITH {MONO_SQL}, l AS (SELECT *, count(*) OVER (PARTITION BY track_id) AS len FROM wave) SELECT track_id, n, CASE WHEN n < floor(len * 0.7) THEN 'train' WHEN n < floor(len * 0.7) + floor(len * 0.1) THEN 'val' ELSE 'test' END AS split FROM l")
def ordinal_split(spark, sf_dir):
    """The first seven tenths of a track, the tenth after them, and the rest. Shares are of whole numbers: 0.7 times 90 in doubles is below 63."""
    rows = wave_mono(spark, sf_dir)
    lengths = rows.groupBy(F.col("track_id").alias("of")).agg(F.count(F.lit(1)).alias("len"))
    rows = rows.join(lengths, F.col("track_id").eqNullSafe(F.col("of")))  # events without a user are a track too
    a, b = F.expr("len * 7 div 10"), F.expr("len div 10")
    return rows.select("track_id", "n", F.when(F.col("n") < a, "train").when(F.col("n") < a + b, "val").otherwise("test").alias("split"))


@query("SELECT doc_id, quality, CASE WHEN (row_number() OVER (PARTITION BY quality ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) - 1) / count(*) OVER (PARTITION BY quality) < 0.8 THEN 'train' ELSE 'test' END AS split FROM labels")
def stratified_split(spark, sf_dir):
    """Four fifths of each class by a hash of the id; the rank within a class comes from ranks within hash buckets.

    Two-level ranks keep a class with most of the rows out of a single task.
    """
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality", F.sha2(F.col("doc_id").cast("string"), 256).alias("h")).withColumn("b", F.substring("h", 1, 2))
    counts = rows.groupBy("quality", "b").agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("quality").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("quality", "b", before.alias("before"), F.sum("c").over(Window.partitionBy("quality")).alias("n"))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("quality", "b").orderBy("h", "doc_id")) - 1).join(counts, ["quality", "b"])
    return ranked.select("doc_id", "quality", F.when((F.col("before") + F.col("r")) / F.col("n") < 0.8, "train").otherwise("test").alias("split"))


@query(f"WITH {MONO_SQL}, f AS (SELECT *, n // 16 AS frame, n % 16 AS i FROM wave), s AS (SELECT *, avg(abs(x)) FILTER (i < 12) OVER (PARTITION BY track_id, frame) AS scale FROM f) SELECT track_id, n, round(x / scale, 6) AS normalized, round(round(x / scale, 6) * scale, 1) AS back FROM (SELECT * REPLACE (nullif(scale, 0) AS scale) FROM s)")
def horizon_normalize(spark, sf_dir):
    """Scales each frame by the mean magnitude of its context (its first twelve samples); null where that is zero."""
    frame = Window.partitionBy("track_id", F.expr("n div 16"))
    rows = wave_mono(spark, sf_dir).withColumn("scale", F.avg(F.when(F.col("n") % 16 < 12, F.abs("x"))).over(frame)).withColumn("scale", F.nullif("scale", F.lit(0.0)))
    return rows.select("track_id", "n", F.round(F.col("x") / F.col("scale"), 6).alias("normalized"), F.round(F.round(F.col("x") / F.col("scale"), 6) * F.col("scale"), 1).alias("back"))


#: A window is closed once the watermark (the latest event less an hour) has reached its end.
_CLOSED_SQL = "mark AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events)"
_CENTS_SQL = "CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents"


@query(f"WITH {_CLOSED_SQL}, w AS (SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, {_CENTS_SQL} FROM events GROUP BY ALL) SELECT w.* FROM w, mark WHERE start + INTERVAL 1 HOUR <= mark")
def stream_tumbling_availablenow(spark, sf_dir):
    """Hourly windows over the events as a stream that stops when it has read them all; open windows aren't written."""
    return spark.read.parquet(run_to_end(windowed(stream_of(spark, f"{sf_dir}/events.parquet"), "1 hour"), "tumbling"))


@query(f"WITH {_CLOSED_SQL}, e AS (SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS b, * FROM events), w AS (SELECT CAST(b - INTERVAL 10 MINUTE * k AS TIMESTAMP) AS start, event_type, count(*) AS n, {_CENTS_SQL} FROM e, range(0, 3) t(k) GROUP BY ALL) SELECT w.* FROM w, mark WHERE start + INTERVAL 30 MINUTE <= mark")
def stream_sliding_clips(spark, sf_dir):
    """Clips of thirty minutes, one every ten."""
    return spark.read.parquet(run_to_end(windowed(stream_of(spark, f"{sf_dir}/events.parquet"), "30 minutes", "10 minutes"), "sliding"))


@query(f"WITH {_CLOSED_SQL}, g AS (SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL 2 HOUR, TRUE) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g), w AS (SELECT user_id, k, min(ts) AS start, max(ts) AS last, count(*) AS n, {_CENTS_SQL} FROM s GROUP BY ALL) SELECT user_id, CAST(start AS TIMESTAMP) AS start, n, cents FROM w, mark WHERE last + INTERVAL 2 HOUR <= mark")
def stream_sessions(spark, sf_dir):
    """Each user's sessions, two hours without an event between them."""
    return spark.read.parquet(run_to_end(sessions(stream_of(spark, f"{sf_dir}/events.parquet"), "2 hours"), "sessions"))


@query(f"WITH {_CLOSED_SQL}, g AS (SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL 2 HOUR, TRUE) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g), w AS (SELECT user_id, k, min(ts) AS start, max(ts) AS last, count(*) AS n, {_CENTS_SQL} FROM s GROUP BY ALL), x AS (SELECT *, k < max(k) OVER (PARTITION BY user_id) AS followed FROM w) SELECT user_id, CAST(start AS TIMESTAMP) AS start, CAST(last AS TIMESTAMP) AS last, n, cents FROM x, mark WHERE followed OR last + INTERVAL 2 HOUR < mark")
def stream_idle_timers(spark, sf_dir):
    """Stretches of each user's events, closed by a timer once the user has been idle for two hours, whose state then goes.

    A stretch that a later event of the user shows to have ended is written with that event.
    """
    with rocks_db(spark):
        path = run_to_end(idle_closed(stream_of(spark, f"{sf_dir}/events.parquet"), 2 * 3_600_000), "idle")
    rows = spark.read.parquet(path)
    return rows.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("last").cast("timestamp_ntz").alias("last"), "n", "cents")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def stream_first_seen(spark, sf_dir):
    """One event of each user and type, remembered for a day of processing time."""
    with rocks_db(spark, without_data=False):
        path = run_to_end(first_seen(stream_of(spark, f"{sf_dir}/events.parquet"), 86_400_000), "seen")
    return spark.read.parquet(path)


@query("SELECT user_id, count(*) AS seen, count(*) // 50 AS resets, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY user_id")
def stream_carried_state(spark, sf_dir):
    """State carried over micro-batches for each user, with a reset every fifty events."""
    root = fresh_path(spark, "batches")
    events = table(spark, sf_dir, "events")
    events.repartition(3, "event_id").write.parquet(root)
    return latest_state(carried(stream_of(spark, root, files=1), 50), "user_id", "seen")


@query("SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS distinct_ids, 2 AS runs FROM events GROUP BY event_type")
def stream_resumed_log(spark, sf_dir):
    """A log that a stream appends to, stopped and started again on its checkpoint when more files are there: no row is
    lost or written twice."""
    root, log = fresh_path(spark, "arriving"), fresh_path(spark, "log")
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    for run in range(2):
        events.where(F.col("event_id") % 2 == run).write.mode("append").parquet(root)
        rows = run_to_end(stream_of(spark, root), "log", log)
    return spark.read.parquet(rows).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("distinct_ids"), F.lit(2).alias("runs"))
