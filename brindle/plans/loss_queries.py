"""Losses, metrics and probabilities over ten logits for each vector: its components summed by their place modulo ten."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.numbering import with_neighbours
from ..sources.views import MONO_SQL, table, wave_mono
from .registry import query

CLASSES = 10
LOGITS_SQL = f"spread AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, (generate_subscripts(embedding, 1) - 1) % {CLASSES} AS c FROM embeddings), logits AS (SELECT vec_id, label, c, 4 * sum(x) AS z FROM spread GROUP BY ALL), scored AS (SELECT *, ln(sum(exp(z)) OVER (PARTITION BY vec_id)) AS lse, row_number() OVER (PARTITION BY vec_id ORDER BY round(z, 9) DESC, c) AS rank FROM logits)"


def logits(spark, sf_dir):
    """vec_id, label, z (an array of ten doubles), lse (the logarithm of the sum of their exponentials)."""
    sums = F.expr(f"transform(sequence(0, {CLASSES - 1}), c -> 4 * aggregate(filter(embedding, (x, i) -> i % {CLASSES} = c), 0D, (a, x) -> a + x))")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", sums.alias("z"))
    return rows.withColumn("lse", F.log(F.expr("aggregate(z, 0D, (a, x) -> a + exp(x))")))


def ranked(spark, sf_dir):
    """A row a vector and class: vec_id, label, lse, c, z, rank (1 is likeliest)."""
    order = F.array_sort(F.expr("transform(z, (x, i) -> struct(-round(x, 9) as k, i as c, x as z))"))
    rows = logits(spark, sf_dir).select("vec_id", "label", "lse", F.posexplode(order).alias("rank", "v"))
    return rows.select("vec_id", "label", "lse", F.col("v.c").alias("c"), F.col("v.z").alias("z"), (F.col("rank") + 1).alias("rank"))


SMOOTHING, Z_LOSS = 0.1, 1e-4
_LOW = SMOOTHING / (CLASSES - 1)
_NORMAL = -((1 - SMOOTHING) * math.log(1 - SMOOTHING) + (CLASSES - 1) * _LOW * math.log(_LOW + 1e-20))


@query(f"WITH {LOGITS_SQL}, l AS (SELECT vec_id, label, sum(CASE WHEN c = label THEN {1 - SMOOTHING} ELSE {_LOW} END * (lse - z)) - {_NORMAL} AS loss, {Z_LOSS} * pow(max(lse), 2) AS z_loss, 1 + vec_id % 3 AS weight FROM scored GROUP BY vec_id, label) SELECT label, round(sum((loss + z_loss) * weight) / sum(weight), 6) AS loss, round(sum(z_loss * weight) / sum(weight), 8) AS z_loss, CAST(sum(weight) AS BIGINT) AS weights FROM l GROUP BY label")
def smoothed_cross_entropy(spark, sf_dir):
    """Weighted cross-entropy with label smoothing and a penalty on the normaliser, less its least value."""
    share = F.expr(f"aggregate(transform(z, (x, i) -> if(i = label, {1 - SMOOTHING}D, {_LOW}D) * (lse - x)), 0D, (a, x) -> a + x)")
    rows = logits(spark, sf_dir).select("label", (share - _NORMAL).alias("loss"), (Z_LOSS * F.pow("lse", F.lit(2))).alias("z_loss"), (1 + F.col("vec_id") % 3).alias("weight"))
    mean = lambda x: F.sum(x * F.col("weight")) / F.sum("weight")
    return rows.groupBy("label").agg(F.round(mean(F.col("loss") + F.col("z_loss")), 6).alias("loss"), F.round(mean(F.col("z_loss")), 8).alias("z_loss"), F.sum("weight").alias("weights"))


@query(f"WITH {MONO_SQL}, p AS (SELECT track_id, n, x / 1000.0::DOUBLE AS x, lag(x, 1, 0) OVER w / 1000.0::DOUBLE AS mean, 1 + abs(lag(x, 2, 0) OVER w) / 10000.0::DOUBLE AS raw FROM wave WINDOW w AS (PARTITION BY track_id ORDER BY n)) SELECT track_id, round(avg(0.5 * ln(2 * pi()) + ln(ln(1 + exp(raw))) + pow((x - mean) / ln(1 + exp(raw)), 2) / 2), 6) AS nll FROM p GROUP BY track_id")
def gaussian_nll(spark, sf_dir):
    """The negative log-likelihood of each sample under a Gaussian about the one before, its scale a softplus."""
    near = with_neighbours(wave_mono(spark, sf_dir), lambda w: {"mean": F.lag("x", 1, 0).over(w) / 1000, "raw": 1 + F.abs(F.lag("x", 2, 0).over(w)) / 10000}, 2)
    rows = near.select("track_id", (F.col("x") / 1000).alias("x"), "mean", "raw")
    scale = F.log(1 + F.exp("raw"))
    nll = 0.5 * math.log(2 * math.pi) + F.log(scale) + F.pow((F.col("x") - F.col("mean")) / scale, F.lit(2)) / 2
    return rows.groupBy("track_id").agg(F.round(F.avg(nll), 6).alias("nll"))


EPS = 2.0**-23


@query(f"WITH {LOGITS_SQL}, p AS (SELECT vec_id, c, exp(z - lse) AS p FROM scored) SELECT vec_id, round(sum((1 - 2 * {CLASSES} * {EPS!r}) * p + {EPS!r}), 9) AS total, round(min((1 - 2 * {CLASSES} * {EPS!r}) * p + {EPS!r}), 9) AS least FROM p GROUP BY vec_id")
def pdf_normalize(spark, sf_dir):
    """Probabilities made fit for coding: none too small, and together below one."""
    fit = F.expr(f"transform(z, x -> {1 - 2 * CLASSES * EPS!r}D * exp(x - lse) + {EPS!r}D)")
    return logits(spark, sf_dir).select("vec_id", fit.alias("p")).select("vec_id", F.round(F.expr("aggregate(p, 0D, (a, x) -> a + x)"), 9).alias("total"), F.round(F.array_min("p"), 9).alias("least"))


@query("SELECT conv_id, turn, round(pow((5 + length(text)) / 6.0, 0.6), 6) AS penalty FROM conversations")
def brevity_penalty(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(F.pow((5 + F.char_length("text")) / 6, F.lit(0.6)), 6).alias("penalty"))


@query("WITH f AS (SELECT p_partkey, 1 + p_partkey % 5000 AS n, unnest(range(1, 1 + CAST(round(sqrt(1 + p_partkey % 5000)) AS BIGINT))) AS d FROM part) SELECT p_partkey, max(d) AS a, n // max(d) AS b FROM f WHERE n % d = 0 GROUP BY p_partkey, n")
def closest_factors(spark, sf_dir):
    """The two factors of a number that lie closest together: an image's height and width."""
    rows = table(spark, sf_dir, "part").select("p_partkey", (1 + F.col("p_partkey") % 5000).alias("n"))
    rows = rows.withColumn("a", F.expr("array_max(filter(sequence(1L, cast(round(sqrt(n)) as bigint)), d -> n % d = 0))"))
    return rows.select("p_partkey", "a", F.expr("n div a").alias("b"))


@query(f"WITH {LOGITS_SQL}, t AS (SELECT label, (rank <= 1)::INT AS one, (rank <= 3)::INT AS three FROM scored WHERE c = label), f AS (SELECT label AS c, count(*) FILTER (c = label) AS tp, count(*) FILTER (c <> label) AS fn FROM scored WHERE rank = 1 GROUP BY ALL), g AS (SELECT c, count(*) FILTER (c <> label) AS fp FROM scored WHERE rank = 1 GROUP BY ALL), h AS (SELECT coalesce(tp, 0) AS tp, coalesce(fn, 0) AS fn, coalesce(fp, 0) AS fp FROM f FULL JOIN g USING (c)) SELECT (SELECT round(avg(one), 6) FROM t) AS accuracy, (SELECT round(avg(three), 6) FROM t) AS accuracy_at_3, (SELECT round(avg(2 * tp / (2 * tp + fn + fp)), 6) FROM h) AS f1_macro, (SELECT round(sum(2 * tp) / sum(2 * tp + fn + fp), 6) FROM h) AS f1_micro")
def accuracy_and_f1(spark, sf_dir):
    """Accuracy among the first and the first three, and F1 by class and over all."""
    rows = ranked(spark, sf_dir)
    hits = rows.where("c = label").agg(F.round(F.avg((F.col("rank") <= 1).cast("int")), 6).alias("accuracy"), F.round(F.avg((F.col("rank") <= 3).cast("int")), 6).alias("accuracy_at_3"))
    first = rows.where("rank = 1")
    wrong, right = F.count_if(F.col("c") != F.col("label")), F.count_if(F.col("c") == F.col("label"))
    known = first.groupBy("label").agg(right.alias("tp"), wrong.alias("fn"))
    given = first.groupBy(F.col("c").alias("label")).agg(wrong.alias("fp"))
    table_ = known.join(given, "label", "full").fillna(0)
    both, every = 2 * F.col("tp"), 2 * F.col("tp") + F.col("fn") + F.col("fp")
    return hits.crossJoin(table_.agg(F.round(F.avg(both / every), 6).alias("f1_macro"), F.round(F.sum(both) / F.sum(every), 6).alias("f1_micro")))


@query(f"WITH {LOGITS_SQL}, p AS (SELECT vec_id, c, exp(z - lse) AS p FROM scored), m AS (SELECT c, avg(p) AS q FROM p GROUP BY c), t AS (SELECT label AS c, count(*) / (SELECT count(*) FROM embeddings) AS y FROM embeddings GROUP BY ALL), k AS (SELECT sum(y * ln(y / q)) AS kl FROM t JOIN m USING (c)), e AS (SELECT avg(h) AS h FROM (SELECT vec_id, -sum(p * ln(p)) AS h FROM p GROUP BY vec_id)), i AS (SELECT avg(d) AS d FROM (SELECT vec_id, sum(p * ln(p / q)) AS d FROM p JOIN m USING (c) GROUP BY vec_id)) SELECT round(kl + h, 6) AS am, round(exp(d), 6) AS inception FROM k, e, i")
def distribution_scores(spark, sf_dir):
    """How close the classes given come to the labels' shares and how sure they are (AM), and the inception score."""
    rows = ranked(spark, sf_dir).withColumn("p", F.exp(F.col("z") - F.col("lse")))
    means = rows.groupBy("c").agg(F.avg("p").alias("q"), F.avg((F.col("c") == F.col("label")).cast("int")).alias("y"))
    kl = means.where("y > 0").agg(F.sum(F.col("y") * F.log(F.col("y") / F.col("q"))).alias("kl"))
    each = rows.join(F.broadcast(means), "c").groupBy("vec_id").agg((-F.sum(F.col("p") * F.log("p"))).alias("h"), F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).alias("d"))
    return each.agg(F.avg("h").alias("h"), F.avg("d").alias("d")).crossJoin(kl).select(F.round(F.col("kl") + F.col("h"), 6).alias("am"), F.round(F.exp("d"), 6).alias("inception"))


@query(f"WITH {LOGITS_SQL}, p AS (SELECT vec_id, label, c, z - lse AS l FROM scored), k AS (SELECT a.label, a.vec_id AS i, b.vec_id AS j, sum(exp(a.l) * (a.l - b.l)) AS kl FROM p a JOIN p b ON a.label = b.label AND a.c = b.c GROUP BY ALL), m AS (SELECT label, count(*) AS pairs, exp(avg(kl)) AS score FROM k GROUP BY label), q AS (SELECT label, c, avg(exp(l)) AS q FROM p GROUP BY ALL), h AS (SELECT p.label, vec_id, sum(exp(l) * (l - ln(q))) AS kl FROM p JOIN q ON p.label = q.label AND p.c = q.c GROUP BY ALL), i AS (SELECT label, exp(avg(kl)) AS score FROM h GROUP BY label) SELECT m.label, pairs, round(m.score, 6) AS modified_inception, round(i.score, 6) AS inception FROM m JOIN i USING (label)")
def modified_inception(spark, sf_dir):
    """The inception score within each label, and the modified one: over all ordered pairs of its vectors, exactly.

    The mean divergence of all pairs is linear in the first's probabilities and in the second's logarithms, so it is made of
    means by class; no pair is formed.
    """
    rows = ranked(spark, sf_dir).withColumn("l", F.col("z") - F.col("lse")).withColumn("p", F.exp("l"))
    means = rows.groupBy("label", "c").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("p") * F.col("l")).alias("own"), F.avg("p").alias("p"), F.avg("l").alias("l"))
    score = lambda other: F.round(F.exp(F.sum(F.col("own") - F.col("p") * other)), 6)
    pairs = (F.max("n") * F.max("n")).alias("pairs")
    return means.groupBy("label").agg(pairs, score(F.col("l")).alias("modified_inception"), score(F.log("p")).alias("inception"))


@query(f"WITH {LOGITS_SQL}, b AS (SELECT vec_id, z, CASE WHEN label % 2 = c % 2 THEN 1 ELSE 0 END AS y, exp(z - lse) AS p, CASE WHEN c = label THEN 0.7 ELSE 0.3 / 9 END AS soft, lse FROM scored) SELECT round(avg(greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))), 6) AS bce, round(avg(((z > 0)::INT = y)::INT), 6) AS accuracy, round(sum(soft * (lse - z)) / count(DISTINCT vec_id), 6) AS soft_ce, round(count(*) FILTER (z > 0 AND y = 1) / count(*) FILTER (z > 0 OR y = 1), 6) AS iou FROM b")
def binary_losses(spark, sf_dir):
    """Binary cross-entropy and accuracy from logits, cross-entropy with soft targets, intersection over union."""
    y = (F.col("label") % 2 == F.col("c") % 2).cast("int")
    rows = ranked(spark, sf_dir).withColumn("y", y)
    z = F.col("z")
    bce = F.greatest(z, F.lit(0.0)) - z * F.col("y") + F.log(1 + F.exp(-F.abs(z)))
    soft = F.when(F.col("c") == F.col("label"), 0.7).otherwise(0.3 / 9) * (F.col("lse") - z)
    return rows.agg(F.round(F.avg(bce), 6).alias("bce"), F.round(F.avg(((z > 0).cast("int") == F.col("y")).cast("int")), 6).alias("accuracy"), F.round(F.sum(soft) / F.countDistinct("vec_id"), 6).alias("soft_ce"), F.round(F.count_if((z > 0) & (F.col("y") == 1)) / F.count_if((z > 0) | (F.col("y") == 1)), 6).alias("iou"))


@query("SELECT user_id % 16 AS job, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total, count(*) AS steps, round(sum(CAST(round(value * 100) AS BIGINT)) / count(*), 6) AS per_step, round(sum(CAST(round(value * 100) AS BIGINT)) / (epoch(max(ts)) - epoch(min(ts))), 6) AS rate, round(count(*) / (epoch(max(ts)) - epoch(min(ts))), 9) AS steps_per_second FROM events GROUP BY 1")
def mergeable_metrics(spark, sf_dir):
    """Sums, means a step and rates over time from partial metrics of each worker, merged in a second step."""
    events = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp").cast("double"))
    workers = events.groupBy((F.col("user_id") % 16).alias("job"), "event_type").agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("total"), F.count(F.lit(1)).alias("steps"), F.min("t").alias("first"), F.max("t").alias("last"))
    merged = workers.groupBy("job").agg(F.sum("total").alias("total"), F.sum("steps").alias("steps"), (F.max("last") - F.min("first")).alias("seconds"))
    return merged.select("job", "total", "steps", F.round(F.col("total") / F.col("steps"), 6).alias("per_step"), F.round(F.col("total") / F.col("seconds"), 6).alias("rate"), F.round(F.col("steps") / F.col("seconds"), 9).alias("steps_per_second"))


@query(f"WITH {MONO_SQL}, e AS (SELECT track_id, abs(10 * x - 9 * lag(x, 1, 0) OVER w) AS a, abs(10 * x - 9 * lead(x, 1, 0) OVER w) AS b FROM wave WINDOW w AS (PARTITION BY track_id ORDER BY n)) SELECT track_id, CAST(sum(a) AS BIGINT) AS forward, CAST(sum(b) AS BIGINT) AS flipped, least(forward, flipped) AS best FROM e GROUP BY track_id")
def best_direction(spark, sf_dir):
    """The lesser of two losses: read forwards and read backwards."""
    off = lambda other: F.abs(10 * F.col("x") - 9 * other)
    errors = with_neighbours(wave_mono(spark, sf_dir), lambda w: {"a": off(F.lag("x", 1, 0).over(w)), "b": off(F.lead("x", 1, 0).over(w))}, 1, 1)
    return errors.groupBy("track_id").agg(F.sum("a").alias("forward"), F.sum("b").alias("flipped"), F.least(F.sum("a"), F.sum("b")).alias("best"))


@query(f"WITH {MONO_SQL}, z AS (SELECT track_id, n, x, lag(x, 1, 0) OVER (PARTITION BY track_id ORDER BY n) AS p, n < 10 + track_id % 50 AS used FROM wave) SELECT track_id, round(avg(pow(x - p, 2)) FILTER (used), 3) AS mse, round(avg(abs(x - p)) FILTER (used), 6) AS mae, round(abs(avg(x) FILTER (used) - avg(p) FILTER (used)), 6) AS row_error FROM z GROUP BY track_id")
def masked_errors(spark, sf_dir):
    """Squared and absolute errors within each track's length, and the error of its mean."""
    rows = with_neighbours(wave_mono(spark, sf_dir), lambda w: {"p": F.lag("x", 1, 0).over(w)}, 1).where(F.col("n") < 10 + F.col("track_id") % 50)
    gap = F.col("x") - F.col("p")
    return rows.groupBy("track_id").agg(F.round(F.avg(F.pow(gap, F.lit(2))), 3).alias("mse"), F.round(F.avg(F.abs(gap)), 6).alias("mae"), F.round(F.abs(F.avg("x") - F.avg("p")), 6).alias("row_error"))


@query(f"WITH {LOGITS_SQL} SELECT vec_id, string_agg(c::VARCHAR, ' ' ORDER BY rank) FILTER (rank <= 3) AS top, round(sum(exp(z - lse)) FILTER (rank <= 3), 6) AS mass FROM scored GROUP BY vec_id")
def top_k_mask(spark, sf_dir):
    """The three likeliest classes of each row, and the probability that a mask of the others leaves."""
    rows = logits(spark, sf_dir).withColumn("v", F.slice(F.array_sort(F.expr("transform(z, (x, i) -> struct(-round(x, 9) as k, i as c, exp(x - lse) as p))")), 1, 3))
    return rows.select("vec_id", F.array_join(F.col("v.c").cast("array<string>"), " ").alias("top"), F.round(F.expr("aggregate(v.p, 0D, (a, x) -> a + x)"), 6).alias("mass"))


@query(f"WITH {LOGITS_SQL}, p AS (SELECT vec_id, c, exp(z - lse) AS w, 1 + c AS scale FROM scored) SELECT vec_id, round(sum(w * scale), 6) AS mean_scale, round(-sum(w * log2(w)), 6) AS entropy FROM p GROUP BY vec_id")
def mixture_statistics(spark, sf_dir):
    """The mean scale and the entropy of a mixture, from the logits of its parts."""
    rows = logits(spark, sf_dir).select("vec_id", F.expr("transform(z, x -> exp(x - lse))").alias("w"))
    return rows.select("vec_id", F.round(F.expr("aggregate(transform(w, (p, i) -> p * (1 + i)), 0D, (a, x) -> a + x)"), 6).alias("mean_scale"), F.round(F.expr("-aggregate(transform(w, p -> p * log2(p)), 0D, (a, x) -> a + x)"), 6).alias("entropy"))
