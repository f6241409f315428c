"""Queries on distributions, errors, agreement, classification and likelihoods."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import quant
from ..operators.frames import residual_frames, residual_sql
from ..operators.ranks import ranked_values
from ..session import kept
from ..sources.views import FLOAT_SQL, MONO_SQL, table, wave_float, wave_mono
from .loss_queries import LOGITS_SQL, logits
from .registry import query

RES = residual_sql(MONO_SQL)
_R = "r AS (SELECT track_id, CASE WHEN z % 2 = 0 THEN z // 2 ELSE -((z + 1) // 2) END AS e FROM res)"


def residuals(spark, sf_dir):
    return residual_frames(wave_mono(spark, sf_dir)).select("track_id", quant.unzigzag("z").alias("e"))


@query(f"WITH {RES}, {_R}, c AS (SELECT e, count(*) AS c FROM r GROUP BY e) SELECT e, c, round(c / (SELECT sum(c) FROM c), 8) AS p FROM c")
def residual_histogram(spark, sf_dir):
    counts = residuals(spark, sf_dir).groupBy("e").agg(F.count(F.lit(1)).alias("c"))
    total = counts.agg(F.sum("c").alias("n"))
    return counts.join(F.broadcast(total), F.lit(True)).select("e", "c", F.round(F.col("c") / F.col("n"), 8).alias("p"))


@query(f"WITH {RES}, {_R} SELECT CASE WHEN e = 0 THEN -1 ELSE length(bin(abs(e))) - 1 END AS bucket, count(*) AS c, CAST(max(abs(e)) AS BIGINT) AS most FROM r GROUP BY ALL")
def magnitude_log2(spark, sf_dir):
    m = F.abs("e")
    bucket = F.when(m == 0, -1).otherwise(F.length(F.bin(m)) - 1).cast("long")
    return residuals(spark, sf_dir).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("c"), F.max(m).alias("most"))


@query(f"WITH {RES}, {_R}, c AS (SELECT track_id, abs(e) // 1000 AS bin, count(*) AS c FROM r GROUP BY ALL), p AS (SELECT *, c / sum(c) OVER (PARTITION BY track_id) AS p FROM c) SELECT bin, round(sum(p) / (SELECT count(DISTINCT track_id) FROM r), 6) AS mean_p, count(*) AS tracks FROM p GROUP BY bin")
def mean_distribution(spark, sf_dir):
    """The mean over tracks of their distributions; a track without a bin counts as zero without a row for it."""
    counts = residuals(spark, sf_dir).groupBy("track_id", F.expr("abs(e) div 1000").alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    shares = counts.withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy("track_id")))
    tracks = counts.agg(F.count_distinct("track_id").alias("n"))
    sums = shares.groupBy("bin").agg(F.sum("p").alias("p"), F.count(F.lit(1)).alias("tracks"))
    return sums.join(F.broadcast(tracks), F.lit(True)).select("bin", F.round(F.col("p") / F.col("n"), 6).alias("mean_p"), "tracks")


@query(f"WITH {RES}, {_R}, c AS (SELECT track_id, abs(e) AS m, count(*) AS c FROM r GROUP BY ALL) SELECT track_id, round(sum(m * c) / sum(c), 6) AS mean_abs, CAST(min(m) AS BIGINT) AS least, CAST(max(m) AS BIGINT) AS most FROM c GROUP BY track_id")
def weighted_mean_abs(spark, sf_dir):
    counts = residuals(spark, sf_dir).groupBy("track_id", F.abs("e").alias("m")).agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy("track_id").agg(F.round(F.sum(F.col("m") * F.col("c")) / F.sum("c"), 6).alias("mean_abs"), F.min("m").alias("least"), F.max("m").alias("most"))


@query(f"WITH {MONO_SQL} SELECT track_id, round(sqrt(avg(x * x)), 4) AS rms, count(DISTINCT x) AS distinct_values, round(log2(count(DISTINCT x)), 6) AS bits FROM wave GROUP BY track_id")
def rms_and_levels(spark, sf_dir):
    return wave_mono(spark, sf_dir).groupBy("track_id").agg(F.round(F.sqrt(F.avg(F.col("x") * F.col("x"))), 4).alias("rms"), F.count_distinct("x").alias("distinct_values"), F.round(F.log2(F.count_distinct("x")), 6).alias("bits"))


RATED = "rated AS (SELECT conv_id, turn, role, length(text) % 5 + 1 AS score, conv_id % 20 AS worker FROM conversations WHERE text IS NOT NULL)"


def _rated(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("text is not null")
    return rows.select("conv_id", "turn", "role", (F.length("text") % 5 + 1).cast("long").alias("score"), (F.col("conv_id") % 20).alias("worker"))


@query(f"WITH {RATED} SELECT role, count(*) AS n, round(avg(score), 6) AS mean, round(1.96 * stddev_samp(score) / sqrt(count(*)), 6) AS ci95 FROM rated GROUP BY role")
def mos_ci95(spark, sf_dir):
    return _rated(spark, sf_dir).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(1.96 * F.stddev_samp("score") / F.sqrt(F.count(F.lit(1))), 6).alias("ci95"))


@query(f"WITH {RATED}, bad AS (SELECT worker FROM rated WHERE turn = 0 GROUP BY worker HAVING avg(score) > 3) SELECT role, count(*) AS n, CAST(sum(score) AS BIGINT) AS total FROM rated WHERE turn > 0 AND worker NOT IN (SELECT worker FROM bad) GROUP BY role")
def worker_blocklist(spark, sf_dir):
    """Workers who rate the controls too high are left out, then the controls."""
    rows = _rated(spark, sf_dir)
    bad = rows.where("turn = 0").groupBy("worker").agg(F.avg("score").alias("mean")).where("mean > 3").select("worker")
    return rows.where("turn > 0").join(bad, "worker", "left_anti").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"))


@query(f"WITH {RATED}, p AS (SELECT a.score >= 3 AS a, b.score >= 3 AS b FROM rated a JOIN rated b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1), c AS (SELECT count(*) AS n, sum(CASE WHEN a = b THEN 1 ELSE 0 END) / count(*) AS po, avg(CAST(a AS INT)) AS pa, avg(CAST(b AS INT)) AS pb FROM p) SELECT n, round(po, 6) AS agreement, round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 6) AS kappa FROM c")
def kappa(spark, sf_dir):
    rows = _rated(spark, sf_dir)
    a = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), (F.col("score") >= 3).alias("a"))
    pairs = a.join(rows.select("conv_id", "turn", (F.col("score") >= 3).alias("b")), ["conv_id", "turn"])
    sums = pairs.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("a") == F.col("b")).cast("int")).alias("po"), F.avg(F.col("a").cast("int")).alias("pa"), F.avg(F.col("b").cast("int")).alias("pb"))
    chance = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return sums.select("n", F.round("po", 6).alias("agreement"), F.round((F.col("po") - chance) / (1 - chance), 6).alias("kappa"))


SCORED = "scored AS (SELECT doc_id, quality AS y, CAST(n_chars > 600 AS INT) AS p, n_chars FROM labels JOIN documents USING (doc_id))"


def _scored(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", F.col("quality").alias("y"), (F.col("n_chars") > 600).cast("int").alias("p"), "n_chars")


@query(f"WITH {SCORED}, c AS (SELECT count(*) AS n, sum(CAST(y = p AS INT)) AS hit, sum(y * p) AS tp, sum((1 - y) * p) AS fp, sum(y * (1 - p)) AS fn FROM scored) SELECT n, round(hit / n, 6) AS accuracy, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tp / (tp + fp), 6) AS precision_, round(tp / (tp + fn), 6) AS recall FROM c")
def classification_metrics(spark, sf_dir):
    y, p = F.col("y"), F.col("p")
    c = _scored(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.sum((y == p).cast("int")).alias("hit"), F.sum(y * p).alias("tp"), F.sum((1 - y) * p).alias("fp"), F.sum(y * (1 - p)).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("n", F.round(F.col("hit") / F.col("n"), 6).alias("accuracy"), F.round(2 * tp / (2 * tp + fp + fn), 6).alias("f1"), F.round(tp / (tp + fp), 6).alias("precision_"), F.round(tp / (tp + fn), 6).alias("recall"))


@query(f"WITH {SCORED}, v AS (SELECT n_chars, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY n_chars), b AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY n_chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM v) SELECT round(sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)), 6) AS auc FROM b")
def auc_rank(spark, sf_dir):
    """The area under the curve from ranks: rows meet in counts a score, scores are ranked in two levels."""
    counts = _scored(spark, sf_dir).groupBy("n_chars").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    rows = ranked_values(kept(counts.withColumn("all", F.lit(0)), "counts"), "all", "n_chars", "neg")
    return rows.agg(F.round(F.sum(F.col("pos") * (F.col("below") + 0.5 * F.col("neg"))) / (F.sum("pos") * F.sum("neg")), 6).alias("auc"))


@query("SELECT doc_id, quality, round(1.0 / count(*) OVER (PARTITION BY quality), 8) AS weight FROM labels")
def class_weights(spark, sf_dir):
    """Counts join back as a table of classes, so no class is one task's work."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    counts = labels.groupBy("quality").agg(F.count(F.lit(1)).alias("c"))
    return labels.join(counts, "quality").select("doc_id", "quality", F.round(1.0 / F.col("c"), 8).alias("weight"))


@query("SELECT label, vec_id, place FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS place FROM embeddings) WHERE place <= 5")
def top_k_per_class(spark, sf_dir):
    order = Window.partitionBy("label").orderBy(F.desc(F.col("embedding")[0]), "vec_id")
    return table(spark, sf_dir, "embeddings").select("label", "vec_id", F.row_number().over(order).cast("long").alias("place")).where("place <= 5")


SOFTMAX_SQL = f"{LOGITS_SQL}, sm AS (SELECT vec_id, label, c AS j, exp(z - lse) AS p FROM scored)"


def _softmax(spark, sf_dir):
    """vec_id, label, p (array) from the ten logits of each vector."""
    return logits(spark, sf_dir).select("vec_id", "label", F.expr("transform(z, x -> exp(x - lse))").alias("p"))


@query(f"WITH {SOFTMAX_SQL}, o AS (SELECT vec_id, j, p, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY p DESC, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sm) SELECT vec_id, j, round(p, 6) AS p FROM o WHERE before < 0.9")
def nucleus_mask(spark, sf_dir):
    """The least set of classes that holds nine tenths of the probability."""
    rows = _softmax(spark, sf_dir).select("vec_id", F.posexplode("p").alias("j", "p"))
    order = Window.partitionBy("vec_id").orderBy(F.desc("p"), "j").rowsBetween(Window.unboundedPreceding, -1)
    kept = rows.withColumn("before", F.coalesce(F.sum("p").over(order), F.lit(0.0))).where("before < 0.9")
    return kept.select("vec_id", F.col("j").cast("long").alias("j"), F.round("p", 6).alias("p"))


@query(f"WITH {SOFTMAX_SQL} SELECT label, count(*) AS n, round(avg(-ln(p)), 5) AS loss, round(avg(-ln(p)) / ln(2), 5) AS bpb, round(exp(avg(-ln(p))), 5) AS ppl FROM sm WHERE j = label GROUP BY label")
def softmax_logloss_bpb(spark, sf_dir):
    loss = F.avg(-F.log(F.get("p", F.col("label"))))
    return _softmax(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(loss, 5).alias("loss"), F.round(loss / math.log(2), 5).alias("bpb"), F.round(F.exp(loss), 5).alias("ppl"))


@query(f"WITH {SOFTMAX_SQL} SELECT label, round(sum(ln(p)), 4) AS log_prob, round(-avg(ln(p)), 5) AS mean_nll FROM sm WHERE j = (vec_id % 10) GROUP BY label")
def sequence_logprob(spark, sf_dir):
    """Log-probability of the true symbol, summed over each sequence (here a label's rows)."""
    gathered = F.log(F.get("p", (F.col("vec_id") % 10).cast("int")))
    return _softmax(spark, sf_dir).groupBy("label").agg(F.round(F.sum(gathered), 4).alias("log_prob"), F.round(-F.avg(gathered), 5).alias("mean_nll"))


@query(f"WITH {FLOAT_SQL}, m AS (SELECT n, avg(abs(x)) AS loss FROM wave GROUP BY n), t AS (SELECT max(n) + 1 AS len FROM m) SELECT round(avg(loss), 6) AS mean_loss, round(avg(loss) FILTER (n >= floor(len * 0.75)), 6) AS last_quarter, round(avg(loss) FILTER (n % 2 = 0), 6) AS even, round(avg(loss) FILTER (n % 2 = 1), 6) AS odd FROM m, t")
def per_position_loss_last_p(spark, sf_dir):
    means = wave_float(spark, sf_dir).groupBy("n").agg(F.avg(F.abs("x")).alias("loss"))
    rows = means.join(F.broadcast(means.agg((F.max("n") + 1).alias("len"))), F.lit(True))
    of = lambda c: F.round(F.avg(F.when(c, F.col("loss"))), 6)
    return rows.agg(of(F.lit(True)).alias("mean_loss"), of(F.col("n") >= F.floor(F.col("len") * 0.75)).alias("last_quarter"), of(F.col("n") % 2 == 0).alias("even"), of(F.col("n") % 2 == 1).alias("odd"))


@query(f"WITH {FLOAT_SQL}, q AS (SELECT track_id, x, least(greatest(CAST(floor((x + 1) / 2 * 65536) AS BIGINT), 0), 65535) AS q FROM wave), e AS (SELECT track_id, x - ((((q >> 8) << 8) | 128) / 32768.0 - 1) AS e FROM q) SELECT track_id, round(avg(e * e), 9) AS mse, round(avg(abs(e)), 7) AS mae, round(sqrt(avg(e * e)), 7) AS rmse FROM e GROUP BY track_id")
def dither_mse_mae(spark, sf_dir):
    """Errors when the low byte is lost and its middle taken."""
    q = quant.pcm_unsigned("x")
    back = quant.joined(quant.msb(q, 8), F.lit(128), 8) / F.lit(32768.0) - 1
    rows = wave_float(spark, sf_dir).select("track_id", (F.col("x") - back).alias("e"))
    square = F.avg(F.col("e") * F.col("e"))
    return rows.groupBy("track_id").agg(F.round(square, 9).alias("mse"), F.round(F.avg(F.abs("e")), 7).alias("mae"), F.round(F.sqrt(square), 7).alias("rmse"))


@query("WITH c AS (SELECT label, count(*) AS n, sum(CAST(embedding[1] > 0 AS INT)) AS hits FROM embeddings GROUP BY label), p AS (SELECT a.label AS a, b.label AS b, a.hits / a.n AS pa, b.hits / b.n AS pb, (a.hits + b.hits) / (a.n + b.n) AS p, a.n AS na, b.n AS nb FROM c a JOIN c b ON a.label < b.label) SELECT a, b, round(z, 5) AS z, coalesce(abs(z) > 1.96, FALSE) AS differs FROM (SELECT a, b, CASE WHEN p > 0 AND p < 1 THEN (pa - pb) / sqrt(p * (1 - p) * (1.0 / na + 1.0 / nb)) END AS z FROM p)")
def two_proportion_z(spark, sf_dir):
    """Each two labels' shares of positive components; the pairs are of labels, which are few."""
    c = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("embedding")[0] > 0).cast("int")).alias("h"))
    pairs = c.toDF("a", "na", "ha").join(c.toDF("b", "nb", "hb"), F.col("a") < F.col("b"))
    p = (F.col("ha") + F.col("hb")) / (F.col("na") + F.col("nb"))
    z = (F.col("ha") / F.col("na") - F.col("hb") / F.col("nb")) / F.sqrt(p * (1 - p) * (1.0 / F.col("na") + 1.0 / F.col("nb")))
    z = F.when((p > 0) & (p < 1), z)
    return pairs.select("a", "b", F.round(z, 5).alias("z"), F.coalesce(F.abs(z) > 1.96, F.lit(False)).alias("differs"))
