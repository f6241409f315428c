"""Queries on mixtures of discretised logistics and on Student's t: code lengths and samples of tracks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.likelihood import logistic_mixture_nll, logistic_mixture_sample, student_t_nll, student_t_sample, uniform
from ..operators.numbering import with_neighbours
from ..sources.views import FLOAT_SQL, MONO_SQL, wave_float, wave_mono
from .registry import query

LEVELS = 256
#: Three predictors: the sample before, the mean of two, the line through two; their weights and scales follow the track.
_LEVEL = "least(greatest(CAST(floor((x + 1) / 2 * 255 + 0.5) AS BIGINT), 0), 255)"
_MIXTURE = f"""{FLOAT_SQL}, q AS (SELECT track_id, n, {_LEVEL} AS q, x FROM wave), g AS (SELECT track_id, n, q, coalesce(lag(x, 1) OVER w, 0) AS p1, coalesce(lag(x, 2) OVER w, 0) AS p2 FROM q WINDOW w AS (PARTITION BY track_id ORDER BY n)),
    m AS (SELECT track_id, n, q, unnest([1, 2, 3]) AS i, unnest([p1, (p1 + p2) / 2, 2 * p1 - p2]) AS mean, unnest([0.5::DOUBLE, (track_id % 3) / 2, -1::DOUBLE]) AS logit, unnest([0.05::DOUBLE, 0.02 + abs(p1 - p2) / 4, 0.2::DOUBLE]) AS scale FROM g)"""
_SOFTPLUS = "(greatest({0}, 0) + ln(1 + exp(-abs({0}))))"


def _mixture(spark, sf_dir) -> tuple[DataFrame, list, list, list]:
    x = F.col("x")
    level = F.least(F.greatest(F.floor((x + 1) / 2 * (LEVELS - 1) + 0.5).cast("long"), F.lit(0)), F.lit(LEVELS - 1))
    rows = with_neighbours(wave_float(spark, sf_dir), lambda w: {"q": level, "p1": F.lag("x", 1, 0.0).over(w), "p2": F.lag("x", 2, 0.0).over(w)}, 2)
    p1, p2 = F.col("p1"), F.col("p2")
    return rows, [F.lit(0.5), F.col("track_id") % 3 / 2, F.lit(-1.0)], [p1, (p1 + p2) / 2, 2 * p1 - p2], [F.lit(0.05), 0.02 + F.abs(p1 - p2) / 4, F.lit(0.2)]


@query(f"""WITH {_MIXTURE}, b AS (SELECT *, (q / 127.5 - 1 - mean + 1 / 255) / scale AS high, (q / 127.5 - 1 - mean - 1 / 255) / scale AS low FROM m),
    t AS (SELECT track_id, n, logit, logit + CASE q WHEN 0 THEN -{_SOFTPLUS.format('(-high)')} WHEN 255 THEN -{_SOFTPLUS.format('low')} ELSE -{_SOFTPLUS.format('(-high)')} - {_SOFTPLUS.format('low')} + ln(1 - exp(low - high)) END AS term FROM b),
    s AS (SELECT track_id, n, max(term) AS most, max(logit) AS top, list(term) AS terms, list(logit) AS logits FROM t GROUP BY ALL),
    l AS (SELECT track_id, top + ln(list_sum(list_transform(logits, lambda v: exp(v - top)))) - most - ln(list_sum(list_transform(terms, lambda v: exp(v - most)))) AS nll FROM s)
    SELECT track_id, count(*) AS samples, round(avg(nll), 6) AS nll, round(avg(nll) / ln(2), 6) AS bits FROM l GROUP BY track_id""")
def logistic_mixture(spark, sf_dir):
    """The code length of each track's samples (256 levels) under a mixture of three logistics about what came before."""
    rows, logits, means, scales = _mixture(spark, sf_dir)
    nll = rows.select("track_id", logistic_mixture_nll(F.col("q"), LEVELS, logits, means, scales).alias("nll"))
    return nll.groupBy("track_id").agg(F.count(F.lit(1)).alias("samples"), F.round(F.avg("nll"), 6).alias("nll"), F.round(F.avg("nll") / math.log(2), 6).alias("bits"))


_U = "((CAST('0x' || substr(md5(concat_ws(':', track_id, n, '{0}')), 1, 12) AS BIGINT) + 0.5) / 281474976710656)"


@query(f"""WITH {_MIXTURE}, u AS (SELECT *, {_U.format('component')} AS c, {_U.format('place')} AS p, max(logit) OVER t AS top FROM m WINDOW t AS (PARTITION BY track_id, n)), e AS (SELECT *, sum(exp(logit - top)) OVER (PARTITION BY track_id, n ORDER BY i) / sum(exp(logit - top)) OVER (PARTITION BY track_id, n) AS upto FROM u),
    d AS (SELECT track_id, n, any_value(q) AS q, arg_min(mean + scale * (ln(p) - ln(1 - p)), i) FILTER (c < upto OR i = 3) AS drawn FROM e GROUP BY ALL), l AS (SELECT track_id, n, q, least(greatest(CAST(floor((drawn + 1) / 2 * 255 + 0.5) AS BIGINT), 0), 255) AS level FROM d)
    SELECT track_id, CAST(sum(level) AS BIGINT) AS total, CAST(sum(abs(level - q)) AS BIGINT) AS apart, min(level) AS lowest, max(level) AS highest FROM l GROUP BY track_id""")
def logistic_mixture_draws(spark, sf_dir):
    """A level drawn for each sample from its mixture, by hashes of its track and place; how they lie about the samples."""
    rows, logits, means, scales = _mixture(spark, sf_dir)
    level = logistic_mixture_sample(uniform("track_id", "n", F.lit("component")), uniform("track_id", "n", F.lit("place")), LEVELS, logits, means, scales)
    drawn = rows.select("track_id", "q", level.alias("level"))
    return drawn.groupBy("track_id").agg(F.sum("level").alias("total"), F.sum(F.abs(F.col("level") - F.col("q"))).alias("apart"), F.min("level").alias("lowest"), F.max("level").alias("highest"))


_STUDENT = f"{MONO_SQL}, p AS (SELECT track_id, n, x / 1000.0::DOUBLE AS x, lag(x, 1, 0) OVER w / 1000.0::DOUBLE AS mean, 1 + abs(lag(x, 2, 0) OVER w) / 10000.0::DOUBLE AS scale, 1.5::DOUBLE + track_id % 5 AS v FROM wave WINDOW w AS (PARTITION BY track_id ORDER BY n))"


def _student(spark, sf_dir) -> DataFrame:
    near = with_neighbours(wave_mono(spark, sf_dir), lambda w: {"mean": F.lag("x", 1, 0).over(w) / 1000, "scale": 1 + F.abs(F.lag("x", 2, 0).over(w)) / 10000}, 2)
    return near.select("track_id", "n", (F.col("x") / 1000).alias("x"), "mean", "scale", (1.5 + F.col("track_id") % 5).alias("v"))


@query(f"WITH {_STUDENT} SELECT track_id, count(*) AS samples, round(avg(lgamma(v / 2) - lgamma((v + 1) / 2) + 0.5 * ln(v * pi()) + ln(scale) + (v + 1) / 2 * ln(1 + pow((x - mean) / scale, 2) / v)), 6) AS nll FROM p GROUP BY track_id")
def student_t(spark, sf_dir):
    """The negative log-likelihood of each track under Student's t about the sample before."""
    nll = student_t_nll(F.col("x"), F.col("mean"), F.col("scale"), F.col("v"))
    return _student(spark, sf_dir).groupBy("track_id").agg(F.count(F.lit(1)).alias("samples"), F.round(F.avg(nll), 6).alias("nll"))


@query(f"WITH {_STUDENT}, d AS (SELECT track_id, x, mean + scale * sqrt(v * (pow({_U.format('radius')}, -2 / v) - 1)) * cos(2 * pi() * {_U.format('angle')}) AS y FROM p) SELECT track_id, round(median(y), 4) AS middle, count(*) FILTER (y < x) AS below, count(*) AS samples FROM d GROUP BY track_id")
def student_t_draws(spark, sf_dir):
    """A value drawn for each sample from its Student's t; their median and how many lie below the sample itself."""
    drawn = student_t_sample(uniform("track_id", "n", F.lit("radius")), uniform("track_id", "n", F.lit("angle")), F.col("mean"), F.col("scale"), F.col("v"))
    rows = _student(spark, sf_dir).withColumn("y", drawn)
    return rows.groupBy("track_id").agg(F.round(F.percentile("y", 0.5), 4).alias("middle"), F.count_if(F.col("y") < F.col("x")).alias("below"), F.count(F.lit(1)).alias("samples"))
