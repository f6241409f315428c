"""Ranks and quantiles in two levels: bins of values first, then the rows of single bins, so that no group is one task's work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BINS = 4096


def ranked_values(counts: DataFrame, key: str, value: str, n: str) -> DataFrame:
    """counts (one row a key and value, n rows of it) with `below`: the rows of its key with lesser values."""
    ends = counts.groupBy(key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0))
    binned = counts.join(ends, key).withColumn("_bin", F.coalesce(F.least(F.floor((F.col(value) - F.col("_lo")) / width * BINS), F.lit(BINS - 1)), F.lit(0))).drop("_lo", "_hi")
    before = Window.partitionBy(key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = binned.groupBy(key, "_bin").agg(F.sum(n).alias("_n")).select(key, "_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(key, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = binned.withColumn("_within", F.coalesce(F.sum(n).over(within), F.lit(0))).join(bins, [key, "_bin"])
    return rows.withColumn("below", F.col("_base") + F.col("_within")).drop("_bin", "_within", "_base")


def quantiles(rows: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """key and a column for each share: the exact quantile, between two values in proportion. Null values don't count."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_c"))  # its exchange is reused
    totals = counts.groupBy(key).agg(F.sum("_c").alias("_total"))
    at = ranked_values(counts, key, value, "_c").join(totals, key)
    spot = lambda q: q * (F.col("_total") - 1)
    holds = lambda k: (F.col("below") <= k) & (k < F.col("below") + F.col("_c"))
    picked = [F.max(F.when(holds(f(spot(q))), F.col(value))).alias(f"{name}_{i}") for name, q in shares.items() for i, f in enumerate((F.floor, F.ceil))]
    found = at.groupBy(key).agg(F.first("_total").alias("_total"), *picked)
    between = lambda name, q: F.col(f"{name}_0") + (spot(q) - F.floor(spot(q))) * (F.col(f"{name}_1") - F.col(f"{name}_0"))
    return found.select(key, *(between(name, q).alias(name) for name, q in shares.items()))
