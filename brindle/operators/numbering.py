"""Numbers and neighbours of ordered rows for tracks of any length: no track is one task's work.

Numbering goes in two levels. Keys with more than `block` rows (at most one in `block` rows is such a key, so they are
broadcast) are cut into bins by their leading order column, bins are counted, and a row's number is the count of the
bins before its own and its place in it. All other keys are one bin. Neighbours go in blocks of numbers: the last rows
of a block stand in the next one too (its halo), so that lags and windows of bounded reach need one block only.

Defined results: rows that tie in all of order are numbered in any order; a null leading column comes first, as Spark
sorts it; null keys are a key, which isn't split; rows of a hot key that tie in the leading column are one bin.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

#: Rows of a key that one task sorts; longer keys are cut.
BLOCK = 1 << 20
#: Rows of a block that has a halo.
SPAN = 1 << 16


def numbered(rows: DataFrame, key: str, order: list[str], name: str = "n", block: int | None = None) -> DataFrame:
    """rows with name: the place (from 0) of each row within its key, in the order of the columns named."""
    block, lead = block or BLOCK, F.col(order[0]).cast("double")
    # lo and hi beside a key; bins of half a block on average
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"), F.min(lead).alias("_lo"), F.max(lead).alias("_hi")).where(F.col("_rows") > block)
    width = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    bins = F.ceil(F.col("_rows") * 2 / block)
    place = F.least(F.floor((lead - F.col("_lo")) / width * bins), bins - 1)
    spot = F.when(F.col("_rows").isNull(), 0).when(lead.isNull(), -1).otherwise(F.coalesce(place, F.lit(0))).cast("long")
    binned = rows.join(F.broadcast(hot), key, "left").withColumn("_bin", spot).drop("_lo", "_hi")
    before = Window.partitionBy(key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = binned.where("_rows is not null").groupBy(key, "_bin").agg(F.count(F.lit(1)).alias("_count"))
    bases = counts.select(key, "_bin", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy(key, "_bin").orderBy(*order)) - 1
    found = binned.withColumn("_within", within.cast("long")).join(bases, [key, "_bin"], "left")
    return found.withColumn(name, F.coalesce("_base", F.lit(0)) + F.col("_within")).select(*rows.columns, name)


def with_halo(rows: DataFrame, before: int, after: int = 0, n: str = "n", size: int = SPAN) -> DataFrame:
    """rows with block (n div size) and own: the last `before` rows of a block stand in the next one too, the first `after`
    rows in the one before, where own is false."""
    if max(before, after) > size:
        raise ValueError("a halo must not be longer than a block")
    here, at = F.expr(f"{n} div {size}"), F.col(n) % size
    nothing = F.array().cast("array<bigint>")
    beside = F.concat(F.when((at < after) & (here > 0), F.array(here - 1)).otherwise(nothing), F.array(here), F.when(at >= size - before, F.array(here + 1)).otherwise(nothing))
    return rows.withColumn("block", F.explode(beside)).withColumn("own", F.col("block") == here)


def with_neighbours(rows: DataFrame, columns: Callable[[WindowSpec], dict[str, Column]], before: int, after: int = 0, key: str = "track_id", n: str = "n", size: int | None = None) -> DataFrame:
    """rows with columns over windows of their key in order of n, which reach so many rows back and ahead at most."""
    spread = with_halo(rows, before, after, n, size or SPAN)
    found = columns(Window.partitionBy(key, "block").orderBy(n))
    return spread.withColumns(found).where("own").select(*rows.columns, *(c for c in found if c not in rows.columns))


def running_sum(rows: DataFrame, value: str, name: str, key: str = "track_id", n: str = "n", size: int | None = None) -> DataFrame:
    """rows with name: the sum of value over this row and those of its key before it, by blocks of n."""
    blocks = rows.withColumn("_block", F.expr(f"{n} div {size or SPAN}"))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.groupBy(key, "_block").agg(F.sum(value).alias("_sum")).select(key, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = F.sum(value).over(Window.partitionBy(key, "_block").orderBy(n).rowsBetween(Window.unboundedPreceding, 0))
    return blocks.withColumn("_within", within).join(bases, [key, "_block"]).select(*rows.columns, (F.col("_base") + F.col("_within")).alias(name))


def with_length(rows: DataFrame, name: str = "len", key: str = "track_id") -> DataFrame:
    """rows with name: how many rows their key has. Joined, so that adaptive execution can split the rows of one key."""
    return rows.join(rows.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key)
