"""Weighted draws over any number of items: cumulative weights in two levels, found by a join on cells of the total."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranges of items that are summed apart, and cells that the total is cut into.
RANGES, CELLS = 1024, 4096


def cumulative(weights: DataFrame, item: str = "item", weight: str = "weight", ranges: int = RANGES) -> DataFrame:
    """item, low, high of each item with a weight above 0: [low, high) is its share of the running sum in order of item.

    Items are cut into ranges by their value, ranges are summed, and items within each of them: the only window without a
    partition is over at most `ranges` sums.
    """
    rows = weights.where(F.col(weight) > 0)
    ends = rows.agg(F.min(F.col(item).cast("double")).alias("_lo"), F.max(F.col(item).cast("double")).alias("_hi"))
    place = F.coalesce(F.least(F.floor((F.col(item).cast("double") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * ranges), F.lit(ranges - 1)), F.lit(0))
    placed = rows.join(F.broadcast(ends), F.lit(True)).withColumn("_range", place.cast("int")).drop("_lo", "_hi")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("_range").agg(F.sum(weight).alias("_sum")).select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = F.sum(weight).over(Window.partitionBy("_range").orderBy(item).rowsBetween(Window.unboundedPreceding, 0))
    found = placed.withColumn("_upto", within).join(F.broadcast(bases), "_range")
    high = F.col("_base") + F.col("_upto")
    return found.select(item, (high - F.col(weight)).alias("low"), high.alias("high"))


def weighted_draws(slots: DataFrame, weights: DataFrame, spot: Callable[[Column], Column], item: str = "item", weight: str = "weight") -> DataFrame:
    """slots with the item that each draws: spot gives a whole number from 0 to the total weight (its argument) less one.

    The total is cut into cells of equal length. An item lies in the cells that its share touches, at most CELLS of them,
    and a slot in the cell of its number, so an equality of cells and a filter find each slot's item. Cells get about
    equal numbers of slots whatever the weights are. No items, or none with a weight: no draws.
    """
    edges = cumulative(weights, item, weight)
    total = weights.where(F.col(weight) > 0).agg(F.sum(weight).cast("long").alias("_total"))
    length = F.greatest(F.expr(f"_total div {CELLS}"), F.lit(1))
    sized = F.broadcast(total.withColumn("_length", length))
    cells = edges.join(sized, F.lit(True)).withColumn("_cell", F.explode(F.expr("sequence(low div _length, (high - 1) div _length)"))).select(item, "low", "high", "_cell")
    drawn = slots.join(sized, F.lit(True)).withColumn("_spot", spot(F.col("_total"))).withColumn("_cell", F.expr("_spot div _length"))
    found = drawn.join(cells, (drawn["_cell"] == cells["_cell"]) & (drawn["_spot"] >= cells["low"]) & (drawn["_spot"] < cells["high"]))
    return found.select(*slots.columns, item)
