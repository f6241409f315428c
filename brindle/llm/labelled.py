"""Labelled rows for the classifiers: folds by a checksum of the id, and a bounded sample to fit on."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """The CRC-32 of the id as text, modulo folds; null ids are in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)), F.lit(0))


def fit_sample(docs: DataFrame, labels: DataFrame, label_col: str, train: Column, per_class: int, id_col: str = "doc_id", text_col: str = "text", classes: Iterable[int] = (0, 1)) -> DataFrame:
    """text, y of at most per_class labelled training rows a class: those whose ids hash lowest, so reruns agree.

    The bound makes the ids small enough to broadcast, so only the sample's texts are shuffled. Of several rows under
    one id the least text counts, so that the bound holds for rows as well; an id labelled both ways is in both classes. Rows with a null or other label, and
    labels of ids that aren't in docs, are left out; a label that is there twice counts once.
    """
    named = labels.where(train).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).distinct()
    order = (F.xxhash64("id", F.lit(7)), F.col("id"))
    chosen = reduce(DataFrame.union, (named.where(F.col("y") == c).orderBy(*order).limit(per_class) for c in classes))
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    return found.groupBy("id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("text", "y")
