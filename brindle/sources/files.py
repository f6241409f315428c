"""Text files as sources and sinks: appended CSV, delimited and headerless scans, JSON lines, time-series text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NULL = "NA"


def append_csv(df: DataFrame, path: str) -> None:
    """Appends rows to a CSV table with a header and nulls written as NA; the table is made where there is none."""
    df.write.mode("append").option("header", True).option("nullValue", NULL).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    """A delimited table by its schema; only the columns that a query selects are parsed. NA is null."""
    return spark.read.schema(schema).option("header", header).option("sep", sep).option("nullValue", NULL).option("enforceSchema", True).csv(path)


def union_of_globs(spark: SparkSession, root: str, schema: str, *globs: str) -> DataFrame:
    """Rows of all Parquet files below root that match one of several globs."""
    return spark.read.schema(schema).parquet(*(f"{root}/{g}" for g in globs))


def files_below(spark: SparkSession, root: str, pattern: str, but_not_in: str) -> DataFrame:
    """path of the files below root, at any depth, whose name matches and whose folder isn't the one named."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path")
    return found.where(F.element_at(F.split("path", "/"), -2) != but_not_in)


def to_ts_lines(rows: DataFrame, values: str, label: str) -> DataFrame:
    """value: a line of time-series text for each row: its values by commas, ? for null, and its label after a colon."""
    return rows.select(F.concat_ws(":", F.array_join(F.transform(values, lambda x: F.coalesce(x.cast("string"), F.lit("?"))), ","), label).alias("value"))


def read_ts(spark: SparkSession, path: str, missing: str = "0") -> DataFrame:
    """label, values (longs, missing ones replaced), n_missing of each data line; lines of tags and comments are skipped."""
    lines = spark.read.text(path).where("value <> '' and not startswith(value, '@') and not startswith(value, '#')")
    parts = lines.select(F.split(F.substring_index("value", ":", 1), ",").alias("v"), F.substring_index("value", ":", -1).alias("label"))
    values = F.transform("v", lambda x: F.when(x == "?", missing).otherwise(x).cast("long"))
    return parts.select("label", values.alias("values"), F.size(F.filter("v", lambda x: x == "?")).alias("n_missing"))


def write_chunks(rows: DataFrame, path: str, chunk: str) -> None:
    """JSON lines in a folder for each chunk; Spark's commit leaves _SUCCESS when all are there."""
    rows.write.partitionBy(chunk).json(path)
