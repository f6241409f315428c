"""Event-time windows over streams of events, written in append mode as they close."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import fresh_path, ship

LATE = "1 hour"


def _events(stream: DataFrame, late: str = LATE) -> DataFrame:
    cents = F.round(F.col("value") * 100).cast("long")
    return stream.select(F.col("ts").cast("timestamp").alias("ts"), "event_id", "user_id", "event_type", cents.alias("cents")).withWatermark("ts", late)


def windowed(stream: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """start, event_type, n, cents of each window. A window is written once the watermark has passed its end; rows that
    come later than that are left out, and state is kept for open windows alone."""
    sums = _events(stream).groupBy(F.window("ts", size, slide), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))
    return sums.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "cents")


def sessions(stream: DataFrame, gap: str) -> DataFrame:
    """user_id, start, n, cents of each session: a user's events, each less than gap after the one before."""
    sums = _events(stream).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))
    return sums.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n", "cents")


def carried(stream: DataFrame, size: int) -> DataFrame:
    """user_id, seen, resets, total: each user's running state over micro-batches. The sum starts anew (a reset) after every
    size events; state is three numbers a user, whatever the user's share of all events."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, resets, total = state.get if state.exists else (0, 0, 0)
        for rows in batches:
            n = len(rows)
            resets += (seen + n) // size - seen // size
            seen += n
            total += int(rows["cents"].sum())
        state.update((seen, resets, total))
        yield pd.DataFrame({"user_id": [key[0]], "seen": [seen], "resets": [resets], "total": [total]})

    ship(stream.sparkSession)
    schema = "seen long, resets long, total long"
    return _events(stream).groupBy("user_id").applyInPandasWithState(step, f"user_id long, {schema}", schema, "update", GroupStateTimeout.NoTimeout)


def stream_of(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A stream over the files of a table, which may be one file or a folder of them; so many files a batch."""
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    if all(f.rstrip("/").endswith(path.rsplit("/", 1)[1]) for f in table.inputFiles()):
        folder, name = path.rsplit("/", 1)
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def run_to_end(stream: DataFrame, name: str, folder: str | None = None) -> str:
    """Runs a stream as far as its input goes, appending to files; started again on the same folder it goes on from its
    checkpoint, and what it has written stays. Gives the folder of rows."""
    folder = folder or fresh_path(stream.sparkSession, name)
    run = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return f"{folder}/rows"


def latest_state(stream: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key that an updating stream gives, run as far as its input goes."""
    out = fresh_path(stream.sparkSession, "state")
    run = stream.writeStream.outputMode("update").foreachBatch(lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/rows/part={number}"))
    run.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = stream.sparkSession.read.parquet(f"{out}/rows").drop("part", "batch")
    return rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != key)), order).alias("s")).select(key, "s.*")
