"""Helpers that the training-data operators share: staged tables, files and ASCII text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_at_end, fresh_path, ship

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: White space as the contracts have it: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def staged(df: DataFrame, name: str, path: str | None = None, compression: str | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, which cuts its lineage and outlives lost executors.

    The table goes when unstage is called on it, or else when the application ends.
    """
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    df.write.parquet(path, compression=compression)
    drop_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(*tables: DataFrame) -> None:
    """Removes staged tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A key is hot if it has more than this share of all rows; so there are fewer hot keys than its inverse.
HOT_SHARE = 1 / 4096


#: Narrow rows (ids and numbers) to a task, and the tasks that even a small table is dealt to.
TASK_ROWS, LEAST_TASKS = 1 << 17, 12


def tasks_for(rows: int) -> int:
    """Tasks for a table of so many narrow rows. Each has a bounded share; a small table isn't cut into as many tasks as
    the session's shuffles have partitions, each of which would take longer to start than to work."""
    return max(LEAST_TASKS, -(-rows // TASK_ROWS))


def hot_join(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int, tasks: int | None = None) -> DataFrame:
    """rows joined with groups on key, whatever the share of one key in rows. groups: one row a key, its count of rows.

    Keys with more than HOT_SHARE of all total rows are fewer than 4,096, so their groups (which must be narrow) are
    broadcast and their rows stay where they are; the other rows are shuffled by key, none of which is hot. With tasks,
    no more tasks than that read a shuffle of the join.
    """
    most = 1 << int(total * HOT_SHARE).bit_length()  # of few values, so that generated code is shared
    hot, cold = groups.where(F.col(count) > most), groups.where(F.col(count) <= most)
    if tasks:
        # the merge hint keeps the groups in the partitions that they are counted in, which the join then reads together
        hot, cold = hot.coalesce(tasks), cold.hint("merge")
        rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
        return rest.join(cold, key).coalesce(tasks).unionByName(rows.join(F.broadcast(hot), key))
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rest.join(cold, key).unionByName(rows.join(F.broadcast(hot), key))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. lower() does just that to texts of ASCII alone, and does it faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def parts_of(batch: pa.RecordBatch, part_bytes: int, column: int = 1):
    """Runs of rows of about part_bytes of text, or single longer ones, so that a task's memory doesn't depend on lengths."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(sizes) - sizes) // part_bytes
    starts = np.flatnonzero(np.diff(group, prepend=-1)).tolist()
    for at, end in zip(starts, [*starts[1:], len(batch)]):
        yield batch.slice(at, end - at)


def open_output(uri: str):
    """A writable stream for a URI of any file system that Arrow knows, from within a task."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def open_input(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)
