"""Waveforms, byte chunks and result tables read from the given tables, and the same views as SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from ..session import ship

STEREO_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_shipdate")
CHUNK_BYTES = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wave_mono(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track_id, n, x: integer samples of one channel; a track a user, in order of time."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("track_id"), "ts", "event_id", F.round(F.col("value") * 100).cast("long").alias("x"))
    seconds = F.datediff("ts", F.lit("1970-01-01")) * 86_400 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")  # in any time zone
    return numbered(rows.withColumn("at", seconds), "track_id", ["at", "ts", "event_id"]).select("track_id", "n", "x")


def wave_stereo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track_id, n, l, r: integer samples of two channels; a track a supplier."""
    items = numbered(table(spark, sf_dir, "lineitem").select("l_suppkey", *STEREO_ORDER), "l_suppkey", [*STEREO_ORDER])
    return items.select(F.col("l_suppkey").alias("track_id"), "n", F.round("l_extendedprice").cast("long").alias("l"), F.round(F.col("l_quantity") * 1000).cast("long").alias("r"))


def wave_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track_id, n, x: samples in [-1, 1)."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("track_id"), F.posexplode("embedding").alias("n", "x"))
    return rows.select("track_id", F.col("n").cast("long").alias("n"), F.col("x").cast("double").alias("x"))


def byte_chunks(spark: SparkSession, sf_dir: str, size: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, chunk, body: the UTF-8 bytes of whole texts, cut into chunks; the last of a text may be short."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "utf-8").alias("bytes")).where(F.octet_length("bytes") > 0)
    cut = docs.select("doc_id", "bytes", F.explode(F.expr(f"sequence(0, (octet_length(bytes) - 1) div {size})")).alias("chunk"))
    return cut.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.expr(f"substring(bytes, chunk * {size} + 1, {size})").alias("body"))


def byte_counts(chunks: DataFrame) -> DataFrame:
    """doc_id, chunk, b, c: how often each byte value occurs in each chunk; counted in Arrow batches, at most 256 rows a chunk."""
    ship(chunks.sparkSession)

    def of(batches):
        for batch in batches:
            doc, chunk, b, c = [], [], [], []
            for i, k, body in zip(*(column.to_pylist() for column in batch.columns)):
                counts = np.bincount(np.frombuffer(body, np.uint8), minlength=256)
                found = np.flatnonzero(counts)
                doc.append(np.full(len(found), i))
                chunk.append(np.full(len(found), k))
                b.append(found)
                c.append(counts[found])
            if doc:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (doc, chunk, b, c)], names=["doc_id", "chunk", "b", "c"])

    return chunks.select("doc_id", "chunk", "body").mapInArrow(of, "doc_id long, chunk long, b long, c long")


def byte_pairs(chunks: DataFrame) -> DataFrame:
    """a, b, c: how often byte b follows byte a within chunks; a row a pair and Arrow batch at most."""
    ship(chunks.sparkSession)

    def of(batches):
        for batch in batches:
            counts = np.zeros(1 << 16, np.int64)
            for body in batch.column(0).to_pylist():
                x = np.frombuffer(body, np.uint8).astype(np.int64)
                np.add.at(counts, x[:-1] << 8 | x[1:], 1)
            found = np.flatnonzero(counts)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (found >> 8, found & 255, counts[found])], names=["a", "b", "c"])

    return chunks.select("body").mapInArrow(of, "a long, b long, c long")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, dataset, domain, priority, status, ts, rate: a result table, a row a run. The dimensions have 25 and 5 rows."""
    nations = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    found = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return found.select(F.col("o_orderkey").alias("run_id"), F.col("n_name").alias("dataset"), F.col("r_name").alias("domain"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("rate"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, step, t (days), v: the metric history of each run."""
    t = F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")).cast("long")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), t.alias("t"), "o_orderdate", "o_orderkey", F.col("o_totalprice").alias("v"))
    return numbered(rows, "run_id", ["t", "o_orderdate", "o_orderkey"], "step").select("run_id", "step", "t", "v")


MONO_SQL = "wave AS (SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, CAST(round(value * 100) AS BIGINT) AS x FROM events)"
STEREO_SQL = f"wave AS (SELECT l_suppkey AS track_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY {', '.join(STEREO_ORDER)}) - 1 AS n, CAST(round(l_extendedprice) AS BIGINT) AS l, CAST(round(l_quantity * 1000) AS BIGINT) AS r FROM lineitem)"
FLOAT_SQL = "wave AS (SELECT vec_id AS track_id, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS n, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"
BYTES_SQL = f"hexed AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE length(text) > 0), spread AS (SELECT doc_id, h, unnest(range(CAST(length(h) / 2 AS BIGINT))) AS idx FROM hexed), bytes AS (SELECT doc_id, idx // {CHUNK_BYTES} AS chunk, idx % {CHUNK_BYTES} AS pos, CAST('0x' || substr(h, 2 * idx + 1, 2) AS BIGINT) AS b FROM spread)"
RUNS_SQL = "runs AS (SELECT o_orderkey AS run_id, n_name AS dataset, r_name AS domain, o_orderpriority AS priority, o_orderstatus AS status, o_orderdate AS ts, o_totalprice AS rate FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
HISTORY_SQL = "history AS (SELECT o_custkey AS run_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS step, datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS t, o_totalprice AS v FROM orders)"
