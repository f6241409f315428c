"""Queries on byte chunks of texts: shifts, masks, entropies and chunked evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.entropy import RICE_K_SQL, bytes_of, rice_k
from ..sources.views import BYTES_SQL, byte_chunks, byte_counts, byte_pairs
from .registry import query


@query(f"WITH {BYTES_SQL} SELECT doc_id, chunk, count(*) AS bytes, CAST(sum(b >> 1) AS BIGINT) AS shifted_sum, CAST(sum(b & 1) AS BIGINT) AS lsb_count, bool_and((((b >> 1) << 1) | (b & 1)) = b) AS restored FROM bytes GROUP BY ALL")
def byte_shift_lsb(spark, sf_dir):
    b, c, half, low = F.col("b"), F.col("c"), F.shiftright("b", 1), F.col("b").bitwiseAND(1)
    return byte_counts(byte_chunks(spark, sf_dir)).groupBy("doc_id", "chunk").agg(F.sum("c").alias("bytes"), F.sum(half * c).alias("shifted_sum"), F.sum(low * c).alias("lsb_count"), F.bool_and(F.shiftleft(half, 1).bitwiseOR(low) == b).alias("restored"))


@query(f"WITH {BYTES_SQL} SELECT doc_id, chunk, CAST(sum(b & 127) AS BIGINT) AS masked_sum, count(*) FILTER (b > 127) AS missed_bits, round(8 * count(*) / (8 * count(*) - count(*) FILTER (b > 127)), 6) AS rescale FROM bytes GROUP BY ALL")
def ascii_mask(spark, sf_dir):
    b, c = F.col("b"), F.col("c")
    missed, bits = F.sum(F.when(b > 127, c).otherwise(0)), 8 * F.sum(c)
    return byte_counts(byte_chunks(spark, sf_dir)).groupBy("doc_id", "chunk").agg(F.sum(b.bitwiseAND(127) * c).alias("masked_sum"), missed.alias("missed_bits"), F.round(bits / (bits - missed), 6).alias("rescale"))


@query(f"WITH {BYTES_SQL}, c AS (SELECT doc_id, b, count(*) AS c FROM bytes GROUP BY ALL), t AS (SELECT *, sum(c) OVER (PARTITION BY doc_id) AS n FROM c) SELECT doc_id, CAST(any_value(n) AS BIGINT) AS bytes, count(*) AS distinct_bytes, round(-sum(c * log2(c / n)) / any_value(n), 5) AS entropy_bits FROM t GROUP BY doc_id")
def byte_entropy_order0(spark, sf_dir):
    counts = byte_counts(byte_chunks(spark, sf_dir)).groupBy("doc_id", "b").agg(F.sum("c").alias("c"))
    rows = counts.withColumn("n", F.sum("c").over(Window.partitionBy("doc_id")))
    return rows.groupBy("doc_id").agg(F.first("n").alias("bytes"), F.count(F.lit(1)).alias("distinct_bytes"), F.round(-F.sum(F.col("c") * F.log2(F.col("c") / F.col("n"))) / F.first("n"), 5).alias("entropy_bits"))


@query(f"""WITH {BYTES_SQL}, l AS (SELECT lag(b) OVER (PARTITION BY doc_id, chunk ORDER BY pos) AS a, b FROM bytes), p AS (SELECT a, b, count(*) AS c FROM l WHERE a IS NOT NULL GROUP BY ALL), s AS (SELECT *, sum(c) OVER (PARTITION BY a) AS n, count(*) OVER (PARTITION BY a) AS followers FROM p)
    SELECT a, CAST(any_value(n) AS BIGINT) AS n, any_value(followers) AS followers, round(-sum(c * log2((c + 1) / (n + 256))) / any_value(n), 5) AS bits_per_byte FROM s GROUP BY a""")
def byte_codelength_order1(spark, sf_dir):
    """Ideal code lengths of bytes given the byte before, with add-one smoothing; at most 65,536 counts after the map side."""
    pairs = byte_pairs(byte_chunks(spark, sf_dir)).groupBy("a", "b").agg(F.sum("c").alias("c"))
    after = Window.partitionBy("a")
    rows = pairs.withColumn("n", F.sum("c").over(after)).withColumn("followers", F.count(F.lit(1)).over(after))
    return rows.groupBy("a").agg(F.first("n").alias("n"), F.first("followers").alias("followers"), F.round(-F.sum(F.col("c") * F.log2((F.col("c") + 1) / (F.col("n") + 256))) / F.first("n"), 5).alias("bits_per_byte"))


@query(f"WITH {BYTES_SQL}, c AS (SELECT doc_id, chunk, count(*) AS bytes FROM bytes WHERE chunk < 10 GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY doc_id, chunk) AS place FROM c) SELECT doc_id, chunk, bytes, place FROM r WHERE place <= 500")
def chunk_cap_per_track(spark, sf_dir):
    """Ten chunks a track and 500 in all: the caps are the operator."""
    chunks = byte_chunks(spark, sf_dir).where("chunk < 10").select("doc_id", "chunk", F.octet_length("body").cast("long").alias("bytes"))
    top = chunks.orderBy("doc_id", "chunk").limit(500)
    return top.withColumn("place", F.row_number().over(Window.orderBy("doc_id", "chunk")).cast("long"))


@query(f"""WITH {BYTES_SQL}, m AS (SELECT doc_id, chunk, count(*) AS raw, avg(b) AS mean FROM bytes GROUP BY ALL), k AS (SELECT *, {RICE_K_SQL} AS k FROM m), c AS (SELECT doc_id, chunk, any_value(raw) AS raw, 18 + CAST(ceil(sum((b >> k) + 1 + k) / 8.0) AS BIGINT) AS comp FROM bytes JOIN k USING (doc_id, chunk) GROUP BY doc_id, chunk),
    d AS (SELECT doc_id, count(*) AS chunks, sum(raw) AS raw, sum(comp) AS comp FROM c GROUP BY ALL) SELECT doc_id, chunks, CAST(raw AS BIGINT) AS raw, CAST(comp - 18 * (chunks - 1) AS BIGINT) AS corrected, round(raw / (comp - 18 * (chunks - 1)), 6) AS rate FROM d""")
def header_once_rate(spark, sf_dir):
    """Chunks coded one by one (their exact Rice size behind an 18-byte header), the header counted once a track."""
    counts = byte_counts(byte_chunks(spark, sf_dir))
    of = Window.partitionBy("doc_id", "chunk")
    rows = counts.withColumn("raw", F.sum("c").over(of)).withColumn("k", rice_k(F.sum(F.col("b") * F.col("c")).over(of) / F.col("raw")))
    coded = rows.groupBy("doc_id", "chunk").agg(F.first("raw").alias("raw"), F.sum((F.expr("shiftright(b, cast(k as int))") + 1 + F.col("k")) * F.col("c")).alias("bits"))
    chunks = coded.select("doc_id", "raw", (18 + bytes_of(F.col("bits"))).alias("comp"))
    docs = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("raw").alias("raw"), F.sum("comp").alias("comp"))
    corrected = F.col("comp") - 18 * (F.col("chunks") - 1)
    return docs.select("doc_id", "chunks", "raw", corrected.alias("corrected"), F.round(F.col("raw") / corrected, 6).alias("rate"))
