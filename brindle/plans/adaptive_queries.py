"""Queries on adaptive models: what documents take when each byte is coded with the counts so far."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.adaptive import text_code_lengths
from ..sources.views import BYTES_SQL, table
from .registry import query

COUNTS_SQL = f"""{BYTES_SQL}, b AS (SELECT doc_id, idx AS n, CAST('0x' || substr(h, 2 * idx + 1, 2) AS BIGINT) AS b FROM spread), c AS (SELECT *, lag(b, 1) OVER w AS b1, lag(b, 2) OVER w AS b2 FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
    k AS (SELECT doc_id, n, b, row_number() OVER (PARTITION BY doc_id, b ORDER BY n) - 1 AS c0, row_number() OVER (PARTITION BY doc_id, b1, b ORDER BY n) - 1 AS c1, row_number() OVER (PARTITION BY doc_id, b2, b1, b ORDER BY n) - 1 AS c2,
          row_number() OVER (PARTITION BY doc_id, b1 ORDER BY n) - 1 AS u1, row_number() OVER (PARTITION BY doc_id, b2, b1 ORDER BY n) - 1 AS u2 FROM c),
    o0 AS (SELECT *, CASE WHEN c0 > 0 THEN -log2(c0 / (n + 1)) ELSE -log2(1 / (n + 1)) + 8 END AS o0 FROM k),
    o1 AS (SELECT *, CASE WHEN n < 1 THEN o0 WHEN c1 > 0 THEN -log2(c1 / (u1 + 1)) ELSE -log2(1 / (u1 + 1)) + o0 END AS o1 FROM o0),
    l AS (SELECT *, CASE WHEN n < 2 THEN o1 WHEN c2 > 0 THEN -log2(c2 / (u2 + 1)) ELSE -log2(1 / (u2 + 1)) + o1 END AS bits FROM o1)"""


@query(f"WITH {COUNTS_SQL}, d AS (SELECT doc_id, count(*) AS bytes, round(avg(bits), 5) AS bits_per_byte, count(*) FILTER (n < 2 OR c2 = 0) AS escapes FROM l GROUP BY doc_id) SELECT documents.doc_id, coalesce(bytes, 0) AS bytes, bits_per_byte, coalesce(escapes, 0) AS escapes FROM documents LEFT JOIN d USING (doc_id)")
def adaptive_code_length(spark, sf_dir):
    """Bits a byte of whole documents under an adaptive model of order 2 that backs off; null for texts without bytes."""
    lengths = text_code_lengths(table(spark, sf_dir, "documents"), "doc_id", "text").groupBy("doc_id")
    sums = lengths.agg(F.sum("bytes").alias("bytes"), F.round(F.sum("bits") / F.sum("bytes"), 5).alias("bits_per_byte"), F.sum("escapes").alias("escapes"))
    docs = table(spark, sf_dir, "documents").select("doc_id").join(sums, "doc_id", "left")
    return docs.select("doc_id", F.coalesce("bytes", F.lit(0)).alias("bytes"), "bits_per_byte", F.coalesce("escapes", F.lit(0)).alias("escapes"))


@query(f"WITH {COUNTS_SQL} SELECT CAST(floor(log2(n + 1)) AS BIGINT) AS octave, count(*) AS bytes, round(avg(bits), 5) AS bits_per_byte, round(avg(o0), 5) AS bits_order0 FROM l GROUP BY octave")
def adaptive_learning_curve(spark, sf_dir):
    """Bits a byte by how far into a document it stands (in doublings), beside those of counts without a context."""
    mean = lambda bits, name: F.round(F.sum(bits) / F.sum("bytes"), 5).alias(name)
    lengths = text_code_lengths(table(spark, sf_dir, "documents"), "doc_id", "text")
    return lengths.groupBy("octave").agg(F.sum("bytes").alias("bytes"), mean("bits", "bits_per_byte"), mean("bits_order0", "bits_order0"))
