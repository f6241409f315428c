"""Queries through a user's own table function and aggregate."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators.mergeable import aggregated
from ..operators.table_functions import register
from ..sources.views import BYTES_SQL, CHUNK_BYTES, table
from .registry import query


@query(f"WITH {BYTES_SQL} SELECT doc_id, chunk, count(*) AS bytes, CAST(sum(b * (pos + 1)) AS BIGINT) AS checksum FROM bytes GROUP BY ALL")
def frames_by_table_function(spark, sf_dir):
    """Whole documents cut into frames by a table function called from SQL, partitioned by document."""
    register(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = spark.sql(f"SELECT * FROM byte_frames(TABLE(SELECT doc_id, text FROM {{docs}}) PARTITION BY (doc_id), {CHUNK_BYTES})", docs=docs)
    return found.select(F.col("key").alias("doc_id"), F.col("frame").alias("chunk"), "bytes", "checksum")


_TURNS = "t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS row, coalesce(text, '') AS text FROM conversations), h AS (SELECT conv_id, row, hex(encode(text)) AS h FROM t), s AS (SELECT conv_id, row, h, unnest(range(CAST(length(h) / 2 AS BIGINT))) AS spot FROM h), b AS (SELECT conv_id, row, row_number() OVER (PARTITION BY conv_id ORDER BY row, spot) - 1 AS idx, CAST('0x' || substr(h, 2 * spot + 1, 2) AS BIGINT) AS b FROM s)"


@query(f"WITH {_TURNS} SELECT conv_id, idx // 512 AS frame, count(*) AS bytes, CAST(sum(b * (idx % 512 + 1)) AS BIGINT) AS checksum, min(row) AS first_row, max(row) - min(row) + 1 AS rows FROM b GROUP BY ALL")
def frames_across_turns(spark, sf_dir):
    """A conversation's turns laid end to end and cut into frames, which may span several of them: state between rows."""
    register(spark)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = spark.sql("SELECT * FROM byte_frames(TABLE(SELECT conv_id, text, turn, role FROM {turns}) PARTITION BY (conv_id) ORDER BY (turn, role, text), 512)", turns=turns)
    return found.withColumnRenamed("key", "conv_id")


def _histogram(buffer: np.ndarray, values: np.ndarray) -> None:
    """Counts of magnitudes by octave, then the count, the sum and the sum of squares."""
    octaves = np.minimum(np.floor(np.log2(np.abs(values) + 1)).astype(int), 15)
    buffer[:16] += np.bincount(octaves, minlength=16)
    buffer[16:] += len(values), values.sum(), (values * values).sum()


@query("WITH e AS (SELECT event_type, CAST(round(value * 100) AS BIGINT) AS x FROM events), o AS (SELECT event_type, least(CAST(floor(log2(abs(x) + 1)) AS BIGINT), 15) AS octave, count(*) AS c FROM e GROUP BY ALL), h AS (SELECT event_type, list_transform(range(16), lambda i: coalesce(map_from_entries(list((octave, c)))[i], 0)) AS counts FROM o GROUP BY event_type) SELECT h.event_type, array_to_string(any_value(counts), ' ') AS octaves, count(*) AS n, round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS deviation FROM e JOIN h USING (event_type) GROUP BY h.event_type")
def mergeable_histogram(spark, sf_dir):
    """A histogram by octave with mean and deviation, as one aggregate whose partial buffers are merged."""
    rows = table(spark, sf_dir, "events").select("event_type", F.round(F.col("value") * 100).alias("x"))
    found = aggregated(rows, "event_type", "x", 19, _histogram)
    n, total, squares = (F.col("buffer")[i] for i in (16, 17, 18))
    octaves = F.array_join(F.slice("buffer", 1, 16).cast("array<bigint>").cast("array<string>"), " ")
    return found.select("event_type", octaves.alias("octaves"), n.cast("long").alias("n"), F.round(total / n, 4).alias("mean"), F.round(F.sqrt(squares / n - F.pow(total / n, F.lit(2))), 4).alias("deviation"))
