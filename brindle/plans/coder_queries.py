"""Queries that encode to real bytes and decode them again, a frame or a chunk at a time."""

from __future__ import annotations

import gzip
import lzma

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import codecs
from ..operators.frames import framed, residual_frames, residual_sql
from ..operators.registry import CODERS
from ..sources.views import BYTES_SQL, MONO_SQL, byte_chunks, wave_mono
from ..sources.wav import read_wav, write_wav
from ..session import fresh_path
from .registry import query

RES = residual_sql(MONO_SQL)


def _lists(rows, value: str, *keys: str):
    """keys, v: the values of each frame in order. A frame is bounded, so the list is."""
    return rows.groupBy(*keys).agg(F.expr(f"transform(array_sort(collect_list(struct(n, {value} as v))), s -> s.v)").alias("v"))


def _coded(rows, of, schema: str):
    """mapInArrow over (keys..., v) with of(v) -> tuple of the new columns."""
    names = [x.split()[0] for x in schema.split(", ")]
    kept = rows.columns[:-1]

    def run(batches):
        for batch in batches:
            found = [of(v) for v in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c) for c in zip(*found))], names=[*kept, *names]) if found else batch.slice(0, 0)

    return rows.where("v is not null").mapInArrow(run, ", ".join([*(f"{c} {t}" for c, t in rows.dtypes[:-1]), schema]))


@query(f"WITH {RES}, b AS (SELECT track_id, frame, count(*) AS n, k, sum((z >> k) + 1 + k) AS bits FROM res, range(1, 31) t(k) GROUP BY track_id, frame, k) SELECT track_id, frame, any_value(n) AS n, arg_min(k, bits * 100 + k) AS k, CAST(ceil(min(bits) / 8.0) AS BIGINT) AS size, TRUE AS lossless FROM b GROUP BY track_id, frame")
def rice_codec_roundtrip(spark, sf_dir):
    def of(v):
        z = np.array(v, np.int64)
        k = codecs.best_k(z)
        data = codecs.rice_encode(z, k)
        return len(z), k, len(data), bool((codecs.rice_decode(data, k, len(z)) == z).all())

    return _coded(_lists(residual_frames(wave_mono(spark, sf_dir)), "z", "track_id", "frame"), of, "n long, k long, size long, lossless boolean")


@query(f"WITH {RES}, p AS (SELECT track_id, frame, row_number() OVER (PARTITION BY track_id, frame ORDER BY n) - 1 AS idx, z FROM res), b AS (SELECT track_id, frame, idx // 16 AS part, k, sum((z >> k) + 1 + k) AS bits, count(*) AS c FROM p, range(1, 31) t(k) GROUP BY ALL), m AS (SELECT track_id, frame, part, any_value(c) AS c, CAST(ceil(min(bits) / 8.0) AS BIGINT) AS size FROM b GROUP BY ALL) SELECT track_id, frame, CAST(sum(c) AS BIGINT) AS n, CAST(sum(3 + size) AS BIGINT) AS size, TRUE AS lossless FROM m GROUP BY ALL")
def partitioned_codec_roundtrip(spark, sf_dir):
    def of(v):
        z = np.array(v, np.int64)
        data = codecs.partitioned_encode(z)
        return len(z), len(data), bool((codecs.partitioned_decode(data, len(z)) == z).all())

    return _coded(_lists(residual_frames(wave_mono(spark, sf_dir)), "z", "track_id", "frame"), of, "n long, size long, lossless boolean")


@query(f"WITH {BYTES_SQL} SELECT doc_id, chunk, count(*) AS n, TRUE AS lossless FROM bytes GROUP BY ALL")
def arith_coder_roundtrip(spark, sf_dir):
    """The order-0 coder over every chunk of every text: each is coded to bytes and decoded from them, many side by side."""
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = byte_chunks(spark, sf_dir).repartition(width, "doc_id", "chunk")

    def run(batches):
        for batch in batches:
            bodies = batch.column(2).to_pylist()
            sizes = [len(body) for body in bodies]
            back = codecs.arithmetic_decode_all(codecs.arithmetic_encode_all(bodies), sizes)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array([x == y for x, y in zip(back, bodies)], pa.bool_())], names=["doc_id", "chunk", "n", "lossless"])

    return chunks.select("doc_id", "chunk", "body").mapInArrow(run, f"doc_id {dict(chunks.dtypes)['doc_id']}, chunk long, n long, lossless boolean")


@query(f"WITH {MONO_SQL} SELECT track_id, n // 64 AS frame, count(*) AS n, TRUE AS lossless FROM wave GROUP BY ALL")
def lpc_codec_roundtrip(spark, sf_dir):
    def of(v):
        x = np.array(v, np.int64)
        return len(x), bool((codecs.lpc_decode(codecs.lpc_encode(x)) == x).all())

    return _coded(_lists(framed(wave_mono(spark, sf_dir), 64), "x", "track_id", "frame"), of, "n long, lossless boolean")


@query(f"WITH {MONO_SQL}, f AS (SELECT track_id, n // 64 AS frame, count(*) AS n FROM wave GROUP BY ALL) SELECT track_id, frame // 8 AS part, count(*) AS frames, CAST(sum(n) AS BIGINT) AS n, TRUE AS lossless FROM f GROUP BY ALL")
def bitstream_container(spark, sf_dir):
    """Containers of up to eight coded frames, written and read back."""

    def of(v):
        x = np.array(v, np.int64)
        frames = [x[i : i + 64] for i in range(0, len(x), 64)]
        back = [codecs.lpc_decode(f) for f in codecs.unpack_container(codecs.pack_container([codecs.lpc_encode(f) for f in frames]))]
        return len(frames), len(x), len(back) == len(frames) and bool((np.concatenate(back) == x).all())

    return _coded(_lists(wave_mono(spark, sf_dir).withColumn("part", F.expr("n div 512")), "x", "track_id", "part"), of, "frames long, n long, lossless boolean")


@query()
def gzip_lzma_eval(spark, sf_dir):
    """Each text's sizes under two general coders, chunk by chunk, and the rates; how many chunks came back whole."""

    def of(v):
        v = bytes(v)
        a, b = gzip.compress(v, 9, mtime=0), lzma.compress(v)
        return len(v), len(a), len(b), gzip.decompress(a) == v and lzma.decompress(b) == v

    chunks = _coded(byte_chunks(spark, sf_dir).select("doc_id", "chunk", F.col("body").alias("v")), of, "raw long, gzip long, lzma long, lossless boolean")
    docs = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_if("lossless").alias("whole"), *(F.sum(c).alias(c) for c in ("raw", "gzip", "lzma")))
    return docs.select("*", *(F.round(F.col("raw") / F.col(c), 6).alias(f"{c}_rate") for c in ("gzip", "lzma")))


@query(f"WITH {MONO_SQL}, f AS (SELECT track_id, n // 64 AS frame, count(*) AS n FROM wave GROUP BY ALL), c AS (SELECT unnest(['arithmetic', 'partitioned', 'rice', 'verbatim']) AS coder) SELECT track_id, frame, coder, n, TRUE AS lossless FROM f, c")
def coder_matrix(spark, sf_dir):
    """Every registered coder over every frame of differences."""
    frames = _lists(framed(wave_mono(spark, sf_dir), 64), "x", "track_id", "frame")
    grid = frames.select("track_id", "frame", F.explode(F.array(*(F.struct(F.lit(c).alias("coder"), F.col("v").alias("x")) for c in sorted(CODERS)))).alias("v"))

    def of(v):
        z = codecs.zigzag(np.diff(np.array(v["x"], np.int64), prepend=0))
        encode, decode = CODERS[v["coder"]]
        return v["coder"], len(z), bool((decode(encode(z), len(z)) == z).all())

    return _coded(grid, of, "coder string, n long, lossless boolean")


@query(f"WITH {MONO_SQL} SELECT track_id, count(*) AS n, 44100 AS rate, TRUE AS same FROM wave GROUP BY track_id")
def wav_sink_source_roundtrip(spark, sf_dir):
    """Tracks as WAV files in the shared folder, and back. A file holds a whole track, as the format wants."""
    tracks = _lists(wave_mono(spark, sf_dir).withColumn("x", F.col("x") - 20000), "x", "track_id").select("track_id", F.transform("v", lambda x: F.greatest(F.least(x, F.lit(32767)), F.lit(-32768))).alias("samples"))
    folder = fresh_path(spark, "wav")
    written = write_wav(tracks, folder)
    written.agg(F.sum("n")).collect()
    back = read_wav(spark, folder).select("track_id", "rate", F.col("samples").alias("back"))
    return tracks.join(back, "track_id").select("track_id", F.size("samples").cast("long").alias("n"), "rate", (F.col("samples") == F.col("back")).alias("same"))
