"""WAV files of 16-bit samples: a sink that writes a file a track, and a source over Spark's binary files."""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def to_wav(samples, rate: int = 44_100, channels: int = 1) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as sink:
        sink.setnchannels(channels)
        sink.setsampwidth(2)
        sink.setframerate(rate)
        sink.writeframes(np.asarray(samples, "<i2").tobytes())
    return out.getvalue()


def from_wav(data: bytes) -> tuple[int, int, np.ndarray]:
    """rate, channels, samples (interleaved) of a 16-bit file."""
    with wave.open(io.BytesIO(data)) as source:
        if source.getsampwidth() != 2:
            raise ValueError("only 16-bit files are read")
        return source.getframerate(), source.getnchannels(), np.frombuffer(source.readframes(source.getnframes()), "<i2").astype(np.int64)


def write_wav(tracks: DataFrame, folder: str, rate: int = 44_100) -> DataFrame:
    """Writes track_id, samples (array) rows as files below folder; gives path, track_id, n of each. Names are the ids, so a repeated attempt writes the same file."""

    def of(batches):
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(folder)
        system.create_dir(top, recursive=True)
        for batch in batches:
            rows = []
            for i, samples in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_output_stream(f"{top}/{i}.wav", compression=None) as sink:
                    sink.write(to_wav(samples, rate))
                rows.append((f"{folder}/{i}.wav", i, len(samples)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["path", "track_id", "n"])

    return tracks.select("track_id", "samples").mapInArrow(of, "path string, track_id long, n long")


def read_wav(spark: SparkSession, folder: str) -> DataFrame:
    """track_id, rate, samples of each WAV file below folder."""

    def of(batches):
        for batch in batches:
            found = [from_wav(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r for r, _, _ in found], pa.int32()), pa.array([s for *_, s in found], pa.list_(pa.int64()))], names=["track_id", "rate", "samples"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(folder)
    rows = files.select(F.regexp_extract("path", r"([0-9]+)\.wav$", 1).cast("long").alias("track_id"), "content")
    return rows.mapInArrow(of, "track_id long, rate int, samples array<long>")
