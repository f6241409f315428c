"""A table function that SQL can call: frames of the bytes of a table's rows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from ..session import ship


@udtf(returnType="key bigint, frame bigint, bytes bigint, checksum bigint, first_row bigint, rows bigint")
class ByteFrames:
    """key, frame (number), bytes, checksum, first_row (place of the row that it begins in), rows (that it touches).

    Called with a table of (key, body), partitioned by key, and the size of a frame: the rows' bodies (texts in UTF-8, or
    bytes) laid end to end, in the partition's order, and cut into frames; the last one may be short. What is carried from
    row to row is less than a frame and its sums, whatever a partition holds. A null body has no bytes.
    """

    def __init__(self):
        self.key, self.frame, self.filled, self.sum, self.row, self.first, self.size = None, 0, 0, 0, -1, 0, 1

    def _closed(self) -> tuple:
        out = self.key, self.frame, self.filled, self.sum, self.first, self.row - self.first + 1
        self.frame, self.filled, self.sum = self.frame + 1, 0, 0
        return out

    def eval(self, row: Row, size: int) -> Iterator[tuple]:
        import numpy as np

        self.key, self.size, self.row = row[0], size, self.row + 1
        body = row[1].encode() if isinstance(row[1], str) else bytes(row[1] or b"")
        values, at = np.frombuffer(body, np.uint8).astype(np.int64), 0
        while at < len(values):
            if not self.filled:
                self.first = self.row
            part = values[at : at + size - self.filled]
            self.sum += int(part @ np.arange(self.filled + 1, self.filled + 1 + len(part)))
            self.filled += len(part)
            at += len(part)
            if self.filled == size:
                yield self._closed()

    def terminate(self) -> Iterator[tuple]:
        if self.filled:
            yield self._closed()


def register(spark: SparkSession) -> None:
    """Makes byte_frames(TABLE(...) PARTITION BY ..., size) known to the session's SQL."""
    ship(spark)
    spark.udtf.register("byte_frames", ByteFrames)
