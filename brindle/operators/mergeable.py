"""Aggregates of one's own with partial buffers: rows to buffers where they are read, buffers merged by key."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Keys whose buffers a task holds before it sends them on.
HELD = 4096


def aggregated(rows: DataFrame, key: str, value: str, length: int, add: Callable[[np.ndarray, np.ndarray], None]) -> DataFrame:
    """key, buffer: for each key an array of so many doubles, all zeros at first, that add(buffer, values) changes in place.

    Buffers must merge by sums of their entries. A task sends one for each key that it meets (and starts anew after HELD
    keys); sums of entries are Spark's own, so partial buffers combine again before the shuffle, and a key with most of
    the rows is a buffer a task. Null values don't count; a null key is a key.
    """
    ship(rows.sparkSession)
    kind = dict(rows.dtypes)[key]

    def of(batches):
        held: dict = {}

        def sent(schema):
            keys = [k for k in held for _ in range(length)]
            out = pa.RecordBatch.from_arrays([pa.array(keys, schema.field(0).type), pa.array(np.tile(np.arange(length, dtype=np.int32), len(held))), pa.array(np.concatenate(list(held.values())))], names=[key, "i", "v"])
            held.clear()
            return out

        schema = None
        for batch in batches:
            schema = batch.schema
            keys, values = batch.column(0).to_pylist(), batch.column(1)
            valid = np.flatnonzero(pa.compute.is_valid(values).to_numpy(zero_copy_only=False))
            numbers = pa.compute.cast(values.take(pa.array(valid)), pa.float64()).to_numpy(zero_copy_only=False)
            of_key: dict = {}
            for place, i in enumerate(valid.tolist()):
                of_key.setdefault(keys[i], []).append(place)
            for k, places in of_key.items():
                if k not in held and len(held) == HELD:
                    yield sent(schema)
                add(held.setdefault(k, np.zeros(length)), numbers[places])
        if held:
            yield sent(schema)

    sums = rows.select(key, value).mapInArrow(of, f"{key} {kind}, i int, v double").groupBy(key, "i").agg(F.sum("v").alias("v"))
    return sums.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("buffer"))
