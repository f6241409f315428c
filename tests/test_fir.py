"""Residuals of a rounded prediction and the samples decoded from them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators.frames import fir_decoded, fir_encoded
from brindle.plans.catalogue import QUERIES

WEIGHTS, SHIFT = [12, -6, 1], 3


def test_fir_prediction_gives_its_samples_back(spark, duck):
    got = QUERIES["fir_prediction"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["track_id", "n", "residual", "back"]
    want = duck("/root/testdata/sf0.001").execute("SELECT user_id, CAST(round(value * 100) AS BIGINT) FROM events").fetchall()
    assert sorted((r.track_id, r.back) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("size", [1, 2, 5, 128])
def test_samples_come_from_residuals(spark, size):
    rng = np.random.default_rng(2)
    rows = [(t, n, int(x)) for t, count in enumerate((1, 2, 3, 4, 40)) for n, x in enumerate(rng.integers(-(1 << 40), 1 << 40, count))]
    rows += [(9, n, None if n in (0, 6, 7, 20) else int(x)) for n, x in enumerate(rng.integers(-900, 900, 25))]
    frames = fir_encoded(spark.createDataFrame(rows, "track_id int, n long, x long").repartition(3), WEIGHTS, SHIFT, size)
    plain = {(t, n): x for t, n, x in rows}
    found = fir_decoded(frames, WEIGHTS, SHIFT).collect()
    assert sorted((r.track_id, r.n) for r in found) == sorted(plain)
    for r in found:
        before = [plain[r.track_id, r.n - j] if r.n >= j else 0 for j in (1, 2, 3)]
        known = None not in (*before, plain[r.track_id, r.n])
        assert r.residual == (plain[r.track_id, r.n] - (12 * before[0] - 6 * before[1] + before[2] >> 3) if known else None)
        assert r.x == plain[r.track_id, r.n]
    # another residual gives another sample, and others after it in its frame
    changed = frames.withColumn("codes", F.transform("codes", lambda c: F.struct(c["n"], F.when(c["n"] == 13, c["residual"] + 8).otherwise(c["residual"]).alias("residual"), c["raw"])))
    other = {(r.track_id, r.n): r.x for r in fir_decoded(changed, WEIGHTS, SHIFT).collect()}
    assert {k for k, x in other.items() if x != plain[k]} >= {(4, 13), (9, 13)}
    assert fir_decoded(frames.where("false"), WEIGHTS, SHIFT).count() == 0
