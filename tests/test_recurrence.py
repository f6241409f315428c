"""Recurrences against a plain loop, with blocks and groups so small that tracks span several of each."""

import numpy as np
import pytest

from brindle.operators import recurrence
from brindle.operators.recurrence import solved


@pytest.mark.parametrize("block, group", [(4, 3), (128, 1024)])
@pytest.mark.parametrize("weights", [[1], [2, -1], [3, -3, 1], [0.9], [1.6, -0.65], [0.5, 0.2, -0.1, 0.05]])
def test_against_a_loop(spark, monkeypatch, block, group, weights):
    monkeypatch.setattr(recurrence, "BLOCK", block)
    monkeypatch.setattr(recurrence, "GROUP", group)
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for track, count in enumerate((1, 3, 4, 5, 12, 13, 100)):
        samples = rng.integers(-1000, 1000, count).tolist()
        x = []
        for n, s in enumerate(samples):
            before = sum(w * (x[n - j] if n >= j else 0) for j, w in enumerate(weights, 1))
            # integer weights: residuals of bounded samples; real ones: any residuals
            whole = all(isinstance(w, int) for w in weights)
            rows.append((track, n, s - before if whole else float(s)))
            x.append(s if whole else s + before)
            want[track, n] = x[-1]
    frame = spark.createDataFrame(rows, "track_id int, n long, e " + ("long" if isinstance(rows[0][2], int) else "double")).repartition(5)
    got = {(r.track_id, r.n): r.x for r in solved(frame, weights).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-6) for k in want)
    assert solved(frame.where("false"), weights).count() == 0


def test_no_python_and_no_track_in_one_task(spark):
    frame = spark.range(1000).selectExpr("0 AS track_id", "id AS n", "id % 7 AS e")
    plan = solved(frame, [2, -1])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Window" not in plan
