"""Numbers, neighbours and running sums in blocks: one track of all events, cut small, gives what whole-track windows give."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.operators import numbering
from brindle.operators.numbering import numbered, running_sum, with_length, with_neighbours

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def one_track(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet").select(F.lit(7).alias("track_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", F.round(F.col("value") * 100).cast("long").alias("x"))
    odd = spark.createDataFrame([(7, None, 1, 5), (7, None, 2, 6), (8, 3, 3, 7), (None, 1, 4, 8), (None, None, 5, 9)], "track_id int, at long, event_id long, x long")
    return rows.union(odd).cache()


def test_one_track_is_many_tasks_work(one_track):
    want = one_track.withColumn("n", F.row_number().over(Window.partitionBy("track_id").orderBy("at", "event_id")).cast("long") - 1)
    got = numbered(one_track, "track_id", ["at", "event_id"], block=100)
    assert got.columns == want.columns and sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    spark = one_track.sparkSession
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = numbered(one_track, "track_id", ["at", "event_id"], block=100).groupBy(F.spark_partition_id().alias("task")).agg(F.count("n").alias("rows"), F.max("n")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) >= 4 and max(r.rows for r in tasks) < 600


def test_neighbours_and_sums_across_blocks(one_track):
    rows = numbered(one_track, "track_id", ["at", "event_id"]).where("track_id is not null").select("track_id", "n", "x")
    columns = lambda w: {"back": F.lag("x", 3, 0).over(w), "ahead": F.sum("x").over(w.rowsBetween(1, 5)), "here": F.count("x").over(w.rowsBetween(-3, 5))}
    whole = Window.partitionBy("track_id").orderBy("n")
    for size in (8, 64, 1 << 16):
        got = with_neighbours(rows, columns, 3, 5, size=size)
        assert sorted(got.collect(), key=str) == sorted(rows.withColumns(columns(whole)).collect(), key=str)
        got = running_sum(rows, "x", "s", size=size)
        assert sorted(got.collect()) == sorted(rows.withColumn("s", F.sum("x").over(whole)).collect())
    assert {(r.track_id, r.len) for r in with_length(rows).collect()} == {(7, 1002), (8, 1)}


def test_halo_is_no_longer_than_a_block(one_track):
    with pytest.raises(ValueError):
        numbering.with_halo(one_track.withColumn("n", F.lit(1)), 9, size=8)


def test_queries_agree_when_blocks_are_small(spark, monkeypatch, duck):
    from brindle.plans.catalogue import ORACLES, QUERIES

    monkeypatch.setattr(numbering, "BLOCK", 8)
    monkeypatch.setattr(numbering, "SPAN", 12)
    for name in ("fixed_predictor_orders", "forecast_windows", "frames_overlap", "running_pool", "lm_streams", "ema_rate"):
        got, want = QUERIES[name](spark, SF), duck(SF).execute(ORACLES[name])
        columns = [d[0] for d in want.description]
        plain = lambda rows: sorted([tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows])
        assert plain(got.select(*columns).collect()) == plain(want.fetchall()), name
