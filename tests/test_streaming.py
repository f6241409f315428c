"""State that ends: what is kept for idle users, and that a stream with timers goes on from its checkpoint."""

from pyspark.sql import functions as F

from brindle.session import fresh_path
from brindle.streaming.expiring import idle_closed, rocks_db
from brindle.streaming.windows import stream_of

HOUR = 3_600_000


def test_idle_users_leave_no_state(spark):
    """Users come in waves, each seen in one file only: what is open stays as small as a wave, however many waves come."""
    root = fresh_path(spark, "waves")
    for wave in range(5):
        rows = spark.range(40).selectExpr(f"{wave} * 1000 + id AS event_id", f"timestamp_ntz'2024-01-01' + make_dt_interval(0, {wave} * 6, 0, id) AS ts", f"{wave} * 20 + id % 20 AS user_id", "'a' AS event_type", "1.0D AS value", "'' AS props")
        rows.coalesce(1).write.mode("append").parquet(root)
    out, seen = fresh_path(spark, "closed"), []
    with rocks_db(spark):
        stream = idle_closed(stream_of(spark, root, files=1), 2 * HOUR)
        run = stream.writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
        seen = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    rows = spark.read.parquet(f"{out}/rows")
    assert rows.count() == 80 and {r.n for r in rows.collect()} == {2}  # the last wave is still open
    assert rows.agg(F.countDistinct("user_id")).first()[0] == 80
    # 20 open users with a timer each (kept in two orders), never 100 of them
    assert max(seen) <= 2 * 20 * 3 and seen[-1] <= 20 * 3
