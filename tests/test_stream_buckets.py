"""The monitor of short gaps: many units to a call, and a stream that is waited for to its end."""

from pyspark.sql import functions as F

from waymark import streaming

SHAPE = "u bigint, w string, id bigint, pos bigint"
BASE = 1_700_000_000


def test_units_share_state_rows_and_keep_their_own_gaps(spark, tmp_path):
    src = str(tmp_path / "in")
    units = [(None, "a"), (2**53 + 1, None), (2**53, "b"), (None, None), *((n, "c") for n in range(60))]
    first = [(u, w, 10 * n, BASE + n) for n, (u, w) in enumerate(units)]
    then = [(u, w, 10 * n + k, BASE + 2000 + n + 50 * k) for n, (u, w) in enumerate(units) for k in (2, 1) if n % 3 != k]
    last = [(units[5][0], units[5][1], 9999, BASE + 90_000)]
    for part in (first, then, last):
        spark.createDataFrame(part, SHAPE).coalesce(1).write.mode("append").parquet(src)
    feed = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(src).withColumn("ts", F.timestamp_seconds("pos"))
    found = streaming.short_gap_monitor(feed, ["u", "w"], "ts", "pos", "id", 60, n_buckets=3)
    q = found.writeStream.format("memory").queryName("shared_rows").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    streaming.drain(q)
    want = sorted((str(u), str(w), 10 * n + 1, 10 * n + 2, 50) for n, (u, w) in enumerate(units) if n % 3 == 0)
    assert sorted((str(r.u), str(r.w), r.previous, r.id, r.gap) for r in spark.table("shared_rows").collect()) == want
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= 3
    assert found.dtypes[:2] == [("u", "bigint"), ("w", "string")]


def test_a_stream_is_waited_for_to_its_end():
    class Slow:
        stopped = False

        def awaitTermination(self, timeout=None):
            return None if timeout is None else False

        def stop(self):
            self.stopped = True

    slow, then = Slow(), []
    streaming.drain(slow, then=lambda: then.append(1))
    assert then == [1] and not slow.stopped
