"""Sessions with timers, and areas saved in committed batches."""

import time
from datetime import UTC, datetime

import pytest

from gleanspark.operators import commits
from gleanspark.streaming import live

SIGNALS = "session_id string, ts timestamp, over boolean"


def test_sessions_are_lost_and_found(spark, tmp_path):
    source = str(tmp_path / "in")

    def send(*rows):
        spark.createDataFrame(rows, SIGNALS).coalesce(1).write.mode("append").parquet(source)

    now = datetime.now(UTC)
    send(("a", None, False), ("b", now, False), ("c", now, True))
    query = live.sessions(spark.readStream.schema(SIGNALS).parquet(source), "session_id", "ts", "over", lost_after=1.5, first_wait=0.5, most_wait=1.0)
    running = query.writeStream.format("memory").queryName("told").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()

    def told(name):
        return [(r.status, r.attempt) for r in spark.table("told").where(f"session_id = '{name}'").collect()]

    def until(test, seconds=120):
        end = time.monotonic() + seconds
        while not test():
            assert time.monotonic() < end and running.isActive, (running.exception(), told("a"), told("b"), told("c"))
            time.sleep(0.3)

    try:
        until(lambda: ("reconnecting", 2) in told("b"))
        assert told("b")[:4] == [("live", 0), ("stream_lost", 0), ("reconnecting", 1), ("reconnecting", 2)]
        assert told("a") == [("connecting", 0)] and told("c") == [("live", 0), ("ended", 0)]
        waits = [r.wait_sec for r in spark.table("told").where("session_id = 'b' AND wait_sec IS NOT NULL").collect()]
        assert waits[:3] == [0.5, 1.0, 1.0]
        send(("a", datetime.now(UTC), False), ("b", datetime.now(UTC), False))
        until(lambda: told("a")[-1][0] != "connecting" and told("b").count(("live", 0)) == 2)
        again = told("b")[told("b").index(("live", 0), 1) :]
        until(lambda: told("b")[-1] == ("reconnecting", 1) or ("reconnecting", 1) in again)  # the waits start short again
        assert ("live", 0) in told("a")
    finally:
        running.stop()


def test_committed_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    assert commits.committed(spark, path, "id long").count() == 0
    assert commits.commit_batch(rows(1, 2), path, "0") and commits.commit_batch(rows(3), path, "1")
    assert not commits.commit_batch(rows(9), path, "1")
    rows(7).write.parquet(f"{path}/data/2-lost")  # written, never named
    assert sorted(r.id for r in commits.committed(spark, path, "id long").collect()) == [1, 2, 3]
    assert set(commits.committed_batches(spark, path)) == {"0", "1"}


@pytest.mark.parametrize("replay", [False, True])
def test_areas_are_saved_once(spark, tmp_path, replay):
    areas = "session_id string, area_id long, ts_ms long"
    spark.createDataFrame([("s", 1, 10_000), ("s", 2, 60_000)], areas).coalesce(1).write.parquet(str(tmp_path / "in"))
    readings = spark.createDataFrame([("s", 9_500, 1.0), ("s", 10_900, 2.0), ("other", 10_000, 3.0)], "session_id string, timestamp_ms long, latitude double")
    path = str(tmp_path / "saved")
    for checkpoint in ["a", "b"] if replay else ["a"]:  # another checkpoint: the first batch comes again
        stream = spark.readStream.schema(areas).parquet(str(tmp_path / "in"))
        live.save_areas(stream, readings, path).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination()
    folder = next(iter(commits.committed_batches(spark, path).values()))
    found = commits.committed(spark, path, spark.read.parquet(f"{path}/{folder}").schema).orderBy("area_id").collect()
    assert [(r.area_id, r.latitude) for r in found] == [(1, 1.0), (2, None)]
