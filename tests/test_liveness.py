"""Liveness by sensor: silent sensors, sensors that report changes only, nodes with heartbeats."""

import pytest
from pyspark.sql import functions as F

from tidewell.streaming import liveness as L


def test_thresholds():
    assert L.sensor_threshold(60, None, 5000) == 300_000 and L.sensor_threshold(0, 30, 5000) == 150_000 and L.sensor_threshold(1, 99, 60_000) == 60_000
    assert L.sensor_threshold(0, 0, 5000) == 300_000 and L.sensor_threshold(None, None, 400_000) == 400_000
    assert L.reports_changes(0, 0) and L.reports_changes(None, None) and not L.reports_changes(1, 0) and not L.reports_changes(0, 2)
    assert L.node_threshold([], None, 5000) == 15_000 and L.node_threshold([20_000, 300_000], 10, 5000) == 300_000 and L.node_threshold([20_000], 100, 5000) == 500_000


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    L.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_silent_and_exempt_sensors(spark, tmp_path, rocksdb):
    """By the signals' own times, a file for each batch."""
    s = lambda node, sensor, t, interval=None, beat=None: (node, sensor, (t + 10_000) * 1_000_000, interval, None, beat)
    batches = [
        [s("n", "fast", 0, 10.0), s("n", "slow", 0, 600.0), s("n", "changes", 0, 0.0), s("n", None, 0, None, 30.0), s("m", "fast", 0, 10.0), s("m", "changes", 0, 0.0)],
        [s("n", "slow", 100), s("other", None, 100)],  # n/fast is silent since 0: offline after 50 s
        [s("n", "fast", 200), s("other", None, 400)],  # heard of again; m is silent since 0: its longest threshold is the five minutes of a sensor of changes
        [s("n", None, 2000), s("other", None, 2500)],  # n/fast and the others are silent again, but the node's heartbeat came
        [s("other", None, 9000)],  # now the node is silent too, and so are those that report changes
        [s("other", None, 9500)],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, L.SIGNALS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        import time

        time.sleep(1.1)  # files are taken in order of their times
    stream = spark.readStream.schema(L.SIGNALS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream = stream.withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", "0 seconds")
    q = L.states(stream, floor_s=15, arrival=False).writeStream.format("memory").queryName("liveness_states").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    got = sorted((r["node_id"], r["sensor_id"] or "", r["at_ms"] // 1000 - 10_000, r["online"]) for r in spark.table("liveness_states").collect() if r["node_id"] != "other")
    want = [
        ("m", "", 0, True), ("m", "", 300, False), ("m", "changes", 0, True), ("m", "changes", 300, False), ("m", "fast", 0, True), ("m", "fast", 50, False),
        ("n", "", 0, True), ("n", "", 5000, False), ("n", "changes", 0, True), ("n", "changes", 5000, False),
        ("n", "fast", 0, True), ("n", "fast", 50, False), ("n", "fast", 200, True), ("n", "fast", 250, False), ("n", "slow", 0, True), ("n", "slow", 3100, False),
    ]
    assert got == want
