"""The lake, messages and streams."""

import json

from pyspark.sql import functions as F

from tidewell.model import METRICS, US
from tidewell.sources import formats, lake
from tidewell.streaming import telemetry

DAY = 86400 * US


def points(spark, n=40, days=3):
    return spark.createDataFrame([(f"s{i % 4}", i * DAY * days // n, float(i), 0) for i in range(n)], METRICS)


def test_lake_round_trip(spark, tmp_path):
    path = str(tmp_path / "lake")
    p = points(spark)
    lake.append(p, path)
    lake.append(p.withColumn("value", F.col("value") + 1).withColumn("inserted_at", F.col("us") + US), path)
    got = lake.read_points(spark, path)
    assert got.count() == 40 and got.select("sensor_id", "us", "value").exceptAll(p.select("sensor_id", "us", F.col("value") + 1)).count() == 0
    some = lake.read_points(spark, path, ["s1 "], 0, DAY)
    assert {r["sensor_id"] for r in some.collect()} == {"s1"} and all(r["us"] <= DAY for r in some.collect())
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "date#" in plan.split("PartitionFilters")[1][:200]
    lake.compact(spark, path, str(tmp_path / "staging"), more_than=1)
    assert lake.inspect(spark, path).agg(F.max("files"), F.sum("rows")).first()[:] == (1, 40)
    assert lake.parity(lake.read_points(spark, path), p).where("not same").count() == 0


def test_replication_and_backfill(spark, tmp_path):
    path = str(tmp_path / "lake")
    source = points(spark).withColumn("inserted_at", F.when(F.col("sensor_id") == "s0", None).otherwise(F.col("us")))
    mark = lake.replicate(source, path, 0, 2 * DAY, lag_s=0, late_s=86400)
    assert mark == 2 * DAY
    got = lake.read_points(spark, path)
    assert got.where("sensor_id <> 's0' and us <= 86400000000").count() == 0
    assert got.where("sensor_id = 's0'").count() == 0  # without an ingest time: not yet
    fixed = lake.repaired(source, 3 * DAY)
    assert fixed.where("inserted_at is null").count() == 0
    for now in (3, 4):  # once, however often replication runs
        mark = lake.replicate(fixed, path, mark, now * DAY, lag_s=0, late_s=2 * 86400)
        assert lake.read_points(spark, path, dedupe=False).where("sensor_id = 's0'").count() == 10
    lake.backfill(source, path, "1970-01-01")
    assert lake.read_points(spark, path, end_us=DAY - 1).count() == source.where(F.col("us") < DAY).count()
    # A day whose shards lost their rows keeps none of them, in neither tier.
    cold = str(tmp_path / "cold")
    lake.retain(spark, path, cold, "1970-01-02")
    fewer = source.where("sensor_id = 's1'")
    lake.backfill(fewer, path, "1970-01-01", cold=cold)
    assert lake.read_points(spark, path, end_us=DAY - 1).count() == fewer.where(F.col("us") < DAY).count()
    assert spark.read.schema(lake.LAKE).parquet(cold).where("date = '1970-01-01'").count() == 0


def test_tiers(spark, tmp_path):
    hot, cold = str(tmp_path / "hot"), str(tmp_path / "cold")
    lake.append(points(spark), hot)
    lake.retain(spark, hot, cold, "1970-01-02")
    assert lake.read_points(spark, cold).count() > 0
    assert lake.tiers(spark, hot, cold).count() == 40
    assert lake.expire(spark, hot, cold, "1970-01-02") == ["1970-01-01"]
    assert lake.read_points(spark, hot).where(F.col("us") < DAY).count() == 0 and lake.tiers(spark, hot, cold).count() == 40


def test_upsert_and_purge(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(tuple(r) for r in lake.upsert(old, new, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(tuple(r) for r in lake.upsert(old, new, ["k"], ignore=True).collect()) == [(1, "a"), (2, "b"), (3, "d")]
    kept, report = lake.purge(points(spark), ["s1"], 0, DAY)
    assert kept.count() + report.first()["n"] == 40


def test_telemetry(spark):
    topics = [("p/n/s/telemetry", t) for t in ("2024-01-01T00:00:00Z", 1704067200000, 1704067200.5, "never")]
    m = spark.createDataFrame([(t, json.dumps({"timestamp": x, "value": 1.5, "seq": 1})) for t, x in topics] + [("p/n/s/status", "{}"), ("p/n/s/telemetry", "{broken")], "topic string, payload string")
    got = sorted(r["us"] for r in formats.telemetry(m, now_us=7).collect())
    assert got == [7, 1704067200 * US, 1704067200 * US, 1704067200 * US + 500000]
    odd = spark.createDataFrame([("q/n/s/telemetry", '{"timestamp": 1.2345678, "value": 1}'), ("p/n/s/x/telemetry", '{"timestamp": 1, "value": 1}')], "topic string, payload string")
    assert [r["us"] for r in formats.telemetry(odd).collect()] == [1_234_000] and formats.telemetry(odd, "p").count() == 0


def test_node_status(spark):
    m = spark.createDataFrame([("p/n1/status", '{"timestamp": 5, "cpu": 12.5, "online": true, "name": "x"}'), ("p/n1/status", "{}"), ("p/n1/s/telemetry", '{"timestamp": 5, "cpu": 1}')], "topic string, payload string")
    assert sorted(tuple(r) for r in formats.node_status(m).collect()) == [("n1", 5000, "cpu", 12.5), ("n1", 5000, "online", 1.0)]


def test_liveness_of_a_stream(spark, tmp_path):
    """Timers of the arrival clock: heard of, then silent. The query is stopped, since it never ends by itself."""
    import time

    folder = tmp_path / "in"
    points(spark).where("sensor_id = 's1'").write.parquet(str(folder))
    stream = spark.readStream.schema(points(spark).schema).parquet(str(folder))
    q = telemetry.liveness(stream, 1500).writeStream.format("memory").queryName("alive").outputMode("append").option("checkpointLocation", str(tmp_path / "at")).trigger(processingTime="1 second").start()
    try:
        until = time.monotonic() + 90
        while time.monotonic() < until and spark.table("alive").count() < 2:
            time.sleep(1)
        newest = points(spark).where("sensor_id = 's1'").agg(F.max("us")).first()[0]
        assert [(r["last_us"], r["online"]) for r in spark.table("alive").collect()][:2] == [(newest, True), (newest, False)]
    finally:
        q.stop()


def test_frames(spark):
    assert len(formats.encode_frame([])) == 10
    frame = formats.encode_frame([("a", [(100, 23.5), (105, 24.0), (110, 24.5)])])
    assert list(formats.decode_frame(frame)) == [("a", 100, 23.5), ("a", 105, 24.0), ("a", 110, 24.5)]
    p = points(spark)
    back = formats.unframed(formats.frames(p))
    assert back.exceptAll(p.select("sensor_id", (F.floor(F.col("us") / US) * US).alias("us"), "value")).count() == 0 and back.count() == 40


def test_files_and_pages(spark, tmp_path):
    p = points(spark)
    formats.write_csv(p, str(tmp_path / "csv"))
    assert formats.read_csv(spark, str(tmp_path / "csv")).exceptAll(p).count() == 0
    first = formats.page(p, None, 10).collect()
    rest = formats.page(p, (first[-1]["us"], first[-1]["sensor_id"]), 100).collect()
    assert len(rest) == 30 and formats.wide(p, ["s0", "s1"]).columns == ["us", "s0", "s1"]
    assert formats.synthetic(spark, 2, 0, 600, 60).count() == 20


def test_weather_station(spark):
    q = spark.createDataFrame([("w", 0, 212.0, 9999.0, 10.0, None, 1.0, float("nan"))], "sensor_id string, us long, tempf double, humidity double, windspeedmph double, winddir double, rainin double, baromin double")
    assert {r["metric"]: round(r["value"], 3) for r in formats.weather_station(q).collect()} == {"temperature_c": 100.0, "wind_speed_ms": 4.47, "rain_mm": 25.4}


def stream(spark, df, path):
    df.coalesce(1).write.mode("append").parquet(path)
    return telemetry.read_points(spark, path)


def test_streams_equal_batches(spark, tmp_path):
    p = points(spark, 60).withColumn("us", F.col("us") + DAY)
    s = stream(spark, p, str(tmp_path / "in"))
    got = telemetry.run_all(telemetry.tumbling(s, "1 day"), "tumbling", "complete")
    assert got.agg(F.sum("samples")).first()[0] == 60
    assert telemetry.run_all(telemetry.once(stream(spark, p, str(tmp_path / "in"))), "once").count() == 60
    sliding = telemetry.run_all(telemetry.sliding(s, "2 days", "1 day"), "sliding", "complete")
    from tidewell.operators.windows import rolling_mean_at

    both = p.unionByName(p)
    want = rolling_mean_at(both, 2 * 86400, 86400)
    assert sorted((r["sensor_id"], r["emit"] // US, round(r["value"], 6)) for r in sliding.collect()) == sorted((r["sensor_id"], r["emit"], round(r["value"], 6)) for r in want.collect())


def test_change_of_value(spark, tmp_path):
    p = spark.createDataFrame([("a", i, v, 0) for i, v in enumerate((1.0, 1.0, 1.0000005, 2.0, 2.0, 1.0))], METRICS)
    got = telemetry.run_all(telemetry.changes_of_value(stream(spark, p, str(tmp_path / "cov"))), "cov")
    assert sorted(r["us"] for r in got.collect()) == [0, 3, 5]


def test_acknowledge_over_losses(spark, tmp_path):
    schema = "stream_id string, seq long, end_seq long"
    m = spark.createDataFrame([("s", 1, None), ("s", 2, None), ("s", 5, None), ("s", 3, 4), ("s", 9, None)], schema)
    path = str(tmp_path / "ack")
    m.coalesce(1).write.parquet(path)
    got = telemetry.run_all(telemetry.acknowledged(telemetry.read_points(spark, path, schema)), "ack")
    assert [r["acked"] for r in got.collect()] == [5]


def test_sessions(spark, tmp_path):
    s = stream(spark, points(spark, 12), str(tmp_path / "live"))
    assert telemetry.run_all(telemetry.sessions(s, "1 hour"), "sessions", "append").columns == ["sensor_id", "start", "end", "events", "peak"]
