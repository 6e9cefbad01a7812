"""Messages and files that points come in and go out as."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.expressions import fahrenheit_to_celsius, inches_to_mm, inhg_to_kpa, mph_to_ms, station_value
from tidewell.model import METRICS, US

PAYLOAD = "timestamp string, value double, quality int, seq bigint, stream_id string, backfill boolean"


def telemetry(messages: DataFrame, prefix: str | None = None, now_us: int | None = None) -> DataFrame:
    """node, sensor_id, us, value, quality, seq, stream_id of ``messages(topic, payload)``.

    Topics are prefix/node/sensor/telemetry, of exactly four parts (``prefix`` None: any). A timestamp is ISO
    8601 text, an integer of milliseconds, or a decimal number of seconds, cut to milliseconds. An unusable
    one counts as now (``now_us`` None: the time of the query); messages without a value go.
    """
    parts = F.split("topic", "/")
    body = F.from_json("payload", PAYLOAD)
    rows = messages.select(parts.alias("t"), body.alias("b")).where((F.size("t") == 4) & (F.col("t")[3] == "telemetry") & (F.lit(True) if prefix is None else F.col("t")[0] == prefix))
    raw = F.col("b.timestamp")
    us = (
        F.when(raw.rlike(r"^-?\d+$"), F.expr("try_cast(b.timestamp AS bigint)") * 1000)
        .when(raw.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), (F.expr("try_cast(b.timestamp AS double)") * 1000).cast("bigint") * 1000)
        .otherwise(F.expr("unix_micros(try_cast(b.timestamp AS timestamp))"))
    )
    us = F.coalesce(us, F.unix_micros(F.current_timestamp()) if now_us is None else F.lit(now_us))
    out = rows.select(F.col("t")[1].alias("node"), F.col("t")[2].alias("sensor_id"), us.alias("us"), F.col("b.value").alias("value"), F.coalesce("b.quality", F.lit(0)).alias("quality"), F.col("b.seq").alias("seq"), F.col("b.stream_id").alias("stream_id"))
    return out.where("value is not null")


def node_status(messages: DataFrame) -> DataFrame:
    """node, us, metric, value of ``messages(topic, payload)`` on prefix/node/status: a health series for each number.

    The payload is a flat JSON object with ``timestamp`` (milliseconds); booleans count as 0 and 1.
    """
    body = F.from_json("payload", "map<string, string>")
    rows = messages.select(F.split("topic", "/").alias("t"), body.alias("b")).where((F.size("t") == 3) & (F.col("t")[2] == "status"))
    pairs = rows.select(F.col("t")[1].alias("node"), (F.expr("try_cast(b['timestamp'] AS bigint)") * 1000).alias("us"), F.explode(F.map_filter("b", lambda k, v: k != "timestamp")).alias("metric", "raw"))
    value = F.when(F.col("raw") == "true", 1.0).when(F.col("raw") == "false", 0.0).otherwise(F.expr("try_cast(raw AS double)"))
    return pairs.select("node", "us", "metric", value.alias("value")).where("us is not null and value is not null")


def weather_station(queries: DataFrame) -> DataFrame:
    """sensor_id, us, metric, value of ``queries(sensor_id, us, tempf, humidity, windspeedmph, winddir, rainin, baromin)``."""
    read = {
        "temperature_c": fahrenheit_to_celsius(station_value(F.col("tempf"))),
        "humidity_pct": station_value(F.col("humidity")),
        "wind_speed_ms": mph_to_ms(station_value(F.col("windspeedmph"))),
        "wind_direction_deg": station_value(F.col("winddir")),
        "rain_mm": inches_to_mm(station_value(F.col("rainin"))),
        "pressure_kpa": inhg_to_kpa(station_value(F.col("baromin"))),
    }
    pairs = F.array(*(F.struct(F.lit(k).alias("metric"), c.cast("double").alias("value")) for k, c in read.items()))
    return queries.select("sensor_id", "us", F.explode(pairs).alias("p")).select("sensor_id", "us", "p.metric", "p.value").where("value is not null")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Points of staged CSV files, with an explicit schema."""
    return spark.read.schema(METRICS).option("header", True).csv(path)


def write_csv(points: DataFrame, path: str) -> None:
    points.select("sensor_id", "us", "value", "quality").write.mode("overwrite").option("header", True).csv(path)


def wide(points: DataFrame, sensors: list[str]) -> DataFrame:
    """A row for each time, a column for each of some sensors."""
    return points.where(F.col("sensor_id").isin(sensors)).groupBy("us").pivot("sensor_id", sensors).agg(F.first("value"))


def synthetic(spark: SparkSession, sensors: int, start_s: int, end_s: int, every_s: int, clusters: int = 5, seed: int = 7) -> DataFrame:
    """Daily sinusoids in clusters with small uniform noise, repeatable by seed."""
    grid = spark.range(start_s, end_s, every_s).withColumnRenamed("id", "s").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(sensors - 1))))
    noise = F.pmod(F.xxhash64("s", "k", F.lit(seed)), F.lit(1_000_001)) / 1_000_000 * 0.1 - 0.05
    value = F.sin(2 * F.pi() * F.col("s") / 86400 + 0.2 * (F.col("k") % clusters)) + 0.0005 * F.col("k") + noise
    return grid.select(F.concat(F.lit("s"), F.col("k")).alias("sensor_id"), (F.col("s") * US).alias("us"), value.alias("value"), F.lit(0).alias("quality"))


# Binary frames: fixed values of the format.
MAGIC = b"FDB1"
_HEAD, _SERIES, _POINT = "<4sHI", "<Hqi", "<If"


def encode_frame(series: list[tuple[str, list[tuple[int, float]]]]) -> bytes:
    """A frame of (sensor_id, [(seconds, value)]): 10 bytes, and each series' name, start and points."""
    out = [struct.pack(_HEAD, MAGIC, len(series), sum(len(p) for _, p in series))]
    for name, points in series:
        raw, start = name.encode(), points[0][0] if points else 0
        out += [struct.pack(_SERIES, len(raw), start, len(points)), raw, *(struct.pack(_POINT, t - start, v) for t, v in points)]
    return b"".join(out)


def decode_frame(frame: bytes) -> Iterator[tuple[str, int, float]]:
    magic, n, _ = struct.unpack_from(_HEAD, frame)
    if magic != MAGIC:
        raise ValueError("not a frame")
    at = struct.calcsize(_HEAD)
    for _ in range(n):
        size, start, points = struct.unpack_from(_SERIES, frame, at)
        at += struct.calcsize(_SERIES)
        name = frame[at : at + size].decode()
        at += size
        for _ in range(points):
            offset, value = struct.unpack_from(_POINT, frame, at)
            at += struct.calcsize(_POINT)
            yield name, start + offset, value


def frames(points: DataFrame, interval_s: int = 86400) -> DataFrame:
    """sensor_id, day, frame: each sensor's points of each interval as a frame."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("us")
        body = [(int(u) // US, float(v)) for u, v in zip(rows["us"], rows["value"], strict=True)]
        return pd.DataFrame({"sensor_id": [rows["sensor_id"].iloc[0]], "day": [rows["day"].iloc[0]], "frame": [encode_frame([(rows["sensor_id"].iloc[0], body)])]})

    day = F.floor(F.col("us") / F.lit(interval_s * US)).cast("long")
    return points.select("sensor_id", "us", "value", day.alias("day")).groupBy("sensor_id", "day").applyInPandas(one, "sensor_id string, day long, frame binary")


def unframed(framed: DataFrame) -> DataFrame:
    """sensor_id, us, value of ``framed(frame)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(s, t * US, v) for f in batch["frame"] for s, t, v in decode_frame(bytes(f))]
            yield pd.DataFrame(rows, columns=["sensor_id", "us", "value"])

    return framed.select("frame").mapInPandas(run, "sensor_id string, us long, value double")


def page(points: DataFrame, after: tuple[int, str] | None, size: int) -> DataFrame:
    """The next ``size`` points after a (time, sensor) cursor."""
    rows = points
    if after is not None:
        at, sensor = F.lit(after[0]), F.lit(after[1])
        rows = rows.where((F.col("us") > at) | ((F.col("us") == at) & (F.col("sensor_id") > sensor)))
    return rows.orderBy("us", "sensor_id").limit(size)


def stable_id(*parts: str | Column) -> Column:
    """24 hex digits from text parts."""
    return F.substring(F.sha2(F.concat_ws(":", *(p if isinstance(p, Column) else F.lit(p) for p in parts)), 256), 1, 24)
