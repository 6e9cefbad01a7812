"""Structured Streaming over points: ``us`` becomes the event time ``ts``."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewell.model import METRICS


def read_points(spark: SparkSession, path: str, schema: str = METRICS, files_per_batch: int | None = None) -> DataFrame:
    """A stream of Parquet files of points as they appear in a folder."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def timed(points: DataFrame, late: str = "48 hours") -> DataFrame:
    return points.withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", late)


def tumbling(points: DataFrame, width: str = "5 minutes", late: str = "48 hours") -> DataFrame:
    """sensor_id, start, value, quality, samples of each window."""
    w = timed(points, late).groupBy("sensor_id", F.window("ts", width).alias("w"))
    return w.agg(F.avg("value").alias("value"), F.avg("quality").alias("quality"), F.count("*").alias("samples")).select("sensor_id", F.unix_micros("w.start").alias("start"), "value", "quality", "samples")


def sliding(points: DataFrame, width: str, every: str, late: str = "48 hours") -> DataFrame:
    """Rolling means: windows (emit - width, emit], each under its emit time.

    Spark's windows hold their start and not their end, so times are moved back by a microsecond.
    """
    w = points.withColumn("ts", F.timestamp_micros(F.col("us") - 1)).withWatermark("ts", late).groupBy("sensor_id", F.window("ts", width, every).alias("w"))
    return w.agg(F.avg("value").alias("value"), F.round(F.avg("quality")).cast("int").alias("quality"), F.count("*").alias("samples")).select("sensor_id", F.unix_micros("w.end").alias("emit"), "value", "quality", "samples")


def once(points: DataFrame, late: str = "48 hours") -> DataFrame:
    """Each (sensor_id, us) once, within the watermark: the first to arrive."""
    return timed(points, late).dropDuplicatesWithinWatermark(["sensor_id", "us"])


def sessions(points: DataFrame, gap: str = "30 minutes", late: str = "48 hours") -> DataFrame:
    s = timed(points, late).groupBy("sensor_id", F.session_window("ts", gap).alias("w"))
    return s.agg(F.count("*").alias("events"), F.max("value").alias("peak")).select("sensor_id", F.unix_micros("w.start").alias("start"), F.unix_micros("w.end").alias("end"), "events", "peak")


def changes_of_value(points: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Points whose value or quality differs from the last that was kept."""

    def keep(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = pd.concat(batches).sort_values("us", kind="stable")
        kept = []
        for row in rows.itertuples(index=False):
            if last is None or abs(row.value - last[0]) > tolerance or row.quality != last[1]:
                last = (row.value, row.quality)
                kept.append(row)
        if last is not None:
            state.update(last)
        yield pd.DataFrame(kept, columns=rows.columns)

    return points.select("sensor_id", "us", "value", "quality").groupBy("sensor_id").applyInPandasWithState(keep, METRICS, "value double, quality int", "append", GroupStateTimeout.NoTimeout)


def liveness(points: DataFrame, silent_ms: int) -> DataFrame:
    """sensor_id, last_us, online: a row when a sensor is heard of, and one when it has been silent.

    The arrival clock decides; the newest sample time is tracked beside it. Spark asks for batch after batch
    where processing-time timers are in use, so an available-now query of this stream never ends by
    itself; run it with a processing-time trigger and stop it.
    """

    def watch(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({"sensor_id": [key[0]], "last_us": [last], "online": [False]})
            return
        newest = max(int(b["us"].max()) for b in batches)
        last = max(newest, state.get[0]) if state.exists else newest
        state.update((last,))
        state.setTimeoutDuration(silent_ms)
        yield pd.DataFrame({"sensor_id": [key[0]], "last_us": [last], "online": [True]})

    return points.select("sensor_id", "us").groupBy("sensor_id").applyInPandasWithState(watch, "sensor_id string, last_us long, online boolean", "last_us long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def acknowledged(messages: DataFrame) -> DataFrame:
    """stream_id, acked: the number up to which every message of ``messages(stream_id, seq, end_seq)``
    has come; a row with end_seq is a range that was lost and counts as come. Numbers begin at 1."""

    def advance(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        acked, pending = (state.get[0], {tuple(p) for p in zip(state.get[1], state.get[2], strict=True)}) if state.exists else (0, set())
        for batch in batches:
            pending |= {(int(a), int(a if pd.isna(b) else b)) for a, b in zip(batch["seq"], batch["end_seq"], strict=True)}
        rest = []
        for a, b in sorted(pending):
            if a <= acked + 1:
                acked = max(acked, b)
            else:
                rest.append((a, b))
        state.update((acked, [a for a, _ in rest], [b for _, b in rest]))
        yield pd.DataFrame({"stream_id": [key[0]], "acked": [acked]})

    return messages.select("stream_id", "seq", "end_seq").groupBy("stream_id").applyInPandasWithState(advance, "stream_id string, acked long", "acked long, a array<long>, b array<long>", "append", GroupStateTimeout.NoTimeout)


def run_all(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now, and return its rows (memory sink; for tests and reports)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
