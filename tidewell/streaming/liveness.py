"""Which nodes and sensors are online: a state for each node, and timers for when it would be silent for too long.

A sensor is silent after five of its intervals, a node after the longest such time of its sensors or five of its heartbeats;
never before a floor. A sensor that only reports changes may be silent as long as its node is online. A node that goes
offline takes its sensors with it; whatever is heard of comes online again.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# How many intervals of silence mean offline; the least for nodes and for sensors that report changes.
INTERVALS, NODE_FLOOR_MS, CHANGES_FLOOR_MS = 5, 15_000, 300_000
SIGNALS = "node_id string, sensor_id string, us long, interval_s double, rolling_s double, heartbeat_s double"
STATES = "node_id string, sensor_id string, at_ms long, online boolean"


def sensor_threshold(interval_s: float | None, rolling_s: float | None, floor_ms: int) -> int:
    """Milliseconds of silence after which a sensor is offline."""
    for seconds in (interval_s, rolling_s):
        if seconds is not None and seconds > 0:
            return max(floor_ms, round(seconds * INTERVALS * 1000))
    return max(floor_ms, CHANGES_FLOOR_MS)


def reports_changes(interval_s: float | None, rolling_s: float | None) -> bool:
    return not (interval_s or 0) > 0 and not (rolling_s or 0) > 0


def node_threshold(sensors: list[int], heartbeat_s: float | None, floor_ms: int) -> int:
    """Milliseconds of silence after which a node is offline. sensors: the thresholds of its sensors."""
    floor = max(floor_ms, NODE_FLOOR_MS)
    beat = round(heartbeat_s * INTERVALS * 1000) if heartbeat_s is not None and heartbeat_s > 0 else 0
    return max(floor, beat, *(sensors or [floor]))


class Watch(StatefulProcessor):
    """The state of one node: when it was heard of, and (last heard of, interval, rolling interval, online) of each sensor."""

    def __init__(self, floor_ms: int, arrival: bool):
        self.floor_ms, self.arrival = floor_ms, arrival

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.node = handle.getValueState("node", "seen_ms long, heartbeat_s double, online boolean, timer_ms long")
        self.sensors = handle.getMapState("sensors", "sensor_id string", "seen_ms long, interval_s double, rolling_s double, online boolean")

    def _now(self, timers: Any) -> int:
        return timers.getCurrentProcessingTimeInMs() if self.arrival else timers.getCurrentWatermarkInMs()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen, beat, online, timer = self.node.get() if self.node.exists() else (0, None, False, None)
        known = {k[0]: list(v) for k, v in self.sensors.iterator()}
        # Silence up to now comes before what is new: timers of this batch run after it.
        online, out = self._expired(self._now(timerValues), seen, beat, online, known)
        signals = pd.concat(list(rows)).sort_values("us", kind="stable")
        value = lambda x: None if pd.isna(x) else float(x)
        for row in signals.itertuples(index=False):
            at = self._now(timerValues) if self.arrival else int(row.us) // 1000
            seen, beat = max(seen, at), value(row.heartbeat_s) if value(row.heartbeat_s) is not None else beat
            if not online:
                online = True
                out.append((None, at, True))
            if row.sensor_id is not None and not pd.isna(row.sensor_id):
                old = known.get(row.sensor_id, [0, None, None, False])
                if not old[3]:
                    out.append((row.sensor_id, at, True))
                interval, rolling = value(row.interval_s), value(row.rolling_s)
                known[row.sensor_id] = [max(old[0], at), old[1] if interval is None else interval, old[2] if rolling is None else rolling, True]
        yield self._written(key, seen, beat, online, timer, known, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.node.exists():
            return
        seen, beat, online, _ = self.node.get()
        known = {k[0]: list(v) for k, v in self.sensors.iterator()}
        online, out = self._expired(expiredTimerInfo.getExpiryTimeInMs(), seen, beat, online, known)
        yield self._written(key, seen, beat, online, None, known, out)

    def _expired(self, now: int, seen: int, beat: float | None, online: bool, known: dict[str, list[Any]]) -> tuple[bool, list[tuple[str | None, int, bool]]]:
        """Is the node still online, and what has gone offline by ``now``, one moment after the other."""
        out: list[tuple[str | None, int, bool]] = []
        while (moment := self._due(seen, beat, online, known)) is not None and moment <= now:
            if online and moment > seen + self._node_limit(beat, known):
                online = False
                out.append((None, moment, False))
            for name, s in known.items():
                if s[3] and (not online or (not reports_changes(s[1], s[2]) and moment > s[0] + sensor_threshold(s[1], s[2], self.floor_ms))):
                    s[3] = False
                    out.append((name, moment, False))
        return online, out

    def _due(self, seen: int, beat: float | None, online: bool, known: dict[str, list[Any]]) -> int | None:
        """The next moment at which something goes offline if nothing is heard."""
        due = [seen + self._node_limit(beat, known) + 1] if online else []
        due += [s[0] + sensor_threshold(s[1], s[2], self.floor_ms) + 1 for s in known.values() if s[3] and not reports_changes(s[1], s[2])]
        return min(due, default=None)

    def _node_limit(self, beat: float | None, known: dict[str, list[Any]]) -> int:
        return node_threshold([sensor_threshold(s[1], s[2], self.floor_ms) for s in known.values()], beat, self.floor_ms)

    def _written(self, key: Any, seen: int, beat: float | None, online: bool, timer: int | None, known: dict[str, list[Any]], out: list[tuple[str | None, int, bool]]) -> pd.DataFrame:
        """Keep the state, set the timer for the next moment at which something may go offline, and report."""
        following = self._due(seen, beat, online, known)
        if timer is not None and timer != following:
            self.handle.deleteTimer(timer)
        if following is not None and timer != following:
            self.handle.registerTimer(following)
        self.node.update((seen, beat, online, following))
        for name, s in known.items():
            self.sensors.updateValue((name,), tuple(s))
        return pd.DataFrame({"node_id": pd.Series([key[0]] * len(out), dtype=object), "sensor_id": pd.Series([o[0] for o in out], dtype=object), "at_ms": pd.Series([o[1] for o in out], dtype="int64"), "online": pd.Series([o[2] for o in out], dtype=bool)})

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that keyed states with timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def states(signals: DataFrame, floor_s: int = 15, arrival: bool = True) -> DataFrame:
    """node_id, sensor_id (null: the node itself), at_ms, online: a row whenever that changes, of a stream ``signals(node_id,
    sensor_id, us, interval_s, rolling_s, heartbeat_s)``: points (with their sensor) and heartbeats (without).

    arrival: the clock at which signals come decides; else their own times do, and ``signals`` need a watermark.
    """
    return signals.groupBy("node_id").transformWithStateInPandas(Watch(floor_s * 1000, arrival), STATES, "Append", "ProcessingTime" if arrival else "EventTime")
