"""Alarm rules: conditions as columns, firing with debounce and hysteresis, incidents, backtests.

A condition is a nested dict (as stored in JSON) that becomes one boolean column over the frame of
a target's facts. A missing value makes a comparison false; ``offline`` is true for targets that
were never seen.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.quantiles import quantiles
from tidewell.operators.selection import greedy
from tidewell.operators.sliding import rolling_percentiles
from tidewell.operators.windows import previous

MAX_DEPTH, MAX_NODES = 6, 30
EPSILON = 2.220446049250313e-16
_COMPARE = {
    "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "eq": lambda a, b: F.abs(a - b) <= EPSILON,
}


def validate(node: dict[str, Any], depth: int = 1) -> int:
    """The number of nodes of a condition; ValueError if it is not well-formed."""
    if depth > MAX_DEPTH:
        raise ValueError(f"conditions are at most {MAX_DEPTH} deep")
    kind = node.get("type")
    for key in ("value", "low", "high", "seconds", "amount"):
        if key in node and not math.isfinite(node[key]):
            raise ValueError(f"{kind}: {key} is not finite")
    if kind == "range" and not node["low"] < node["high"]:
        raise ValueError("range: low is below high")
    if kind in ("all", "any"):
        if not node.get("of"):
            raise ValueError(f"{kind}: needs a condition")
        total = 1 + sum(validate(c, depth + 1) for c in node["of"])
    elif kind == "not":
        total = 1 + validate(node["of"], depth + 1)
    elif kind in ("threshold", "range", "offline", "rolling_window", "deviation"):
        total = 1
    else:
        raise ValueError(f"unknown condition {kind!r}")
    if total > MAX_NODES:
        raise ValueError(f"conditions have at most {MAX_NODES} nodes")
    return total


def condition(node: dict[str, Any], value: str = "value", now: str = "now", seen: str = "last_seen") -> Column:
    """The condition as a boolean column, never null.

    rolling_window and deviation read the columns ``<stat>_<seconds>`` of ``window_facts``.
    """
    kind = node["type"]
    if kind == "threshold":
        out = _COMPARE[node["op"]](F.col(value), F.lit(float(node["value"])))
    elif kind == "range":
        inside = (F.col(value) >= node["low"]) & (F.col(value) <= node["high"])
        out = inside if node.get("mode", "inside") == "inside" else ~inside
    elif kind == "offline":
        out = F.col(seen).isNull() | ((F.col(now) - F.col(seen)) > node["seconds"])
    elif kind == "rolling_window":
        out = _COMPARE[node["op"]](F.col(f"{node['stat']}_{node['seconds']}"), F.lit(float(node["value"])))
    elif kind == "deviation":
        base = F.col(f"{node.get('baseline', 'mean')}_{node['seconds']}")
        apart = F.abs(F.col(value) - base)
        out = apart > node["amount"] if node.get("mode", "absolute") == "absolute" else (F.abs(base) > EPSILON) & (100 * apart / F.nullif(F.abs(base), F.lit(0.0)) > node["amount"])
    elif kind == "not":
        return ~condition(node["of"], value, now, seen)
    else:
        parts = [condition(c, value, now, seen) for c in node["of"]]
        return reduce((lambda a, b: a & b) if kind == "all" else (lambda a, b: a | b), parts)
    return F.coalesce(out, F.lit(False))


def consecutive(states: DataFrame, count: int, period: str = "eval", interval: int = 3600) -> DataFrame:
    """sensor_id, bucket, streak, met: has the condition held in ``count`` successive periods?

    states: sensor_id, bucket, met. period: ``eval`` counts evaluations; ``hour`` and ``day`` count those periods,
    once each, a missing one breaking the streak. An evaluation that is not met sets the streak to zero.
    Neighbours come from chunks of time, and runs of states are what is numbered.
    """
    width = {"eval": None, "hour": 3600, "day": 86_400}[period]
    steps = previous(states.select("sensor_id", "bucket", "met"), ["sensor_id"], "bucket", ["bucket", "met"], chunk=interval * 4096)
    now = F.col("bucket") if width is None else F.floor(F.col("bucket") / width)
    before = F.col("prev_bucket") if width is None else F.floor(F.col("prev_bucket") / width)
    goes_on = F.col("met") & F.coalesce("prev_met", F.lit(False)) & (F.lit(True) if width is None else (now - before <= 1))
    adds = F.when(~F.col("met"), 0).when(~goes_on, 1).otherwise(1 if width is None else now - before)
    chunk = F.floor(F.col("bucket") / (interval * 4096))
    marked = steps.select("sensor_id", "bucket", "met", adds.cast("long").alias("_add"), (~goes_on).alias("_new"), chunk.alias("_c"))
    inside = Window.partitionBy("sensor_id", "_c").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("_sum", F.sum("_add").over(inside)).withColumn("_base", F.max(F.when(F.col("_new"), F.col("_sum") - F.col("_add"))).over(inside))
    # What a chunk adds to a streak that is open at its end, and whether that began before it.
    ends = marked.groupBy("sensor_id", "_c").agg(F.max("_sum").alias("_all"), F.max("_base").alias("_from"))
    by_chunk = Window.partitionBy("sensor_id").orderBy("_c")
    ends = ends.withColumn("_open", F.col("_all") - F.coalesce("_from", F.lit(0))).withColumn("_run", F.sum(F.col("_from").isNotNull().cast("long")).over(by_chunk))
    ends = ends.withColumn("_reach", F.sum("_open").over(Window.partitionBy("sensor_id", "_run").orderBy("_c")))
    ends = ends.select("sensor_id", "_c", F.coalesce(F.lag("_reach").over(by_chunk), F.lit(0)).alias("_carry"))
    streak = F.when(F.col("met"), F.col("_sum") - F.coalesce("_base", -F.col("_carry"))).otherwise(0)
    return marked.join(ends, ["sensor_id", "_c"]).select("sensor_id", "bucket", streak.cast("long").alias("streak"), (streak >= count).alias("met"))


def targets(sensors: DataFrame, selector: dict[str, Any]) -> DataFrame:
    """target_key, sensor_id, node_id: the sensors that a rule looks at, of ``sensors(sensor_id, node_id, type, config,
    deleted_at)``.

    selector: {"kind": "sensor", "sensor_id"}, {"kind": "sensor_set", "sensor_ids"}, {"kind": "node_sensors", "node_id",
    "types"} or {"kind": "filter", "provider", "metric", "type"} (what is absent does not restrict). With
    "match" ``any`` or ``all`` they are one target; by default each is its own. Deleted sensors are none.
    """
    rows = sensors.where(F.col("deleted_at").isNull())
    kind = selector["kind"]
    if kind == "sensor":
        rows = rows.where(F.col("sensor_id") == selector["sensor_id"].strip())
    elif kind == "sensor_set":
        rows = rows.where(F.col("sensor_id").isin([s.strip() for s in selector["sensor_ids"] if s.strip()]))
    elif kind == "node_sensors":
        types = [t.strip() for t in selector.get("types", ()) if t.strip()]
        rows = rows.where(F.col("node_id") == selector["node_id"])
        rows = rows.where(F.col("type").isin(types)) if types else rows
    elif kind == "filter":
        for key in ("provider", "metric"):
            if selector.get(key):
                rows = rows.where(F.nullif(F.trim(F.get_json_object(F.coalesce("config", F.lit("{}")), f"$.{key}")), F.lit("")) == selector[key])
        rows = rows.where(F.col("type") == selector["type"]) if selector.get("type") else rows
    else:
        raise ValueError(f"unknown selector {kind!r}")
    match = selector.get("match", "per_sensor")
    key = F.concat(F.lit("sensor:"), "sensor_id") if match == "per_sensor" else F.lit(f"selector:{match}")
    return rows.select(key.alias("target_key"), "sensor_id", "node_id")


def met_targets(states: DataFrame, match: str = "per_sensor") -> DataFrame:
    """target_key, met: of ``states(target_key, sensor_id, met)``; without a sample a target is not met."""
    met = F.coalesce("met", F.lit(False))
    return states.groupBy("target_key").agg((F.bool_and(met) if match == "all" else F.bool_or(met)).alias("met"))


def window_facts(buckets: DataFrame, seconds: list[int], value: str = "agg_value", stats: set[tuple[str, int]] | None = None) -> DataFrame:
    """``buckets`` with mean, min, max, stddev (null for one value) and median of each trailing window (t - seconds, t],
    or those of ``stats`` only.

    A series is cut into chunks of at least the window's length, each of which also gets the rows of the
    chunk before that its first windows reach back to; a task holds two chunks, however long the series is.
    """
    out = buckets
    for s in seconds:
        size = 64 * s
        chunk = F.floor(F.col("bucket") / size)
        back = F.when(F.pmod(F.col("bucket"), F.lit(size)) >= size - s, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
        spread = out.withColumn("_c", F.explode(back))
        w = Window.partitionBy("sensor_id", "_c").orderBy("bucket").rangeBetween(1 - s, 0)
        every = {"mean": F.avg(value).over(w), "min": F.min(value).over(w), "max": F.max(value).over(w), "stddev": F.when(F.count(value).over(w) >= 2, F.stddev_pop(value).over(w))}
        for name, stat in every.items():
            if stats is None or (name, s) in stats:
                spread = spread.withColumn(f"{name}_{s}", stat)
        out = spread.where(F.col("_c") == chunk).drop("_c")
        if stats is None or ("median", s) in stats:
            out = rolling_percentiles(out, ["sensor_id"], "bucket", value, s, [0.5], "_p").withColumn(f"median_{s}", F.col("_p")[0]).drop("_p")
    return out


def firing(states: DataFrame, interval: int, debounce: int = 0, clear: int = 0) -> DataFrame:
    """sensor_id, start, end: when a target fires. states: sensor_id, bucket, met.

    It fires once the condition has held for ``debounce`` seconds, and clears once it has not held
    for ``clear`` seconds (end null: still firing). States are known at the end of their bucket.
    Runs of equal states are what is ordered, not the states.
    """
    w = Window.partitionBy("sensor_id").orderBy("bucket")
    runs = states.withColumn("_f", F.when(F.col("met") == F.lag("met").over(w), 0).otherwise(1)).withColumn("_run", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("sensor_id", "_run").agg(F.first("met").alias("met"), F.min("bucket").alias("a"), F.max("bucket").alias("b"))
    held = F.col("b") - F.col("a")
    turns = runs.where(F.when(F.col("met"), held >= debounce).otherwise(held >= clear))
    at = F.col("a") + interval + F.when(F.col("met"), debounce).otherwise(clear)
    turns = turns.select("sensor_id", "_run", "met", at.alias("at"))
    by_run = Window.partitionBy("sensor_id").orderBy("_run")
    changes = turns.withColumn("_was", F.coalesce(F.lag("met").over(by_run), F.lit(False))).where(F.col("met") != F.col("_was"))
    out = changes.withColumn("end", F.lead("at").over(by_run)).where("met")
    return out.select("sensor_id", F.col("at").alias("start"), "end")


def backtest(buckets: DataFrame, node: dict[str, Any], interval: int, debounce: int = 0, clear: int = 0, value: str = "agg_value") -> DataFrame:
    """The firing intervals of a rule over past buckets."""
    validate(node)
    stats = _windows(node)
    facts = window_facts(buckets, sorted({s for _, s in stats}), value, stats)
    return firing(facts.select("sensor_id", "bucket", condition(node, value).alias("met")), interval, debounce, clear)


def durations(firings: DataFrame, until: int) -> DataFrame:
    """sensor_id, firings, open, total_s, mean_s, least_s, most_s, p50_s, p95_s of ``firings(sensor_id, start, end)``; one that is
    still firing lasts to ``until``."""
    d = firings.select("sensor_id", F.col("end").isNull().cast("int").alias("open"), (F.coalesce("end", F.lit(until)) - F.col("start")).alias("s"))
    sums = d.groupBy("sensor_id").agg(F.count("*").alias("firings"), F.sum("open").alias("open"), F.sum("s").alias("total_s"), F.avg("s").alias("mean_s"), F.min("s").alias("least_s"), F.max("s").alias("most_s"))
    q = quantiles(d, ["sensor_id"], "s", [0.5, 0.95])
    return sums.join(q, "sensor_id").select("sensor_id", "firings", "open", "total_s", "mean_s", "least_s", "most_s", F.col("_q")[0].alias("p50_s"), F.col("_q")[1].alias("p95_s"))


def with_cooldown(alarms: DataFrame, keys: list[str], time: str, seconds: int = 300) -> DataFrame:
    """Of ``alarms`` those that are raised: the first of each key, and then each that comes ``seconds`` or more after the last raised."""
    return greedy(alarms, keys, time, seconds - 1, [F.col(time)])


def _windows(node: dict[str, Any]) -> set[tuple[str, int]]:
    """(statistic, seconds) of the windows that a condition reads."""
    if node["type"] == "rolling_window":
        return {(node["stat"], node["seconds"])}
    if node["type"] == "deviation":
        return {(node.get("baseline", "mean"), node["seconds"])}
    below = node.get("of", [])
    return set().union(*(_windows(c) for c in (below if isinstance(below, list) else [below])))


def incidents(events: DataFrame, keys: list[str], time: str, severity: str, resolved: str, gap: int = 1800) -> DataFrame:
    """keys, start, end, events, severity: events at most ``gap`` apart; a resolution joins its incident however late.

    Of events at one time the resolutions come last, so the incidents do not depend on the order of rows.
    """
    w = Window.partitionBy(*keys).orderBy(time, F.coalesce(resolved, F.lit(True)))
    fresh = F.when(F.lag(time).over(w).isNull() | ((F.col(time) - F.lag(time).over(w) > gap) & ~F.col(resolved)), 1).otherwise(0)
    numbered = events.withColumn("_n", fresh).withColumn("_i", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_i").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("events"), F.max(severity).alias("severity")).drop("_i")
