"""Functions of derived series, and derived series themselves.

A derived series is a Spark SQL expression, or a function of columns, over named inputs; Catalyst
parses and optimises it. A missing or non-finite input or result means that there is no row:
``least`` and ``greatest`` of Spark skip nulls, hence the n-ary functions here.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Formula = str | Callable[[Mapping[str, Column]], Column]


def finite(c: Column) -> Column:
    """The value, or null if it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def _strict(values: tuple[Column, ...], out: Column) -> Column:
    missing = reduce(lambda a, b: a | b, (v.isNull() for v in values))
    return F.when(~missing, out)


def n_min(*values: Column) -> Column:
    return _strict(values, F.least(*values)) if len(values) > 1 else values[0]


def n_max(*values: Column) -> Column:
    return _strict(values, F.greatest(*values)) if len(values) > 1 else values[0]


def n_sum(*values: Column) -> Column:
    return reduce(lambda a, b: a + b, values)


def n_avg(*values: Column) -> Column:
    return n_sum(*values) / len(values)


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    return _strict((x, low, high), F.least(F.greatest(x, low), high))


def divide(a: Column, b: Column) -> Column:
    """a / b, null for a zero divisor also where ANSI mode would raise."""
    return F.try_divide(a, b)


def root(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def natural_log(x: Column) -> Column:
    return F.when(x > 0, F.log(x))


def log_base(x: Column, base: Column | float) -> Column:
    base = base if isinstance(base, Column) else F.lit(float(base))
    return F.when((x > 0) & (base > 0) & (base != 1), F.log(x) / F.log(base))


def if_else(condition: Column, yes: Column, no: Column) -> Column:
    """yes for a condition that is true or a number other than 0; null for a null condition."""
    return F.when(condition.isNull(), None).when(condition.cast("boolean"), yes).otherwise(no)


# Scaling and units of sensor readings.


def linear(x: Column, scale: float = 1.0, offset: float = 0.0) -> Column:
    return x * scale + offset


def loop_depth(volts: Column, shunt_ohms: float, range_m: float, low_ma: float = 4.0, high_ma: float = 20.0) -> tuple[Column, Column]:
    """(depth, quality) of a 4-20 mA loop: quality 1 under 3.5 mA, 2 over 21 mA, 3 without a reading."""
    ma = volts / shunt_ohms * 1000
    depth = clamp((ma - low_ma) / (high_ma - low_ma), 0.0, 1.0) * range_m
    return depth, F.when(volts.isNull(), 3).when(ma < 3.5, 1).when(ma > 21.0, 2).otherwise(0)


def pulse_delta(total: Column, before: Column) -> Column:
    """Growth of a counter; its first reading and one after a reset count in full."""
    return F.when(before.isNull() | (total < before), total).otherwise(total - before)


def fahrenheit_to_celsius(x: Column) -> Column:
    return (x - 32) * 5 / 9


def mph_to_ms(x: Column) -> Column:
    return x * 0.44704


def inches_to_mm(x: Column) -> Column:
    return x * 25.4


def inhg_to_kpa(x: Column) -> Column:
    return x * 3.386389


def station_value(x: Column) -> Column:
    """Null for the sentinels of weather stations: non-finite, or 9990 and beyond."""
    return F.when(F.abs(finite(x)) < 9990, x)


# Derived series.


@dataclass
class Derived:
    """One derived series. inputs: name in the formula -> (sensor_id, lag in seconds, >= 0 for the past)."""

    sensor_id: str
    inputs: dict[str, tuple[str, int]]
    formula: Formula
    after: list[str] = field(default_factory=list)


def evaluate(buckets: DataFrame, derived: Derived, interval: int, value: str = "agg_value") -> DataFrame:
    """sensor_id, bucket, value, samples (1) of one derived series.

    Candidates are the buckets that any input has; an input with a lag is read at that much before,
    at the start of the bucket if that is within one. Each input is an equi-join on the bucket.
    """
    sources = sorted({s for s, _ in derived.inputs.values()})
    used = buckets.where(F.col("sensor_id").isin(sources)).select("sensor_id", "bucket", F.col(value).alias("v"))
    parts = [used.select(F.col("bucket"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("v"), F.lit(True).alias("here"))]
    for name, (sensor, lag) in derived.inputs.items():
        shifted = F.col("bucket") + (lag // interval + (1 if lag % interval else 0)) * interval
        parts.append(used.where(F.col("sensor_id") == sensor).select(shifted.alias("bucket"), F.lit(name).alias("name"), "v", F.lit(False).alias("here")))
    every = reduce(DataFrame.unionByName, parts)
    columns = [F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in derived.inputs]
    wide = every.groupBy("bucket").agg(F.max("here").alias("_here"), *columns).where("_here")
    out = F.expr(derived.formula) if isinstance(derived.formula, str) else derived.formula({n: F.col(n) for n in derived.inputs})
    known = reduce(lambda a, b: a & b, (F.col(n).isNotNull() for n in derived.inputs), F.lit(True))
    result = wide.where(known).select(F.lit(derived.sensor_id).alias("sensor_id"), "bucket", finite(out.cast("double")).alias(value), F.lit(1).cast("long").alias("samples"))
    return result.where(F.col(value).isNotNull())


def in_order(series: list[Derived]) -> list[Derived]:
    """Each series after those it is made of; a cycle is an error."""
    from graphlib import TopologicalSorter

    by_id = {d.sensor_id: d for d in series}
    order = TopologicalSorter({d.sensor_id: {s for s, _ in d.inputs.values() if s in by_id} for d in series}).static_order()
    return [by_id[s] for s in order]


def evaluate_all(buckets: DataFrame, series: list[Derived], interval: int, value: str = "agg_value") -> DataFrame:
    """All derived series, also of each other."""
    known, out = buckets.select("sensor_id", "bucket", value, "samples"), []
    for d in in_order(series):
        out.append(evaluate(known, d, interval, value))
        known = known.unionByName(out[-1])
    return reduce(DataFrame.unionByName, out)


def dependents(series: list[Derived], focus: str) -> set[str]:
    """Series that are made of ``focus``, directly or through others."""
    found = {focus}
    for d in in_order(series):
        if found & {s for s, _ in d.inputs.values()}:
            found.add(d.sensor_id)
    return found - {focus}
