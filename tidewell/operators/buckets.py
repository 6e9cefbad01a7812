"""Bucketed aggregation of ``metrics`` and what is computed from buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.model import US
from tidewell.operators.quantiles import quantiles
from tidewell.operators.windows import previous

# The modes, and below the sensor types that each is for, in order of precedence.
MODES = ("avg", "last", "sum", "min", "max")


def bucket_of(interval: int, us: str = "us") -> Column:
    """Start of the bucket, in seconds since the epoch."""
    return (F.floor(F.col(us) / F.lit(interval * US)) * interval).cast("long")


def _aggregate(mode: str) -> Column:
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {', '.join(MODES)}")
    return F.max_by("value", "us") if mode == "last" else getattr(F, mode)("value")


def bucket_agg(metrics: DataFrame, interval: int, mode: str = "avg", good_only: bool = False, min_samples: int = 0) -> DataFrame:
    """sensor_id, bucket, agg_value, samples. Ties of ``last`` go to either row of that time."""
    if good_only:
        metrics = metrics.where(F.coalesce("quality", F.lit(0)) == 0)
    out = metrics.groupBy("sensor_id", bucket_of(interval).alias("bucket")).agg(_aggregate(mode).alias("agg_value"), F.count("*").alias("samples"))
    return out.where(F.col("samples") >= min_samples) if min_samples > 1 else out


def normal_type(name: str) -> Column:
    """A sensor type in lower case, with underscores for spaces and hyphens."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(F.col(name), F.lit("")))), "[ -]", "_")


def mode_of_type(name: str) -> Column:
    """Bucket mode by sensor type; the first rule that matches."""
    t = normal_type(name)
    has = lambda *parts: F.lit(False) if not parts else _any([t.contains(p) for p in parts])
    return (
        F.when(t == "", "avg")
        .when(has("wind_direction") | (has("wind") & has("direction")), "last")
        .when(has("rain_rate", "rainrate"), "avg")
        .when(has("rain", "precip") & has("gauge", "tip", "pulse", "counter"), "sum")
        .when((t == "rain") | has("daily_rain", "rain_daily", "cumulative_rain", "rain_cumulative"), "last")
        .when(has("pulse", "flow", "counter"), "sum")
        .when(has("state", "status", "bool", "switch", "contact", "mode"), "last")
        .when(has("rain", "precip"), "sum")
        .otherwise("avg")
    )


def delta_mode_of_type(name: str) -> Column:
    """How differences of a type are taken: linear, circular (of 360) or reset."""
    t = normal_type(name)
    rain_total = (t == "rain") | _any([t.contains(p) for p in ("daily_rain", "rain_daily", "cumulative_rain", "rain_cumulative")])
    wind = t.contains("wind_direction") | (t.contains("wind") & t.contains("direction"))
    other = _any([t.contains(p) for p in ("rain_rate", "rainrate")]) | (_any([t.contains("rain"), t.contains("precip")]) & _any([t.contains(p) for p in ("gauge", "tip", "pulse", "counter")]))
    return F.when(wind, "circular").when(rain_total & ~other, "reset").otherwise("linear")


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def bucket_auto(metrics: DataFrame, interval: int, type_column: str) -> DataFrame:
    """Buckets by each sensor's own mode, in one scan."""
    out = metrics.groupBy("sensor_id", F.col(type_column).alias("type"), bucket_of(interval).alias("bucket")).agg(
        F.avg("value").alias("a"), F.max_by("value", "us").alias("l"), F.sum("value").alias("s"), F.count("*").alias("samples")
    )
    mode = mode_of_type("type")
    return out.select("sensor_id", "bucket", F.when(mode == "last", F.col("l")).when(mode == "sum", F.col("s")).otherwise(F.col("a")).alias("agg_value"), "samples")


def coverage_stats(buckets: DataFrame, interval: int, gap: int = 5) -> DataFrame:
    """sensor_id, bucket_rows, delta_count: buckets, and pairs of neighbours at most ``gap`` intervals apart."""
    steps = previous(buckets.select("sensor_id", "bucket").distinct(), ["sensor_id"], "bucket", ["bucket"], chunk=interval * 4096)
    near = (F.col("bucket") - F.col("prev_bucket")) <= gap * interval
    return steps.groupBy("sensor_id").agg(F.count("*").alias("bucket_rows"), F.count(F.when(near, 1)).alias("delta_count"))


def coverage_percent(buckets: DataFrame, interval: int, start: int, end: int) -> DataFrame:
    """sensor_id, buckets, expected, coverage_pct over the grid of [start, end) in seconds."""
    first, last = start // interval, -(-end // interval)
    expected = max(0, last - first)
    inside = buckets.where((F.col("bucket") >= first * interval) & (F.col("bucket") < end))
    n = F.countDistinct("bucket")
    return inside.groupBy("sensor_id").agg(n.alias("buckets"), F.lit(expected).cast("long").alias("expected"), (100.0 * n / F.lit(float(max(1, expected)))).alias("coverage_pct"))


def integrate(metrics: DataFrame, until_us: int) -> DataFrame:
    """sensor_id, kwh: left Riemann sum of watts; the last sample lasts until ``until_us``."""
    from tidewell.operators.windows import following

    steps = following(metrics.where(F.col("us") <= until_us), ["sensor_id"], "us", ["us"], chunk=86_400 * US)
    hours = (F.coalesce("next_us", F.lit(until_us)) - F.col("us")) / F.lit(3600.0 * US)
    return steps.groupBy("sensor_id").agg(F.round(F.sum(F.col("value") * hours) / 1000, 3).alias("kwh"))


def latest(df: DataFrame, keys: list[str], order: list[str], columns: list[str], first: bool = False) -> DataFrame:
    """The newest (or oldest) row of each key, by partial aggregation; ties go to the greater columns."""
    rank = F.struct(*order, *columns)
    pick = (F.min if first else F.max)(rank)
    return df.groupBy(*keys).agg(pick.alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in dict.fromkeys([*order, *columns])))


def robust_scale(metrics: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, n, median, scale: 1.4826 MAD, else IQR / 1.349, else 1; null for under three values."""
    middle = quantiles(metrics, keys, value, [0.25, 0.5, 0.75])
    apart = metrics.join(middle, keys).select(*keys, F.abs(F.col(value) - F.col("_q")[1]).alias("_apart"))
    spread = quantiles(apart, keys, "_apart", [0.5], "_mad").select(*keys, F.col("_mad")[0].alias("mad"))
    out = middle.join(spread, keys)
    iqr = F.col("_q")[2] - F.col("_q")[0]
    scale = F.when(F.col("n") < 3, None).when(F.col("mad") * 1.4826 > 1e-9, F.col("mad") * 1.4826).when(iqr / 1.349 > 1e-9, iqr / 1.349).otherwise(1.0)
    return out.select(*keys, "n", F.col("_q")[1].alias("median"), "mad", iqr.alias("iqr"), scale.alias("scale"))
