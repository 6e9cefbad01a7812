"""Neighbouring rows of a series without gathering the series in one task.

``previous`` and ``following`` cut each series into chunks of time. Within a chunk they are window
functions; the neighbour beyond a chunk's edge comes from a table that holds one row for each
chunk. A series of any length is thus spread over as many tasks as it has chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.model import US


def _neighbour(df: DataFrame, keys: list[str], order: str, columns: list[str], chunk: int, back: bool, label: str) -> DataFrame:
    cut = df.withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk)))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order)
    step = F.lag if back else F.lead
    values = F.struct(*(F.col(c) for c in columns))
    edge = (F.max_by if back else F.min_by)(values, order)
    edges = cut.groupBy(*keys, "_chunk").agg(edge.alias("_v"))
    across = Window.partitionBy(*keys).orderBy("_chunk")
    edges = edges.select(*keys, "_chunk", step("_v").over(across).alias("_edge"))
    found = cut.withColumn("_in", step(values).over(inside)).join(edges, [*keys, "_chunk"])
    near = F.coalesce("_in", "_edge")
    return found.select(*df.columns, *(near[c].alias(f"{label}_{c}") for c in columns))


def previous(df: DataFrame, keys: list[str], order: str, columns: list[str], chunk: int) -> DataFrame:
    """``df`` with prev_<column> of the row before; ``order`` is unique within ``keys``."""
    return _neighbour(df, keys, order, columns, chunk, True, "prev")


def following(df: DataFrame, keys: list[str], order: str, columns: list[str], chunk: int) -> DataFrame:
    """``df`` with next_<column> of the row after."""
    return _neighbour(df, keys, order, columns, chunk, False, "next")


def difference(mode: str, now: Column, before: Column, period: float = 360.0) -> Column:
    """now - before: linear, circular into (-period/2, period/2], or never below zero (reset)."""
    plain = now - before
    if mode == "linear":
        return plain
    if mode == "reset":
        return F.when(plain.isNotNull(), F.greatest(plain, F.lit(0.0)))
    if mode == "circular":
        turned = F.pmod(plain, F.lit(period))
        return F.when(turned > period / 2, turned - period).otherwise(turned)
    raise ValueError(f"unknown difference mode {mode!r}")


def deltas(buckets: DataFrame, interval: int, gap: int = 0, mode: str = "linear", value: str = "agg_value") -> DataFrame:
    """sensor_id, bucket, delta, dt: differences of neighbours at most ``gap`` intervals apart (0: any)."""
    steps = previous(buckets, ["sensor_id"], "bucket", ["bucket", value], chunk=interval * 4096)
    out = steps.select("sensor_id", "bucket", difference(mode, F.col(value), F.col(f"prev_{value}")).alias("delta"), (F.col("bucket") - F.col("prev_bucket")).alias("dt"))
    out = out.where(F.col("delta").isNotNull())
    return out.where(F.col("dt") <= gap * interval) if gap else out


def second_deltas(buckets: DataFrame, interval: int, gap: int = 5, value: str = "agg_value") -> DataFrame:
    """sensor_id, bucket, delta2: differences of successive deltas, both steps within the gap."""
    first = previous(buckets, ["sensor_id"], "bucket", ["bucket", value], chunk=interval * 4096)
    d = first.select("sensor_id", "bucket", (F.col(value) - F.col(f"prev_{value}")).alias("delta"), (F.col("bucket") - F.col("prev_bucket")).alias("dt"))
    both = previous(d, ["sensor_id"], "bucket", ["delta", "dt"], chunk=interval * 4096)
    near = (F.col("dt") <= gap * interval) & (F.col("prev_dt") <= gap * interval)
    return both.where(near).select("sensor_id", "bucket", (F.col("delta") - F.col("prev_delta")).alias("delta2"))


def trailing_average(buckets: DataFrame, step: int, interval: int, value: str = "agg_value") -> DataFrame:
    """sensor_id, bucket, trailing_mean: mean of the ``step`` buckets of the grid that end at each one.

    Each bucket is sent to the ``step`` anchors it counts for, so series are not gathered.
    """
    anchors = buckets.select("sensor_id", F.col("bucket").alias("anchor"))
    sent = buckets.select("sensor_id", value, F.explode(F.sequence(F.lit(0), F.lit(step - 1))).alias("k"), "bucket").withColumn("anchor", F.col("bucket") + F.col("k") * interval)
    return anchors.join(sent.groupBy("sensor_id", "anchor").agg(F.avg(value).alias("trailing")), ["sensor_id", "anchor"]).select("sensor_id", F.col("anchor").alias("bucket"), F.col("trailing").alias("trailing_mean"))


def rolling_mean_at(metrics: DataFrame, width: int, every: int) -> DataFrame:
    """sensor_id, emit, value, samples: mean over (emit - width, emit] at multiples of ``every`` seconds."""
    us_every, us_width = every * US, width * US
    first = F.ceil(F.col("us") / us_every) * us_every
    last = F.floor((F.col("us") + us_width - 1) / us_every) * us_every
    spread = metrics.where(last >= first).withColumn("emit", F.explode(F.sequence(first, last, F.lit(us_every))))
    return spread.groupBy("sensor_id", F.expr(f"emit div {US}").alias("emit")).agg(F.avg("value").alias("value"), F.count("*").alias("samples"))


def hour_residual(buckets: DataFrame, value: str = "agg_value", horizon: int | None = None) -> DataFrame:
    """sensor_id, bucket, residual: values less the sensor's mean for that hour of the day.

    horizon: the seconds that are looked at; under two days there are no hours to compare, and the values stay as they are.
    """
    if horizon is not None and horizon < 2 * 86_400:
        return buckets.select("sensor_id", "bucket", F.col(value).alias("residual"))
    hour = F.expr("(bucket div 3600) % 24")
    means = buckets.groupBy("sensor_id", hour.alias("hour")).agg(F.avg(value).alias("mean"))
    return buckets.withColumn("hour", hour).join(means, ["sensor_id", "hour"]).select("sensor_id", "bucket", (F.col(value) - F.col("mean")).alias("residual"))


def dense_grid(buckets: DataFrame, interval: int, value: str = "agg_value") -> DataFrame:
    """Every bucket between each sensor's first and last, null where there is none."""
    span = buckets.groupBy("sensor_id").agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    grid = span.select("sensor_id", F.explode(F.sequence("lo", "hi", F.lit(interval))).alias("bucket"))
    return grid.join(buckets.select("sensor_id", "bucket", value), ["sensor_id", "bucket"], "left")


def average_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``df`` with avg_rank (1-based, ties share their mean), from counts of distinct values."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranks = counts.select(*keys, value, (before - (F.col("_c") - 1) / 2).alias("avg_rank"))
    return df.join(ranks, [*keys, value])


def stride_downsample(df: DataFrame, keys: list[str], order: str, stride: int) -> DataFrame:
    """Every ``stride``-th row of each series, and always its last."""
    w = Window.partitionBy(*keys).orderBy(order)
    numbered = df.withColumn("_n", F.row_number().over(w)).withColumn("_last", F.lead(order).over(w).isNull())
    return numbered.where(((F.col("_n") - 1) % stride == 0) | F.col("_last")).drop("_n", "_last")


def rolling_pearson(pairs: DataFrame, keys: list[str], order: str, x: str, y: str, rows: int) -> DataFrame:
    """keys, order, r of the ``rows`` rows that end at each; rows without a defined r are left out."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - rows, 0)
    s = lambda c: F.sum(c).over(w)
    a, b = F.col(x), F.col(y)
    out = pairs.select(*keys, order, F.count("*").over(w).alias("n"), s(a).alias("sx"), s(b).alias("sy"), s(a * a).alias("sxx"), s(b * b).alias("syy"), s(a * b).alias("sxy")).where(F.col("n") == rows)
    from tidewell.functions.stats import pearson_of_sums

    return out.select(*keys, order, pearson_of_sums().alias("r")).where(F.col("r").isNotNull())
