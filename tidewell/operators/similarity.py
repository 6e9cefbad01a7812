"""Embeddings of series, nearest neighbours by cosine, candidate selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.quantiles import quantiles
from tidewell.operators.storage import stored
from tidewell.operators.windows import previous

# The windows of an embedding in seconds, back from the last bucket of a series; what a spike is.
WINDOWS = (300, 3600, 21_600, 86_400, 604_800, 2_592_000, 7_776_000)
CLIP, SPIKE, SPIKE_HIGH = 6.0, 2.5, 4.0
_ALWAYS = 1 << 62
_FEATURES, _SIGNATURE = 10, 4


def window_values(buckets: DataFrame, windows: tuple[int, ...] = WINDOWS, value: str = "agg_value", chunk: int = 4096 * 3600) -> DataFrame:
    """sensor_id, kind (v: values, d: changes a second), span, x: what each window of each series holds.

    A change belongs to the windows that hold both of its values; the last span holds everything. Series of
    under three values have no rows.
    """
    finite = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    points = stored(buckets.where(finite).groupBy("sensor_id", "bucket").agg(F.max(value).alias("v")))
    ends = points.groupBy("sensor_id").agg(F.max("bucket").alias("_end"), F.count("*").alias("_n")).where("_n >= 3")
    steps = previous(points, ["sensor_id"], "bucket", ["bucket", "v"], chunk).join(ends, "sensor_id")
    age, rate = F.col("_end") - F.col("bucket"), (F.col("v") - F.col("prev_v")) / F.greatest(F.lit(1), F.col("bucket") - F.col("prev_bucket"))
    spans = F.array(*(F.lit(w).cast("long") for w in (*windows, _ALWAYS)))
    both = F.array(F.struct(F.lit("v").alias("kind"), age.alias("age"), F.col("v").alias("x")), F.struct(F.lit("d").alias("kind"), (F.col("_end") - F.col("prev_bucket")).alias("age"), rate.alias("x")))
    long = steps.select("sensor_id", F.explode(both).alias("s")).where("s.age is not null")
    return long.select("sensor_id", "s.kind", F.explode(F.filter(spans, lambda w: w >= F.col("s.age"))).alias("span"), "s.x")


def features(buckets: DataFrame, windows: tuple[int, ...] = WINDOWS, clip: float = CLIP, spike: float = SPIKE, high: float = SPIKE_HIGH, value: str = "agg_value") -> DataFrame:
    """sensor_id, kind, span, n, ten robust features and the shares of spikes of what each window holds.

    Percentiles come from two calls of ``quantiles`` (of the values, and of their distances from the median) over
    one stored table; the clipped z-scores rise with that distance, so their percentile is read off its ranks.
    """
    keys = ["sensor_id", "kind", "span"]
    spread = stored(window_values(buckets, windows, value))
    first = quantiles(spread, keys, "x", [0.05, 0.25, 0.5, 0.75, 0.95])
    moments = spread.groupBy(*keys).agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    middle = stored(first.where("n >= 3").join(moments, keys))
    apart = stored(spread.join(middle.select(*keys, F.col("_q")[2].alias("m")), keys).select(*keys, F.abs(F.col("x") - F.col("m")).alias("a")))
    second = quantiles(apart, keys, "a", [0.5, 0.95], "_a", ranks=True).drop("n")
    q, mad = F.col("_q"), F.col("_a")[0]
    iqr = q[3] - q[1]
    scaled = middle.join(second, keys).withColumn("scale", F.when(mad > 1e-9, mad * 1.4826).when(iqr > 1e-9, iqr / 1.349).otherwise(1.0))
    scaled = stored(scaled)
    z = F.least(F.lit(clip), F.col("a") / F.col("scale"))
    rates = apart.join(scaled.select(*keys, "scale"), keys).groupBy(*keys).agg(F.avg(z).alias("z_mean"), F.max(z).alias("z_most"), F.avg((z >= spike).cast("double")).alias("spikes"), F.avg((z >= high).cast("double")).alias("high_spikes"))
    low, top = (F.least(F.lit(clip), F.col(f"_a_{side}")[1] / F.col("scale")) for side in ("low", "high"))
    z_high = low + (top - low) * F.col("_a_part")[1]
    out = scaled.join(rates, keys)
    return out.select(*keys, "n", q[2].alias("median"), mad.alias("mad"), q[0].alias("p05"), q[2].alias("p50"), q[4].alias("p95"), iqr.alias("iqr"), "mean", "std", "z_mean", z_high.alias("z_high"), "spikes", "high_spikes", "z_most")


def embed(buckets: DataFrame, windows: tuple[int, ...] = WINDOWS, sizes: tuple[int, int, int] = (128, 128, 64), value: str = "agg_value", **options) -> DataFrame:
    """sensor_id, value, delta, event: three vectors of each series, padded or cut to ``sizes``, at length one.

    value and delta: the ten features of each window. event: of each window, and of everything, the shares of
    spikes and high spikes, the greatest and the 95th percentile of the absolute z-scores, of values and of changes.
    What a window of under three values would give is zero.
    """
    f = features(buckets, windows, value=value, **options)
    ten = F.array(*(F.col(c) for c in ("median", "mad", "p05", "p50", "p95", "iqr", "mean", "std", "z_mean", "z_high")))
    four = F.array(F.col("spikes"), F.col("high_spikes"), F.col("z_most"), F.col("z_high"))
    pick = lambda kind, span, what: F.max(F.when((F.col("kind") == kind) & (F.col("span") == span), what))
    row = f.groupBy("sensor_id").agg(
        *(F.coalesce(pick(kind, w, ten), F.array_repeat(F.lit(0.0), _FEATURES)).alias(f"{kind}{k}") for kind in "vd" for k, w in enumerate(windows)),
        *(F.coalesce(pick(kind, w, four), F.array_repeat(F.lit(0.0), _SIGNATURE)).alias(f"e{kind}{k}") for k, w in enumerate((*windows, _ALWAYS)) for kind in "vd"),
    )
    parts = ([f"v{k}" for k in range(len(windows))], [f"d{k}" for k in range(len(windows))], [f"e{kind}{k}" for k in range(len(windows) + 1) for kind in "vd"])
    sized = lambda names, n: F.slice(F.concat(*(F.col(c) for c in names), F.array_repeat(F.lit(0.0), n)), 1, n)
    return row.select("sensor_id", *(sized(names, n).alias(name) for name, names, n in zip(("value", "delta", "event"), parts, sizes, strict=True))).select("sensor_id", *(normalised(F.col(c)).alias(c) for c in ("value", "delta", "event")))


def normalised(vector: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(vector, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def cosine_top_k(rows: DataFrame, queries: DataFrame, k: int = 10, row_block: int = 8192, query_block: int = 4096) -> DataFrame:
    """query_id, vec_id, similarity: the k best rows of ``rows(vec_id, embedding)`` for each of ``queries``.

    Rows and queries are dealt into blocks, a task is one block of either, and returns its k best
    for each query; zero vectors and rows without a vector have no neighbours. Ties go to the
    smallest vec_id. A row does not find its own id.
    """
    unit = lambda df, key: df.where(F.col("embedding").isNotNull() & F.col(key).isNotNull()).select(key, F.col("embedding").cast("array<double>").alias("v"))
    n = max(1, -(-rows.count() // row_block))
    m = max(1, -(-queries.count() // query_block))
    r = unit(rows, "vec_id").withColumn("i", F.pmod(F.xxhash64("vec_id"), F.lit(n))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    q = unit(queries.withColumnRenamed("vec_id", "query_id"), "query_id").withColumn("j", F.pmod(F.xxhash64("query_id"), F.lit(m)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})
        if not len(left) or not len(right):
            return out
        left = left.sort_values("vec_id", ignore_index=True)
        a, b = np.stack(right["v"].to_list()), np.stack(left["v"].to_list())
        na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        ids, found = left["vec_id"].to_numpy(), []
        for at in range(0, len(a), 256):
            with np.errstate(all="ignore"):
                s = (a[at : at + 256] @ b.T) / (na[at : at + 256, None] * nb[None, :])
            own = right["query_id"].to_numpy()[at : at + 256]
            s[own[:, None] == ids[None, :]] = -np.inf
            s[~np.isfinite(s)] = -np.inf
            order = np.argsort(-s, axis=1, kind="stable")[:, :k]
            found.append(pd.DataFrame({"query_id": np.repeat(own, order.shape[1]), "vec_id": ids[order].ravel(), "similarity": np.take_along_axis(s, order, 1).ravel()}))
        every = pd.concat(found, ignore_index=True)
        return every[np.isfinite(every["similarity"])]

    met = r.groupBy("i", "j").cogroup(q.groupBy("i", "j")).applyInPandas(best, "query_id long, vec_id long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def widen_candidates(pool: DataFrame, focus: dict[str, str], stages: list[str], limit: int) -> DataFrame:
    """id, stage, hits: the pool in order of the first filter that a sensor passes.

    Stage s drops the first s filters; hits is the number of stages that a sensor passes.
    """
    passes = []
    for s in range(len(stages) + 1):
        keep = F.lit(True)
        for column in stages[s:]:
            keep = keep & (F.col(column) == F.lit(focus[column]))
        passes.append(F.coalesce(keep, F.lit(False)))
    marks = F.array(*passes)
    out = pool.withColumn("stage", (F.array_position(marks, True) - 1).cast("int")).withColumn("hits", F.size(F.filter(marks, lambda x: x)))
    return out.orderBy("stage", F.desc("hits"), "id").limit(limit).select("id", "stage", "hits")
