"""Sums over all pairs of series, in blocks of series and chunks of time.

A task is a pair of blocks of series within a chunk of time: its values are a matrix, and the sums of all its pairs are
products of matrices. A pair leaves one row for each chunk and lag, not one for each bucket, so what is shuffled
afterwards grows with the pairs, which are the result; a bucket that all series share is no key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SUMS = "n", "sx", "sy", "sxx", "syy", "sxy"


def pair_sums(series: DataFrame, value: str, lags: list[int] | None = None, interval: int = 0, block: int = 128, buckets: int = 4096) -> DataFrame:
    """a, b (a < b), lag, n, sx, sy, sxx, syy, sxy of ``series(sensor_id, bucket, value)``: sums over the buckets that both
    have, b's ``lag`` intervals later. Buckets are unique within a series; null and NaN values are none. Pairs without a
    common bucket are left out.

    interval: the length of a bucket (a minute if not given), of which a chunk holds ``buckets``.
    """
    lags = lags or [0]
    step = interval or 60
    width = step * buckets
    rows = series.select(F.col("sensor_id").cast("string").alias("sensor_id"), F.col("bucket").cast("long").alias("bucket"), F.col(value).cast("double").alias("v")).where("sensor_id is not null and bucket is not null and v is not null and not isnan(v)")
    blocks = max(1, -(-rows.select("sensor_id").distinct().count() // block))
    own = F.pmod(F.xxhash64("sensor_id"), F.lit(blocks))
    # A row is needed as b in the chunks that lie up to the lags before it.
    first, last = (F.floor((F.col("bucket") - k * step) / width) for k in (max(0, *lags), min(0, *lags)))
    chunks = F.sequence(first, last)
    spread = rows.withColumn("_o", own).withColumn("_c", F.explode(chunks)).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    dealt = spread.select("sensor_id", "bucket", "v", "_o", "_c", F.least("_o", "_k").alias("_i"), F.greatest("_o", "_k").alias("_j"))

    def sums(part: pa.Table) -> pa.Table:
        c, i, j = (part.column(n)[0].as_py() for n in ("_c", "_i", "_j"))
        names, at = np.unique(np.array(part.column("sensor_id").to_pylist(), object), return_inverse=True)
        times, when = np.unique(part.column("bucket").to_numpy(), return_inverse=True)
        grid = np.full((len(names), len(times)), np.nan)
        grid[at, when] = part.column("v").to_numpy()
        home = np.zeros(len(names), np.int64)
        home[at] = part.column("_o").to_numpy()
        known, filled = ~np.isnan(grid), np.nan_to_num(grid)
        wanted = np.triu(np.ones((len(names), len(names)), bool), 1) & (np.minimum.outer(home, home) == i) & (np.maximum.outer(home, home) == j)
        core = np.flatnonzero((times >= c * width) & (times < (c + 1) * width))
        out: dict[str, list[np.ndarray]] = {n: [] for n in ("a", "b", "lag", *_SUMS)}
        for lag in lags:
            target = times[core] + lag * step
            there = np.searchsorted(times, target)
            met = (there < len(times)) & (times[np.minimum(there, len(times) - 1)] == target)
            left, right = core[met], there[met]
            x, y, mx, my = filled[:, left], filled[:, right], known[:, left].astype(float), known[:, right].astype(float)
            n = mx @ my.T
            a, b = np.nonzero(wanted & (n > 0))
            out["a"].append(names[a])
            out["b"].append(names[b])
            out["lag"].append(np.full(len(a), lag))
            for name, m in zip(_SUMS, (n, x @ my.T, mx @ y.T, (x * x) @ my.T, mx @ (y * y).T, x @ y.T), strict=True):
                out[name].append(m[a, b])
        columns = {k: np.concatenate(v) for k, v in out.items()}
        return pa.table([pa.array(columns["a"], pa.string()), pa.array(columns["b"], pa.string()), pa.array(columns["lag"].astype(np.int32)), *(pa.array(columns[n]) for n in _SUMS)], ["a", "b", "lag", *_SUMS])

    partial = dealt.groupBy("_i", "_j", "_c").applyInArrow(lambda part: sums(part), "a string, b string, lag int, " + ", ".join(f"{n} double" for n in _SUMS))
    return partial.groupBy("a", "b", "lag").agg(F.sum("n").cast("long").alias("n"), *(F.sum(n).alias(n) for n in _SUMS[1:]))
