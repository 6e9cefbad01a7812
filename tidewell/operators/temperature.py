"""Dependence of sensors on temperature: polynomials with a drift in time, and the lag that explains most.

A group's fit is least squares from its Gram matrix: sums of products of the regressors, added up by
partial aggregates about the group's own centres, and solved where only one row a group is left.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.quantiles import quantiles
from tidewell.operators.storage import stored

DAY = 86_400


def solve(matrix: np.ndarray, right: np.ndarray) -> np.ndarray | None:
    """The solution of a small linear system by elimination with pivots; None if one is below 1e-12."""
    m = np.column_stack((matrix, right)).astype(float)
    n = len(right)
    for c in range(n):
        p = c + int(np.argmax(np.abs(m[c:, c])))
        if not np.isfinite(m[p, c]) or abs(m[p, c]) < 1e-12:
            return None
        m[[c, p]] = m[[p, c]]
        m[c] /= m[c, c]
        others = np.arange(n) != c
        m[others] -= np.outer(m[others, c], m[c])
    return m[:, n] if np.isfinite(m[:, n]).all() else None


def align(raw: DataFrame, temperature: DataFrame, lags: list[int]) -> DataFrame:
    """sensor_id, lag, t, x, y: ``raw(sensor_id, t, y)`` beside ``temperature(t, x)`` of ``lag`` seconds before.

    The temperature is one series; each of its rows is sent to the times of all lags, an equi-join on time.
    """
    moved = temperature.select(F.explode(F.array(*(F.lit(k) for k in lags))).alias("lag"), "t", "x").select("lag", (F.col("t") + F.col("lag")).alias("t"), "x")
    return raw.join(moved, "t").where(_finite("x") & _finite("y")).select("sensor_id", "lag", "t", "x", "y")


def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def fit(points: DataFrame, keys: list[str], degree: int = 2, time_slope: bool = False, centre: float | None = None) -> DataFrame:
    """keys, n, centre, centre_t, beta (array: constant, powers of the temperature), slope (a day; null without) of
    ``points(keys, t, x, y)``: y by powers of x - centre, and by time where asked for.

    Groups of under max(10, degree + 2) points, and those whose system has no solution, have no row.
    """
    means = points.groupBy(*keys).agg(F.count("*").alias("n"), (F.avg("x") if centre is None else F.lit(float(centre))).alias("centre"), F.avg("t").alias("centre_t")).where(F.col("n") >= max(10, degree + 2))
    x = F.col("x") - F.col("centre")
    basis = [F.lit(1.0), *(F.pow(x, F.lit(float(k))) for k in range(1, degree + 1)), *([(F.col("t") - F.col("centre_t")) / DAY] if time_slope else [])]
    d = len(basis)
    cells = [(i, j) for i in range(d) for j in range(i, d)]
    sums = points.join(means, keys).groupBy(*keys, "n", "centre", "centre_t").agg(F.array(*(F.sum(basis[i] * basis[j]) for i, j in cells)).alias("gram"), F.array(*(F.sum(b * F.col("y")) for b in basis)).alias("moments"))
    kinds = dict(sums.dtypes)
    head = [*keys, "n", "centre", "centre_t"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            beta, slope = [], []
            for gram, moments in zip(batch.column("gram").to_pylist(), batch.column("moments").to_pylist(), strict=True):
                m = np.zeros((d, d))
                for (i, j), v in zip(cells, gram, strict=True):
                    m[i, j] = m[j, i] = v
                found = solve(m, np.array(moments))
                beta.append(None if found is None else found[: degree + 1].tolist())
                slope.append(float(found[-1]) if found is not None and time_slope else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in head), pa.array(beta, pa.list_(pa.float64())), pa.array(slope, pa.float64())], [*head, "beta", "slope"])

    return sums.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in head) + ", beta array<double>, slope double").where("beta is not null")


def correction(x: Column, centre: Column, beta: Column, degree: int, most: float | None = None) -> Column:
    """What the temperature adds to a reading, beyond the constant; within ``most`` where given."""
    out = sum((F.element_at(beta, k + 1) * F.pow(x - centre, F.lit(float(k))) for k in range(1, degree + 1)), F.lit(0.0))
    return out if most is None else F.greatest(F.lit(-most), F.least(F.lit(most), out))


def explained(points: DataFrame, fits: DataFrame, keys: list[str], degree: int) -> DataFrame:
    """keys, r2 (0 to 1; null without variance) of fits, from their residuals."""
    both = points.join(fits, keys)
    guess = F.element_at("beta", 1) + correction(F.col("x"), F.col("centre"), F.col("beta"), degree) + F.coalesce("slope", F.lit(0.0)) * (F.col("t") - F.col("centre_t")) / DAY
    sums = both.groupBy(*keys).agg(F.sum(F.pow(F.col("y") - guess, F.lit(2.0))).alias("rest"), (F.var_pop("y") * F.count("y")).alias("whole"))
    r2 = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("rest") / F.col("whole")))
    return sums.select(*keys, F.when(F.col("whole") > 0, r2).alias("r2"))


def expression(raw: str, temperature: str, centre: float, beta: list[float], most: float | None = None) -> str:
    """The compensated series as a Spark SQL formula of a derived series."""
    terms = " + ".join(f"{b!r} * pow({temperature} - {centre!r}, {k})" for k, b in enumerate(beta[1:], 1))
    return f"{raw} - ({terms})" if most is None else f"{raw} - greatest({-most!r}, least({most!r}, {terms}))"


def lag_scores(points: DataFrame, degree: int = 2, time_slope: bool = False, most: float | None = None, min_samples: int = 20) -> DataFrame:
    """sensor_id, lag, n, raw_swing, swing, reduction_pct: the spread (p95 - p5) of each series before and after its
    dependence on the temperature of ``lag`` seconds before is taken out, of ``points`` as ``align`` gives them."""
    keys = ["sensor_id", "lag"]
    points = stored(points)
    fits = stored(fit(points, keys, degree, time_slope).where(F.col("n") >= min_samples))
    both = points.join(fits, keys).select(*keys, "y", (F.col("y") - correction(F.col("x"), F.col("centre"), F.col("beta"), degree, most)).alias("c"))
    # Both columns as one, so that one sketch and one count serve them.
    long = both.select(*keys, F.explode(F.array(F.struct(F.lit("y").alias("of"), F.col("y").alias("v")), F.struct(F.lit("c").alias("of"), F.col("c").alias("v")))).alias("s")).select(*keys, "s.of", "s.v")
    q = quantiles(long, [*keys, "of"], "v", [0.05, 0.95])
    wide = q.groupBy(*keys).agg(*(F.max(F.when(F.col("of") == of, F.col("_q")[1] - F.col("_q")[0])).alias(name) for of, name in (("y", "raw_swing"), ("c", "swing"))))
    less = F.when(F.col("raw_swing") > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), (1 - F.col("swing") / F.col("raw_swing")) * 100)))
    return fits.join(wide, keys).select(*keys, "n", "raw_swing", "swing", less.alias("reduction_pct"))


def choose_lag(scores: DataFrame, least_gain: float = 5.0) -> DataFrame:
    """sensor_id, lag, best_lag, reduction_pct, baseline_pct: the lag with the greatest reduction (ties: the shortest), or
    no lag where it gains under ``least_gain`` points over none, or either is unknown."""
    of = ["sensor_id"]
    base = F.max(F.when(F.col("lag") == 0, F.col("reduction_pct")))
    best = F.max(F.struct(F.coalesce("reduction_pct", F.lit(-1.0)).alias("s"), (-F.col("lag")).alias("l"), "reduction_pct"))
    found = scores.groupBy(*of).agg(base.alias("baseline_pct"), best.alias("b")).select(*of, "baseline_pct", (-F.col("b.l")).alias("best_lag"), F.col("b.reduction_pct").alias("reduction_pct"))
    gains = F.coalesce(F.col("reduction_pct") - F.col("baseline_pct") >= least_gain, F.lit(False))
    return found.select(*of, F.when(gains, F.col("best_lag")).otherwise(0).alias("lag"), "best_lag", "reduction_pct", "baseline_pct")
