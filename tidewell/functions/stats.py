"""Statistics over sums, and the special functions that Spark lacks."""

from __future__ import annotations

import math
import sys
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


SMALLEST_P = sys.float_info.min


def pearson_of_sums(n: str = "n", sx: str = "sx", sy: str = "sy", sxx: str = "sxx", syy: str = "syy", sxy: str = "sxy") -> Column:
    """Pearson's r from raw sums; null without variance, else within [-1, 1]."""
    c = F.col
    vx, vy = c(n) * c(sxx) - c(sx) * c(sx), c(n) * c(syy) - c(sy) * c(sy)
    r = (c(n) * c(sxy) - c(sx) * c(sy)) / F.sqrt(vx * vy)
    return F.when((vx > 1e-12) & (vy > 1e-12), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def raw_sums(x: str, y: str) -> list[Column]:
    a, b = F.col(x), F.col(y)
    return [F.count("*").alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(b * b).alias("syy"), F.sum(a * b).alias("sxy")]


def aligned_pairs(series: DataFrame, value: str) -> DataFrame:
    """a, b (a < b), bucket, x, y: values of two sensors at equal buckets, for what needs the values themselves."""
    left = series.select(F.col("sensor_id").alias("a"), "bucket", F.col(value).alias("x"))
    right = series.select(F.col("sensor_id").alias("b"), "bucket", F.col(value).alias("y"))
    return left.join(right, "bucket").where("a < b")


def correlations(series: DataFrame, value: str, lags: list[int] | None = None, interval: int = 0, min_overlap: int = 3) -> DataFrame:
    """a, b, lag, n, r of all pairs of sensors; r is null below ``min_overlap`` or without variance."""
    from tidewell.operators.pairs import pair_sums

    sums = pair_sums(series, value, lags, interval)
    return sums.select("a", "b", "lag", "n", F.when(F.col("n") >= min_overlap, pearson_of_sums()).alias("r"))


def best_lag(cells: DataFrame) -> DataFrame:
    """The lag of each pair with the greatest |r|; then more overlap, a shorter lag, the lesser lag."""
    rank = F.struct(F.coalesce(F.abs("r"), F.lit(-1.0)).alias("s"), "n", (-F.abs("lag")).alias("l"), (-F.col("lag")).alias("k"), "r", "lag")
    return cells.groupBy("a", "b").agg(F.max(rank).alias("t")).select("a", "b", F.col("t.lag").alias("lag"), F.col("t.n").alias("n"), F.col("t.r").alias("r"))


def lag1_autocorrelation(series: DataFrame, value: str, chunk: int) -> DataFrame:
    """sensor_id, rho1: correlation of neighbours in order, within 0.9999999."""
    from tidewell.operators.windows import previous

    steps = previous(series, ["sensor_id"], "bucket", [value], chunk).where(F.col(f"prev_{value}").isNotNull())
    r = pearson_of_sums()
    return steps.groupBy("sensor_id").agg(*raw_sums(f"prev_{value}", value)).select("sensor_id", F.greatest(F.lit(-0.9999999), F.least(F.lit(0.9999999), r)).alias("rho1"))


def effective_n(n: Column, rho_x: Column, rho_y: Column) -> Column:
    """Sample size for autocorrelated series, between 3 and n."""
    shrink = F.greatest(F.lit(1.0), 1 + 2 * rho_x * rho_y)
    return F.when(rho_x.isNull() | rho_y.isNull(), n).otherwise(F.greatest(F.lit(3), F.least(n, F.floor(n / shrink)))).cast("long")


@F.pandas_udf(DoubleType())
def fisher_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation by Fisher's z; null below four values."""

    def one(r: float | None, n: float | None) -> float | None:
        if r is None or n is None or math.isnan(r) or math.isnan(n) or n < 4:
            return None
        if abs(r) >= 0.999999:
            return SMALLEST_P
        return max(SMALLEST_P, math.erfc(abs(math.atanh(r)) * math.sqrt(n - 3) / math.sqrt(2)))

    return pd.Series([one(a, b) for a, b in zip(r, n, strict=True)], dtype="float64")


def fisher_interval(r: Column, n: Column, alpha: float = 0.05) -> tuple[Column, Column]:
    """(low, high) of the confidence interval of a correlation."""
    z = NormalDist().inv_cdf(1 - alpha / 2)
    centre, half = F.atanh(F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), r))), z / F.sqrt(n - 3)
    ok = n >= 4
    return F.when(ok, F.tanh(centre - half)), F.when(ok, F.tanh(centre + half))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_fraction(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tiny, c, d = 1e-300, 1.0, 1 / (1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / ((1 + top * d) or tiny), (1 + top / c) or tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * out


@F.pandas_udf(DoubleType())
def student_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a rank correlation by Student's t with n - 2 degrees of freedom."""

    def one(r: float | None, n: float | None) -> float | None:
        if r is None or n is None or math.isnan(r) or math.isnan(n) or n < 4:
            return None
        return SMALLEST_P if abs(r) >= 0.999999 else max(SMALLEST_P, _beta_fraction((n - 2) / 2, 0.5, 1 - r * r))

    return pd.Series([one(a, b) for a, b in zip(r, n, strict=True)], dtype="float64")


def sidak(p: Column, lags: int) -> Column:
    """p of the best of ``lags`` lags."""
    return 1 - F.pow(1 - p, F.lit(float(lags)))


def benjamini_hochberg(df: DataFrame, p: str, keys: list[str] | None = None) -> DataFrame:
    """``df`` with q, the false-discovery rate; p outside [0, 1] is not counted and has no q.

    Distinct p are counted and ranked within ranges of p, sixteen to an octave; what is before and after
    a range comes from a table of one row a range (some 17,000 at most).
    """
    keys = keys or []
    ok = F.col(p).between(0, 1) & ~F.isnan(p)
    part = F.when(F.col(p) > 0, F.floor(16 * F.log2(p))).otherwise(-20_000).cast("int")
    counts = df.where(ok).groupBy(*keys, p).agg(F.count("*").alias("_c")).withColumn("_part", part)
    rising = Window.partitionBy(*keys).orderBy("_part")
    parts = counts.groupBy(*keys, "_part").agg(F.sum("_c").alias("_in"))
    parts = parts.select(*keys, "_part", (F.sum("_in").over(rising) - F.col("_in")).alias("_before"), F.sum("_in").over(Window.partitionBy(*keys)).alias("_m"))
    own = Window.partitionBy(*keys, "_part").orderBy(p).rowsBetween(Window.unboundedPreceding, 0)
    rate = counts.join(parts, [*keys, "_part"]).withColumn("_rate", F.col(p) * F.col("_m") / (F.sum("_c").over(own) + F.col("_before")))
    later = Window.partitionBy(*keys).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    least = rate.groupBy(*keys, "_part").agg(F.min("_rate").alias("_low")).select(*keys, "_part", F.min("_low").over(later).alias("_after"))
    falling = Window.partitionBy(*keys, "_part").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    q = rate.join(least, [*keys, "_part"]).select(*keys, p, F.least(F.lit(1.0), F.min("_rate").over(falling), F.coalesce("_after", F.lit(1.0))).alias("q"))
    return df.join(q, [*keys, p], "left")


def regression(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, n, slope, intercept, r2 of least squares; null without variance."""
    c = F.col
    sums = df.groupBy(*keys).agg(*raw_sums(x, y))
    vx = c("n") * c("sxx") - c("sx") * c("sx")
    slope = F.when(vx > 1e-12, (c("n") * c("sxy") - c("sx") * c("sy")) / vx)
    r = pearson_of_sums()
    return sums.select(*keys, "n", slope.alias("slope"), ((c("sy") - slope * c("sx")) / c("n")).alias("intercept"), (r * r).alias("r2"))


def hour_entropy(df: DataFrame, keys: list[str], hour: Column) -> DataFrame:
    """keys, entropy (0 to 1 over 24 hours), weight (entropy within [0.25, 1])."""
    counts = df.groupBy(*keys, hour.alias("hour")).agg(F.count("*").alias("c"))
    total = counts.groupBy(*keys).agg(F.sum("c").alias("t"))
    p = F.col("c") / F.col("t")
    h = counts.join(total, keys).groupBy(*keys).agg((-F.sum(p * F.log(p)) / math.log(24)).alias("entropy"))
    return h.select(*keys, "entropy", F.greatest(F.lit(0.25), F.least(F.lit(1.0), F.col("entropy"))).alias("weight"))

