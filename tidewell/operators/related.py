"""Series related to a focus: best lag with its inference, episodes of correlation, score.

All steps are joins, partial sums and windows. The focus is one series, so what is joined to it has
one row for each bucket and lag; rolling windows are cut into chunks of rows that overlap by the
window. Runs of windows are found by one sort for each candidate and window length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import stats as S
from tidewell.operators import buckets as B
from tidewell.operators.events import islands, numbered
from tidewell.operators.storage import stored

# Window lengths in seconds, and the weights of the score.
WINDOWS = (300, 900, 3600, 21_600, 86_400, 604_800, 2_592_000, 7_776_000)
PRIMARY_WEIGHT, PEAK_WEIGHT = 0.5, 0.5
EPISODE_WEIGHT, EPISODE_LEAST, EPISODES_COUNTED = 0.10, 0.80, 8
SEVERAL_BONUS, SEVERAL_LEAST = 0.02, 0.92
SHORT_COVERAGE, SHORT_FACTOR = 0.02, 0.85
LOW_OVERLAP, LOW_OVERLAP_FACTOR = 20, 0.9
WIDE_INTERVAL, WIDE_FACTOR = 0.08, 0.92
DAY, DAY_TOLERANCE, DAY_FACTOR = 86_400, 1800, 0.35
SIGNAL_FLOOR, SIGNAL_WEIGHT, POWER = 0.20, 0.80, 1.3


def robust_z(buckets: DataFrame, clip: float = 6.0, value: str = "agg_value") -> DataFrame:
    """sensor_id, bucket, z: distance from the series' median in robust scales, within ``clip``; none for under three values."""
    scale = B.robust_scale(buckets, ["sensor_id"], value).where("n >= 3").select("sensor_id", "median", "scale")
    z = (F.col(value) - F.col("median")) / F.col("scale")
    return buckets.join(scale, "sensor_id").select("sensor_id", "bucket", F.greatest(F.lit(-clip), F.least(F.lit(clip), z)).alias("z"))


def lag_inference(z: DataFrame, focus: str, lags: list[int], interval: int, min_n: int = 10, alpha: float = 0.05) -> DataFrame:
    """candidate, lag, n, r, m_lag, n_eff, p_raw, p_lag, q, low, high: each candidate's best lag in intervals.

    The greatest |r| of those with ``min_n`` common buckets decides; at a tie lag 0, then the least lag.
    p_lag is p_raw corrected for the lags tried, q the false-discovery rate of p_lag over candidates.
    """
    f = z.where(F.col("sensor_id") == focus).select("bucket", F.col("z").alias("x"))
    shifted = f.withColumn("lag", F.explode(F.array(*(F.lit(k) for k in lags)))).withColumn("bucket", F.col("bucket") + F.col("lag") * interval)
    others = z.where(F.col("sensor_id") != focus).select(F.col("sensor_id").alias("candidate"), "bucket", F.col("z").alias("y"))
    cells = shifted.join(others, "bucket").groupBy("candidate", "lag").agg(*S.raw_sums("x", "y")).where(F.col("n") >= max(3, min_n)).select("candidate", "lag", "n", S.pearson_of_sums().alias("r"))
    rank = F.struct(F.coalesce(F.abs("r"), F.lit(0.0)).alias("s"), (F.col("lag") == 0).alias("zero"), (-F.col("lag")).alias("l"), "lag", "n", "r")
    best = cells.groupBy("candidate").agg(F.max(rank).alias("t"), F.count("*").alias("m_lag")).select("candidate", "t.lag", "t.n", F.coalesce("t.r", F.lit(0.0)).alias("r"), "m_lag")
    rho = S.lag1_autocorrelation(z, "z", interval * 4096)
    own = rho.where(F.col("sensor_id") == focus).agg(F.max("rho1").alias("rf"))  # one row
    best = best.join(rho.select(F.col("sensor_id").alias("candidate"), F.col("rho1").alias("rc")), "candidate", "left").crossJoin(F.broadcast(own))
    best = best.withColumn("n_eff", S.effective_n(F.col("n"), F.col("rf"), F.col("rc")))
    best = best.withColumn("p_raw", S.fisher_p(F.abs("r"), F.col("n_eff").cast("double")))
    best = best.withColumn("p_lag", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.pow(1 - F.col("p_raw"), F.col("m_lag").cast("double")))))
    low, high = S.fisher_interval(F.col("r"), F.col("n_eff"), alpha)
    out = S.benjamini_hochberg(best, "p_lag").withColumn("low", low).withColumn("high", high)
    return out.select("candidate", "lag", "n", "r", "m_lag", "n_eff", "p_raw", "p_lag", "q", "low", "high")


def significant(inference: DataFrame, min_abs_r: float = 0.2, alpha: float = 0.05) -> DataFrame:
    """Candidates that pass in strength, in p_lag and in q."""
    return inference.where((F.abs("r") >= min_abs_r) & (F.col("p_lag") <= alpha) & (F.col("q") <= alpha))


def window_lengths(horizon: int, interval: int) -> list[int]:
    """Window lengths in seconds within the horizon, of at least six buckets."""
    return [w for w in WINDOWS if w <= horizon and w // interval >= 6] or [max(10 * interval, 60)]


def _rolling(pairs: DataFrame, window: int, points: int, chunk: int) -> DataFrame:
    """sensor_id (candidate, window_s), bucket, r of the ``points`` rows from each on; ``pairs`` has its row number k."""
    size = max(chunk, 4 * points)
    cut = F.floor(F.col("k") / size)
    ahead = (F.pmod("k", F.lit(size)) < points - 1) & (cut > 0)
    dealt = pairs.withColumn("_cut", F.explode(F.when(ahead, F.array(cut, cut - 1)).otherwise(F.array(cut))))
    w = Window.partitionBy("sensor_id", "_cut").orderBy("k").rowsBetween(0, points - 1)
    a, b = F.col("x"), F.col("y")
    s = lambda c: F.sum(c).over(w)
    sums = dealt.select("sensor_id", "bucket", "k", "_cut", F.count("*").over(w).alias("n"), s(a).alias("sx"), s(b).alias("sy"), s(a * a).alias("sxx"), s(b * b).alias("syy"), s(a * b).alias("sxy"))
    own = sums.where((F.col("n") == points) & (F.col("_cut") == F.floor(F.col("k") / size)))
    key = F.struct(F.col("sensor_id").alias("candidate"), F.lit(window).alias("window_s"))
    stride = F.lit(max(1, points // 4)).alias("stride")
    return own.select(key.alias("sensor_id"), "bucket", S.pearson_of_sums().alias("r"), F.lit(points).alias("points"), stride).where("r is not null")


def episodes(z: DataFrame, focus: str, lags: DataFrame, interval: int, horizon: int, threshold: float = 0.6, chunk: int = 1 << 14) -> DataFrame:
    """candidate, window_s, start, end, peak, mean, coverage, points: runs of windows with |r| of ``threshold`` or more.

    ``lags(candidate, lag)`` says how candidates are shifted. Windows of every length in
    ``window_lengths`` start at each common bucket; every quarter of a window is looked at.
    """
    f = z.where(F.col("sensor_id") == focus).select("bucket", F.col("z").alias("x"))
    moved = z.join(lags.select(F.col("candidate").alias("sensor_id"), "lag"), "sensor_id").select("sensor_id", (F.col("bucket") - F.col("lag") * interval).alias("bucket"), F.col("z").alias("y"))
    pairs = stored(numbered(moved.join(f, "bucket").select("sensor_id", "bucket", "x", "y")))
    every = stored(reduce(DataFrame.unionByName, (_rolling(pairs, w, max(3, w // interval), chunk) for w in window_lengths(horizon, interval))))
    looked = numbered(every).where(F.pmod("k", "stride") == 0).withColumn("j", F.floor(F.col("k") / F.col("stride")))
    runs = islands(looked.where(F.abs("r") >= threshold), ["sensor_id"], "j", 1)
    out = runs.groupBy("sensor_id", "island").agg(
        F.min("bucket").alias("start"), F.max("bucket").alias("last"), F.max(F.abs("r")).alias("peak"), F.avg(F.abs("r")).alias("mean"), F.sum(F.col("points").cast("long")).alias("points")
    )
    end = F.col("last") + F.col("sensor_id.window_s")
    coverage = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (end - F.col("start")) / F.lit(float(max(1, horizon)))))
    return out.select("sensor_id.candidate", "sensor_id.window_s", "start", end.alias("end"), "peak", "mean", coverage.alias("coverage"), "points")


def daily_lag(seconds: Column) -> Column:
    """Is the lag close to a whole number of days, other than none?"""
    days = F.floor((F.abs(seconds) + DAY // 2) / DAY)
    return (days > 0) & (F.abs(F.abs(seconds) - days * DAY) <= DAY_TOLERANCE)


def scores(inference: DataFrame, found: DataFrame, interval: int, min_n: int = 10, most: int = 50) -> DataFrame:
    """``inference`` with episodes, best_window, coverage, daily and score.

    Of a candidate's episodes the ``most`` with the greatest peaks count (an option of the report);
    without any, the score comes to 0.
    """
    order = Window.partitionBy("candidate").orderBy(F.desc("peak"), "start", "window_s")
    ranked = found.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most)
    counted = (F.col("peak") >= EPISODE_LEAST) & (F.col("_k") <= EPISODES_COUNTED)  # peaks fall with _k
    best = ranked.groupBy("candidate").agg(
        F.count("*").alias("episodes"),
        F.count(F.when(F.col("peak") >= SEVERAL_LEAST, 1)).alias("strong"),
        F.product(F.when(counted, 1 - F.least(F.lit(1.0), F.col("peak")) * EPISODE_WEIGHT)).alias("left"),
        F.min_by(F.struct("window_s", "coverage", "peak"), "_k").alias("top"),
    )
    out = inference.join(best, "candidate", "left").withColumn("daily", daily_lag(F.col("lag") * interval))
    primary = 1 - F.coalesce("left", F.lit(1.0))
    top = F.col("top")
    score = F.when(top.isNull(), primary).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), primary * PRIMARY_WEIGHT + top["peak"] * PEAK_WEIGHT)) * F.when(top["coverage"] < SHORT_COVERAGE, SHORT_FACTOR).otherwise(1.0))
    score = F.when(~F.col("daily") & (F.coalesce("strong", F.lit(0)) >= 2), F.least(F.lit(1.0), score + SEVERAL_BONUS)).otherwise(score)
    score = score * F.when(F.col("n") < max(2 * max(3, min_n), LOW_OVERLAP), LOW_OVERLAP_FACTOR).otherwise(1.0)
    score = score * F.when(F.abs(F.col("high") - F.col("low")) > WIDE_INTERVAL, WIDE_FACTOR).otherwise(1.0)
    score = score * F.least(F.lit(1.0), SIGNAL_FLOOR + SIGNAL_WEIGHT * F.abs("r")) * F.when(F.col("daily"), DAY_FACTOR).otherwise(1.0)
    return out.select(*inference.columns, F.coalesce("episodes", F.lit(0)).alias("episodes"), top["window_s"].alias("best_window"), top["coverage"].alias("coverage"), "daily", F.least(F.lit(1.0), F.pow(score, F.lit(POWER))).alias("score"))
