"""Change events, their suppression, co-occurrence and matching."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.stats import pearson_of_sums, raw_sums
from tidewell.operators.selection import greedy
from tidewell.operators.buckets import robust_scale
from tidewell.operators.joins import within_tolerance
from tidewell.operators.quantiles import quantiles
from tidewell.operators.storage import stored
from tidewell.operators.windows import deltas, second_deltas


def zscores(steps_of: DataFrame, value: str = "delta", step_floor: bool = True) -> DataFrame:
    """sensor_id, bucket, value, z: robust z of each difference.

    With ``step_floor`` the scale is at least the median non-zero |difference| (the step of quantised
    readings), where there are five of them.
    """
    scale = robust_scale(steps_of, ["sensor_id"], value).select("sensor_id", "median", "scale")
    if not step_floor:
        return steps_of.join(scale, "sensor_id").where("scale is not null").select("sensor_id", "bucket", F.col(value).alias("value"), ((F.col(value) - F.col("median")) / F.col("scale")).alias("z"))
    moved = steps_of.where(F.abs(value) > 0).select("sensor_id", F.abs(value).alias("_size"))
    steps = quantiles(moved, ["sensor_id"], "_size", [0.5]).select("sensor_id", F.col("n").alias("_n"), F.col("_q")[0].alias("_step"))
    both = scale.join(steps, "sensor_id", "left")
    used = F.greatest("scale", F.when(F.col("_n") >= 5, F.col("_step")))
    both = both.select("sensor_id", "median", F.when(F.col("scale").isNotNull(), used).alias("scale"))
    return steps_of.join(both, "sensor_id").where("scale is not null").select("sensor_id", "bucket", F.col(value).alias("value"), ((F.col(value) - F.col("median")) / F.col("scale")).alias("z"))


def islands(df: DataFrame, keys: list[str], order: str, gap: int, name: str = "island") -> DataFrame:
    """``df`` with the number of its run of rows that are at most ``gap`` apart."""
    w = Window.partitionBy(*keys).orderBy(order)
    fresh = F.when(F.col(order) - F.lag(order).over(w) <= gap, 0).otherwise(1)
    return df.withColumn("_f", fresh).withColumn(name, F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_f")


def suppress(events: DataFrame, window: int) -> DataFrame:
    """Events that are left when the strongest suppress those within ``window`` seconds, and so on.

    Ties go to the earlier. See ``selection.greedy``: no task holds more than a chunk of time.
    """
    return greedy(events, ["sensor_id"], "bucket", window, [-F.abs("z")])


def detect(steps_of: DataFrame, threshold: float = 3.0, separation: int = 0, polarity: str = "both", cap: int | None = None, value: str = "delta") -> DataFrame:
    """sensor_id, bucket, value, z, direction: events at |z| >= threshold, suppressed; with a ``cap`` the strongest of each sensor."""
    e = zscores(steps_of, value).where(F.abs("z") >= threshold)
    if polarity != "both":
        e = e.where(F.col("z") >= 0 if polarity == "up" else F.col("z") < 0)
    e = e.withColumn("direction", F.when(F.col("z") >= 0, "up").otherwise("down"))
    if separation:
        e = suppress(e, separation)
    if cap is None:
        return e
    w = Window.partitionBy("sensor_id").orderBy(F.desc(F.abs("z")), "bucket")
    return e.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= cap).drop("_k")


def _points(buckets: DataFrame, interval: int, mode: str, gap: int) -> DataFrame:
    """sensor_id, bucket, value: what a detector looks at."""
    if mode == "level":
        return buckets.select("sensor_id", "bucket", F.col("agg_value").alias("value"))
    steps = deltas(buckets, interval, gap) if mode == "delta" else second_deltas(buckets, interval, gap or 1 << 30)
    return steps.select("sensor_id", "bucket", F.col("delta" if mode == "delta" else "delta2").alias("value"))


def _strongest(z: DataFrame, k: int) -> DataFrame:
    """sensor_id, kth: the k-th greatest |z| of each sensor that has so many; first within parts of its rows."""
    size = F.abs("z")
    part = Window.partitionBy("sensor_id", "_part").orderBy(F.desc("_size"))
    some = z.select("sensor_id", size.alias("_size"), F.pmod(F.xxhash64("bucket"), F.lit(64)).alias("_part"))
    few = some.withColumn("_k", F.row_number().over(part)).where(F.col("_k") <= k)
    ranked = few.withColumn("_k", F.row_number().over(Window.partitionBy("sensor_id").orderBy(F.desc("_size"))))
    return ranked.where(F.col("_k") == k).select("sensor_id", F.col("_size").alias("kth"))


def detect_changes(
    buckets: DataFrame, interval: int, mode: str = "delta", threshold: float = 3.0, gap: int = 5, polarity: str = "both", target: tuple[int | None, int | None] | None = None,
    separation: int = 0, greedy: bool = False, boundaries: bool = True, sparse: bool = False,
) -> DataFrame:
    """sensor_id, bucket, value, z, direction, boundary: change events of bucketed series.

    mode: ``delta``, ``second`` (differences of differences) or ``level`` (values, reported less their
    median). target: (least, most) events of a sensor; the threshold is then at least the |z| of the event
    in their middle. separation: the strongest of what is close stays, by suppression or, ``greedy``, by
    one pass in time whose anchor moves to a stronger event. boundary: within an interval of a series'
    first or last bucket; such events go unless ``boundaries``. sparse: sensors without any event are
    looked at again by level. Series of fewer than three buckets or points have no events.
    """
    if mode not in ("delta", "second", "level"):
        raise ValueError(f"unknown detector {mode!r}")
    usable = buckets.where(F.col("agg_value").isNotNull() & ~F.isnan("agg_value") & (F.abs("agg_value") < float("inf")))
    span = usable.groupBy("sensor_id").agg(F.min("bucket").alias("_lo"), F.max("bucket").alias("_hi"), F.count("*").alias("_rows")).where("_rows >= 3")
    z = stored(zscores(_points(usable, interval, mode, gap), "value", mode != "level"))
    least = F.lit(float(threshold))
    if target and any(target):
        low, high = target[0] or target[1], target[1] or target[0]
        z = z.join(_strongest(z, max(1, (low + high) // 2)), "sensor_id", "left")
        least = F.greatest(least, F.coalesce("kth", F.lit(0.0)))
    e = z.where(F.abs("z") >= least)
    if polarity != "both":
        e = e.where(F.col("z") >= 0 if polarity == "up" else F.col("z") < 0)
    near = (F.abs(F.col("bucket") - F.col("_lo")) <= interval) | (F.abs(F.col("_hi") - F.col("bucket")) <= interval)
    e = e.join(span, "sensor_id").select("sensor_id", "bucket", "value", "z", F.when(F.col("z") >= 0, "up").otherwise("down").alias("direction"), near.alias("boundary"))
    if mode == "level":
        middle = quantiles(_points(usable, interval, mode, gap), ["sensor_id"], "value", [0.5]).select("sensor_id", F.col("_q")[0].alias("_m"))
        e = e.join(middle, "sensor_id").withColumn("value", F.col("value") - F.col("_m")).drop("_m")
    if not boundaries:
        e = e.where("not boundary")
    if separation:
        e = separate(e, separation) if greedy else suppress(e, separation)
    if sparse and mode != "level":
        e = stored(e)
        silent = usable.join(e.select("sensor_id").distinct(), "sensor_id", "left_anti")
        e = e.unionByName(detect_changes(silent, interval, "level", threshold, gap, polarity, target, separation, greedy, boundaries))
    return e


def separate(events: DataFrame, apart: int) -> DataFrame:
    """Events in order of time; one at most ``apart`` seconds after the last kept replaces it if it is
    stronger, and is left out otherwise. Runs of close events are folded each for itself."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["island", "bucket"], ignore_index=True)
        kept: list[int] = []
        for i, (island, at, z) in enumerate(zip(rows["island"], rows["bucket"], rows["z"].abs(), strict=True)):
            if kept and rows["island"][kept[-1]] == island and at - rows["bucket"][kept[-1]] <= apart:
                if z > abs(rows["z"][kept[-1]]):
                    kept[-1] = i
            else:
                kept.append(i)
        return rows.iloc[kept].drop(columns=["island", "part"])

    runs = islands(events, ["sensor_id"], "bucket", apart).withColumn("part", F.floor(F.col("island") / 256))
    return runs.groupBy("sensor_id", "part").applyInPandas(fold, events.schema)


def shared_evidence(focus: DataFrame, others: DataFrame, newest: int = 10) -> DataFrame:
    """candidate, shared, buckets, peak, times: what each sensor's events have in common with the focus's.

    shared: sum of |z| |z'| over common buckets; peak: its greatest |z| there; times: the latest buckets.
    The latest are kept by partial top-k over parts, so a busy sensor is no single list.
    """
    f = focus.groupBy("bucket").agg(F.max(F.abs("z")).alias("fz"))
    met = others.select(F.col("sensor_id").alias("candidate"), "bucket", F.abs("z").alias("cz")).join(f, "bucket")
    sums = met.groupBy("candidate").agg(F.sum(F.col("cz") * F.col("fz")).alias("shared"), F.count("*").alias("buckets"), F.max("cz").alias("peak"))
    part = Window.partitionBy("candidate", F.pmod(F.xxhash64("bucket"), F.lit(32))).orderBy(F.desc("bucket"))
    late = met.select("candidate", "bucket").withColumn("_k", F.row_number().over(part)).where(F.col("_k") <= newest)
    late = late.withColumn("_k", F.row_number().over(Window.partitionBy("candidate").orderBy(F.desc("bucket")))).where(F.col("_k") <= newest)
    times = late.groupBy("candidate").agg(F.sort_array(F.collect_list("bucket"), asc=False).alias("times"))  # ``newest`` of each at most
    return sums.join(times, "candidate")


def evidence_weights(focus: DataFrame, others: DataFrame) -> DataFrame:
    """candidate, prevalence, surprise: a penalty for candidates with more events than the focus, and how
    much stronger common buckets are than the two series' means let expect (0 to 10; null without)."""
    own = focus.agg(F.count("*").alias("nf"), F.avg(F.abs("z")).alias("mf"))
    each = others.groupBy(F.col("sensor_id").alias("candidate")).agg(F.count("*").alias("nc"), F.avg(F.abs("z")).alias("mc"))
    both = each.join(shared_evidence(focus, others).select("candidate", "shared", "buckets"), "candidate", "left").crossJoin(F.broadcast(own))
    expected = F.col("mf") * F.col("mc")
    surprise = F.when((F.col("shared") > 0) & (expected > 0), F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.col("shared") / F.col("buckets") / expected)))
    return both.select("candidate", prevalence(F.col("nf"), F.col("nc")).alias("prevalence"), surprise.alias("surprise"))


def without_system_wide(groups: DataFrame, sensors: Column | int, most: int = 10, share: float = 0.5) -> DataFrame:
    """Co-occurrence groups of fewer than ``most`` sensors and less than this share of all."""
    n = F.lit(sensors) if isinstance(sensors, int) else sensors
    return groups.where((F.col("group_size") < most) & (F.col("group_size") < share * n))


def cooccurrence(events: DataFrame, interval: int, tolerance: int = 0, min_sensors: int = 2, prefer: str = "specific", sensors: int | None = None) -> DataFrame:
    """bucket, group_size, severity, score: buckets in which several sensors have events.

    An event counts in the buckets up to ``tolerance`` away, and of a sensor's events in a bucket
    the strongest. prefer: specific (small groups score higher), system (sum of |z|) or pairs.
    """
    spread = events.select("sensor_id", "z", F.explode(F.sequence(F.lit(-tolerance), F.lit(tolerance))).alias("k"), F.col("bucket").alias("at"))
    spread = spread.select("sensor_id", F.abs("z").alias("s"), ((F.floor(F.col("at") / interval) + F.col("k")) * interval).cast("long").alias("bucket"))
    strongest = spread.groupBy("bucket", "sensor_id").agg(F.max("s").alias("s"))
    groups = strongest.groupBy("bucket").agg(F.count("*").alias("group_size"), F.sum("s").alias("severity")).where(F.col("group_size") >= min_sensors)
    n = F.col("group_size").cast("double")
    if prefer == "specific":
        total = F.lit(float(sensors)) if sensors else F.col("_total")
        if not sensors:
            groups = groups.crossJoin(F.broadcast(events.agg(F.countDistinct("sensor_id").cast("double").alias("_total"))))
        score = F.col("severity") / n / F.log(2 + n) * F.log((total + 1) / (n + 1))
    else:
        score = F.col("severity") if prefer == "system" else F.col("severity") * n * (n - 1) / 2
    return groups.select("bucket", "group_size", "severity", score.alias("score"))


def select_buckets(groups: DataFrame, apart: int, focus: str | None = None, most: int | None = None) -> DataFrame:
    """The groups that stay when the best shuts out those at most ``apart`` seconds away, and so on: by score, then the smaller
    group, then the later one; with ``focus``, a column of the focus's strength, by that first. most: so many of the best."""
    rank = [*([-F.round(focus, 9)] if focus else []), -F.round("score", 9), F.col("group_size"), -F.col("bucket")]
    chosen = greedy(groups, [], "bucket", apart, rank)
    return chosen if most is None else chosen.orderBy(*rank).limit(most)


def _weight(z: Column, cap: float) -> Column:
    return F.least(F.abs(z), F.lit(cap))


def match(focus: DataFrame, candidates: DataFrame, lags: list[int], tolerance: int = 0, cap: float = 15.0) -> DataFrame:
    """candidate, lag, pairs, overlap, agree: events of the focus sensor met by those of each candidate.

    ``lag`` (seconds) is how much later the candidate's are. Every event is used once: in order of
    time, the earliest still free within the tolerance. Without a tolerance that is an equi-join.
    """
    f = focus.select(F.col("bucket").alias("t"), F.col("z").alias("fz"))
    c = candidates.select(F.col("sensor_id").alias("candidate"), F.col("bucket").alias("t"), F.col("z").alias("cz"))
    shifted = f.withColumn("lag", F.explode(F.array(*(F.lit(k) for k in lags)))).withColumn("t", F.col("t") + F.col("lag"))
    if not tolerance:
        pairs = shifted.join(c, "t").select("candidate", "lag", "t", "fz", "cz")
    else:
        # An event that has none of the other side within the tolerance matches nothing, nor is it in the way.
        near = within_tolerance(shifted, c.withColumnRenamed("t", "ct"), [], "t", "ct", tolerance)
        none = F.lit(None).cast("double")
        both = near.select("candidate", "lag", "t", "fz", none.alias("cz")).distinct().unionByName(near.select("candidate", "lag", F.col("ct").alias("t"), none.alias("fz"), "cz").distinct())

        def pair(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("t", kind="stable")
            a, b = rows[rows["fz"].notna()], rows[rows["cz"].notna()]
            i = j = 0
            out = []
            while i < len(a) and j < len(b):
                apart = b["t"].iloc[j] - a["t"].iloc[i]
                if abs(apart) <= tolerance:
                    out.append((a["t"].iloc[i], a["fz"].iloc[i], b["cz"].iloc[j]))
                    i, j = i + 1, j + 1
                elif apart < 0:
                    j += 1
                else:
                    i += 1
            found = pd.DataFrame(out, columns=["t", "fz", "cz"])
            return found.assign(candidate=rows["candidate"].iloc[0], lag=rows["lag"].iloc[0])[["candidate", "lag", "t", "fz", "cz"]]

        pairs = islands(both, ["candidate", "lag"], "t", tolerance).groupBy("candidate", "lag", F.floor(F.col("island") / 256).alias("part")).applyInPandas(pair, "candidate string, lag int, t long, fz double, cz double")
    return pairs.withColumn("overlap", F.least(_weight(F.col("fz"), cap), _weight(F.col("cz"), cap)))


def match_scores(focus: DataFrame, candidates: DataFrame, lags: list[int], tolerance: int = 0, cap: float = 15.0) -> DataFrame:
    """candidate, lag, pairs, score (weighted F1), agreement of each lag with a match."""
    pairs = match(focus, candidates, lags, tolerance, cap)
    sums = pairs.groupBy("candidate", "lag").agg(F.count("*").alias("pairs"), F.sum("overlap").alias("o"), F.avg((F.col("fz") * F.col("cz") >= 0).cast("double")).alias("agreement"))
    total = candidates.groupBy(F.col("sensor_id").alias("candidate")).agg(F.sum(_weight(F.col("z"), cap)).alias("cw"))
    own = focus.agg(F.sum(_weight(F.col("z"), cap)).alias("fw"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * F.col("o") / (F.col("fw") + F.col("cw"))))
    return sums.join(total, "candidate").crossJoin(F.broadcast(own)).select("candidate", "lag", "pairs", score.alias("score"), "agreement")


def best_matches(scores: DataFrame) -> DataFrame:
    """The lag of each candidate with the best score; then more pairs, a shorter lag, the lesser lag."""
    rank = F.struct("score", "pairs", (-F.abs("lag")).alias("l"), (-F.col("lag")).alias("k"), "lag", "agreement")
    label = F.when(F.col("pairs") < 3, "unknown").when(F.col("agreement") >= 0.5, "same").otherwise("opposite")
    return scores.groupBy("candidate").agg(F.max(rank).alias("b")).select("candidate", "b.lag", "b.pairs", "b.score", "b.agreement").withColumn("direction", label)


def top_lags(scores: DataFrame, most: int = 3) -> DataFrame:
    """candidate, lag, pairs, score, place: the best ``most`` lags of each candidate; then more pairs, a shorter lag, the lesser lag.

    A lag that occurs more than once counts with its best score.
    """
    once = scores.groupBy("candidate", "lag").agg(F.max(F.struct("score", "pairs")).alias("b")).select("candidate", "lag", "b.pairs", "b.score")
    w = Window.partitionBy("candidate").orderBy(F.desc(F.round("score", 12)), F.desc("pairs"), F.abs("lag"), "lag")
    return once.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def delta_correlation(steps_of: DataFrame, focus: str, best: DataFrame, least: int = 10) -> DataFrame:
    """candidate, delta_corr: correlation of the differences at each candidate's best lag (null under ``least`` pairs)."""
    a = steps_of.where(F.col("sensor_id") == focus).select("bucket", F.col("delta").alias("x"))
    b = steps_of.select(F.col("sensor_id").alias("candidate"), F.col("bucket").alias("at"), F.col("delta").alias("y")).join(best.select("candidate", "lag"), "candidate").select("candidate", (F.col("at") - F.col("lag")).alias("bucket"), "y")
    return a.join(b, "bucket").groupBy("candidate").agg(*raw_sums("x", "y")).select("candidate", F.when(F.col("n") >= least, pearson_of_sums()).alias("delta_corr"))


def episodes(pairs: DataFrame, gap: int) -> DataFrame:
    """candidate, lag, start, end, points, peak, mean: runs of matched events at most ``gap`` seconds apart."""
    strength = F.least(F.abs("fz"), F.abs("cz"))
    return islands(pairs.select("candidate", "lag", "t", strength.alias("s")), ["candidate", "lag"], "t", gap).groupBy("candidate", "lag", "island").agg(
        F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("points"), F.max("s").alias("peak"), F.avg("s").alias("mean")
    ).drop("island")


def prevalence(n_focus: Column, n_candidate: Column) -> Column:
    """Penalty for candidates with more events than the focus; none without events."""
    return F.when((n_focus == 0) | (n_candidate == 0), 1.0).otherwise(F.greatest(F.lit(0.25), F.least(F.lit(1.0), F.sqrt(n_focus / n_candidate))))


def unified_rank(matches: DataFrame, shared: DataFrame, match_weight: float = 0.6, shared_weight: float = 0.4) -> DataFrame:
    """candidate, blend, tier, rank: evidence of matching and co-occurrence, each over its pool's maximum."""
    both = matches.select("candidate", "score").join(shared.select("candidate", "shared"), "candidate", "full")
    top = both.agg(F.max("score").alias("ms"), F.max("shared").alias("mc"))
    over = lambda v, m: F.coalesce(F.when(F.col(m) > 0, F.col(v) / F.col(m)), F.lit(0.0))
    blend = match_weight * over("score", "ms") + shared_weight * over("shared", "mc")
    out = both.crossJoin(F.broadcast(top)).select("candidate", blend.alias("blend"))
    tier = F.when(F.col("blend") >= 0.75, "high").when(F.col("blend") >= 0.35, "medium").otherwise("low")
    # Numbered in ranges of the blend, on top of the counts of the ranges before.
    ranged = out.withColumn("tier", tier).withColumn("_p", F.floor(F.col("blend") * -4096))
    before = ranged.groupBy("_p").agg(F.count("*").alias("_c")).select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(F.desc("blend"), "candidate")) + F.col("_before")
    return ranged.join(F.broadcast(before), "_p").select("candidate", "blend", "tier", place.cast("int").alias("rank"))  # 4097 ranges at most


# ---- matrix profile, smoothing -----------------------------------------------------------


def _normalised(values: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(z-normalised subsequences, which of them are constant)."""
    parts = np.lib.stride_tricks.sliding_window_view(values.astype(float), window)
    with np.errstate(invalid="ignore"):
        spread = parts.std(axis=1, keepdims=True)
        z = np.where(spread > 1e-12, (parts - parts.mean(axis=1, keepdims=True)) / np.where(spread > 1e-12, spread, 1), 0.0)
    z[np.isnan(spread[:, 0])] = np.nan
    return z, spread[:, 0] <= 1e-12


def _squared(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], apart: np.ndarray, exclusion: int) -> np.ndarray:
    """Squared distances of the subsequences of a and b; infinite where they are too close or not numbers."""
    (z, flat), (y, even) = a, b
    squared = np.maximum(0, (z * z).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * z @ y.T)
    squared[np.ix_(flat, even)] = 0.0
    squared[(np.abs(apart) <= exclusion) | np.isnan(squared)] = np.inf
    return squared


def profile(values: np.ndarray, window: int, exclusion: int) -> tuple[np.ndarray, np.ndarray]:
    """(distance to the nearest other subsequence, its start) of z-normalised subsequences.

    Constant subsequences are at distance 0 of each other and sqrt(window) of others.
    """
    if len(values) <= window:
        return np.zeros(0), np.zeros(0, np.int64)
    own = _normalised(values, window)
    k = np.arange(len(own[0]))
    squared = _squared(own, own, k[:, None] - k[None, :], exclusion)
    nearest = squared.argmin(axis=1)
    return np.sqrt(squared[k, nearest]), np.where(np.isfinite(squared[k, nearest]), nearest, -1)


def numbered(rows: DataFrame, span: int = 1 << 22) -> DataFrame:
    """``rows`` with their place k in their series and its ``size``, counted in chunks of ``span`` seconds."""
    rows = rows.withColumn("_c", F.floor(F.col("bucket") / span))
    w = Window.partitionBy("_s").orderBy("_d")
    chunks = rows.groupBy(F.col("sensor_id").alias("_s"), F.col("_c").alias("_d")).agg(F.count("*").alias("_n"))
    chunks = chunks.select("_s", "_d", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"), F.sum("_n").over(Window.partitionBy("_s")).alias("size"))
    within = F.row_number().over(Window.partitionBy("sensor_id", "_c").orderBy("bucket")) - 1
    return rows.withColumn("_k", within).join(chunks, F.col("sensor_id").eqNullSafe(F.col("_s")) & (F.col("_c") == F.col("_d"))).withColumn("k", F.col("_b") + F.col("_k")).drop("_c", "_k", "_s", "_d", "_b")


def matrix_profile(buckets: DataFrame, points: int | None = None, window: int = 32, exclusion: int | None = None, value: str = "agg_value", block: int = 1024) -> DataFrame:
    """sensor_id, bucket, distance, nearest over all buckets of each series, or its last ``points``.

    A series' subsequences are cut into blocks and every pair of blocks is a task of its own. Of
    equally near subsequences the earliest is taken.
    """
    skip = window // 2 if exclusion is None else exclusion
    rows = numbered(buckets.select("sensor_id", "bucket", F.col(value).cast("double").alias("v")))
    if points is not None:
        rows = rows.where(F.col("k") >= F.col("size") - points).withColumn("k", F.col("k") - F.greatest(F.lit(0), F.col("size") - points)).withColumn("size", F.least("size", F.lit(points)))
    rows = rows.where(F.col("size") > window).withColumn("blocks", F.ceil((F.col("size") - window + 1) / block))
    span = F.sequence(F.greatest(F.lit(0), F.floor((F.col("k") - window + 1) / block)), F.least(F.col("blocks") - 1, F.floor(F.col("k") / block)))
    dealt = rows.withColumn("own", F.explode(span)).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("sensor_id", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "k", "bucket", "v")

    def pair(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("k", ignore_index=True)
        i, j = part["i"].iloc[0], part["j"].iloc[0]
        sides = [part[part["own"] == b] for b in ((i, j) if i != j else (i,))]
        parts = [_normalised(side["v"].to_numpy(), window) for side in sides]
        place = [side["k"].to_numpy()[: len(z)] for side, (z, _) in zip(sides, parts, strict=True)]
        start = [side["bucket"].to_numpy()[: len(z)] for side, (z, _) in zip(sides, parts, strict=True)]
        squared = _squared(parts[0], parts[-1], place[0][:, None] - place[-1][None, :], skip)
        out = []
        for near, own, other in ((squared, 0, -1), (squared.T, 1, 0))[: len(sides)]:
            at = near.argmin(axis=1)
            distance = np.sqrt(near[np.arange(len(at)), at])
            nearest = pd.array(start[other][at], "Int64")
            nearest[~np.isfinite(distance)] = pd.NA
            out.append(pd.DataFrame({"bucket": start[own], "distance": distance, "nearest": nearest}))
        found = pd.concat(out, ignore_index=True)
        found.insert(0, "sensor_id", part["sensor_id"].iloc[0])
        return found

    pairs = dealt.groupBy("sensor_id", "i", "j").applyInPandas(pair, "sensor_id string, bucket long, distance double, nearest long")
    return pairs.groupBy("sensor_id", "bucket").agg(F.min(F.struct("distance", "nearest")).alias("b")).select("sensor_id", "bucket", "b.distance", "b.nearest")


def profile_extremes(profile: DataFrame, buckets: DataFrame, window: int, interval: int, most: int = 10) -> DataFrame:
    """sensor_id, kind (motif or anomaly), place, start, end, distance, match_start, match_end: of each series' profile the
    ``most`` subsequences that are nearest to another, and the most that are farthest from any.

    An end is the last bucket of a subsequence and its ``interval``. Ties go to the earlier; subsequences without a match are neither.
    """
    found = profile.where("nearest is not null").select("sensor_id", F.col("bucket").alias("start"), F.round("distance", 9).alias("_d"), "distance", F.col("nearest").alias("match_start"))
    pick = lambda kind, order: found.withColumn("place", F.row_number().over(Window.partitionBy("sensor_id").orderBy(order, "start"))).where(F.col("place") <= most).withColumn("kind", F.lit(kind))
    both = pick("motif", F.asc("_d")).unionByName(pick("anomaly", F.desc("_d")))
    places = numbered(buckets.select("sensor_id", "bucket")).select("sensor_id", "bucket", "k")
    ends = places.join(places.select("sensor_id", F.col("bucket").alias("_last"), (F.col("k") - window + 1).alias("k")), ["sensor_id", "k"]).select("sensor_id", "bucket", (F.col("_last") + interval).alias("_end"))
    out = both.join(ends.select("sensor_id", F.col("bucket").alias("start"), F.col("_end").alias("end")), ["sensor_id", "start"]).join(ends.select("sensor_id", F.col("bucket").alias("match_start"), F.col("_end").alias("match_end")), ["sensor_id", "match_start"])
    return out.select("sensor_id", "kind", "place", "start", "end", "distance", "match_start", "match_end")


@lru_cache(maxsize=256)
def savitzky_golay_weights(window: int, degree: int, derivative: int = 0, at: int | None = None) -> np.ndarray:
    """Weights of the values in a window for the fitted polynomial (or a derivative) at one of them."""
    if window % 2 == 0 or degree >= window or derivative > degree:
        raise ValueError("the window is odd and larger than the degree, which is at least the derivative")
    place = np.arange(window) - (window // 2 if at is None else at)
    basis = np.vander(place.astype(float), degree + 1, increasing=True)
    return np.linalg.pinv(basis)[derivative] * math.factorial(derivative)


def savitzky_golay(buckets: DataFrame, window: int, degree: int, derivative: int = 0, value: str = "agg_value", gap: int | None = None, chunk: int = 1 << 14) -> DataFrame:
    """sensor_id, bucket, smooth: the polynomial fitted to the values of the window around each one.

    At the edges of a series the polynomial of the first or last whole window is used (interp).
    Rows are smoothed in chunks that overlap by a window, however long the series is.
    ``gap``: a longer step between buckets starts a new segment; too short segments keep their values.
    """
    half, chunk = window // 2, max(chunk, window)
    rows = buckets.select("sensor_id", "bucket", F.col(value).alias("v"))
    rows = islands(rows, ["sensor_id"], "bucket", gap, "segment") if gap else rows.withColumn("segment", F.lit(1))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("sensor_id", "segment").orderBy("bucket")) - 1)
    last = rows.groupBy("sensor_id", "segment").agg((F.max("k") + 1).alias("size"))
    cut = rows.join(last, ["sensor_id", "segment"])
    span = F.array_distinct(F.array(*(F.floor((F.col("k") + d) / chunk) for d in (-window, 0, window))))
    dealt = cut.withColumn("part", F.explode(span)).where("part >= 0")

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("k", ignore_index=True)
        k, v, size = part["k"].to_numpy(), part["v"].to_numpy(float), int(part["size"].iloc[0])
        own = np.flatnonzero(k // chunk == part["part"].iloc[0])
        out = v.copy()
        if size >= window:
            for i in own:
                first = min(max(k[i] - half, 0), size - window)
                at = int(first - k[0])
                out[i] = savitzky_golay_weights(window, degree, derivative, int(k[i] - first)) @ v[at : at + window]
        elif derivative:
            out[:] = 0.0
        return pd.DataFrame({"sensor_id": part["sensor_id"], "bucket": part["bucket"], "smooth": out}).iloc[own]

    return dealt.groupBy("sensor_id", "segment", "part").applyInPandas(one, "sensor_id string, bucket long, smooth double")
