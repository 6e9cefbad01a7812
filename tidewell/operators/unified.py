"""The series related to a focus: matched events, shared buckets and correlated changes in one ranking.

The same evidence is gathered for the whole time and for each of its thirds, as a key of every aggregate, so a ranking's
stability costs no further pass. No more than one row a candidate, part and lag goes past the first aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.stats import pearson_of_sums, raw_sums
from tidewell.operators.events import prevalence
from tidewell.operators.graphs import dependency_paths
from tidewell.operators.storage import stored

# What is a system-wide bucket; how a stability is called; of how many candidates it is measured.
WIDE_SENSORS, WIDE_SHARE = 10, 0.5
STABLE_TOP, STABLE_MOST = 10, 120


@dataclass(frozen=True)
class Ranking:
    """Weights of the evidence. surprise: how much stronger shared buckets are than expected, in place of their mean product."""

    events: float = 0.6
    cooccurrence: float = 0.4
    delta_corr: float = 0.0
    surprise: bool = False
    cap: float = 15.0
    least_pairs: int = 10
    include_low: bool = False
    results: int = 60
    strip_system_wide: bool = False


def parts_of(rows: DataFrame, start: int, end: int) -> DataFrame:
    """``rows`` with part: 0 for all of [start, end], and 1, 2 or 3 for its thirds; an edge belongs to both."""
    third, at = (end - start) // 3, F.col("bucket")
    edges = [(0, start, end), (1, start, start + third), (2, start + third, start + 2 * third), (3, start + 2 * third, end)]
    parts = F.array_compact(F.array(*(F.when((at >= a) & (at <= b), F.lit(k)) for k, a, b in edges)))
    return rows.withColumn("part", F.explode(parts))


def evidence(events: DataFrame, changes: DataFrame, focus: str, lags: list[int], how: Ranking, entropy: DataFrame | None = None) -> DataFrame:
    """part, candidate, lag, score, overlap, agreement, shared, average, surprise, penalty, delta_corr.

    events: part, sensor_id, bucket, z; changes: part, sensor_id, bucket, delta; entropy: candidate, weight (1 where missing).
    """
    w = lambda c: F.least(F.abs(c), F.lit(how.cap))
    f = events.where(F.col("sensor_id") == focus).select("part", "bucket", F.col("z").alias("fz"))
    c = events.where(F.col("sensor_id") != focus).select("part", F.col("sensor_id").alias("candidate"), "bucket", F.col("z").alias("cz"))
    own = f.groupBy("part").agg(F.sum(w("fz")).alias("fw"), F.count("*").alias("nf"), F.avg(w("fz")).alias("fm"))
    each = c.groupBy("part", "candidate").agg(F.sum(w("cz")).alias("cw"), F.count("*").alias("nc"), F.avg(w("cz")).alias("cm"))
    moved = f.withColumn("lag", F.explode(F.array(*(F.lit(k) for k in lags)))).withColumn("bucket", F.col("bucket") + F.col("lag"))
    met = moved.join(c, ["part", "bucket"]).groupBy("part", "candidate", "lag").agg(F.count("*").alias("overlap"), F.sum(F.least(w("fz"), w("cz"))).alias("o"), F.avg((F.col("fz") * F.col("cz") >= 0).cast("double")).alias("agreement"))
    scored = met.join(each, ["part", "candidate"]).join(own, "part").withColumn("score", F.least(F.lit(1.0), 2 * F.col("o") / (F.col("fw") + F.col("cw"))))
    best = F.max(F.struct(F.round("score", 9).alias("s"), "overlap", (-F.abs("lag")).alias("l"), (-F.col("lag")).alias("k"), "lag", "score", "agreement", "nf", "nc"))
    matched = stored(scored.groupBy("part", "candidate").agg(best.alias("b")).select("part", "candidate", "b.lag", "b.score", "b.overlap", "b.agreement", prevalence(F.col("b.nf"), F.col("b.nc")).alias("penalty")))

    together = f.join(c, ["part", "bucket"])
    if how.strip_system_wide:
        sizes = events.groupBy("part", "bucket").agg(F.count_distinct("sensor_id").alias("size"))
        total = events.groupBy("part").agg(F.count_distinct("sensor_id").alias("total"))
        calm = sizes.join(total, "part").where((F.col("size") < WIDE_SENSORS) & (F.col("size") < WIDE_SHARE * F.col("total"))).select("part", "bucket")
        together = together.join(calm, ["part", "bucket"], "left_semi")
    sums = together.groupBy("part", "candidate").agg(F.count("*").alias("shared"), F.sum(w("fz") * w("cz")).alias("product"))
    if entropy is not None:
        sums = sums.join(entropy, "candidate", "left").withColumn("product", F.col("product") * F.coalesce("weight", F.lit(1.0))).drop("weight")
    sums = sums.withColumn("average", F.when(F.col("product") > 0, F.col("product") / F.col("shared")))
    expected = F.col("fm") * F.col("cm")
    sums = sums.join(each, ["part", "candidate"]).join(own, "part")
    sums = sums.select("part", "candidate", "shared", "average", F.when((expected > 0) & F.col("average").isNotNull(), F.least(F.lit(10.0), F.col("average") / expected)).alias("surprise"))

    x = changes.where(F.col("sensor_id") == focus).select("part", "bucket", F.col("delta").alias("x"))
    y = changes.select("part", F.col("sensor_id").alias("candidate"), "bucket", F.col("delta").alias("y")).join(matched.select("part", "candidate", "lag"), ["part", "candidate"])
    y = y.select("part", "candidate", (F.col("bucket") - F.col("lag")).alias("bucket"), "y")
    corr = x.join(y, ["part", "bucket"]).groupBy("part", "candidate").agg(*raw_sums("x", "y")).select("part", "candidate", F.when(F.col("n") >= how.least_pairs, pearson_of_sums()).alias("delta_corr"))
    return matched.join(sums, ["part", "candidate"], "full").join(corr, ["part", "candidate"], "left")


def ranked(found: DataFrame, how: Ranking) -> DataFrame:
    """``found`` with blend, tier and rank: each kind of evidence over its part's greatest, weighted; without blends of zero.

    A tier wants support as well as a blend: two matched events or shared buckets for high, one for medium.
    """
    metric = F.col("surprise" if how.surprise else "average") * F.coalesce("penalty", F.lit(1.0))
    tops = found.groupBy("part").agg(F.max("score").alias("_s"), F.max(metric).alias("_m"))
    over = lambda v, m: F.coalesce(F.when((v > 0) & (F.col(m) > 0), F.least(F.lit(1.0), v / F.col(m))), F.lit(0.0))
    blend = how.events * over(F.col("score"), "_s") + how.cooccurrence * over(metric, "_m") + how.delta_corr * F.least(F.lit(1.0), F.coalesce(F.abs("delta_corr"), F.lit(0.0)))
    out = found.join(tops, "part").withColumn("blend", blend).drop("_s", "_m").where("blend > 0")
    support = lambda n: (F.coalesce("overlap", F.lit(0)) >= n) | (F.coalesce("shared", F.lit(0)) >= n)
    out = out.withColumn("tier", F.when((F.col("blend") >= 0.75) & support(2), "high").when((F.col("blend") >= 0.35) & support(1), "medium").otherwise("low"))
    out = out if how.include_low else out.where("tier <> 'low'")
    weight = F.when(F.col("tier") == "high", 3).when(F.col("tier") == "medium", 2).otherwise(1)
    order = Window.partitionBy("part").orderBy(F.desc(F.round("blend", 9)), F.desc(weight), F.desc(F.coalesce("shared", F.lit(0))), F.desc(F.coalesce("overlap", F.lit(0))), "candidate")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= how.results)


def stability(ranks: DataFrame, eligible: int, top: int = STABLE_TOP) -> DataFrame:
    """stability, stability_tier: the mean share of the best ``top`` of the whole time that are among the best of each third; null
    where more than ``STABLE_MOST`` candidates were eligible."""
    best = ranks.where(F.col("rank") <= top).select("part", "candidate")
    whole = best.where("part = 0").select("candidate")
    hits = best.where("part > 0").join(whole, "candidate", "left_semi").agg(F.count("*").alias("n"))
    score: Column = F.col("n") / F.lit(3.0 * top) if eligible <= STABLE_MOST else F.lit(None).cast("double")
    out = hits.select(score.alias("stability"))
    return out.withColumn("stability_tier", F.when(F.col("stability") >= 0.8, "high").when(F.col("stability") >= 0.5, "medium").when(F.col("stability").isNotNull(), "low"))


def related(events: DataFrame, changes: DataFrame, focus: str, start: int, end: int, lags: list[int], how: Ranking, edges: DataFrame | None = None, entropy: DataFrame | None = None) -> DataFrame:
    """One row a related series: candidate, rank, blend, tier, lag, score, overlap, agreement, shared, average, surprise, penalty,
    delta_corr, stability, stability_tier, path (by which it is made of the focus, of ``edges``; null if it is not).

    ``events(sensor_id, bucket, z)`` are those of the whole time; a third sees its share of them.
    """
    e = stored(parts_of(events.select("sensor_id", "bucket", "z"), start, end))
    d = parts_of(changes.select("sensor_id", "bucket", "delta"), start, end)
    ranks = stored(ranked(evidence(e, d, focus, lags, how, entropy), how))
    eligible = e.where((F.col("part") == 0) & (F.col("sensor_id") != focus)).select("sensor_id").distinct().count()
    out = ranks.where("part = 0").drop("part").crossJoin(F.broadcast(stability(ranks, eligible)))  # one row
    if edges is None:
        return out.withColumn("path", F.lit(None).cast("array<string>"))
    paths = dependency_paths(edges, out.select("candidate", F.lit(focus).alias("focus"))).select("candidate", "path")
    return out.join(paths, "candidate", "left")
