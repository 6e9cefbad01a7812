"""Exact percentiles of groups of any size.

A sketch of bounded size (``percentile_approx``, merged from partial aggregates) gives for each
percentile a range of values that holds its ranks. One aggregate then counts the values within the ranges one
by one, and what lies before, between and after them in a row each; the ranks are read off running sums
over those. No task holds the values of a group, whatever share of the rows it has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quantiles(df: DataFrame, keys: list[str], value: str, probabilities: list[float], name: str = "_q", accuracy: int = 10_000, ranks: bool = False) -> DataFrame:
    """keys, n, ``name``: percentiles with linear interpolation of the non-null values, as an array.

    Groups without a value are left out. ``accuracy`` bounds the sketch, and so the share of a group
    that is looked at value by value: 4 / ``accuracy`` for each percentile. Of at most ``accuracy`` values all are.
    ranks: also ``name``_low, ``name``_high and ``name``_part, the values at both ranks and the way between them. A rank
    outside its range, which the sketch's bound rules out, is an error and not a null.
    """
    given = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null")
    slack, k = 2 / accuracy, len(probabilities)
    edges = [max(0.0, p - slack) for p in probabilities] + [min(1.0, p + slack) for p in probabilities]
    sketch = given.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.percentile_approx("_v", F.lit(edges), accuracy).alias("_e"))
    few = F.col("_n") <= accuracy  # in larger groups a rank more or less is within the slack
    lows = [(F.col("_lo") if p <= slack else F.when(few, F.col("_lo")).otherwise(F.col("_e")[i])).alias(f"_a{i}") for i, p in enumerate(probabilities)]
    highs = [(F.col("_hi") if p >= 1 - slack else F.when(few, F.col("_hi")).otherwise(F.col("_e")[k + i])).alias(f"_b{i}") for i, p in enumerate(probabilities)]
    ranged = given.join(sketch.select(*keys, "_n", *lows, *highs), keys)
    within = reduce(lambda a, b: a | b, ((F.col("_v") >= F.col(f"_a{i}")) & (F.col("_v") <= F.col(f"_b{i}")) for i in range(k)))
    passed = reduce(lambda a, b: a + b, ((F.col("_v") > F.col(f"_b{i}")).cast("int") for i in range(k)))  # numbers the gaps between ranges
    counts = ranged.groupBy(*keys, "_n", F.when(within, F.col("_v")).alias("_x"), F.when(~within, passed).alias("_gap")).agg(F.count("*").alias("_c"), F.max("_v").alias("_top"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_top").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("_to", upto)
    found = []
    for i, p in enumerate(probabilities):
        place = F.lit(p) * (F.col("_n") - 1)
        for side, rank in (("l", F.floor(place)), ("h", F.ceil(place))):
            found.append(F.max(F.when((F.col("_to") - F.col("_c") <= rank) & (rank < F.col("_to")), F.col("_x"))).alias(f"_{side}{i}"))
    read = placed.groupBy(*keys, "_n").agg(*found)
    sure = lambda c: F.coalesce(F.col(c), F.raise_error("a rank lies outside the range of the sketch").cast("double"))
    low, high = ([sure(f"_{side}{i}") for i in range(k)] for side in "lh")
    part = [F.lit(p) * (F.col("_n") - 1) - F.floor(F.lit(p) * (F.col("_n") - 1)) for p in probabilities]
    out = [F.array(*(a + (b - a) * t for a, b, t in zip(low, high, part, strict=True))).alias(name)]
    if ranks:
        out += [F.array(*low).alias(f"{name}_low"), F.array(*high).alias(f"{name}_high"), F.array(*part).alias(f"{name}_part")]
    return read.select(*keys, F.col("_n").alias("n"), *out)
