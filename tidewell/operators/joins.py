"""Joins that Spark has no operator for, from equi-joins and partial aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, columns: list[str], bucket: int) -> DataFrame:
    """``left`` with the newest row of ``right`` not after it (null if there is none).

    Time is cut into buckets. The newest earlier row is either in the same bucket, found by a
    window over both sides in order of time, or the last of an earlier bucket, which comes from a table
    of one row a bucket.
    """
    value = F.struct(right_time, *columns)
    r = right.select(*keys, F.floor(F.col(right_time) / bucket).alias("_b"), F.col(right_time), *columns)
    lasts = r.groupBy(*keys, "_b").agg(F.max(value).alias("_last"))
    l_buckets = left.select(*keys, F.floor(F.col(left_time) / bucket).alias("_b")).distinct()
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = l_buckets.join(lasts, [*keys, "_b"], "full").select(*keys, "_b", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    both = left.select(*keys, F.floor(F.col(left_time) / bucket).alias("_b"), F.col(left_time).alias("_t"), F.struct(*left.columns).alias("_row"), F.lit(1).alias("_side"), F.lit(None).cast(r.select(value).schema[0].dataType).alias("_v"))
    both = both.unionByName(r.select(*keys, "_b", F.col(right_time).alias("_t"), F.lit(None).cast(both.schema["_row"].dataType).alias("_row"), F.lit(0).alias("_side"), value.alias("_v")))
    upto = Window.partitionBy(*keys, "_b").orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_same", F.last("_v", ignorenulls=True).over(upto)).where("_side = 1").join(carried, [*keys, "_b"], "left")
    found = F.coalesce("_same", "_carry")
    return out.select(*(F.col("_row")[c].alias(c) for c in left.columns), *(found[c].alias(c) for c in (right_time, *columns)))


def within_tolerance(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, tolerance: int) -> DataFrame:
    """Pairs at most ``tolerance`` apart, as an equi-join on buckets of that width and their neighbours."""
    width = max(1, tolerance)
    a = left.withColumn("_b", F.explode(F.array(*(F.floor(F.col(left_time) / width) + k for k in (-1, 0, 1)))))
    b = right.withColumn("_b", F.floor(F.col(right_time) / width))
    return a.join(b, [*keys, "_b"]).where(F.abs(F.col(left_time) - F.col(right_time)) <= tolerance).drop("_b")


def merge_ranges(df: DataFrame, keys: list[str], start: str, end: str, gap: int = 1) -> DataFrame:
    """keys, start, end: ranges that overlap or are at most ``gap`` apart, merged."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(F.col(start) <= reach + gap, 0).otherwise(1))
    grouped = marked.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "_g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_g")
