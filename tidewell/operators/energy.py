"""Power runway."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def runway_hours(net_watts: Column, energy_wh: Column, cutoff_wh: Column) -> Column:
    """Hours until the energy falls to the cutoff, from an array of net watts by hour; the last hour
    counts in part, and the whole projection if it never does."""
    start = F.struct(energy_wh.cast("double").alias("e"), F.lit(0.0).alias("h"), (energy_wh <= cutoff_wh).alias("done"))

    def hour(s: Column, net: Column) -> Column:
        after = s["e"] + net
        part = F.try_divide(s["e"] - cutoff_wh, -net)
        ends = (net < 0) & (after <= cutoff_wh)
        return F.when(s["done"], s).otherwise(F.struct(after.alias("e"), (s["h"] + F.when(ends, part).otherwise(1.0)).alias("h"), ends.alias("done")))

    return F.aggregate(net_watts, start, hour, lambda s: s["h"])


def project_runway(state: DataFrame, load_profile: DataFrame, pv: DataFrame, hours: int, derate: float = 0.75) -> DataFrame:
    """node_id, runway: ``state(node_id, hour, energy_wh, cutoff_wh)``, ``load_profile(hour_of_day, load_w)``, ``pv(hour, pv_w)``."""
    ahead = state.select("node_id", F.explode(F.sequence(F.col("hour"), F.col("hour") + hours - 1)).alias("hour"), "energy_wh", "cutoff_wh")
    both = ahead.withColumn("hour_of_day", (F.col("hour") % 24)).join(load_profile, "hour_of_day", "left").join(pv, "hour", "left")
    net = F.greatest(F.coalesce("pv_w", F.lit(0.0)), F.lit(0.0)) * derate - F.greatest(F.coalesce("load_w", F.lit(0.0)), F.lit(0.0))
    series = both.groupBy("node_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("hour", net.alias("net")))), lambda s: s["net"]).alias("net"), F.first("energy_wh").alias("e"), F.first("cutoff_wh").alias("c"))
    return series.select("node_id", runway_hours(F.col("net"), F.col("e"), F.col("c")).alias("runway"))
