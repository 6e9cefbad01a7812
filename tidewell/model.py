"""The canonical tables, and how the driver's tables become them.

metrics: sensor_id string, us bigint (microseconds since the epoch, UTC), value double, quality
int. Times are kept as numbers, so no result depends on the session's time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

US = 1_000_000
METRICS = "sensor_id string, us bigint, value double, quality int"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> Column:
    """Microseconds since the epoch of a timestamp without time zone, or of a date."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ))")


def local_time(us: Column, zone: str) -> Column:
    """The clock of ``zone`` at a time in microseconds, as a timestamp without time zone."""
    seconds = (us.cast("decimal(20,0)") / F.lit(US)).cast("decimal(18,6)")
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def day_start(day: Column, zone: str) -> Column:
    """Microseconds since the epoch at which a day of ``zone`` begins."""
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), day.cast("timestamp_ntz"))
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), utc)


def metrics(spark: SparkSession, sf_dir: str, by_user: bool = False) -> DataFrame:
    """The fact table: a series for each event type, or for each user."""
    sensor = F.concat(F.lit("u"), F.col("user_id")) if by_user else F.col("event_type")
    quality = F.get_json_object("props", "$.k").cast("int") % 3
    return read(spark, sf_dir, "events").select(sensor.alias("sensor_id"), micros("ts").alias("us"), "value", quality.alias("quality"))


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sensor dimension: a customer is a sensor, its nation the node, the region the site."""
    customer, nation, region = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("c_custkey").alias("sensor_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"), F.col("n_name").alias("node"), F.col("r_name").alias("site"), F.col("c_acctbal").alias("reading"))
    )
