"""The Parquet lake: points partitioned by date and shard, with late arrivals and compaction.

A folder is ``date=YYYY-MM-DD/shard=NN``. Rows carry ``inserted_at`` (microseconds), the clock that
replication follows; duplicates of (sensor_id, us) go to the last ingested one when read or compacted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.model import US
from tidewell.operators.storage import stored

SHARDS = 16
LAKE = "sensor_id string, us bigint, value double, quality int, inserted_at bigint, date string, shard string"


def shard_of(sensor: str = "sensor_id", shards: int = SHARDS) -> Column:
    return F.lpad(F.pmod(F.xxhash64(sensor), F.lit(shards)).cast("string"), 2, "0")


def date_of(us: str = "us") -> Column:
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col(us) / F.lit(86400 * US)).cast("int")), "yyyy-MM-dd")


def with_partitions(points: DataFrame, shards: int = SHARDS) -> DataFrame:
    inserted = F.col("inserted_at") if "inserted_at" in points.columns else F.lit(None)
    return points.select("sensor_id", "us", "value", "quality", F.coalesce(inserted.cast("bigint"), "us").alias("inserted_at"), date_of().alias("date"), shard_of(shards=shards).alias("shard"))


def append(points: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Add points; one file for each date and shard, sorted for the readers' row-group statistics."""
    dealt = with_partitions(points, shards).repartition("date", "shard").sortWithinPartitions("date", "shard", "sensor_id", "us")
    dealt.write.mode("append").option("compression", "zstd").partitionBy("date", "shard").parquet(path)


def last_ingested(rows: DataFrame) -> DataFrame:
    """One row for each sensor and time: the last ingested."""
    newest = F.max(F.struct("inserted_at", "value", "quality"))
    return rows.groupBy("sensor_id", "us", "date", "shard").agg(newest.alias("r")).select("sensor_id", "us", F.col("r.value").alias("value"), F.col("r.quality").alias("quality"), F.col("r.inserted_at").alias("inserted_at"), "date", "shard")


def read_points(spark: SparkSession, path: str, sensors: list[str] | None = None, start_us: int | None = None, end_us: int | None = None, dedupe: bool = True, shards: int = SHARDS) -> DataFrame:
    """Points of [start, end] (both included), pruned by date and by the sensors' shards."""
    rows = spark.read.schema(LAKE).parquet(path)
    if start_us is not None:
        rows = rows.where((F.col("us") >= start_us) & (F.col("date") >= _day(start_us)))
    if end_us is not None:
        rows = rows.where((F.col("us") <= end_us) & (F.col("date") <= _day(end_us)))
    if sensors is not None:
        wanted = [s.strip() for s in sensors]
        found = spark.range(1).select(F.array(*(shard_of_value(s, shards) for s in wanted)).alias("s")).first()["s"] if wanted else []
        rows = rows.where(F.col("sensor_id").isin(wanted) & F.col("shard").isin(found))
    return last_ingested(rows) if dedupe else rows


def shard_of_value(sensor: str, shards: int = SHARDS) -> Column:
    return F.lpad(F.pmod(F.xxhash64(F.lit(sensor)), F.lit(shards)).cast("string"), 2, "0")


def _day(us: int) -> str:
    from datetime import UTC, datetime

    return datetime.fromtimestamp(us // US, UTC).strftime("%Y-%m-%d")


def overwrite_days(rows: DataFrame, path: str) -> None:
    """Replace the partitions that ``rows`` has, and no others."""
    dealt = rows.select("sensor_id", "us", "value", "quality", "inserted_at", "date", "shard").repartition("date", "shard").sortWithinPartitions("date", "shard", "sensor_id", "us")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("date", "shard").parquet(path)


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """date, shard, files, rows."""
    rows = spark.read.schema(LAKE).parquet(path).select("date", "shard", F.col("_metadata.file_path").alias("_file"))
    return rows.groupBy("date", "shard").agg(F.countDistinct("_file").alias("files"), F.count("*").alias("rows"))


def compact(spark: SparkSession, path: str, staging: str, more_than: int = 10) -> DataFrame:
    """Rewrite the partitions with more than ``more_than`` files, last ingested wins; their inventory before.

    The rows go through ``staging``, since a partition cannot be read while it is replaced.
    """
    busy = stored(inspect(spark, path).where(F.col("files") > more_than))
    rows = spark.read.schema(LAKE).parquet(path).join(busy.select("date", "shard"), ["date", "shard"], "left_semi")
    last_ingested(rows).write.mode("overwrite").parquet(staging)
    overwrite_days(spark.read.schema(LAKE).parquet(staging), path)
    return busy


def replicate(source: DataFrame, path: str, last_us: int, now_us: int, lag_s: int = 60, late_s: int = 48 * 3600, shards: int = SHARDS) -> int:
    """Append what was ingested in (last, now - lag]; the new watermark.

    Rows that were ingested before ``target - late`` wait for a backfill, as that is where the
    window begins when replication has been away for longer. Rows without an ingest time are not
    taken; ``repaired`` gives them one, once.
    """
    target = now_us - lag_s * US
    since = max(last_us, target - late_s * US)
    append(source.where((F.col("inserted_at") > since) & (F.col("inserted_at") <= target)), path, shards)
    return target


def repaired(source: DataFrame, target_us: int, since_us: int | None = None) -> DataFrame:
    """``source`` with ``target_us`` for missing ingest times (of rows from ``since_us`` on); to be written back,
    so that the next replication finds each such row once."""
    recent = F.lit(True) if since_us is None else F.col("us") >= since_us
    return source.withColumn("inserted_at", F.when(F.col("inserted_at").isNull() & recent, F.lit(target_us)).otherwise(F.col("inserted_at")))


def _delete(spark: SparkSession, path: str) -> None:
    """Remove a folder, if it is there, through the file system that Spark uses for it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.delete(at, True) and files.exists(at):
        raise OSError(f"{path} could not be removed")


def backfill(source: DataFrame, path: str, day: str, shards: int = SHARDS, cold: str | None = None) -> None:
    """Rewrite a whole day from the source: shards that it no longer has go, and so does the day in the cold tier."""
    spark = source.sparkSession
    rows = last_ingested(with_partitions(source, shards).where(F.col("date") == day))
    overwrite_days(rows, path)
    now = {r["shard"] for r in rows.select("shard").distinct().collect()}  # one a shard
    for r in spark.read.schema(LAKE).parquet(path).where(F.col("date") == day).select("shard").distinct().collect():
        if r["shard"] not in now:
            _delete(spark, f"{path}/date={day}/shard={r['shard']}")
    if cold is not None:
        _delete(spark, f"{cold}/date={day}")


def parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """sensor_id, left_rows, right_rows, same: the counts of two stores."""
    a, b = (d.groupBy("sensor_id").agg(F.count("*").alias(n)) for d, n in ((left, "left_rows"), (right, "right_rows")))
    out = a.join(b, "sensor_id", "full").fillna(0, ["left_rows", "right_rows"])
    return out.withColumn("same", F.col("left_rows") == F.col("right_rows"))


def retain(spark: SparkSession, hot: str, cold: str, before: str) -> None:
    """Copy the days before ``before`` to the cold tier; ``expire`` removes them from the hot one."""
    rows = spark.read.schema(LAKE).parquet(hot).where(F.col("date") < before)
    overwrite_days(last_ingested(rows), cold)


def expire(spark: SparkSession, hot: str, cold: str, before: str) -> list[str]:
    """Remove the days before ``before`` from the hot tier, of those that the cold one holds in full; their dates."""
    keys = ["sensor_id", "us"]
    old = spark.read.schema(LAKE).parquet(hot).where(F.col("date") < before)
    missing = old.select("date", *keys).join(spark.read.schema(LAKE).parquet(cold).where(F.col("date") < before).select("date", *keys), ["date", *keys], "left_anti").select("date").distinct()
    days = sorted(r["date"] for r in old.select("date").distinct().join(missing, "date", "left_anti").collect())  # one a day
    for day in days:
        _delete(spark, f"{hot}/date={day}")
    return days


def tiers(spark: SparkSession, hot: str, cold: str, **options) -> DataFrame:
    """Points of both tiers; a partition that is in the hot tier is not read from the cold one."""
    a, b = (read_points(spark, p, dedupe=False, **options) for p in (hot, cold))
    owned = a.select("date", "shard").distinct()
    return last_ingested(a.unionByName(b.join(owned, ["date", "shard"], "left_anti")))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], ignore: bool = False) -> DataFrame:
    """``old`` with the rows of ``new``: of equal keys the new one stays, or with ``ignore`` the old one."""
    if ignore:
        return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti").select(*new.columns))


def purge(rows: DataFrame, sensors: list[str], start_us: int, end_us: int) -> tuple[DataFrame, DataFrame]:
    """(rows without those of [start, end] of the sensors, sensor_id, n, first_us, last_us of what goes)."""
    inside = F.col("sensor_id").isin(sensors) & F.col("us").between(start_us, end_us)
    report = rows.where(inside).groupBy("sensor_id").agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    return rows.where(~F.coalesce(inside, F.lit(False))), report
