"""Queries on scans, filters, buckets and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.model import US, metrics, micros, read, sensors
from tidewell.operators import buckets as B
from tidewell.operators import joins as J
from tidewell.operators.quantiles import quantiles
from tidewell.plans.registry import query

HOUR = 3600
#: 2024-01-08 to 2024-01-15, in seconds since the epoch.
WEEK = (1704672000, 1705276800)


def hourly(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return B.bucket_agg(metrics(spark, sf_dir), HOUR, **options)


def _bucket_sql(aggregate: str, where: str = "", having: str = "") -> str:
    return f"SELECT sensor_id, CAST(floor(us / 3600e6) * 3600 AS BIGINT) AS bucket, {aggregate} AS agg_value, count(*) AS samples FROM m {where} GROUP BY 1, 2 {having}"


@query(_bucket_sql("avg(value)"), "agg_value")
def bucket_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(spark, sf_dir)


@query(_bucket_sql("arg_max(value, us)"), "agg_value")
def bucket_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(spark, sf_dir, mode="last")


@query(_bucket_sql("sum(value)"), "agg_value")
def bucket_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(spark, sf_dir, mode="sum")


@query(_bucket_sql("min(value)"), "agg_value")
def bucket_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(spark, sf_dir, mode="min")


@query(_bucket_sql("max(value)"), "agg_value")
def bucket_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(spark, sf_dir, mode="max")


@query(_bucket_sql("avg(value)", "WHERE coalesce(quality, 0) = 0", "HAVING count(*) >= 2"), "agg_value")
def bucket_quality_min_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(spark, sf_dir, good_only=True, min_samples=2)


@query(
    """WITH t AS (SELECT *, CASE sensor_id WHEN 'click' THEN 'flow meter' WHEN 'view' THEN 'door-state' WHEN 'purchase' THEN 'Rain Gauge' ELSE 'temperature' END AS type FROM m)
    SELECT_FROM SELECT sensor_id, CAST(floor(us / 3600e6) * 3600 AS BIGINT) AS bucket,
        CASE type WHEN 'flow meter' THEN sum(value) WHEN 'Rain Gauge' THEN sum(value) WHEN 'door-state' THEN arg_max(value, us) ELSE avg(value) END AS agg_value, count(*) AS samples
    FROM t GROUP BY sensor_id, type, 2""",
    "agg_value",
)
def bucket_auto_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("sensor_id") == "click", "flow meter").when(F.col("sensor_id") == "view", "door-state").when(F.col("sensor_id") == "purchase", "Rain Gauge").otherwise("temperature")
    return B.bucket_auto(metrics(spark, sf_dir).withColumn("type", name), HOUR, "type")


@query(f"SELECT sensor_id, us, value, quality FROM m WHERE sensor_id IN ('click', 'view') AND us BETWEEN {WEEK[0] * US} AND {WEEK[1] * US}", "value")
def scan_points_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw points of some sensors; the end of the range is included."""
    return metrics(spark, sf_dir).where(F.col("sensor_id").isin("click", "view") & F.col("us").between(WEEK[0] * US, WEEK[1] * US))


@query(f"SELECT sensor_id, us, value, quality FROM m WHERE us >= {WEEK[0] * US} AND us < {WEEK[1] * US} + 1 AND coalesce(quality, 0) = 0 AND isfinite(value)", "value")
def scan_points_half_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good, finite points; an inclusive end is the exclusive one a microsecond later."""
    value = F.col("value")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return metrics(spark, sf_dir).where((F.col("us") >= WEEK[0] * US) & (F.col("us") < WEEK[1] * US + 1) & (F.coalesce("quality", F.lit(0)) == 0) & finite)


@query(
    """WITH s AS (SELECT sensor_id, bucket, lag(bucket) OVER (PARTITION BY sensor_id ORDER BY bucket) AS p FROM h)
    SELECT_FROM SELECT sensor_id, count(*) AS bucket_rows, count(CASE WHEN bucket - p <= 5 * 3600 THEN 1 END) AS delta_count FROM s GROUP BY 1"""
)
def coverage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.coverage_stats(hourly(spark, sf_dir), HOUR)


@query(f"SELECT sensor_id, count(DISTINCT bucket) AS buckets, CAST(168 AS BIGINT) AS expected, 100.0 * count(DISTINCT bucket) / 168 AS coverage_pct FROM h WHERE bucket >= {WEEK[0]} AND bucket < {WEEK[1]} GROUP BY 1", "coverage_pct")
def coverage_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.coverage_percent(hourly(spark, sf_dir), HOUR, *WEEK)


@query("SELECT sensor_id, max(us) AS us, arg_max(value, us) AS value FROM u GROUP BY 1", "value")
def latest_per_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.latest(metrics(spark, sf_dir, by_user=True), ["sensor_id"], ["us"], ["value"])


@query("SELECT sensor_id, min(us) AS us, arg_min(value, us) AS value FROM u GROUP BY 1", "value")
def first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.latest(metrics(spark, sf_dir, by_user=True), ["sensor_id"], ["us"], ["value"], first=True)


@query(
    """WITH l AS (SELECT sensor_id, max(us) AS us, arg_max(value, us) AS value FROM u GROUP BY 1)
    SELECT_FROM SELECT CAST(substr(sensor_id, 2) AS BIGINT) % 10 AS node, sum(value) AS total, avg(value) AS mean, max(value) AS most FROM l GROUP BY 1""",
    "total mean most",
)
def latest_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = B.latest(metrics(spark, sf_dir, by_user=True), ["sensor_id"], ["us"], ["value"])
    return newest.groupBy((F.substring("sensor_id", 2, 20).cast("long") % 10).alias("node")).agg(F.sum("value").alias("total"), F.avg("value").alias("mean"), F.max("value").alias("most"))


@query(
    """WITH s AS (SELECT c_custkey AS customer, n_name AS node FROM customer JOIN nation ON c_nationkey = n_nationkey),
      l AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY 1)
    SELECT_FROM SELECT s.customer, s.node, l.k AS last_order, o.o_totalprice AS value FROM s LEFT JOIN l ON l.o_custkey = s.customer LEFT JOIN orders AS o ON o.o_orderkey = l.k""",
    "value",
)
def latest_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dimension with the newest fact of each row, if it has one."""
    dim = sensors(spark, sf_dir).select(F.col("sensor_id").alias("customer"), "node")
    newest = B.latest(read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "customer"), ["customer"], ["o_orderkey"], ["o_totalprice"])
    return dim.join(newest, "customer", "left").select("customer", "node", F.col("o_orderkey").alias("last_order"), F.col("o_totalprice").alias("value"))


@query("SELECT o_orderpriority AS subject, epoch_us(CAST(o_orderdate AS TIMESTAMP)) AS issued_us, max(o_orderkey) AS k, arg_max(o_totalprice, o_orderkey) AS value FROM orders GROUP BY 1, 2", "value")
def vintage_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each subject and issue time."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("subject"), micros("o_orderdate").alias("issued_us"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("value"))
    return orders.groupBy("subject", "issued_us").agg(F.max("k").alias("k"), F.max_by("value", "k").alias("value"))


@query(
    """WITH f AS (SELECT o_orderpriority AS subject, epoch_us(CAST(o_orderdate AS TIMESTAMP)) AS issued, avg(o_totalprice) AS price FROM orders GROUP BY 1, 2),
      p AS (SELECT '1-URGENT' AS subject, us FROM (SELECT range * 86400000000 * 30 + 694224000000000 AS us FROM range(0, 90)))
    SELECT_FROM SELECT p.subject, p.us, f.issued, f.price AS value FROM p ASOF JOIN f ON p.subject = f.subject AND p.us >= f.issued""",
    "value",
)
def vintage_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each time the value of the newest issue not after it."""
    orders = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("subject"), micros("o_orderdate").alias("issued")).agg(F.avg("o_totalprice").alias("price"))
    times = spark.range(90).select(F.lit("1-URGENT").alias("subject"), (F.col("id") * 86400 * US * 30 + 694224000 * US).alias("us"))
    found = J.asof(times, orders, ["subject"], "us", "issued", ["price"], bucket=86400 * US * 64)
    return found.where("issued is not null").select("subject", "us", "issued", F.col("price").alias("value"))


@query(
    """SELECT l_orderkey % 7 AS kind, l_returnflag AS subject, CAST(date_trunc('month', l_shipdate) AS DATE) AS target, max(o_orderdate) AS issued, arg_max(l_extendedprice, (o_orderdate, l_orderkey, l_linenumber, l_extendedprice)) AS value
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate <= l_shipdate GROUP BY 1, 2, 3""",
    "value",
)
def forecast_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts by target month: of each the newest vintage that was issued before it."""
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).where("o_orderdate <= l_shipdate")
    keys = [(F.col("l_orderkey") % 7).alias("kind"), F.col("l_returnflag").alias("subject"), F.trunc("l_shipdate", "month").alias("target")]
    return both.groupBy(*keys).agg(F.max("o_orderdate").alias("issued"), F.max_by("l_extendedprice", F.struct("o_orderdate", "l_orderkey", "l_linenumber", "l_extendedprice")).alias("value"))


@query("SELECT sensor_id, CAST(floor(us / 300e6) * 300 AS BIGINT) AS bucket, avg(value) AS value, avg(quality) AS quality, count(*) AS samples FROM m GROUP BY 1, 2", "value quality")
def time_bucket_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir).groupBy("sensor_id", B.bucket_of(300).alias("bucket")).agg(F.avg("value").alias("value"), F.avg("quality").alias("quality"), F.count("*").alias("samples"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type AS metric, avg(value) AS mean, sum(value) AS total, max(ts) AS newest FROM events GROUP BY 1, 2", "mean total")
def hourly_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    return events.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), F.col("event_type").alias("metric")).agg(F.avg("value").alias("mean"), F.sum("value").alias("total"), F.max("ts").alias("newest"))


@query(
    """WITH e AS (SELECT *, lead(us) OVER (PARTITION BY sensor_id ORDER BY us) AS n FROM m)
    SELECT_FROM SELECT sensor_id, round(sum(value * (coalesce(n, 1706745600000000) - us) / 3600e6) / 1000, 3) AS kwh FROM e GROUP BY 1""",
    "kwh",
)
def integrate_kwh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.integrate(metrics(spark, sf_dir), 1706745600 * US)


_NODES = "n AS (SELECT CAST(substr(sensor_id, 2) AS BIGINT) % 5 AS node, sensor_id, CAST(floor(us / 86400e6) * 86400 AS BIGINT) AS bucket, avg(value) AS v FROM u GROUP BY 1, 2, 3)"


def _by_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = B.bucket_agg(metrics(spark, sf_dir, by_user=True), 86400)
    return daily.select((F.substring("sensor_id", 2, 20).cast("long") % 5).alias("node"), "bucket", F.col("agg_value").alias("v"))


@query(f"WITH {_NODES} SELECT_FROM SELECT bucket, sum(a) AS total FROM (SELECT node, bucket, avg(v) AS a FROM n GROUP BY 1, 2) GROUP BY 1", "total")
def two_level_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_node(spark, sf_dir).groupBy("node", "bucket").agg(F.avg("v").alias("a")).groupBy("bucket").agg(F.sum("a").alias("total"))


@query(f"WITH {_NODES} SELECT_FROM SELECT bucket, avg(v) AS mean, min(v) AS least, max(v) AS most FROM n GROUP BY 1", "mean least most")
def two_level_avg_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_node(spark, sf_dir).groupBy("bucket").agg(F.avg("v").alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"))


@query("SELECT v.bucket, v.agg_value * a.agg_value AS power FROM h AS v JOIN h AS a ON v.bucket = a.bucket WHERE v.sensor_id = 'view' AND a.sensor_id = 'click'", "power")
def power_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean volts times mean amperes of each bucket."""
    h = hourly(spark, sf_dir)
    volts = h.where("sensor_id = 'view'").select("bucket", F.col("agg_value").alias("v"))
    amps = h.where("sensor_id = 'click'").select("bucket", F.col("agg_value").alias("a"))
    return volts.join(amps, "bucket").select("bucket", (F.col("v") * F.col("a")).alias("power"))


@query("SELECT sum(value) AS power, max(us) AS us FROM (SELECT sensor_id, max(us) AS us, arg_max(value, us) AS value FROM m GROUP BY 1)", "power")
def latest_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.latest(metrics(spark, sf_dir), ["sensor_id"], ["us"], ["value"]).agg(F.sum("value").alias("power"), F.max("us").alias("us"))


@query("SELECT sensor_id, avg(value) AS mean, min(value) AS least, max(value) AS most, coalesce(stddev_pop(value), 0) AS deviation, quantile_cont(value, 0.5) AS median FROM u GROUP BY 1", "mean least most deviation median")
def window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics(spark, sf_dir, by_user=True)
    stats = m.groupBy("sensor_id").agg(F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("deviation"))
    return stats.join(quantiles(m, ["sensor_id"], "value", [0.5]).select("sensor_id", F.col("_q")[0].alias("median")), "sensor_id")


_MAD = """q AS (SELECT sensor_id, count(*) AS n, median(value) AS median, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM u GROUP BY 1),
      d AS (SELECT u.sensor_id, median(abs(value - q.median)) AS mad FROM u JOIN q ON u.sensor_id = q.sensor_id GROUP BY 1),
      r AS (SELECT q.sensor_id, n, median, mad, iqr, CASE WHEN n < 3 THEN NULL WHEN mad * 1.4826 > 1e-9 THEN mad * 1.4826 WHEN iqr / 1.349 > 1e-9 THEN iqr / 1.349 ELSE 1.0 END AS scale FROM q JOIN d ON q.sensor_id = d.sensor_id)"""


@query(f"WITH {_MAD} SELECT_FROM SELECT * FROM r", "median mad iqr scale")
def robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.robust_scale(metrics(spark, sf_dir, by_user=True), ["sensor_id"])


@query(f"WITH {_MAD} SELECT_FROM SELECT u.sensor_id, us, greatest(-6.0, least(6.0, (value - median) / scale)) AS z FROM u JOIN r ON u.sensor_id = r.sensor_id WHERE scale IS NOT NULL", "z")
def robust_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics(spark, sf_dir, by_user=True)
    z = (F.col("value") - F.col("median")) / F.col("scale")
    return m.join(B.robust_scale(m, ["sensor_id"]), "sensor_id").where("scale is not null").select("sensor_id", "us", F.greatest(F.lit(-6.0), F.least(F.lit(6.0), z)).alias("z"))


_Q = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


@query(
    f"""WITH {_MAD.replace('u GROUP', 'm GROUP').replace('FROM u JOIN', 'FROM m JOIN').replace('u.sensor_id', 'm.sensor_id').replace('FROM u ', 'FROM m ')},
      s AS (SELECT sensor_id, min(value) AS least, max(value) AS most, avg(value) AS mean, stddev_pop(value) AS deviation, {', '.join(f'quantile_cont(value, {q}) AS p{round(100 * q)}' for q in _Q)} FROM m GROUP BY 1)
    SELECT_FROM SELECT s.*, r.n, r.mad, r.iqr FROM s JOIN r ON s.sensor_id = r.sensor_id""",
    "least most mean deviation p1 p5 p25 p50 p75 p95 p99 mad iqr",
)
def rule_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What alarm limits are chosen from."""
    m = metrics(spark, sf_dir)
    scale = B.robust_scale(m, ["sensor_id"]).select("sensor_id", "n", "mad", "iqr")
    stats = m.groupBy("sensor_id").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation"))
    return stats.join(quantiles(m, ["sensor_id"], "value", list(_Q), "_p").drop("n"), "sensor_id").select("sensor_id", "least", "most", "mean", "deviation", *(F.col("_p")[k].alias(f"p{round(100 * q)}") for k, q in enumerate(_Q))).join(scale, "sensor_id")


@query(
    f"""WITH {_MAD.replace('u GROUP', 'm GROUP').replace('FROM u JOIN', 'FROM m JOIN').replace('u.sensor_id', 'm.sensor_id').replace('FROM u ', 'FROM m ')},
      s AS (SELECT sensor_id, avg(value) AS mean, stddev_pop(value) AS sd FROM m GROUP BY 1), k AS (SELECT unnest([1, 2, 3]) AS k)
    SELECT_FROM SELECT s.sensor_id, k, mean - k * sd AS low, mean + k * sd AS high, median - k * 1.4826 * mad AS robust_low, median + k * 1.4826 * mad AS robust_high FROM s JOIN r ON s.sensor_id = r.sensor_id CROSS JOIN k""",
    "low high robust_low robust_high",
)
def sigma_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics(spark, sf_dir)
    both = m.groupBy("sensor_id").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd")).join(B.robust_scale(m, ["sensor_id"]), "sensor_id")
    wide, k = 1.4826 * F.col("mad"), F.col("k")
    return both.withColumn("k", F.explode(F.array(*(F.lit(n) for n in (1, 2, 3))))).select(
        "sensor_id", "k", (F.col("mean") - k * F.col("sd")).alias("low"), (F.col("mean") + k * F.col("sd")).alias("high"), (F.col("median") - k * wide).alias("robust_low"), (F.col("median") + k * wide).alias("robust_high")
    )


@query(
    """WITH p AS (SELECT sensor_id, CAST((bucket // 3600) % 24 AS BIGINT) AS hour, avg(agg_value) AS a FROM h GROUP BY 1, 2)
    SELECT_FROM SELECT g.hour, coalesce(sum(p.a), (SELECT avg(t) FROM (SELECT sum(a) AS t FROM p GROUP BY hour))) AS total FROM (SELECT range AS hour FROM range(24)) AS g LEFT JOIN p ON p.hour = g.hour GROUP BY 1""",
    "total",
)
def hour_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by hour of the day, summed over sensors; hours without data get the mean of the others."""
    h = hourly(spark, sf_dir)
    totals = h.groupBy("sensor_id", F.expr("(bucket div 3600) % 24").alias("hour")).agg(F.avg("agg_value").alias("a")).groupBy("hour").agg(F.sum("a").alias("total"))
    mean = totals.agg(F.avg("total").alias("mean"))
    return spark.range(24).withColumnRenamed("id", "hour").join(totals, "hour", "left").crossJoin(F.broadcast(mean)).select("hour", F.coalesce("total", "mean").alias("total"))


@query(
    """WITH s AS (SELECT sensor_id, avg(value) AS mean, stddev_pop(value) AS sd, count(*) AS n, max(us) AS us, arg_max(value, us) AS newest FROM u GROUP BY 1)
    SELECT_FROM SELECT sensor_id, n, us, 1 / (1 + exp(-((CASE WHEN sd > 1e-9 THEN abs(newest - mean) / sd ELSE 10.0 END) - 3))) AS score FROM s WHERE n >= 12 ORDER BY us DESC, sensor_id LIMIT 50""",
    "score",
)
def predictive_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomaly score of the newest value of the sensors heard of last (a top-k report)."""
    s = metrics(spark, sf_dir, by_user=True).groupBy("sensor_id").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.count("*").alias("n"), F.max("us").alias("us"), F.max_by("value", "us").alias("newest"))
    z = F.when(F.col("sd") > 1e-9, F.abs(F.col("newest") - F.col("mean")) / F.col("sd")).otherwise(10.0)
    return s.where("n >= 12").select("sensor_id", "n", "us", (1 / (1 + F.exp(-(z - 3)))).alias("score")).orderBy(F.desc("us"), "sensor_id").limit(50)


@query("SELECT sensor_id, count(*) AS n, min(us) AS first_us, max(us) AS last_us, min(value) AS least, max(value) AS most, avg(value) AS mean, min(quality) AS q_min, max(quality) AS q_max FROM m GROUP BY 1", "least most mean")
def parity_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two stores of the same points must agree on."""
    return metrics(spark, sf_dir).groupBy("sensor_id").agg(
        F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.min("value").alias("least"), F.max("value").alias("most"), F.avg("value").alias("mean"), F.min("quality").alias("q_min"), F.max("quality").alias("q_max")
    )


@query("SELECT sensor_id, max(value) FILTER (WHERE quality > 0) AS worst_bad, count(*) FILTER (WHERE quality = 0) AS good, count(*) FILTER (WHERE quality > 0) AS bad FROM m GROUP BY 1", "worst_bad")
def filter_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.col("quality") > 0
    return metrics(spark, sf_dir).groupBy("sensor_id").agg(F.max(F.when(bad, F.col("value"))).alias("worst_bad"), F.count(F.when(F.col("quality") == 0, 1)).alias("good"), F.count(F.when(bad, 1)).alias("bad"))
