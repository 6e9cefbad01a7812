"""Queries on windows, ranks, sets, limits, JSON and derived series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import expressions as X
from tidewell.functions import stats as S
from tidewell.model import metrics, micros, read, sensors
from tidewell.operators import buckets as B
from tidewell.operators import joins as J
from tidewell.operators import windows as W
from tidewell.plans.aggregates import HOUR, hourly
from tidewell.plans.registry import query

_STEPS = "d AS (SELECT *, lag(bucket) OVER w AS pb, lag(agg_value) OVER w AS pv FROM h WINDOW w AS (PARTITION BY sensor_id ORDER BY bucket))"


@query(f"WITH {_STEPS} SELECT_FROM SELECT sensor_id, bucket, agg_value - pv AS delta, bucket - pb AS dt FROM d WHERE pv IS NOT NULL", "delta")
def delta_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.deltas(hourly(spark, sf_dir), HOUR)


@query(f"WITH {_STEPS}, t AS (SELECT *, (agg_value - pv) - 360 * floor((agg_value - pv) / 360) AS t FROM d WHERE pv IS NOT NULL) SELECT_FROM SELECT sensor_id, bucket, CASE WHEN t > 180 THEN t - 360 ELSE t END AS delta, bucket - pb AS dt FROM t", "delta")
def delta_circular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.deltas(hourly(spark, sf_dir), HOUR, mode="circular")


@query(f"WITH {_STEPS} SELECT_FROM SELECT sensor_id, bucket, greatest(agg_value - pv, 0.0) AS delta, bucket - pb AS dt FROM d WHERE pv IS NOT NULL", "delta")
def delta_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.deltas(hourly(spark, sf_dir), HOUR, mode="reset")


@query(f"WITH {_STEPS} SELECT_FROM SELECT sensor_id, bucket, agg_value - pv AS delta, bucket - pb AS dt FROM d WHERE pv IS NOT NULL AND bucket - pb <= 3600", "delta")
def gap_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.deltas(hourly(spark, sf_dir), HOUR, gap=1)


@query(
    f"""WITH {_STEPS}, e AS (SELECT sensor_id, bucket, agg_value - pv AS x, bucket - pb AS dt FROM d),
      f AS (SELECT *, lag(x) OVER w AS px, lag(dt) OVER w AS pdt FROM e WINDOW w AS (PARTITION BY sensor_id ORDER BY bucket))
    SELECT_FROM SELECT sensor_id, bucket, x - px AS delta2 FROM f WHERE dt <= 7200 AND pdt <= 7200""",
    "delta2",
)
def second_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.second_deltas(hourly(spark, sf_dir), HOUR, gap=2)


@query(f"WITH {_STEPS} SELECT_FROM SELECT sensor_id, bucket, 3600 * (agg_value - pv) / greatest(bucket - pb, 1) AS rate FROM d WHERE pv IS NOT NULL", "rate")
def rate_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change per hour."""
    return W.deltas(hourly(spark, sf_dir), HOUR).select("sensor_id", "bucket", (3600 * F.col("delta") / F.greatest(F.col("dt"), F.lit(1))).alias("rate"))


@query("SELECT a.sensor_id, a.bucket, avg(b.agg_value) AS trailing_mean FROM h AS a JOIN h AS b ON a.sensor_id = b.sensor_id AND b.bucket BETWEEN a.bucket - 5 * 3600 AND a.bucket GROUP BY 1, 2", "trailing_mean")
def trailing_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.trailing_average(hourly(spark, sf_dir), 6, HOUR)


_PAIRS = "p AS (SELECT a.sensor_id AS a, b.sensor_id AS b, a.bucket, a.agg_value AS x, b.agg_value AS y FROM h AS a JOIN h AS b ON a.bucket = b.bucket AND a.sensor_id < b.sensor_id)"
_PEARSON = "CASE WHEN n * sxx - sx * sx > 1e-12 AND n * syy - sy * sy > 1e-12 THEN greatest(-1.0, least(1.0, (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)))) END"
_SUMS = "count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy"


@query(
    f"""WITH {_PAIRS}, s AS (SELECT a, b, bucket, count(*) OVER w AS n, sum(x) OVER w AS sx, sum(y) OVER w AS sy, sum(x * x) OVER w AS sxx, sum(y * y) OVER w AS syy, sum(x * y) OVER w AS sxy
      FROM p WINDOW w AS (PARTITION BY a, b ORDER BY bucket ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
    SELECT_FROM SELECT a, b, bucket, {_PEARSON} AS r FROM s WHERE n = 24""",
    "r",
)
def rolling_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = S.aligned_pairs(hourly(spark, sf_dir), "agg_value")
    return W.rolling_pearson(pairs, ["a", "b"], "bucket", "x", "y", 24)


_RHO = f"rho AS (SELECT sensor_id, greatest(-0.9999999, least(0.9999999, {_PEARSON})) AS rho1 FROM (SELECT sensor_id, {_SUMS} FROM (SELECT sensor_id, pv AS x, agg_value AS y FROM d WHERE pv IS NOT NULL) GROUP BY 1))"


@query(f"WITH {_STEPS}, {_RHO} SELECT_FROM SELECT * FROM rho", "rho1")
def lag1_autocorr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.lag1_autocorrelation(hourly(spark, sf_dir), "agg_value", HOUR * 4096)


_RANKS = "k AS (SELECT *, rank() OVER (PARTITION BY sensor_id ORDER BY q) + (count(*) OVER (PARTITION BY sensor_id, q) - 1) / 2.0 AS avg_rank FROM (SELECT sensor_id, bucket, round(agg_value) AS q FROM h))"


@query(f"WITH {_RANKS} SELECT_FROM SELECT * FROM k", "q avg_rank")
def rank_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    coarse = hourly(spark, sf_dir).select("sensor_id", "bucket", F.round("agg_value").alias("q"))
    return W.average_ranks(coarse, ["sensor_id"], "q").select("sensor_id", "bucket", "q", "avg_rank")


@query(f"WITH {_PAIRS} SELECT_FROM SELECT a, b, 0 AS lag, n, {_PEARSON} AS r FROM (SELECT a, b, {_SUMS} FROM p GROUP BY 1, 2)", "r")
def pearson_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.correlations(hourly(spark, sf_dir), "agg_value", interval=HOUR)


@query(
    f"""WITH {_PAIRS}, r AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0 AS x, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0 AS y FROM p)
    SELECT_FROM SELECT a, b, n, {_PEARSON} AS r FROM (SELECT a, b, {_SUMS} FROM r GROUP BY 1, 2)""",
    "r",
)
def spearman_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = S.aligned_pairs(hourly(spark, sf_dir), "agg_value")
    ranked = W.average_ranks(W.average_ranks(pairs, ["a", "b"], "x").withColumnRenamed("avg_rank", "rx"), ["a", "b"], "y")
    return ranked.groupBy("a", "b").agg(*S.raw_sums("rx", "avg_rank")).select("a", "b", "n", S.pearson_of_sums().alias("r"))


_LAGS = f"""l AS (SELECT unnest(range(-6, 7)) AS lag), q AS (SELECT a.sensor_id AS a, b.sensor_id AS b, CAST(lag AS INTEGER) AS lag, a.agg_value AS x, b.agg_value AS y FROM h AS a CROSS JOIN l JOIN h AS b ON b.bucket = a.bucket + lag * 3600 AND a.sensor_id < b.sensor_id),
    c AS (SELECT a, b, lag, n, CASE WHEN n >= 3 THEN {_PEARSON} END AS r FROM (SELECT a, b, lag, {_SUMS} FROM q GROUP BY 1, 2, 3))"""


@query(f"WITH {_LAGS} SELECT_FROM SELECT * FROM c", "r")
def lag_corr_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.correlations(hourly(spark, sf_dir), "agg_value", list(range(-6, 7)), HOUR)


@query(f"WITH {_LAGS} SELECT_FROM SELECT a, b, lag, n, r FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY coalesce(abs(r), -1) DESC, n DESC, abs(lag), lag) AS k FROM c) WHERE k = 1", "r")
def best_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.best_lag(S.correlations(hourly(spark, sf_dir), "agg_value", list(range(-6, 7)), HOUR))


def correlation_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a, b, n, n_eff, r, p, q, low, high, status: the correlation matrix with its inference."""
    h = hourly(spark, sf_dir)
    rho = S.lag1_autocorrelation(h, "agg_value", HOUR * 4096)
    cells = S.correlations(h, "agg_value", interval=HOUR)
    cells = cells.join(rho.select(F.col("sensor_id").alias("a"), F.col("rho1").alias("ra")), "a", "left").join(rho.select(F.col("sensor_id").alias("b"), F.col("rho1").alias("rb")), "b", "left")
    cells = cells.withColumn("n_eff", S.effective_n(F.col("n"), F.col("ra"), F.col("rb")))
    cells = cells.withColumn("p", S.fisher_p(F.col("r"), F.col("n_eff").cast("double")))
    low, high = S.fisher_interval(F.col("r"), F.col("n_eff"))
    out = S.benjamini_hochberg(cells, "p").withColumn("low", low).withColumn("high", high)
    status = F.when(F.col("r").isNull(), "insufficient_overlap").when((F.col("n") >= 10) & (F.col("q") <= 0.05) & (F.abs("r") >= 0.2), "ok").otherwise("not_significant")
    return out.select("a", "b", "n", "n_eff", "r", "p", "q", "low", "high", status.alias("status"))


@query(
    f"""WITH {_STEPS}, {_RHO}, {_PAIRS}, c AS (SELECT a, b, n, {_PEARSON} AS r FROM (SELECT a, b, {_SUMS} FROM p GROUP BY 1, 2))
    SELECT_FROM SELECT a, b, n, r, CAST(greatest(3, least(n, floor(n / greatest(1.0, 1 + 2 * x.rho1 * y.rho1)))) AS BIGINT) AS n_eff FROM c JOIN rho AS x ON x.sensor_id = a JOIN rho AS y ON y.sensor_id = b""",
    "r",
)
def n_eff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlation_cells(spark, sf_dir).select("a", "b", "n", "r", "n_eff")


@query(
    """WITH t AS (SELECT p_partkey AS k, p_retailprice / (SELECT max(p_retailprice) FROM part) AS p FROM part),
      r AS (SELECT k, p, p * count(*) OVER () / row_number() OVER (ORDER BY p, k DESC) AS a, p * count(*) OVER () / (count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING)) AS v FROM t)
    SELECT_FROM SELECT k, p, least(1.0, min(v) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) AS q FROM r""",
    "p q",
)
def bh_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    most = part.agg(F.max("p_retailprice").alias("m"))
    return S.benjamini_hochberg(part.crossJoin(F.broadcast(most)).select(F.col("p_partkey").alias("k"), (F.col("p_retailprice") / F.col("m")).alias("p")), "p").select("k", "p", "q")


@query(
    f"SELECT k AS linestatus, n, CASE WHEN n * sxx - sx * sx > 1e-12 THEN (n * sxy - sx * sy) / (n * sxx - sx * sx) END AS slope, (sy - (n * sxy - sx * sy) / (n * sxx - sx * sx) * sx) / n AS intercept, power({_PEARSON}, 2) AS r2 FROM (SELECT l_linestatus AS k, {_SUMS} FROM (SELECT l_linestatus, CAST(l_quantity AS DOUBLE) AS x, l_extendedprice / 1000.0 AS y FROM lineitem) GROUP BY 1)",
    "slope intercept r2",
)
def ols_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("linestatus"), F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice") / 1000.0).alias("y"))
    return S.regression(lines, ["linestatus"], "x", "y")


@query("WITH s AS (SELECT sensor_id, avg(agg_value) AS m, stddev_samp(agg_value) AS d FROM h GROUP BY 1) SELECT_FROM SELECT h.sensor_id, bucket, (agg_value - m) / d AS z FROM h JOIN s ON h.sensor_id = s.sensor_id WHERE d > 0", "z")
def zscore_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hourly(spark, sf_dir)
    s = h.groupBy("sensor_id").agg(F.avg("agg_value").alias("m"), F.stddev_samp("agg_value").alias("d"))
    return h.join(s, "sensor_id").where("d > 0").select("sensor_id", "bucket", ((F.col("agg_value") - F.col("m")) / F.col("d")).alias("z"))


@query("WITH s AS (SELECT sensor_id, (bucket // 3600) % 24 AS hour, avg(agg_value) AS m FROM h GROUP BY 1, 2) SELECT_FROM SELECT h.sensor_id, bucket, agg_value - m AS residual FROM h JOIN s ON h.sensor_id = s.sensor_id AND (bucket // 3600) % 24 = hour", "residual")
def hour_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.hour_residual(hourly(spark, sf_dir))


@query(
    """WITH c AS (SELECT sensor_id, (us // 3600000000) % 24 AS hour, count(*) AS c FROM u GROUP BY 1, 2), e AS (SELECT sensor_id, -sum(c / t * ln(c / t)) / ln(24) AS entropy FROM (SELECT *, sum(c) OVER (PARTITION BY sensor_id) AS t FROM c) GROUP BY 1)
    SELECT_FROM SELECT sensor_id, entropy, greatest(0.25, least(1.0, entropy)) AS weight FROM e""",
    "entropy weight",
)
def hour_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hour_entropy(metrics(spark, sf_dir, by_user=True), ["sensor_id"], F.expr("(us div 3600000000) % 24"))


@query(
    """WITH s AS (SELECT sensor_id, min(bucket) AS lo, max(bucket) AS hi FROM h GROUP BY 1), g AS (SELECT sensor_id, unnest(range(lo, hi + 1, 3600)) AS bucket FROM s)
    SELECT_FROM SELECT g.sensor_id, g.bucket, h.agg_value FROM g LEFT JOIN h ON g.sensor_id = h.sensor_id AND g.bucket = h.bucket""",
    "agg_value",
)
def dense_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.dense_grid(hourly(spark, sf_dir), HOUR)


@query("WITH n AS (SELECT *, row_number() OVER w AS k, lead(us) OVER w AS nx FROM m WINDOW w AS (PARTITION BY sensor_id ORDER BY us)) SELECT_FROM SELECT sensor_id, us, value FROM n WHERE (k - 1) % 10 = 0 OR nx IS NULL", "value")
def stride_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.stride_downsample(metrics(spark, sf_dir).select("sensor_id", "us", "value"), ["sensor_id"], "us", 10)


@query(
    """WITH g AS (SELECT * FROM (SELECT sensor_id, us, value, unnest(range(CAST(ceil(us / 3600e6) AS BIGINT) * 3600, (us // 1000000) + 7201, 3600)) AS emit FROM m))
    SELECT_FROM SELECT sensor_id, emit, avg(value) AS value, count(*) AS samples FROM g WHERE us > (emit - 7200) * 1000000 AND us <= emit * 1000000 GROUP BY 1, 2""",
    "value",
)
def rolling_emit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.rolling_mean_at(metrics(spark, sf_dir), 7200, HOUR)


@query("SELECT s_suppkey AS id, CASE WHEN s_acctbal > 5000 THEN s_suppkey END AS given, CAST(row_number() OVER (ORDER BY CASE WHEN s_acctbal > 5000 THEN s_suppkey END ASC NULLS LAST, s_suppkey) AS BIGINT) AS place FROM supplier")
def row_number_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An explicit order first; rows without one are appended.

    Range partitions are numbered each for itself, on top of the counts of those before.
    """
    given = F.when(F.col("s_acctbal") > 5000, F.col("s_suppkey"))
    rows = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), given.alias("given"))
    part = F.when(F.col("given").isNull(), F.lit(1 << 40)).otherwise(0) + F.floor(F.coalesce("given", "id") / F.lit(4096))
    dealt = rows.withColumn("_p", part)
    before = dealt.groupBy("_p").agg(F.count("*").alias("c")).select("_p", (F.sum("c").over(Window.orderBy("_p")) - F.col("c")).alias("_before"))
    inside = Window.partitionBy("_p").orderBy(F.asc_nulls_last("given"), "id")
    return dealt.join(before, "_p").select("id", "given", (F.row_number().over(inside) + F.col("_before")).cast("long").alias("place"))


# ---- duplicates, sets, limits, JSON ------------------------------------------------------


@query("SELECT l_orderkey AS sensor, l_linenumber % 2 AS slot, arg_max(l_extendedprice, (l_shipdate, l_linenumber, l_extendedprice)) AS value, max(l_shipdate) AS inserted FROM lineitem GROUP BY 1, 2", "value")
def compaction_last_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of rows with one key the last ingested, as compaction keeps them."""
    lines = read(spark, sf_dir, "lineitem")
    newest = F.max_by("l_extendedprice", F.struct("l_shipdate", "l_linenumber", "l_extendedprice"))
    return lines.groupBy(F.col("l_orderkey").alias("sensor"), (F.col("l_linenumber") % 2).alias("slot")).agg(newest.alias("value"), F.max("l_shipdate").alias("inserted"))


@query("SELECT l_orderkey AS sensor, l_linenumber % 2 AS slot, arg_min(l_extendedprice, (l_shipdate, l_linenumber, l_extendedprice)) AS value FROM lineitem GROUP BY 1, 2", "value")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of rows with one key the first written."""
    lines = read(spark, sf_dir, "lineitem")
    oldest = F.min_by("l_extendedprice", F.struct("l_shipdate", "l_linenumber", "l_extendedprice"))
    return lines.groupBy(F.col("l_orderkey").alias("sensor"), (F.col("l_linenumber") % 2).alias("slot")).agg(oldest.alias("value"))


@query("SELECT bucket, sum(v) AS total FROM (SELECT bucket, agg_value AS v FROM h WHERE sensor_id = 'click' UNION ALL SELECT bucket, agg_value FROM h WHERE sensor_id = 'view') GROUP BY 1", "total")
def union_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hourly(spark, sf_dir)
    a, b = (h.where(F.col("sensor_id") == s).select("bucket", "agg_value") for s in ("click", "view"))
    return a.unionByName(b).groupBy("bucket").agg(F.sum("agg_value").alias("total"))


@query("SELECT c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_has_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(F.col("c_custkey").alias("id"))


@query("SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("id"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract_string(coalesce(props, '{}'), '$.k') AS INTEGER) >= 90")
def json_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object(F.coalesce("props", F.lit("{}")), "$.k").cast("int")
    return read(spark, sf_dir, "events").select("event_id", k.alias("k")).where("k >= 90")


@query("SELECT p_partkey AS id, p_name AS name, p_type AS type FROM part WHERE p_name ILIKE '%an%' OR p_type ILIKE '%an%'")
def ilike_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"))
    return part.where(F.col("name").ilike("%an%") | F.col("type").ilike("%an%"))


@query("SELECT event_id, epoch_us(ts) AS us FROM events WHERE (epoch_us(ts), event_id) > (1705276800000000, 0) ORDER BY 2, 1 LIMIT 100")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of events after a (time, id) cursor."""
    rows = read(spark, sf_dir, "events").select("event_id", micros("ts").alias("us"))
    at = F.lit(1705276800000000)
    return rows.where((F.col("us") > at) | ((F.col("us") == at) & (F.col("event_id") > 0))).orderBy("us", "event_id").limit(100)


@query("SELECT site, node, count(*) AS sensors, sum(reading) AS total FROM (SELECT r_name AS site, n_name AS node, c_acctbal AS reading FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) GROUP BY 1, 2", "total")
def dimension_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensors(spark, sf_dir).groupBy("site", "node").agg(F.count("*").alias("sensors"), F.sum("reading").alias("total"))


@query(
    """WITH RECURSIVE o AS (SELECT l_suppkey AS g, epoch_us(CAST(l_shipdate AS TIMESTAMP)) // 86400000000 AS s, epoch_us(CAST(l_shipdate AS TIMESTAMP)) // 86400000000 + l_linenumber AS e FROM lineitem),
      b AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY g ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM o),
      c AS (SELECT *, sum(fresh) OVER (PARTITION BY g ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM b)
    SELECT_FROM SELECT g, min(s) AS s, max(e) AS e FROM c GROUP BY g, k""".replace("RECURSIVE ", "")
)
def loss_range_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda c: F.expr(f"unix_date({c})").cast("long")
    ranges = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("g"), day("CAST(l_shipdate AS DATE)").alias("s"), (day("CAST(l_shipdate AS DATE)") + F.col("l_linenumber")).alias("e"))
    return J.merge_ranges(ranges, ["g"], "s", "e")


# ---- derived series ----------------------------------------------------------------------

_WIDE = "w AS (SELECT bucket, max(CASE WHEN sensor_id = 'click' THEN agg_value END) AS a, max(CASE WHEN sensor_id = 'view' THEN agg_value END) AS b FROM h WHERE sensor_id IN ('click', 'view') GROUP BY 1)"


@query(f"WITH {_WIDE} SELECT_FROM SELECT 'ratio' AS sensor_id, bucket, 100 * a / (a + b) + sqrt(a) AS agg_value, CAST(1 AS BIGINT) AS samples FROM w WHERE a IS NOT NULL AND b IS NOT NULL AND a + b <> 0 AND a >= 0", "agg_value")
def derived_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = X.Derived("ratio", {"a": ("click", 0), "b": ("view", 0)}, lambda c: 100 * X.divide(c["a"], c["a"] + c["b"]) + X.root(c["a"]))
    return X.evaluate(hourly(spark, sf_dir), ratio, HOUR)


_LAGGED = "z AS (SELECT w.bucket, w.a - x.agg_value AS v FROM w JOIN h AS x ON x.sensor_id = 'view' AND x.bucket = w.bucket - 7200 WHERE w.a IS NOT NULL)"


@query(f"WITH {_WIDE}, {_LAGGED} SELECT_FROM SELECT 'change' AS sensor_id, bucket, v AS agg_value, CAST(1 AS BIGINT) AS samples FROM z", "agg_value")
def derived_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    change = X.Derived("change", {"a": ("click", 0), "b": ("view", 7200)}, "a - b")
    return X.evaluate(hourly(spark, sf_dir), change, HOUR)


@query(f"WITH {_WIDE}, {_LAGGED} SELECT_FROM SELECT 'change' AS sensor_id, bucket, v AS agg_value, CAST(1 AS BIGINT) AS samples FROM z UNION ALL SELECT 'bounded', bucket, greatest(-10.0, least(10.0, v)), 1 FROM z", "agg_value")
def derived_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    change = X.Derived("change", {"a": ("click", 0), "b": ("view", 7200)}, "a - b")
    bounded = X.Derived("bounded", {"x": ("change", 0)}, lambda c: X.clamp(c["x"], -10.0, 10.0))
    return X.evaluate_all(hourly(spark, sf_dir), [bounded, change], HOUR)


@query("SELECT l_linenumber AS k, count(*) AS n, sum(CASE WHEN l_quantity > 25 THEN least(l_quantity, 40) ELSE greatest(l_quantity, 5) END) AS total FROM lineitem GROUP BY 1", "total")
def conditional_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("double")
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg(F.count("*").alias("n"), F.sum(X.if_else(q > 25, X.n_min(q, F.lit(40.0)), X.n_max(q, F.lit(5.0)))).alias("total"))


@query("SELECT sensor_id, bucket FROM (SELECT sensor_id, bucket, row_number() OVER (PARTITION BY sensor_id ORDER BY abs(agg_value) DESC, bucket) AS k FROM h) WHERE k <= 5")
def top_k_per_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("sensor_id").orderBy(F.desc(F.abs("agg_value")), "bucket")
    return hourly(spark, sf_dir).withColumn("k", F.row_number().over(w)).where("k <= 5").select("sensor_id", "bucket")


@query("SELECT b.sensor_id, b.bucket, count(*) AS n FROM h AS b JOIN m ON m.sensor_id = b.sensor_id AND abs(m.us - b.bucket * 1000000) <= 600000000 GROUP BY 1, 2")
def band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points within ten minutes of a bucket's start."""
    h = hourly(spark, sf_dir).select("sensor_id", "bucket", (F.col("bucket") * 1_000_000).alias("at"))
    return J.within_tolerance(h, metrics(spark, sf_dir).select("sensor_id", "us"), ["sensor_id"], "at", "us", 600_000_000).groupBy("sensor_id", "bucket").agg(F.count("*").alias("n"))
