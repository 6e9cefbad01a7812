"""Queries of series related to a focus, of the correlation matrix's inference, and of compensation by lag."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import expressions as X
from tidewell.functions import stats as S
from tidewell.model import US, day_start, local_time, metrics, micros, read
from tidewell.operators import events, unified
from tidewell.operators import related as R
from tidewell.operators.quantiles import quantiles
from tidewell.operators.storage import stored
from tidewell.operators.windows import deltas
from tidewell.plans.aggregates import HOUR, hourly
from tidewell.plans.jobs import _Z as JOB_Z
from tidewell.plans.registry import query
from tidewell.plans.transforms import _PAIRS, _PEARSON, _RHO, _STEPS, _SUMS, correlation_cells

LAGS = list(range(-6, 7))
HORIZON = 30 * 86_400
#: Thresholds of the queries: the test series are hardly correlated, so the usual 0.2 and 0.05 would leave no row.
MIN_R, ALPHA, THRESHOLD = 0.02, 0.9, 0.45


def _fisher_sql(r: str, n: str) -> str:
    """Two-sided p in SQL: 1 - erf, whose series has positive terms only."""
    x = f"(atanh(least(abs({r}), 0.999999)) * sqrt({n} - 3) / sqrt(2))"
    erf = f"exp(-{x} * {x}) * list_sum(list_transform(range(0, 240), lambda k: exp((2 * k + 1) * ln({x}) - lgamma(k + 1.5))))"
    return f"CASE WHEN {n} < 4 THEN NULL WHEN {x} <= 0 THEN 1.0 WHEN {x} > 7 THEN 0.0 ELSE greatest(0.0, 1 - {erf}) END"


_Z95 = 1.959963984540054


def _interval_sql(r: str, n: str, sign: str) -> str:
    return f"CASE WHEN {n} >= 4 THEN tanh(atanh(greatest(-0.999999, least(0.999999, {r}))) {sign} {_Z95} / sqrt({n} - 3)) END"


def _fdr_sql(table: str, p: str) -> str:
    """CTEs that give ``table`` the column q, as <table>q."""
    return f"""{table}v AS (SELECT *, {p} * count({p}) OVER () / (count({p}) OVER (ORDER BY {p} RANGE UNBOUNDED PRECEDING)) AS v FROM {table}),
      {table}q AS (SELECT * EXCLUDE (v), CASE WHEN {p} IS NOT NULL THEN least(1.0, min(v) OVER (ORDER BY {p} DESC RANGE UNBOUNDED PRECEDING)) END AS q FROM {table}v)"""


_N_EFF = "CAST(greatest(3, least(n, floor(n / greatest(1.0, 1 + 2 * x.rho1 * y.rho1)))) AS BIGINT) AS n_eff"
_INFER = f"""rq AS (SELECT sensor_id, median(agg_value) AS med, quantile_cont(agg_value, 0.75) - quantile_cont(agg_value, 0.25) AS iqr, count(*) AS n FROM h GROUP BY 1),
  ra AS (SELECT h.sensor_id, median(abs(agg_value - med)) AS mad FROM h JOIN rq ON h.sensor_id = rq.sensor_id GROUP BY 1),
  rs AS (SELECT rq.sensor_id, med, CASE WHEN mad * 1.4826 > 1e-9 THEN mad * 1.4826 WHEN iqr / 1.349 > 1e-9 THEN iqr / 1.349 ELSE 1.0 END AS scale FROM rq JOIN ra ON rq.sensor_id = ra.sensor_id WHERE n >= 3),
  z AS (SELECT h.sensor_id, bucket, greatest(-6.0, least(6.0, (agg_value - med) / scale)) AS z FROM h JOIN rs ON h.sensor_id = rs.sensor_id),
  rho AS (SELECT sensor_id, greatest(-0.9999999, least(0.9999999, {_PEARSON})) AS rho1 FROM (SELECT sensor_id, {_SUMS} FROM (SELECT sensor_id, lag(z) OVER (PARTITION BY sensor_id ORDER BY bucket) AS x, z AS y FROM z) WHERE x IS NOT NULL GROUP BY 1)),
  l AS (SELECT CAST(unnest(range(-6, 7)) AS INTEGER) AS lag),
  p AS (SELECT b.sensor_id AS candidate, lag, a.bucket, a.z AS x, b.z AS y FROM z AS a CROSS JOIN l JOIN z AS b ON b.bucket = a.bucket + lag * 3600 WHERE a.sensor_id = 'click' AND b.sensor_id <> 'click'),
  c AS (SELECT candidate, lag, n, {_PEARSON} AS r FROM (SELECT candidate, lag, {_SUMS} FROM p GROUP BY 1, 2) WHERE n >= 10),
  b AS (SELECT * FROM (SELECT candidate, lag, n, coalesce(r, 0) AS r, count(*) OVER (PARTITION BY candidate) AS m_lag, row_number() OVER (PARTITION BY candidate ORDER BY coalesce(abs(r), 0) DESC, lag <> 0, lag) AS k FROM c) WHERE k = 1),
  e AS (SELECT candidate, lag, n, r, m_lag, {_N_EFF} FROM b JOIN rho AS x ON x.sensor_id = 'click' JOIN rho AS y ON y.sensor_id = candidate),
  g AS (SELECT *, 1 - pow(1 - p_raw, m_lag) AS p_lag FROM (SELECT *, {_fisher_sql("r", "n_eff")} AS p_raw FROM e)), {_fdr_sql("g", "p_lag")},
  inf AS (SELECT candidate, lag, n, r, m_lag, n_eff, p_raw, p_lag, q, {_interval_sql("r", "n_eff", "-")} AS low, {_interval_sql("r", "n_eff", "+")} AS high FROM gq)"""


def _z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(R.robust_z(hourly(spark, sf_dir)))


@query(f"WITH {_INFER} SELECT_FROM SELECT * FROM inf", "r p_raw p_lag q low high")
def lag_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.lag_inference(_z(spark, sf_dir), "click", LAGS, HOUR)


_EPISODES = f"""s AS (SELECT * FROM inf WHERE abs(r) >= {MIN_R} AND p_lag <= {ALPHA} AND q <= {ALPHA}),
  w AS (SELECT CAST(unnest([21600, 86400, 604800, 2592000]) AS INTEGER) AS w),
  al AS (SELECT p.candidate, p.bucket, x, y, row_number() OVER (PARTITION BY p.candidate ORDER BY p.bucket) AS k FROM p JOIN s ON p.candidate = s.candidate AND p.lag = s.lag),
  ro AS (SELECT candidate, w, bucket, {_PEARSON} AS r FROM (SELECT a.candidate, w, a.bucket, count(*) AS n, sum(b.x) AS sx, sum(b.y) AS sy, sum(b.x * b.x) AS sxx, sum(b.y * b.y) AS syy, sum(b.x * b.y) AS sxy
    FROM al AS a CROSS JOIN w JOIN al AS b ON b.candidate = a.candidate AND b.k BETWEEN a.k AND a.k + w // 3600 - 1 GROUP BY 1, 2, 3) WHERE n = w // 3600),
  st AS (SELECT *, row_number() OVER (PARTITION BY candidate, w ORDER BY bucket) - 1 AS i, greatest(1, w // 14400) AS step FROM ro WHERE r IS NOT NULL),
  pa AS (SELECT *, i // step - row_number() OVER (PARTITION BY candidate, w ORDER BY i) AS run FROM st WHERE i % step = 0 AND abs(r) >= {THRESHOLD}),
  ep AS (SELECT candidate, w AS window_s, min(bucket) AS start, max(bucket) + w AS "end", max(abs(r)) AS peak, avg(abs(r)) AS mean, least(1.0, (max(bucket) + w - min(bucket)) / {float(HORIZON)}) AS coverage, CAST(count(*) * (w // 3600) AS BIGINT) AS points FROM pa GROUP BY candidate, w, run)"""


def _related(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    z = _z(spark, sf_dir)
    found = stored(R.significant(R.lag_inference(z, "click", LAGS, HOUR), MIN_R, ALPHA))
    return found, R.episodes(z, "click", found, HOUR, HORIZON, THRESHOLD)


@query(f"WITH {_INFER}, {_EPISODES} SELECT_FROM SELECT * FROM ep", "peak mean coverage")
def related_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _related(spark, sf_dir)[1]


@query(
    f"""WITH {_INFER}, {_EPISODES}, rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY peak DESC, start, window_s) AS k FROM ep) WHERE k <= 50),
      be AS (SELECT candidate, count(*) AS episodes, count(*) FILTER (WHERE peak >= 0.92) AS strong, 1 - coalesce(product(1 - 0.1 * peak) FILTER (WHERE peak >= 0.8 AND k <= 8), 1.0) AS prim, arg_min(window_s, k) AS best_window, arg_min(coverage, k) AS coverage, arg_min(peak, k) AS peak FROM rk GROUP BY 1),
      jo AS (SELECT s.*, coalesce(episodes, 0) AS episodes, coalesce(strong, 0) AS strong, best_window, coverage,
        abs(lag) * 3600 >= 43200 AND abs(abs(lag) * 3600 - ((abs(lag) * 3600 + 43200) // 86400) * 86400) <= 1800 AS daily,
        CASE WHEN best_window IS NULL THEN 0.0 ELSE (0.5 * prim + 0.5 * peak) * CASE WHEN coverage < 0.02 THEN 0.85 ELSE 1.0 END END AS s0 FROM s LEFT JOIN be ON s.candidate = be.candidate)
    SELECT_FROM SELECT candidate, lag, n, r, m_lag, n_eff, p_raw, p_lag, q, low, high, episodes, best_window, coverage, daily,
      least(1.0, pow((CASE WHEN NOT daily AND strong >= 2 THEN least(1.0, s0 + 0.02) ELSE s0 END) * CASE WHEN n < 20 THEN 0.9 ELSE 1.0 END * CASE WHEN high - low > 0.08 THEN 0.92 ELSE 1.0 END * (0.2 + 0.8 * abs(r)) * CASE WHEN daily THEN 0.35 ELSE 1.0 END, 1.3)) AS score FROM jo""",
    "r p_raw p_lag q low high coverage score",
)
def related_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series related to 'click': lag, inference, episodes and score, one row for each that passes."""
    return R.scores(*_related(spark, sf_dir), HOUR)


# ---- compensation -------------------------------------------------------------------------


@query(
    """WITH l AS (SELECT CAST(unnest(range(0, 7)) * 3600 AS INTEGER) AS lag),
      p AS (SELECT lag, a.agg_value AS y, b.agg_value AS x FROM h AS a CROSS JOIN l JOIN h AS b ON b.bucket = a.bucket - lag WHERE a.sensor_id = 'view' AND b.sensor_id = 'click'),
      f AS (SELECT lag, count(*) AS n, regr_slope(y, x) AS slope, avg(x) AS centre, regr_r2(y, x) AS r2 FROM p GROUP BY 1 HAVING count(*) >= 20),
      s AS (SELECT p.lag, quantile_cont(y, 0.95) - quantile_cont(y, 0.05) AS raw, quantile_cont(y - slope * (x - centre), 0.95) - quantile_cont(y - slope * (x - centre), 0.05) AS left_over FROM p JOIN f ON p.lag = f.lag GROUP BY 1)
    SELECT_FROM SELECT f.lag, n, r2, raw, left_over, CASE WHEN raw > 0 THEN greatest(0.0, least(100.0, (1 - left_over / raw) * 100)) END AS reduction_pct FROM f JOIN s ON f.lag = s.lag""",
    "r2 raw left_over reduction_pct",
)
def temperature_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a series' swing (p95 - p5) goes when its dependence on a lagged temperature is taken out."""
    h = hourly(spark, sf_dir)
    y = h.where("sensor_id = 'view'").select("bucket", F.col("agg_value").alias("y"))
    x = h.where("sensor_id = 'click'").withColumn("lag", F.explode(F.array(*(F.lit(k * HOUR) for k in range(7)))))
    pairs = y.join(x.select((F.col("bucket") + F.col("lag")).alias("bucket"), "lag", F.col("agg_value").alias("x")), "bucket")
    fit = S.regression(pairs, ["lag"], "x", "y").join(pairs.groupBy("lag").agg(F.avg("x").alias("centre")), "lag").where("n >= 20")
    both = pairs.join(fit.select("lag", "slope", "centre"), "lag").withColumn("c", F.col("y") - F.col("slope") * (F.col("x") - F.col("centre")))
    swing = lambda c: quantiles(both, ["lag"], c, [0.05, 0.95], "s").select("lag", (F.col("s")[1] - F.col("s")[0]).alias(f"swing_{c}"))
    less = F.when(F.col("swing_y") > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), (1 - F.col("swing_c") / F.col("swing_y")) * 100)))
    return fit.join(swing("y"), "lag").join(swing("c"), "lag").select("lag", "n", "r2", F.col("swing_y").alias("raw"), F.col("swing_c").alias("left_over"), less.alias("reduction_pct"))


# ---- time of day, order, sources of a series ---------------------------------------------------


@query(
    """WITH t AS (SELECT sensor_id, CAST((make_timestamp(us) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS day, value FROM m)
    SELECT_FROM SELECT sensor_id, day, count(*) AS n, sum(value) AS total, CAST(epoch(((day + INTERVAL 1 DAY)::TIMESTAMP AT TIME ZONE 'America/New_York') - (day::TIMESTAMP AT TIME ZONE 'America/New_York')) AS BIGINT) AS seconds FROM t GROUP BY 1, 2""",
    "total",
)
def local_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by the local day of a site, whose length in seconds follows the clock changes."""
    zone = "America/New_York"
    day = local_time(F.col("us"), zone).cast("date").alias("day")
    days = metrics(spark, sf_dir).groupBy("sensor_id", day).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    length = day_start(F.date_add("day", 1), zone) - day_start(F.col("day"), zone)
    return days.withColumn("seconds", F.floor(length / US).cast("long"))


@query("SELECT c_custkey AS id, CAST(CASE WHEN c_nationkey = 3 THEN 0 WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 2 END AS INTEGER) AS priority, CAST(row_number() OVER (ORDER BY CASE WHEN c_nationkey = 3 THEN 0 WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 2 END, md5('seed-7|' || c_custkey), c_custkey) AS BIGINT) AS place FROM customer")
def deterministic_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensors in groups of priority (same node, same type, others), within them in an order that a seed fixes.

    Numbered within ranges of the hash and counted ahead, so no task sees more than a 256th of a group.
    """
    rows = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") == 3, 0).when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(2).alias("priority"), F.md5(F.concat(F.lit("seed-7|"), F.col("c_custkey").cast("string"))).alias("hash")
    )
    rows = rows.withColumn("part", F.substring("hash", 1, 2))
    before = Window.orderBy("priority", "part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("priority", "part").count()  # 768 rows at most
    parts = parts.select("priority", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    own = F.row_number().over(Window.partitionBy("priority", "part").orderBy("hash", "id"))
    return rows.withColumn("own", own).join(F.broadcast(parts), ["priority", "part"]).select("id", "priority", (F.col("ahead") + F.col("own")).alias("place"))


@query(
    """WITH f AS (SELECT 'forecast:driver:price' AS sensor_id, CAST(epoch(CAST(l_shipdate AS TIMESTAMP)) AS BIGINT) // 3600 * 3600 AS bucket, l_extendedprice AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate <= l_shipdate),
      r AS (SELECT sensor_id, bucket, agg_value, samples FROM h WHERE sensor_id IN ('click', 'view')),
      d AS (SELECT 'ratio' AS sensor_id, a.bucket, a.agg_value / b.agg_value AS agg_value, CAST(1 AS BIGINT) AS samples FROM h AS a JOIN h AS b ON a.bucket = b.bucket WHERE a.sensor_id = 'click' AND b.sensor_id = 'view' AND b.agg_value <> 0)
    SELECT_FROM SELECT 'raw' AS kind, * FROM r UNION ALL SELECT 'derived', * FROM d UNION ALL SELECT 'forecast', sensor_id, bucket, avg(value), count(*) FROM f GROUP BY 2, 3""",
    "agg_value",
)
def bucket_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of any series: points, formulas of other series, or forecasts; each is read in its own way."""
    h = hourly(spark, sf_dir)
    raw = h.where(F.col("sensor_id").isin("click", "view"))
    derived = X.evaluate(h, X.Derived("ratio", {"a": ("click", 0), "b": ("view", 0)}, lambda v: X.divide(v["a"], v["b"])), HOUR)
    both = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).where("o_orderdate <= l_shipdate")
    points = both.select(F.lit("forecast:driver:price").alias("sensor_id"), micros("l_shipdate").alias("us"), F.col("l_extendedprice").alias("value"))
    forecast = points.groupBy("sensor_id", (F.floor(F.col("us") / (HOUR * US)) * HOUR).alias("bucket")).agg(F.avg("value").alias("agg_value"), F.count("*").alias("samples"))
    out = lambda df, kind: df.select(F.lit(kind).alias("kind"), "sensor_id", "bucket", "agg_value", "samples")
    return out(raw, "raw").unionByName(out(derived, "derived")).unionByName(out(forecast, "forecast"))


CORRELATION_SQL = f"""WITH {_STEPS}, {_RHO}, {_PAIRS}, c AS (SELECT a, b, n, CASE WHEN n >= 3 THEN {_PEARSON} END AS r FROM (SELECT a, b, {_SUMS} FROM p GROUP BY 1, 2)),
  e AS (SELECT a, b, n, r, {_N_EFF} FROM c JOIN rho AS x ON x.sensor_id = a JOIN rho AS y ON y.sensor_id = b),
  g AS (SELECT *, {_fisher_sql("r", "n_eff")} AS p FROM e), {_fdr_sql("g", "p")}
SELECT_FROM SELECT a, b, n, n_eff, r, p, q, {_interval_sql("r", "n_eff", "-")} AS low, {_interval_sql("r", "n_eff", "+")} AS high,
  CASE WHEN r IS NULL THEN 'insufficient_overlap' WHEN n >= 10 AND q <= 0.05 AND abs(r) >= 0.2 THEN 'ok' ELSE 'not_significant' END AS status FROM gq"""


@query(CORRELATION_SQL, "r p q low high")
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlation_cells(spark, sf_dir)


# ---- one ranking ----------------------------------------------------------------------------

_START, _END = 1_704_067_200, 1_706_659_200
_FINE = "hh AS (SELECT sensor_id || '-' || quality AS sensor_id, CAST(floor(us / 3600e6) * 3600 AS BIGINT) AS bucket, avg(value) AS agg_value FROM m WHERE quality IS NOT NULL GROUP BY 1, 2)"
_UNIFIED = f"""{_FINE}, {JOB_Z.replace("FROM h ", "FROM hh ")},
      ev AS (SELECT sensor_id, bucket, z FROM z WHERE abs(z) >= 1.5),
      pt AS (SELECT unnest([0, 1, 2, 3]) AS part, unnest([{_START}, {_START}, {_START + 864_000}, {_START + 2 * 864_000}]) AS lo, unnest([{_END}, {_START + 864_000}, {_START + 2 * 864_000}, {_END}]) AS hi),
      ep AS (SELECT part, sensor_id, bucket, z, least(abs(z), 15) AS w FROM ev JOIN pt ON bucket BETWEEN lo AND hi),
      xp AS (SELECT part, sensor_id, bucket, delta FROM x JOIN pt ON bucket BETWEEN lo AND hi),
      fo AS (SELECT part, bucket, z AS fz, w AS fw FROM ep WHERE sensor_id = 'click-0'), ca AS (SELECT part, sensor_id AS candidate, bucket, z AS cz, w AS cw FROM ep WHERE sensor_id <> 'click-0'),
      ow AS (SELECT part, sum(fw) AS fs, count(*) AS nf, avg(fw) AS fm FROM fo GROUP BY 1), ea AS (SELECT part, candidate, sum(cw) AS cs, count(*) AS nc, avg(cw) AS cm FROM ca GROUP BY 1, 2),
      lg AS (SELECT CAST(unnest(range(-6, 7)) * 3600 AS INTEGER) AS lag),
      me AS (SELECT fo.part, candidate, lag, count(*) AS overlap, sum(least(fw, cw)) AS o, avg(CASE WHEN fz * cz >= 0 THEN 1.0 ELSE 0.0 END) AS agreement FROM fo CROSS JOIN lg JOIN ca ON ca.part = fo.part AND ca.bucket = fo.bucket + lag GROUP BY 1, 2, 3),
      sc AS (SELECT me.*, least(1.0, 2 * o / (fs + cs)) AS score, CASE WHEN nc <= nf THEN 1.0 ELSE greatest(0.25, sqrt(nf / nc)) END AS penalty FROM me JOIN ea USING (part, candidate) JOIN ow USING (part)),
      bm AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY part, candidate ORDER BY round(score, 9) DESC, overlap DESC, abs(lag), lag) = 1),
      sz AS (SELECT part, bucket FROM ep GROUP BY 1, 2 HAVING count(DISTINCT sensor_id) < 10 AND count(DISTINCT sensor_id) < 0.5 * (SELECT count(DISTINCT sensor_id) FROM ep AS y WHERE y.part = ep.part)),
      sh AS (SELECT fo.part, candidate, count(*) AS shared, sum(fw * cw) / count(*) AS average FROM fo JOIN ca USING (part, bucket) JOIN sz USING (part, bucket) GROUP BY 1, 2),
      su AS (SELECT sh.*, least(10.0, average / (fm * cm)) AS surprise FROM sh JOIN ea USING (part, candidate) JOIN ow USING (part)),
      dp AS (SELECT b.part, b.candidate, f.delta AS x, c.delta AS y FROM bm AS b JOIN xp AS c ON c.part = b.part AND c.sensor_id = b.candidate JOIN xp AS f ON f.part = b.part AND f.sensor_id = 'click-0' AND f.bucket = c.bucket - b.lag),
      dc AS (SELECT part, candidate, CASE WHEN count(*) >= 10 THEN corr(x, y) END AS delta_corr FROM dp GROUP BY 1, 2),
      al AS (SELECT coalesce(bm.part, su.part) AS part, coalesce(bm.candidate, su.candidate) AS candidate, lag, score, overlap, agreement, penalty, shared, average, surprise FROM bm FULL JOIN su ON bm.part = su.part AND bm.candidate = su.candidate),
      jn AS (SELECT al.*, delta_corr FROM al LEFT JOIN dc USING (part, candidate)),
      bl AS (SELECT *, 0.5 * coalesce(score / max(score) OVER p, 0) + 0.3 * coalesce(surprise * coalesce(penalty, 1) / max(surprise * coalesce(penalty, 1)) OVER p, 0) + 0.2 * coalesce(abs(delta_corr), 0) AS blend FROM jn WINDOW p AS (PARTITION BY part)),
      ti AS (SELECT *, CASE WHEN blend >= 0.75 AND (coalesce(overlap, 0) >= 2 OR coalesce(shared, 0) >= 2) THEN 3 WHEN blend >= 0.35 AND (coalesce(overlap, 0) >= 1 OR coalesce(shared, 0) >= 1) THEN 2 ELSE 1 END AS t FROM bl WHERE blend > 0),
      rn AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY round(blend, 9) DESC, t DESC, coalesce(shared, 0) DESC, coalesce(overlap, 0) DESC, candidate) AS rank FROM ti),
      st AS (SELECT count(*) / 30.0 AS stability FROM rn WHERE part > 0 AND rank <= 10 AND candidate IN (SELECT candidate FROM rn WHERE part = 0 AND rank <= 10)),
      pa AS (SELECT unnest(['view-1', 'signup-2', 'purchase-0']) AS candidate, unnest(['view-1>click-0', 'signup-2>view-1>click-0', 'purchase-0>click-0']) AS path)
    SELECT_FROM SELECT candidate, CAST(rank AS INTEGER) AS rank, blend, ['low', 'medium', 'high'][t] AS tier, lag, score, overlap, agreement, penalty, shared, average, surprise, delta_corr, stability,
      CASE WHEN stability >= 0.8 THEN 'high' WHEN stability >= 0.5 THEN 'medium' ELSE 'low' END AS stability_tier, path FROM rn CROSS JOIN st LEFT JOIN pa USING (candidate) WHERE part = 0"""


@query(f"WITH {_UNIFIED}", "blend score agreement penalty average surprise delta_corr stability")
def related_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything related to one of fifteen series: matches, shared buckets, changes, tiers with support, stability, dependency paths."""
    m = metrics(spark, sf_dir).where("quality is not null")
    h = stored(m.groupBy(F.concat_ws("-", "sensor_id", "quality").alias("sensor_id"), (F.floor(F.col("us") / (HOUR * US)) * HOUR).alias("bucket")).agg(F.avg("value").alias("agg_value")))
    changes = stored(deltas(h, HOUR, gap=5))
    found = events.zscores(changes).where("abs(z) >= 1.5")
    edges = spark.createDataFrame([("view-1", "click-0"), ("signup-2", "view-1"), ("purchase-0", "view-1"), ("purchase-0", "click-0"), ("view-1", "signup-2")], "node string, input string")
    how = unified.Ranking(0.5, 0.3, 0.2, surprise=True, include_low=True, strip_system_wide=True)
    out = unified.related(found, changes, "click-0", _START, _END, [k * HOUR for k in LAGS], how, edges)
    return out.withColumn("path", F.when(F.col("path").isNotNull(), F.concat_ws(">", "path")))
