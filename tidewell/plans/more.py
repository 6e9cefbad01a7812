"""Queries of drift compensation, forecasts as series, evidence percentiles and stability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import stats as S
from tidewell.model import micros, read
from tidewell.operators import events
from tidewell.operators.quantiles import quantiles
from tidewell.plans.aggregates import HOUR, hourly
from tidewell.plans.jobs import _E, _LAGS, _M, _events, _focus
from tidewell.plans.registry import query

_TEMP = "p AS (SELECT a.bucket, a.agg_value AS y, b.agg_value AS x FROM h AS a JOIN h AS b ON a.bucket = b.bucket WHERE a.sensor_id = 'view' AND b.sensor_id = 'click')"


@query(
    f"""WITH {_TEMP}, f AS (SELECT regr_slope(y, x) AS slope, avg(x) AS centre FROM p)
    SELECT_FROM SELECT bucket, y - slope * (x - centre) AS compensated FROM p CROSS JOIN f""",
    "compensated",
)
def temperature_compensation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series less its linear dependence on another (temperature), around the mean of that."""
    h = hourly(spark, sf_dir)
    y = h.where("sensor_id = 'view'").select("bucket", F.col("agg_value").alias("y"))
    x = h.where("sensor_id = 'click'").select("bucket", F.col("agg_value").alias("x"))
    pairs = y.join(x, "bucket")
    fit = S.regression(pairs.withColumn("k", F.lit(0)), ["k"], "x", "y").join(pairs.agg(F.avg("x").alias("centre")).withColumn("k", F.lit(0)), "k")
    return pairs.crossJoin(F.broadcast(fit.select("slope", "centre"))).select("bucket", (F.col("y") - F.col("slope") * (F.col("x") - F.col("centre"))).alias("compensated"))


@query(
    """SELECT 'forecast:driver:' || lower(l_shipmode_or_flag) || ':price:' || l_suppkey AS sensor_id, us, value FROM (
      SELECT l_returnflag AS l_shipmode_or_flag, l_suppkey, epoch_us(CAST(l_shipdate AS TIMESTAMP)) AS us, arg_max(l_extendedprice, (o_orderdate, l_orderkey, l_linenumber, l_extendedprice)) AS value
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate <= l_shipdate GROUP BY 1, 2, 3)""",
    "value",
)
def forecast_materialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts as points of synthetic sensors: of each target time the newest vintage issued before it."""
    both = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).where("o_orderdate <= l_shipdate")
    name = F.concat(F.lit("forecast:driver:"), F.lower("l_returnflag"), F.lit(":price:"), F.col("l_suppkey"))
    newest = F.max_by("l_extendedprice", F.struct("o_orderdate", "l_orderkey", "l_linenumber", "l_extendedprice"))
    return both.groupBy(name.alias("sensor_id"), micros("l_shipdate").alias("us")).agg(newest.alias("value"))


@query(f"WITH {_E} SELECT_FROM SELECT sensor_id, quantile_cont(abs(z), 0.5) AS p50, quantile_cont(abs(z), 0.9) AS p90, quantile_cont(abs(z), 0.95) AS p95, quantile_cont(abs(z), 0.99) AS p99 FROM e GROUP BY 1", "p50 p90 p95 p99")
def evidence_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    qs = (0.5, 0.9, 0.95, 0.99)
    e = quantiles(_events(spark, sf_dir).select("sensor_id", F.abs("z").alias("z")), ["sensor_id"], "z", list(qs), "p")
    return e.select("sensor_id", *(F.col("p")[k].alias(f"p{round(100 * q)}") for k, q in enumerate(qs)))


@query(
    f"""WITH {_M}, t AS (SELECT candidate, CAST(t // 864000 AS BIGINT) AS part, sum(least(abs(fz), abs(cz), 15)) AS s FROM p WHERE lag = 0 GROUP BY 1, 2),
      k AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY s DESC, candidate) AS k FROM t),
      top AS (SELECT candidate FROM (SELECT candidate, row_number() OVER (ORDER BY sum(s) DESC, candidate) AS k FROM t GROUP BY candidate) WHERE k <= 2)
    SELECT_FROM SELECT part, count(*) FILTER (WHERE candidate IN (SELECT candidate FROM top)) / 2.0 AS overlap FROM k WHERE k <= 2 GROUP BY 1""",
    "overlap",
)
def rank_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the best candidates of each ten days that are the best of the whole time too."""
    pairs = events.match(*_focus(spark, sf_dir), [0])
    scores = pairs.groupBy("candidate", F.expr("t div 864000").alias("part")).agg(F.sum("overlap").alias("s"))
    first = lambda df, *keys: df.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("s"), "candidate"))).where("k <= 2")
    whole = first(scores.groupBy("candidate").agg(F.sum("s").alias("s"))).select("candidate", F.lit(1).alias("hit"))
    return first(scores, "part").join(F.broadcast(whole), "candidate", "left").groupBy("part").agg((F.count("hit") / 2.0).alias("overlap"))


@query(
    f"""WITH {_M},
      b AS (SELECT candidate, lag FROM (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY score DESC, pairs DESC, abs(lag), lag) AS k FROM r) WHERE k = 1),
      j AS (SELECT b.candidate, f.delta AS x, c.delta AS y FROM b JOIN x AS c ON c.sensor_id = b.candidate JOIN x AS f ON f.sensor_id = 'click' AND f.bucket = c.bucket - b.lag)
    SELECT_FROM SELECT candidate, CASE WHEN count(*) >= 10 THEN corr(x, y) END AS delta_corr FROM j GROUP BY 1""",
    "delta_corr",
)
def delta_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of differences of each candidate with the focus, at the lag of its best match."""
    from tidewell.operators.windows import deltas

    best = events.best_matches(events.match_scores(*_focus(spark, sf_dir), _LAGS))
    return events.delta_correlation(deltas(hourly(spark, sf_dir), HOUR, gap=5), "click", best)
