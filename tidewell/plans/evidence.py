"""Queries of the detectors' modes, of evidence between series, of rules over periods, and small predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import stats as S
from tidewell.model import metrics, read
from tidewell.operators import buckets as B
from tidewell.operators import events, rules, sliding
from tidewell.operators.storage import stored
from tidewell.operators.windows import deltas
from tidewell.plans.aggregates import HOUR, hourly
from tidewell.plans.jobs import _E, _focus
from tidewell.plans.registry import query
from tidewell.plans.related import _fisher_sql
from tidewell.plans.transforms import _LAGS, _STEPS

_DELTAS = "SELECT sensor_id, bucket, agg_value - pv AS delta FROM d WHERE pv IS NOT NULL AND bucket - pb <= 18000"
_SECOND = """SELECT sensor_id, bucket, d1 - pd1 AS delta FROM (SELECT *, lag(d1) OVER w AS pd1, lag(dt) OVER w AS pdt FROM (SELECT sensor_id, bucket, agg_value - pv AS d1, bucket - pb AS dt FROM d) WINDOW w AS (PARTITION BY sensor_id ORDER BY bucket))
    WHERE dt <= 18000 AND pdt <= 18000"""
_LEVELS = "SELECT sensor_id, bucket, agg_value AS delta FROM h"


def _detector(points: str, floor: bool = True, n: str = "") -> str:
    """CTEs z<n> and span<n> of what a detector looks at."""
    step = ", CASE WHEN nz >= 5 THEN step ELSE 0 END" if floor else ", 0.0"
    return f"""x{n} AS ({points}),
      q{n} AS (SELECT sensor_id, count(*) AS n, median(delta) AS med, quantile_cont(delta, 0.75) - quantile_cont(delta, 0.25) AS iqr, count(*) FILTER (WHERE delta <> 0) AS nz, median(abs(delta)) FILTER (WHERE delta <> 0) AS step FROM x{n} GROUP BY 1),
      a{n} AS (SELECT x.sensor_id, median(abs(delta - med)) AS mad FROM x{n} AS x JOIN q{n} AS q ON x.sensor_id = q.sensor_id GROUP BY 1),
      c{n} AS (SELECT q.sensor_id, med, greatest(CASE WHEN mad * 1.4826 > 1e-9 THEN mad * 1.4826 WHEN iqr / 1.349 > 1e-9 THEN iqr / 1.349 ELSE 1.0 END{step}) AS scale FROM q{n} AS q JOIN a{n} AS a ON q.sensor_id = a.sensor_id WHERE n >= 3),
      z{n} AS (SELECT x.sensor_id, bucket, delta - {'0' if floor else 'med'} AS value, (delta - med) / scale AS z FROM x{n} AS x JOIN c{n} AS c ON x.sensor_id = c.sensor_id),
      span{n} AS (SELECT sensor_id, min(bucket) AS lo, max(bucket) AS hi FROM h GROUP BY 1)"""


def _found(n: str = "", where: str = "abs(z) >= 1.5") -> str:
    return f"SELECT z.sensor_id, bucket, value, z, CASE WHEN z >= 0 THEN 'up' ELSE 'down' END AS direction, abs(bucket - lo) <= 3600 OR abs(hi - bucket) <= 3600 AS boundary FROM z{n} AS z JOIN span{n} AS s ON z.sensor_id = s.sensor_id WHERE {where}"


@query(f"WITH {_STEPS}, {_detector(_LEVELS, False)} SELECT_FROM {_found()}", "value z")
def change_events_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.detect_changes(hourly(spark, sf_dir), HOUR, "level", 1.5)


@query(f"WITH {_STEPS}, {_detector(_SECOND)} SELECT_FROM {_found(where='z >= 2')}", "value z")
def change_events_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.detect_changes(hourly(spark, sf_dir), HOUR, "second", 2.0, polarity="up")


@query(
    f"""WITH {_STEPS}, {_detector(_DELTAS)}, k AS (SELECT sensor_id, abs(z) AS kth FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY abs(z) DESC) AS r FROM z) WHERE r = 20)
    SELECT_FROM SELECT f.* FROM ({_found(where='abs(z) >= 0.5')}) AS f LEFT JOIN k ON f.sensor_id = k.sensor_id WHERE abs(z) >= coalesce(kth, 0) AND NOT boundary""",
    "value z",
)
def change_events_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A threshold that gives each sensor some twenty events; none at the edges."""
    return events.detect_changes(hourly(spark, sf_dir), HOUR, "delta", 0.5, target=(10, 30), boundaries=False)


@query(
    f"""WITH {_STEPS}, {_detector(_DELTAS)}, {_detector(_LEVELS, False, '2')}, e AS ({_found(where='abs(z) >= 2.7')})
    SELECT_FROM SELECT * FROM e UNION ALL SELECT * FROM ({_found('2', 'abs(z) >= 2.7')}) WHERE sensor_id NOT IN (SELECT sensor_id FROM e)""",
    "value z",
)
def change_events_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensors without an event among their differences are looked at by level."""
    return events.detect_changes(hourly(spark, sf_dir), HOUR, "delta", 2.7, sparse=True)


@query(
    f"""RECURSIVE WITH {_STEPS}, {_detector(_DELTAS)}, fo AS ({_found(where='abs(z) >= 1.5')}),
      og AS (SELECT sensor_id, bucket, abs(z) AS s, row_number() OVER (PARTITION BY sensor_id ORDER BY bucket) AS k FROM fo),
      gr(sensor_id, k, last, s, run) AS (SELECT sensor_id, k, bucket, s, CAST(1 AS BIGINT) FROM og WHERE k = 1
        UNION ALL SELECT og.sensor_id, og.k, CASE WHEN og.bucket - last <= 7200 AND og.s <= gr.s THEN last ELSE og.bucket END, CASE WHEN og.bucket - last <= 7200 AND og.s <= gr.s THEN gr.s ELSE og.s END, run + CASE WHEN og.bucket - last <= 7200 THEN 0 ELSE 1 END
        FROM gr JOIN og ON og.sensor_id = gr.sensor_id AND og.k = gr.k + 1),
      ke AS (SELECT sensor_id, arg_max(last, k) AS bucket FROM gr GROUP BY sensor_id, run)
    SELECT_FROM SELECT fo.* FROM fo JOIN ke ON ke.sensor_id = fo.sensor_id AND ke.bucket = fo.bucket""",
    "value z",
)
def change_events_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.detect_changes(hourly(spark, sf_dir), HOUR, "delta", 1.5, separation=2 * HOUR, greedy=True)


# ---- evidence ----------------------------------------------------------------------------


@query(
    f"""WITH {_E}, t AS (SELECT y.sensor_id AS candidate, y.bucket, abs(y.z) AS cz, abs(x.z) AS fz FROM e AS x JOIN e AS y ON x.bucket = y.bucket WHERE x.sensor_id = 'click' AND y.sensor_id <> 'click'),
      n AS (SELECT candidate, bucket FROM (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY bucket DESC) AS k FROM t) WHERE k <= 10)
    SELECT_FROM SELECT t.candidate, sum(cz * fz) AS shared, count(*) AS buckets, max(cz) AS peak, any_value(l.times) AS times FROM t JOIN (SELECT candidate, string_agg(bucket, ',' ORDER BY bucket DESC) AS times FROM n GROUP BY 1) AS l ON t.candidate = l.candidate GROUP BY 1""",
    "shared peak",
)
def cooccurrence_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    focus, others = _focus(spark, sf_dir)
    return events.shared_evidence(focus, others).withColumn("times", F.array_join("times", ","))


@query(
    f"""WITH {_E}, f AS (SELECT count(*) AS nf, avg(abs(z)) AS mf FROM e WHERE sensor_id = 'click'), own AS (SELECT sensor_id AS candidate, count(*) AS nc, avg(abs(z)) AS mc FROM e WHERE sensor_id <> 'click' GROUP BY 1),
      t AS (SELECT y.sensor_id AS candidate, avg(abs(x.z) * abs(y.z)) AS p FROM e AS x JOIN e AS y ON x.bucket = y.bucket WHERE x.sensor_id = 'click' AND y.sensor_id <> 'click' GROUP BY 1)
    SELECT_FROM SELECT own.candidate, greatest(0.25, least(1.0, sqrt(nf / nc))) AS prevalence, CASE WHEN p > 0 THEN least(10.0, p / (mf * mc)) END AS surprise FROM own CROSS JOIN f LEFT JOIN t ON t.candidate = own.candidate""",
    "prevalence surprise",
)
def evidence_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.evidence_weights(*_focus(spark, sf_dir))


@query(
    f"""WITH {_E}, g AS (SELECT bucket, count(DISTINCT sensor_id) AS group_size, sum(s) AS severity FROM (SELECT bucket, sensor_id, max(abs(z)) AS s FROM e GROUP BY 1, 2) GROUP BY 1 HAVING count(*) >= 2)
    SELECT_FROM SELECT bucket, group_size, severity FROM g WHERE group_size < 10 AND group_size < 0.5 * (SELECT count(DISTINCT sensor_id) FROM e)""",
    "severity",
)
def system_wide_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Co-occurrence without the buckets in which half of all sensors have events."""
    e = events.detect_changes(hourly(spark, sf_dir), HOUR, "delta", 1.5).select("sensor_id", "bucket", "z")
    e = stored(e)
    n = e.agg(F.countDistinct("sensor_id").alias("n"))
    groups = events.cooccurrence(e, HOUR, prefer="system").crossJoin(F.broadcast(n))
    return events.without_system_wide(groups, F.col("n")).select("bucket", "group_size", "severity")


@query(
    f"""WITH {_STEPS}, s AS (SELECT sensor_id, count(*) AS bucket_rows, count(*) FILTER (WHERE bucket - pb <= 18000) AS delta_count FROM d GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY sensor_id) AS place FROM s WHERE bucket_rows >= 3 AND delta_count >= 3)
    SELECT_FROM SELECT sensor_id, bucket_rows, delta_count FROM r WHERE place <= 150"""
)
def coverage_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sensors, in their order, that have enough to be compared (a limit by design)."""
    return B.coverage_stats(hourly(spark, sf_dir), HOUR).where("bucket_rows >= 3 and delta_count >= 3").orderBy("sensor_id").limit(150)


@query(
    f"WITH {_LAGS}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY coalesce(abs(r), -1) DESC, n DESC, abs(lag), lag) AS k FROM c) WHERE k = 1) SELECT_FROM SELECT a, b, lag, n, r, 1 - pow(1 - ({_fisher_sql('r', 'n')}), 13) AS corrected FROM b",
    "r corrected",
)
def lag_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of thirteen lags, and the p of its correlation corrected for having been selected."""
    best = S.best_lag(S.correlations(hourly(spark, sf_dir), "agg_value", list(range(-6, 7)), HOUR))
    return best.withColumn("corrected", S.sidak(S.fisher_p(F.col("r"), F.col("n").cast("double")), 13))


@query(
    f"""WITH {_STEPS}, y AS (SELECT sensor_id, bucket, agg_value - pv AS v FROM d WHERE pv IS NOT NULL AND bucket - pb <= 18000), s AS (SELECT a.sensor_id AS a, b.sensor_id AS b, count(*) AS n, sum(a.v) AS sx, sum(b.v) AS sy, sum(a.v * a.v) AS sxx, sum(b.v * b.v) AS syy, sum(a.v * b.v) AS sxy FROM y AS a JOIN y AS b ON a.bucket = b.bucket AND a.sensor_id < b.sensor_id GROUP BY 1, 2)
    SELECT_FROM SELECT a, b, 0 AS lag, n, CASE WHEN n >= 3 THEN greatest(-1.0, least(1.0, (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)))) END AS r FROM s""",
    "r",
)
def correlation_of_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = stored(deltas(hourly(spark, sf_dir), HOUR, gap=5))
    return S.correlations(steps, "delta", interval=HOUR)


# ---- rules over periods ------------------------------------------------------------------


@query(
    """WITH s AS (SELECT sensor_id, bucket, agg_value > 40 AS met, lag(agg_value > 40) OVER w AS pm, lag(bucket) OVER w AS pb FROM h WINDOW w AS (PARTITION BY sensor_id ORDER BY bucket)),
      g AS (SELECT *, sum(CASE WHEN met AND coalesce(pm, false) AND bucket - pb <= 3600 THEN 0 ELSE 1 END) OVER (PARTITION BY sensor_id ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS g FROM s),
      k AS (SELECT *, CASE WHEN met THEN row_number() OVER (PARTITION BY sensor_id, g ORDER BY bucket) ELSE 0 END AS streak FROM g)
    SELECT_FROM SELECT sensor_id, bucket, streak, streak >= 3 AS met FROM k"""
)
def rule_consecutive_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = hourly(spark, sf_dir).select("sensor_id", "bucket", (F.col("agg_value") > 40).alias("met"))
    return rules.consecutive(states, 3, "hour", HOUR)


@query("SELECT n_nationkey AS node, count(*) FILTER (WHERE c_acctbal >= 0) AS online, count(*) FILTER (WHERE c_acctbal < 0) AS offline, count(DISTINCT c_mktsegment) AS types FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def count_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = read(spark, sf_dir, "customer").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    return joined.groupBy(F.col("n_nationkey").alias("node")).agg(F.count_if(F.col("c_acctbal") >= 0).alias("online"), F.count_if(F.col("c_acctbal") < 0).alias("offline"), F.countDistinct("c_mktsegment").alias("types"))


# ---- predicates, arrays, JSON ------------------------------------------------------------


def optional(df: DataFrame, **wanted: object) -> DataFrame:
    """Rows that equal every given value; a None does not restrict."""
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


@query("SELECT c_custkey AS id, c_mktsegment AS type FROM customer WHERE (NULL IS NULL OR c_nationkey = NULL) AND ('BUILDING' IS NULL OR c_mktsegment = 'BUILDING')")
def optional_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return optional(read(spark, sf_dir, "customer"), c_nationkey=None, c_mktsegment="BUILDING").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("type"))


@query("SELECT s_suppkey AS id FROM (SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 1 END AS deleted_at FROM supplier) WHERE deleted_at IS NULL")
def soft_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_acctbal") < 0, 1).alias("deleted_at"))
    return rows.where(F.col("deleted_at").isNull()).select("id")


@query("SELECT u.sensor_id, us, value FROM u JOIN (SELECT sensor_id, max(us) AS last FROM u GROUP BY 1) AS l ON u.sensor_id = l.sensor_id WHERE us >= last - 24 * 3600000000", "value")
def last_n_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points within a day of each sensor's last."""
    m = metrics(spark, sf_dir, by_user=True)
    last = m.groupBy("sensor_id").agg(F.max("us").alias("last"))
    return m.join(last, "sensor_id").where(F.col("us") >= F.col("last") - 24 * 3_600_000_000).select("sensor_id", "us", "value")


@query("SELECT p_partkey AS id, CAST(place AS INTEGER) AS place, word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS place FROM part)")
def unnest_with_ordinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.posexplode(F.split("p_name", " ")).alias("place", "word")).select("id", (F.col("place") + 1).alias("place"), "word")


@query("SELECT c_custkey AS id, place > 100 AS truncated FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS place FROM customer)")
def limit_and_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which ids are within a limit, and which fell off; the limit's last id is found by a top-k."""
    ids = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    last = ids.orderBy("id").limit(100).agg(F.max("id").alias("last"))
    return ids.crossJoin(F.broadcast(last)).select("id", (F.col("id") > F.col("last")).alias("truncated"))


@query(
    """WITH p AS (SELECT c_custkey AS id, 1 AS stage, c_acctbal AS score FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_custkey, 2, c_acctbal / 2 FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT o_custkey, 3, o_totalprice / 1000 FROM orders WHERE o_orderpriority = '1-URGENT')
    SELECT_FROM SELECT id, min(stage) AS stage, max(score) AS score, count(*) AS hits FROM p GROUP BY 1""",
    "score",
)
def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of several searches: of each the earliest stage and the best score."""
    customer, orders = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    pools = (
        customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"), F.lit(1).alias("stage"), F.col("c_acctbal").alias("score")),
        customer.where("c_acctbal > 5000").select("c_custkey", F.lit(2), F.col("c_acctbal") / 2),
        orders.where("o_orderpriority = '1-URGENT'").select("o_custkey", F.lit(3), F.col("o_totalprice") / 1000),
    )
    every = pools[0].union(pools[1]).union(pools[2])
    return every.groupBy("id").agg(F.min("stage").alias("stage"), F.max("score").alias("score"), F.count("*").alias("hits"))


@query(
    "WITH w AS (SELECT sensor_id, us, 100.0 * avg(CASE WHEN quality = 0 THEN 1.0 ELSE 0.0 END) OVER v AS uptime, stddev_pop(value) OVER v AS jitter FROM m WINDOW v AS (PARTITION BY sensor_id ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)) SELECT_FROM SELECT * FROM w",
    "uptime jitter",
)
def uptime_and_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of good samples and deviation over the trailing day."""
    good = F.coalesce(F.col("quality") == 0, F.lit(False)).cast("double")
    m = metrics(spark, sf_dir).select("sensor_id", "us", good.alias("good"), "value")
    out = sliding.rolling_moments(m, ["sensor_id"], "us", ["good", "value"], 86_400_000_000)
    return out.select("sensor_id", "us", (100 * F.col("good_mean")).alias("uptime"), F.col("value_deviation").alias("jitter"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, 'driver' AS origin FROM events")
def json_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field is set in a JSON object, and read back."""
    fields = F.map_concat(F.map_filter(F.from_json("props", "map<string, string>"), lambda k, v: k != "origin"), F.create_map(F.lit("origin"), F.lit("driver")))
    rows = read(spark, sf_dir, "events").select("event_id", F.to_json(fields).alias("config"))
    return rows.select("event_id", F.get_json_object("config", "$.k").cast("int").alias("k"), F.get_json_object("config", "$.origin").alias("origin"))


@query(
    """WITH p AS (SELECT sensor_id, us, value, quantile_cont(value, 0.5) OVER w AS p50, quantile_cont(value, 0.95) OVER w AS p95 FROM m WINDOW w AS (PARTITION BY sensor_id ORDER BY us RANGE BETWEEN 1799999999 PRECEDING AND CURRENT ROW))
    SELECT_FROM SELECT * FROM p""",
    "value p50 p95",
)
def rolling_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and 95th percentile of the half hour up to each point."""
    m = metrics(spark, sf_dir).select("sensor_id", "us", "value")
    p = sliding.rolling_percentiles(m, ["sensor_id"], "us", "value", 1_800_000_000, [0.5, 0.95], "p", chunks=48)
    return p.select("sensor_id", "us", "value", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"))
