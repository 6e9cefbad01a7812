"""Queries of the composite jobs: events, matching, profiles, similarity, rules, energy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.model import metrics, read
from tidewell.operators import energy, events, rules, similarity
from tidewell.operators import windows as W
from tidewell.operators.storage import shared_folder, stored
from tidewell.plans.aggregates import HOUR, hourly
from tidewell.plans.registry import query
from tidewell.plans.transforms import _STEPS
from tidewell.sources import spool

_Z = f"""{_STEPS}, x AS (SELECT sensor_id, bucket, agg_value - pv AS delta FROM d WHERE pv IS NOT NULL AND bucket - pb <= 18000),
    q AS (SELECT sensor_id, count(*) AS n, median(delta) AS med, quantile_cont(delta, 0.75) - quantile_cont(delta, 0.25) AS iqr, count(*) FILTER (WHERE delta <> 0) AS nz, median(abs(delta)) FILTER (WHERE delta <> 0) AS step FROM x GROUP BY 1),
    a AS (SELECT x.sensor_id, median(abs(delta - med)) AS mad FROM x JOIN q ON x.sensor_id = q.sensor_id GROUP BY 1),
    c AS (SELECT q.sensor_id, med, greatest(CASE WHEN mad * 1.4826 > 1e-9 THEN mad * 1.4826 WHEN iqr / 1.349 > 1e-9 THEN iqr / 1.349 ELSE 1.0 END, CASE WHEN nz >= 5 THEN step ELSE 0 END) AS scale FROM q JOIN a ON q.sensor_id = a.sensor_id WHERE n >= 3),
    z AS (SELECT x.sensor_id, bucket, delta AS value, (delta - med) / scale AS z FROM x JOIN c ON x.sensor_id = c.sensor_id)"""


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.deltas(hourly(spark, sf_dir), HOUR, gap=5)


@query(f"WITH {_Z} SELECT_FROM SELECT * FROM z", "value z")
def event_zscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.zscores(_deltas(spark, sf_dir))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a job, detected once."""
    return stored(events.detect(stored(_deltas(spark, sf_dir)), threshold=1.5))


_E = f"{_Z}, e AS (SELECT *, CASE WHEN z >= 0 THEN 'up' ELSE 'down' END AS direction FROM z WHERE abs(z) >= 1.5)"


@query(f"WITH {_E} SELECT_FROM SELECT * FROM e", "value z")
def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir)


_NMS = """o AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY abs(z) DESC, bucket) AS k FROM e),
    g(sensor_id, k, chosen) AS (SELECT DISTINCT sensor_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM o
      UNION ALL SELECT g.sensor_id, o.k, CASE WHEN len(list_filter(g.chosen, lambda b: abs(b - o.bucket) <= 7200)) = 0 THEN list_append(g.chosen, o.bucket) ELSE g.chosen END FROM g JOIN o ON o.sensor_id = g.sensor_id AND o.k = g.k + 1),
    n AS (SELECT sensor_id, unnest(arg_max(chosen, k)) AS bucket FROM g GROUP BY 1)"""


@query(f"RECURSIVE WITH {_E}, {_NMS} SELECT_FROM SELECT e.* FROM e JOIN n ON e.sensor_id = n.sensor_id AND e.bucket = n.bucket", "value z")
def events_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.detect(_deltas(spark, sf_dir), threshold=1.5, separation=2 * HOUR)


_SPREAD = "s AS (SELECT bucket + k * 3600 AS bucket, sensor_id, max(abs(z)) AS s FROM e, (SELECT unnest([-1, 0, 1]) AS k) GROUP BY 1, 2), g AS (SELECT bucket, count(*) AS group_size, sum(s) AS severity FROM s GROUP BY 1 HAVING count(*) >= 2)"


@query(f"WITH {_E}, {_SPREAD} SELECT_FROM SELECT bucket, group_size, severity, severity / group_size / ln(2 + group_size) * ln(((SELECT count(DISTINCT sensor_id) FROM e) + 1.0) / (group_size + 1)) AS score FROM g", "severity score")
def cooccurrence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.cooccurrence(_events(spark, sf_dir), HOUR, tolerance=1)


@query(f"WITH {_E}, {_SPREAD} SELECT_FROM SELECT bucket, group_size, severity, severity * group_size * (group_size - 1) / 2.0 AS score FROM g", "severity score")
def cooccurrence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.cooccurrence(_events(spark, sf_dir), HOUR, tolerance=1, prefer="pairs")


@query(
    f"""RECURSIVE WITH {_E}, {_SPREAD}, sc AS (SELECT bucket, group_size, severity / group_size / ln(2 + group_size) * ln(((SELECT count(DISTINCT sensor_id) FROM e) + 1.0) / (group_size + 1)) AS score FROM g),
      o AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, group_size, bucket DESC) AS k FROM sc),
      p(k, chosen) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT o.k, CASE WHEN len(list_filter(p.chosen, lambda b: abs(b - o.bucket) <= 7200)) = 0 THEN list_append(p.chosen, o.bucket) ELSE p.chosen END FROM p JOIN o ON o.k = p.k + 1)
    SELECT_FROM SELECT bucket, group_size, score FROM o WHERE list_contains((SELECT arg_max(chosen, k) FROM p), bucket)""",
    "score",
)
def cooccurrence_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The buckets that are left when the best shuts out those within two hours, and so on."""
    groups = events.cooccurrence(_events(spark, sf_dir), HOUR, tolerance=1)
    return events.select_buckets(groups, 2 * HOUR).select("bucket", "group_size", "score")


_LAGS = [k * HOUR for k in range(-6, 7)]
_M = f"""{_E}, l AS (SELECT CAST(unnest(range(-6, 7)) * 3600 AS INTEGER) AS lag),
    p AS (SELECT b.sensor_id AS candidate, lag, b.bucket AS t, a.z AS fz, b.z AS cz FROM e AS a CROSS JOIN l JOIN e AS b ON b.bucket = a.bucket + lag WHERE a.sensor_id = 'click' AND b.sensor_id <> 'click'),
    w AS (SELECT sensor_id, sum(least(abs(z), 15)) AS w FROM e GROUP BY 1),
    r AS (SELECT candidate, lag, count(*) AS pairs, 2 * sum(least(abs(fz), abs(cz), 15)) / (any_value(w.w) + (SELECT w FROM w WHERE sensor_id = 'click')) AS score, avg(CASE WHEN fz * cz >= 0 THEN 1.0 ELSE 0.0 END) AS agreement FROM p JOIN w ON w.sensor_id = candidate GROUP BY 1, 2)"""


def _focus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = _events(spark, sf_dir)
    return e.where("sensor_id = 'click'"), e.where("sensor_id <> 'click'")


@query(f"WITH {_M} SELECT_FROM SELECT * FROM r", "score agreement")
def event_match_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.match_scores(*_focus(spark, sf_dir), _LAGS)


_BEST = "b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY score DESC, pairs DESC, abs(lag), lag) AS k FROM r) WHERE k = 1)"


@query(f"WITH {_M}, {_BEST} SELECT_FROM SELECT candidate, lag, pairs, score, agreement, CASE WHEN pairs < 3 THEN 'unknown' WHEN agreement >= 0.5 THEN 'same' ELSE 'opposite' END AS direction FROM b", "score agreement")
def event_match_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.best_matches(events.match_scores(*_focus(spark, sf_dir), _LAGS))


@query()
def event_match_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.match_scores(*_focus(spark, sf_dir), _LAGS, tolerance=HOUR)


@query(
    f"""WITH {_M}, i AS (SELECT *, CASE WHEN t - lag(t) OVER v <= 86400 THEN 0 ELSE 1 END AS f FROM p WINDOW v AS (PARTITION BY candidate, lag ORDER BY t)),
      j AS (SELECT *, sum(f) OVER (PARTITION BY candidate, lag ORDER BY t ROWS UNBOUNDED PRECEDING) AS n FROM i)
    SELECT_FROM SELECT candidate, lag, min(t) AS start, max(t) AS end, count(*) AS points, max(least(abs(fz), abs(cz))) AS peak, avg(least(abs(fz), abs(cz))) AS mean FROM j GROUP BY candidate, lag, n""",
    "peak mean",
)
def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.episodes(events.match(*_focus(spark, sf_dir), _LAGS), 86400)


@query(
    f"""WITH {_M}, {_BEST}, o AS (SELECT y.sensor_id AS candidate, sum(abs(x.z) * abs(y.z)) AS shared FROM e AS x JOIN e AS y ON x.bucket = y.bucket WHERE x.sensor_id = 'click' AND y.sensor_id <> 'click' GROUP BY 1),
      j AS (SELECT coalesce(b.candidate, o.candidate) AS candidate, score, shared FROM b FULL JOIN o ON b.candidate = o.candidate),
      k AS (SELECT candidate, 0.6 * coalesce(score / max(score) OVER (), 0) + 0.4 * coalesce(shared / max(shared) OVER (), 0) AS blend FROM j)
    SELECT_FROM SELECT candidate, blend, CASE WHEN blend >= 0.75 THEN 'high' WHEN blend >= 0.35 THEN 'medium' ELSE 'low' END AS tier, CAST(row_number() OVER (ORDER BY blend DESC, candidate) AS INTEGER) AS rank FROM k""",
    "blend",
)
def unified_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Related series of one focus: event matching blended with shared co-occurrence."""
    focus, others = _focus(spark, sf_dir)
    best = events.best_matches(events.match_scores(focus, others, _LAGS))
    f = focus.select("bucket", F.abs("z").alias("fz"))
    shared = others.join(f, "bucket").groupBy(F.col("sensor_id").alias("candidate")).agg(F.sum(F.abs("z") * F.col("fz")).alias("shared"))
    return events.unified_rank(best, shared)


_PROFILE = """n AS (SELECT sensor_id, bucket, agg_value AS v, row_number() OVER (PARTITION BY sensor_id ORDER BY bucket) AS k, count(*) OVER (PARTITION BY sensor_id) AS size FROM h),
    w AS (SELECT a.sensor_id, a.bucket, a.k, list(b.v ORDER BY b.k) AS v FROM n AS a JOIN n AS b ON a.sensor_id = b.sensor_id AND b.k BETWEEN a.k AND a.k + 31 WHERE a.size > 32 GROUP BY 1, 2, 3 HAVING count(*) = 32),
    s AS (SELECT *, list_avg(v) AS mean, list_stddev_pop(v) AS std FROM w),
    zs AS (SELECT sensor_id, bucket, k, std <= 1e-12 AS flat, [CASE WHEN std > 1e-12 THEN (x - mean) / std ELSE 0.0 END FOR x IN v] AS z FROM s),
    pd AS (SELECT a.sensor_id, a.bucket, b.bucket AS nearest, CASE WHEN a.flat AND b.flat THEN 0.0 ELSE sqrt(greatest(0.0, list_dot_product(a.z, a.z) + list_dot_product(b.z, b.z) - 2 * list_dot_product(a.z, b.z))) END AS distance
      FROM zs AS a JOIN zs AS b ON a.sensor_id = b.sensor_id AND abs(a.k - b.k) > 16),
    pr AS (SELECT sensor_id, bucket, min(distance) AS distance, arg_min(nearest, (round(distance, 9), nearest)) AS nearest FROM pd GROUP BY 1, 2)"""


@query(f"WITH {_PROFILE} SELECT_FROM SELECT * FROM pr", "distance")
def matrix_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.matrix_profile(hourly(spark, sf_dir))


@query(
    f"""WITH {_PROFILE}, pe AS (SELECT n.sensor_id, n.bucket, o.bucket + 3600 AS stop FROM n JOIN n AS o ON o.sensor_id = n.sensor_id AND o.k = n.k + 31),
      r AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY round(distance, 9), bucket) AS near, row_number() OVER (PARTITION BY sensor_id ORDER BY round(distance, 9) DESC, bucket) AS far FROM pr),
      e2 AS (SELECT sensor_id, 'motif' AS kind, near AS place, bucket, nearest, distance FROM r WHERE near <= 5 UNION ALL SELECT sensor_id, 'anomaly', far, bucket, nearest, distance FROM r WHERE far <= 5)
    SELECT_FROM SELECT e2.sensor_id, kind, CAST(place AS INTEGER) AS place, e2.bucket AS start, a.stop AS "end", distance, nearest AS match_start, b.stop AS match_end FROM e2 JOIN pe AS a ON a.sensor_id = e2.sensor_id AND a.bucket = e2.bucket JOIN pe AS b ON b.sensor_id = e2.sensor_id AND b.bucket = e2.nearest""",
    "distance",
)
def profile_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best motifs and the five farthest anomalies of each series."""
    h = stored(hourly(spark, sf_dir))
    return events.profile_extremes(stored(events.matrix_profile(h)), h, 32, HOUR, 5)


_WEIGHTS = ", ".join(f"({at}, {j}, {w!r})" for at in range(7) for j, w in enumerate(events.savitzky_golay_weights(7, 2, 0, at).tolist()))


@query(
    f"""WITH n AS (SELECT sensor_id, bucket, agg_value AS v, row_number() OVER (PARTITION BY sensor_id ORDER BY bucket) - 1 AS k, count(*) OVER (PARTITION BY sensor_id) AS size FROM h),
      f AS (SELECT *, greatest(0, least(k - 3, size - 7)) AS first FROM n), g(p, j, w) AS (VALUES {_WEIGHTS})
    SELECT_FROM SELECT f.sensor_id, f.bucket, CASE WHEN any_value(f.size) < 7 THEN any_value(f.v) ELSE sum(n.v * w) END AS smooth FROM f JOIN n ON n.sensor_id = f.sensor_id AND n.k BETWEEN f.first AND f.first + 6 JOIN g ON g.p = least(6, f.k - f.first) AND g.j = n.k - f.first GROUP BY 1, 2""",
    "smooth",
)
def savgol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.savitzky_golay(hourly(spark, sf_dir), 7, 2)


@query(
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.x, v.x) AS similarity FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)
    SELECT_FROM SELECT query_id, vec_id, similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
    "similarity",
)
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return similarity.cosine_top_k(vectors, vectors.where("vec_id % 20 = 0"))


@query(
    """WITH p AS (SELECT c_custkey AS id, n_name = 'FRANCE' AS a, c_mktsegment = 'BUILDING' AS b FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT_FROM SELECT id, CAST(CASE WHEN a AND b THEN 0 WHEN b THEN 1 ELSE 2 END AS INTEGER) AS stage, CAST(CASE WHEN a AND b THEN 3 WHEN b THEN 2 ELSE 1 END AS INTEGER) AS hits FROM p ORDER BY 2, 3 DESC, 1 LIMIT 200"""
)
def candidate_widen(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    pool = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.col("n_name").alias("node"), F.col("c_mktsegment").alias("type"))
    return similarity.widen_candidates(pool, {"node": "FRANCE", "type": "BUILDING"}, ["node", "type"], 200)


# ---- rules -------------------------------------------------------------------------------


@query("SELECT sensor_id, bucket, agg_value > 60 AND NOT (agg_value >= 80 AND agg_value <= 90) AS met FROM h")
def rule_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = {"type": "all", "of": [{"type": "threshold", "op": "gt", "value": 60}, {"type": "not", "of": {"type": "range", "low": 80, "high": 90}}]}
    rules.validate(rule)
    return hourly(spark, sf_dir).select("sensor_id", "bucket", rules.condition(rule, "agg_value").alias("met"))


@query("WITH w AS (SELECT *, avg(agg_value) OVER (PARTITION BY sensor_id ORDER BY bucket RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS mean FROM h) SELECT_FROM SELECT sensor_id, bucket, 100 * abs(agg_value - mean) / abs(mean) > 50 AS met FROM w")
def rule_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = {"type": "deviation", "seconds": 86400, "mode": "percent", "amount": 50}
    return rules.window_facts(hourly(spark, sf_dir), [86400]).select("sensor_id", "bucket", rules.condition(rule, "agg_value").alias("met"))


_FIRINGS = """WITH w AS (SELECT sensor_id, bucket, coalesce(avg(agg_value) OVER (PARTITION BY sensor_id ORDER BY bucket RANGE BETWEEN 21599 PRECEDING AND CURRENT ROW) > 45, false) AS met FROM h),
    l AS (SELECT *, CASE WHEN met = lag(met) OVER (PARTITION BY sensor_id ORDER BY bucket) THEN 0 ELSE 1 END AS f FROM w),
    g AS (SELECT *, sum(f) OVER (PARTITION BY sensor_id ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS run FROM l),
    r AS (SELECT sensor_id, run, any_value(met) AS met, min(bucket) AS a, max(bucket) AS b FROM g GROUP BY 1, 2),
    t AS (SELECT sensor_id, run, met, a + 3600 + CASE WHEN met THEN 7200 ELSE 3600 END AS due FROM r WHERE b - a >= CASE WHEN met THEN 7200 ELSE 3600 END),
    c AS (SELECT * FROM (SELECT *, coalesce(lag(met) OVER (PARTITION BY sensor_id ORDER BY run), false) AS was FROM t) WHERE met <> was),
    fi AS (SELECT * FROM (SELECT sensor_id, met, due AS start, lead(due) OVER (PARTITION BY sensor_id ORDER BY run) AS stop FROM c) WHERE met)"""


@query(f'{_FIRINGS} SELECT_FROM SELECT sensor_id, start, stop AS "end" FROM fi')
def rule_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = {"type": "rolling_window", "stat": "mean", "seconds": 6 * HOUR, "op": "gt", "value": 45}
    return rules.backtest(hourly(spark, sf_dir), rule, HOUR, debounce=2 * HOUR, clear=HOUR)


@query(
    f"""{_FIRINGS}, du AS (SELECT sensor_id, stop IS NULL AS open, coalesce(stop, 1706659200) - start AS s FROM fi)
    SELECT_FROM SELECT sensor_id, count(*) AS firings, count(*) FILTER (WHERE open) AS open, CAST(sum(s) AS BIGINT) AS total_s, avg(s) AS mean_s, min(s) AS least_s, max(s) AS most_s, quantile_cont(s, 0.5) AS p50_s, quantile_cont(s, 0.95) AS p95_s FROM du GROUP BY 1""",
    "mean_s p50_s p95_s",
)
def backtest_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long the rule of the backtest fired, by series."""
    rule = {"type": "rolling_window", "stat": "mean", "seconds": 6 * HOUR, "op": "gt", "value": 45}
    return rules.durations(rules.backtest(hourly(spark, sf_dir), rule, HOUR, debounce=2 * HOUR, clear=HOUR), 1_706_659_200)


@query(
    """WITH e AS (SELECT sensor_id, us // 1000000 AS t, CAST(value AS INTEGER) % 4 AS severity, quality = 2 AS resolved FROM u WHERE value > 50),
      n AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR (t - lag(t) OVER w > 7200 AND NOT resolved) THEN 1 ELSE 0 END AS f FROM e WINDOW w AS (PARTITION BY sensor_id ORDER BY t)),
      i AS (SELECT *, sum(f) OVER (PARTITION BY sensor_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS i FROM n)
    SELECT_FROM SELECT sensor_id, min(t) AS start, max(t) AS end, count(*) AS events, max(severity) AS severity FROM i GROUP BY sensor_id, i"""
)
def incidents_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = metrics(spark, sf_dir, by_user=True).where("value > 50")
    severity = F.rint("value").cast("int") % 4
    return rules.incidents(e.select("sensor_id", F.expr("us div 1000000").alias("t"), severity.alias("severity"), (F.col("quality") == 2).alias("resolved")), ["sensor_id"], "t", "severity", "resolved", 7200)


@query("SELECT sensor_id, max(us) AS last_us, max(us) < 1706486400000000 AS offline FROM u GROUP BY 1")
def liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensors that were last heard of before a given time."""
    seen = metrics(spark, sf_dir, by_user=True).groupBy("sensor_id").agg(F.max("us").alias("last_us"))
    return seen.select("sensor_id", "last_us", (F.col("last_us") < 1706486400000000).alias("offline"))


@query(
    """WITH g AS (SELECT l_suppkey AS stream, l_orderkey AS seq FROM lineitem GROUP BY 1, 2), n AS (SELECT *, seq - row_number() OVER (PARTITION BY stream ORDER BY seq) AS k, min(seq) OVER (PARTITION BY stream) AS lo FROM g)
    SELECT_FROM SELECT stream, max(seq) AS acked FROM n WHERE k = lo - 1 GROUP BY 1"""
)
def contiguous_ack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last number of each stream up to which none is missing."""
    seen = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("stream"), F.col("l_orderkey").alias("seq")).distinct()
    after = seen.select("stream", (F.col("seq") - 1).alias("seq"))
    return seen.join(after, ["stream", "seq"], "left_anti").groupBy("stream").agg(F.min("seq").alias("acked"))


@query(
    """WITH st AS (SELECT sensor_id AS node_id, min(bucket // 3600) AS hour, sum(agg_value) / 10 AS e, sum(agg_value) / 10 * 0.2 AS c FROM h GROUP BY 1),
      lo AS (SELECT (bucket // 3600) % 24 AS hod, avg(agg_value) AS l FROM h WHERE sensor_id = 'click' GROUP BY 1), pv AS (SELECT bucket // 3600 AS hour, agg_value AS p FROM h WHERE sensor_id = 'view'),
      ah AS (SELECT node_id, e, c, k, greatest(coalesce(p, 0), 0) * 0.75 - greatest(coalesce(l, 0), 0) AS net FROM st CROSS JOIN (SELECT unnest(range(1, 241)) AS k) LEFT JOIN pv ON pv.hour = st.hour + k - 1 LEFT JOIN lo ON lo.hod = (st.hour + k - 1) % 24),
      cu AS (SELECT *, e + sum(net) OVER (PARTITION BY node_id ORDER BY k) AS after FROM ah), fi AS (SELECT node_id, min(k) AS k FROM cu WHERE net < 0 AND after <= c GROUP BY 1)
    SELECT_FROM SELECT st.node_id, CASE WHEN st.e <= st.c THEN 0.0 WHEN fi.k IS NULL THEN 240.0 ELSE fi.k - 1 + (cu.after - cu.net - cu.c) / -cu.net END AS runway FROM st LEFT JOIN fi ON fi.node_id = st.node_id LEFT JOIN cu ON cu.node_id = st.node_id AND cu.k = fi.k""",
    "runway",
)
def power_runway(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hourly(spark, sf_dir)
    hour = F.expr("bucket div 3600")
    load = h.where("sensor_id = 'click'").groupBy((hour % 24).alias("hour_of_day")).agg(F.avg("agg_value").alias("load_w"))
    pv = h.where("sensor_id = 'view'").select(hour.alias("hour"), F.col("agg_value").alias("pv_w"))
    state = h.groupBy(F.col("sensor_id").alias("node_id")).agg(F.min(hour).alias("hour"), (F.sum("agg_value") / 10).alias("energy_wh")).withColumn("cutoff_wh", F.col("energy_wh") * 0.2)
    return energy.project_runway(state, load, pv, 240)


@query("WITH p AS (SELECT sensor_id, us, round(value) AS value, quality FROM m), n AS (SELECT *, lag(value) OVER w AS pv, lag(quality) OVER w AS pq FROM p WINDOW w AS (PARTITION BY sensor_id ORDER BY us)) SELECT_FROM SELECT sensor_id, us, value, quality FROM n WHERE pv IS NULL OR abs(value - pv) > 1e-6 OR quality IS DISTINCT FROM pq", "value")
def cov_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose value or quality differs from the row before."""
    m = metrics(spark, sf_dir).select("sensor_id", "us", F.round("value").alias("value"), "quality")
    steps = W.previous(m, ["sensor_id"], "us", ["value", "quality"], 86_400_000_000)
    same = (F.abs(F.col("value") - F.col("prev_value")) <= 1e-6) & F.col("quality").eqNullSafe(F.col("prev_quality"))
    return steps.where(~F.coalesce(same, F.lit(False))).select("sensor_id", "us", "value", "quality")


@query("SELECT sensor_id, bucket, value FROM (SELECT sensor_id, bucket, agg_value AS value, row_number() OVER (PARTITION BY sensor_id ORDER BY bucket DESC) AS k FROM h) WHERE k <= 24", "value")
def last_n_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("sensor_id").orderBy(F.desc("bucket"))
    return hourly(spark, sf_dir).withColumn("k", F.row_number().over(w)).where("k <= 24").select("sensor_id", "bucket", F.col("agg_value").alias("value"))


@query(
    """WITH a AS (SELECT event_type, max(event_id) // 2 AS acked FROM events GROUP BY 1)
    SELECT_FROM SELECT e.event_type AS stream, e.event_id AS seq, epoch_us(e.ts) // 1000 AS ms, e.value FROM events AS e JOIN a ON e.event_type = a.event_type WHERE e.event_id > a.acked""",
    "value",
)
def spool_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written to segments, a stream for each type, and what is left after half of the numbers were acknowledged."""
    e = read(spark, sf_dir, "events")
    stream = F.expr("concat(substring(md5(event_type), 1, 8), '-', substring(md5(event_type), 9, 4), '-', substring(md5(event_type), 13, 4), '-', substring(md5(event_type), 17, 4), '-', substring(md5(event_type), 21, 12))")
    rows = e.select(stream.alias("stream_id"), (F.col("user_id") % 100).alias("sensor_idx"), F.col("event_id").alias("seq"), F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))").alias("ms"), "value", F.lit(0).alias("quality"), F.lit(1).alias("time_quality"), F.lit(0).cast("long").alias("monotonic_ms"))
    path = shared_folder(spark)
    spool.write_spool(rows, path, max_samples=20_000)
    streams = e.groupBy("event_type").agg(F.expr("max(event_id) div 2").alias("acked")).withColumn("stream_id", stream)
    left = spool.replay(spool.read_spool(spark, path), streams.select("stream_id", "acked"))
    return left.join(streams.select("stream_id", F.col("event_type").alias("stream")), "stream_id").select("stream", "seq", "ms", "value")
