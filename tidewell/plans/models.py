"""Queries of dependency paths, battery charge, temperature models and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.model import metrics, read
from tidewell.operators import battery, graphs, similarity, temperature, vectors
from tidewell.operators.storage import stored
from tidewell.plans.aggregates import HOUR, hourly
from tidewell.plans.registry import query

_EDGES = """e AS (SELECT DISTINCT 'p' || l_partkey AS node, 's' || l_suppkey AS input FROM lineitem
      UNION SELECT 'p' || p_partkey, 'p' || (p_partkey // 2) FROM part WHERE p_partkey > 1
      UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part is made of its suppliers and of the part of half its number, a supplier of its nation, that of its region."""
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c))
    of = lambda table, node, input_: read(spark, sf_dir, table).select(node.alias("node"), input_.alias("input"))
    half = read(spark, sf_dir, "part").where("p_partkey > 1").select(name("p", "p_partkey").alias("node"), F.concat(F.lit("p"), F.expr("p_partkey div 2")).alias("input"))
    return of("lineitem", name("p", "l_partkey"), name("s", "l_suppkey")).unionByName(half).unionByName(of("supplier", name("s", "s_suppkey"), name("n", "s_nationkey"))).unionByName(of("nation", name("n", "n_nationkey"), name("r", "n_regionkey")))


@query(
    f"""RECURSIVE WITH {_EDGES},
      w(candidate, focus, node, path) AS (SELECT 'p' || p_partkey, f.focus, 'p' || p_partkey, ['p' || p_partkey] FROM part, (SELECT unnest(['n7', 'p3']) AS focus) AS f WHERE f.focus <> 'p' || p_partkey
        UNION ALL SELECT w.candidate, w.focus, e.input, list_append(w.path, e.input) FROM w JOIN e ON w.node = e.node WHERE w.node <> w.focus AND len(w.path) <= 3),
      b AS (SELECT *, row_number() OVER (PARTITION BY candidate, focus ORDER BY len(path), path) AS k FROM w WHERE node = focus)
    SELECT_FROM SELECT candidate, focus, CAST(len(path) - 1 AS INTEGER) AS depth, array_to_string(path, '>') AS path FROM b WHERE k = 1"""
)
def dependency_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of what path a part is made of a nation, or of another part, in at most three steps."""
    parts = read(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("candidate"), F.explode(F.array(F.lit("n7"), F.lit("p3"))).alias("focus"))
    found = graphs.dependency_paths(_edges(spark, sf_dir), parts, max_depth=3)
    return found.select("candidate", "focus", "depth", F.concat_ws(">", "path").alias("path"))


@query(
    """RECURSIVE WITH s AS (SELECT sensor_id AS node_id, us, max(value) - 30 AS i, max(value) % 100 AS q FROM m GROUP BY 1, 2),
      p AS (SELECT *, row_number() OVER w AS k, lag(us) OVER w AS pu, lag(i) OVER w AS pi, lag(q) OVER w AS pq FROM s WINDOW w AS (PARTITION BY node_id ORDER BY us)),
      v AS (SELECT *, CASE WHEN abs(q - pq) >= 1 AND abs(i) >= 0.05 THEN CASE WHEN (q > pq) = (i > 0) THEN 1 ELSE -1 END END AS vote, CASE WHEN abs(i) <= 15 AND coalesce(abs(pi) > 15, true) THEN us END AS starts FROM p),
      c AS (SELECT *, count(*) FILTER (WHERE vote = 1) OVER w AS pos, count(*) FILTER (WHERE vote = -1) OVER w AS neg, last_value(starts IGNORE NULLS) OVER w AS since FROM v WINDOW w AS (PARTITION BY node_id ORDER BY us ROWS UNBOUNDED PRECEDING)),
      l AS (SELECT node_id, arg_min(CASE WHEN pos >= 3 AND pos >= neg + 2 THEN 1 ELSE -1 END, us) AS turn, min(us) AS locked FROM c WHERE (pos >= 3 AND pos >= neg + 2) OR (neg >= 3 AND neg >= pos + 2) GROUP BY 1),
      r AS (SELECT c.node_id, k, us, q, us - pu > 7200000000 AS anew, CASE WHEN us >= locked THEN turn ELSE 1 END * i * (us - pu) / 3.6e9 AS ah, abs(i) <= 15 AND us - since >= 600000000 AS resting FROM c LEFT JOIN l ON c.node_id = l.node_id),
      f(node_id, k, us, soc, capacity_ah, anchor, counted) AS (SELECT node_id, k, us, CAST(q AS DOUBLE), CAST(200 AS DOUBLE), CAST(q AS DOUBLE), CAST(0 AS DOUBLE) FROM r WHERE k = 1
        UNION ALL SELECT node_id, k, us, CASE WHEN resting THEN least(100, greatest(0, s + least(0.5, greatest(-0.5, (q - s) * 0.1)))) ELSE s END,
          CASE WHEN resting AND abs(q - a) >= 20 THEN 0.8 * capacity_ah + 0.2 * least(400, greatest(50, abs(g) / (abs(q - a) / 100))) ELSE capacity_ah END,
          CASE WHEN resting AND abs(q - a) >= 20 THEN q ELSE a END, CASE WHEN resting AND abs(q - a) >= 20 THEN 0 ELSE g END
        FROM (SELECT r.*, f.capacity_ah, CASE WHEN anew THEN q ELSE least(100, greatest(0, soc + ah / f.capacity_ah * 100)) END AS s, CASE WHEN anew THEN q ELSE anchor END AS a, CASE WHEN anew THEN 0 ELSE counted + ah END AS g
              FROM f JOIN r ON r.node_id = f.node_id AND r.k = f.k + 1) AS step)
    SELECT_FROM SELECT node_id, us, soc, capacity_ah FROM f""",
    "soc capacity_ah",
)
def battery_soc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charge and capacity, with the direction by votes and rest of ten minutes."""
    m = metrics(spark, sf_dir).select(F.col("sensor_id").alias("node_id"), "us", (F.col("value") - 30).alias("current_a"), (F.col("value") % 100).alias("soc_pct"))
    model = battery.Model(200.0, max_gap_s=7200, rest_current=15.0, rest_minutes=10, sign=None, learn=battery.Capacity(span=20.0, alpha=0.2, low_ah=50.0, high_ah=400.0))
    return battery.state_of_charge(m, model)


# ---- temperature ---------------------------------------------------------------------------

#: Least squares of y by x, x^2 and time for each sensor and lag: the regressors made orthogonal, one after the other.
_FIT = """, a AS (SELECT y.sensor_id, l.lag, y.bucket AS t, y.agg_value AS y, x.agg_value AS x FROM h AS y CROSS JOIN l JOIN h AS x ON x.bucket = y.bucket - l.lag WHERE y.sensor_id <> 'click' AND x.sensor_id = 'click'),
      g AS (SELECT sensor_id, lag, count(*) AS n, avg(x) AS centre, avg(t) AS centre_t, avg(y) AS ym FROM a GROUP BY 1, 2 HAVING count(*) >= 20),
      b AS (SELECT a.*, n, centre, centre_t, ym, x - centre AS x1, power(x - centre, 2) AS x2, (t - centre_t) / 86400 AS d FROM a JOIN g ON a.sensor_id = g.sensor_id AND a.lag = g.lag),
      b2 AS (SELECT *, x2 - avg(x2) OVER w - coalesce(regr_slope(x2, x1) OVER w, 0) * x1 AS z2, regr_slope(x2, x1) OVER w AS s21 FROM b WINDOW w AS (PARTITION BY sensor_id, lag)),
      b3 AS (SELECT *, d - regr_slope(d, x1) OVER w * x1 - regr_slope(d, z2) OVER w * z2 AS z3, regr_slope(d, x1) OVER w AS s31, regr_slope(d, z2) OVER w AS s32 FROM b2 WINDOW w AS (PARTITION BY sensor_id, lag)),
      c AS (SELECT sensor_id, lag, any_value(n) AS n, any_value(centre) AS centre, any_value(ym) AS ym, avg(x2) AS x2m, regr_slope(y, x1) AS c1, regr_slope(y, z2) AS c2, regr_slope(y, z3) AS c3, any_value(s21) AS s21, any_value(s31) AS s31, any_value(s32) AS s32 FROM b3 GROUP BY 1, 2),
      f AS (SELECT sensor_id, lag, n, centre, ym, x2m, c3 AS slope, c2 - c3 * s32 AS b2, c1 - c2 * s21 - c3 * (s31 - s32 * s21) AS b1 FROM c),
      k AS (SELECT b.*, f.b1, f.b2, f.slope, ym - f.b2 * x2m AS b0 FROM b JOIN f USING (sensor_id, lag, n, centre, ym))"""


def _aligned(spark: SparkSession, sf_dir: str, lags: list[int]) -> DataFrame:
    h = hourly(spark, sf_dir)
    raw = h.where("sensor_id <> 'click'").select("sensor_id", F.col("bucket").alias("t"), F.col("agg_value").alias("y"))
    return temperature.align(raw, h.where("sensor_id = 'click'").select(F.col("bucket").alias("t"), F.col("agg_value").alias("x")), lags)


@query(
    f"""WITH l AS (SELECT 0 AS lag){_FIT}
    SELECT_FROM SELECT sensor_id, any_value(n) AS n, any_value(centre) AS centre, any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2, any_value(slope) AS slope,
      1 - sum(power(y - b0 - b1 * x1 - b2 * x2 - slope * d, 2)) / (var_pop(y) * count(y)) AS r2 FROM k GROUP BY 1""",
    "centre b0 b1 b2 slope r2",
)
def temperature_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each series by a square polynomial of another (the temperature) and a drift in time."""
    points = _aligned(spark, sf_dir, [0])
    fits = temperature.fit(points, ["sensor_id"], 2, time_slope=True).where("n >= 20")
    b = F.col("beta")
    return fits.join(temperature.explained(points, fits, ["sensor_id"], 2), "sensor_id").select("sensor_id", "n", "centre", b[0].alias("b0"), b[1].alias("b1"), b[2].alias("b2"), "slope", "r2")


@query(
    f"""WITH l AS (SELECT CAST(unnest(range(0, 7)) * 3600 AS INTEGER) AS lag){_FIT},
      q AS (SELECT sensor_id, lag, quantile_cont(y, 0.95) - quantile_cont(y, 0.05) AS raw, quantile_cont(y - b1 * x1 - b2 * x2, 0.95) - quantile_cont(y - b1 * x1 - b2 * x2, 0.05) AS swing FROM k GROUP BY 1, 2),
      r AS (SELECT sensor_id, lag, CASE WHEN raw > 0 THEN greatest(0, least(100, (1 - swing / raw) * 100)) END AS pct FROM q),
      o AS (SELECT sensor_id, arg_max(lag, (coalesce(pct, -1), -lag)) AS best_lag, arg_max(pct, (coalesce(pct, -1), -lag)) AS reduction_pct, max(pct) FILTER (WHERE lag = 0) AS baseline_pct FROM r GROUP BY 1)
    SELECT_FROM SELECT sensor_id, CASE WHEN reduction_pct - baseline_pct >= 1 THEN best_lag ELSE 0 END AS lag, best_lag, reduction_pct, baseline_pct FROM o""",
    "reduction_pct baseline_pct",
)
def temperature_lag_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lag of the temperature that takes most of the swing away, where it gains a percent at least."""
    return temperature.choose_lag(temperature.lag_scores(_aligned(spark, sf_dir, [k * HOUR for k in range(7)]), 2, time_slope=True), 1.0)


# ---- embeddings ----------------------------------------------------------------------------


@query(
    """WITH w AS (SELECT unnest([300, 3600, 21600, 86400, 604800, 2592000, 7776000, 4611686018427387904]) AS span, unnest(range(8)) AS pos),
      e AS (SELECT *, lag(bucket) OVER s AS pb, lag(agg_value) OVER s AS pv, max(bucket) OVER (PARTITION BY sensor_id) AS last, count(*) OVER (PARTITION BY sensor_id) AS many FROM h WINDOW s AS (PARTITION BY sensor_id ORDER BY bucket)),
      x AS (SELECT sensor_id, 'v' AS kind, pos, agg_value AS x FROM e JOIN w ON last - bucket <= span WHERE many >= 3 UNION ALL SELECT sensor_id, 'd', pos, (agg_value - pv) / greatest(1, bucket - pb) FROM e JOIN w ON last - pb <= span WHERE many >= 3),
      g AS (SELECT sensor_id, kind, pos, median(x) AS m, quantile_cont(x, 0.05) AS p05, quantile_cont(x, 0.95) AS p95, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr, avg(x) AS mean, stddev_pop(x) AS std FROM x GROUP BY ALL HAVING count(*) >= 3),
      d AS (SELECT x.sensor_id, x.kind, x.pos, median(abs(x.x - m)) AS mad FROM x JOIN g USING (sensor_id, kind, pos) GROUP BY ALL),
      c AS (SELECT *, CASE WHEN mad > 1e-9 THEN mad * 1.4826 WHEN iqr > 1e-9 THEN iqr / 1.349 ELSE 1 END AS scale FROM g JOIN d USING (sensor_id, kind, pos)),
      z AS (SELECT sensor_id, kind, pos, least(6, abs(x.x - m) / scale) AS z FROM x JOIN c USING (sensor_id, kind, pos)),
      s AS (SELECT sensor_id, kind, pos, avg(z) AS z_mean, max(z) AS z_most, quantile_cont(z, 0.95) AS z_high, avg((z >= 2.5)::INT) AS spikes, avg((z >= 4)::INT) AS high_spikes FROM z GROUP BY ALL),
      f AS (SELECT sensor_id, CASE kind WHEN 'v' THEN 'value' ELSE 'delta' END AS vector, pos * 10 AS base, [m, mad, p05, m, p95, iqr, mean, std, z_mean, z_high] AS part FROM c JOIN s USING (sensor_id, kind, pos) WHERE pos < 7
            UNION ALL SELECT sensor_id, 'event', pos * 8 + CASE kind WHEN 'v' THEN 0 ELSE 4 END, [spikes, high_spikes, z_most, z_high] FROM s),
      p AS (SELECT sensor_id, vector, base + unnest(range(len(part))) AS place, unnest(part) AS x FROM f),
      n AS (SELECT sensor_id, vector, sqrt(sum(x * x)) AS norm FROM p GROUP BY ALL),
      a AS (SELECT DISTINCT sensor_id FROM e WHERE many >= 3),
      every AS (SELECT sensor_id, vector, unnest(range(CASE vector WHEN 'event' THEN 64 ELSE 128 END)) AS place FROM a, (SELECT unnest(['value', 'delta', 'event']) AS vector))
    SELECT_FROM SELECT every.sensor_id, every.vector, CAST(every.place AS INTEGER) AS place, coalesce(CASE WHEN norm > 0 THEN x / norm ELSE x END, 0) AS x FROM every LEFT JOIN p USING (sensor_id, vector, place) LEFT JOIN n USING (sensor_id, vector)""",
    "x",
)
def embeddings_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of values, of changes and of events of each series, entry by entry."""
    e = similarity.embed(hourly(spark, sf_dir))
    parts = [e.select("sensor_id", F.lit(name).alias("vector"), F.posexplode(name).alias("place", "x")) for name in ("value", "delta", "event")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---- vector search -------------------------------------------------------------------------

_PAYLOAD = """v AS (SELECT CAST(vec_id AS VARCHAR) AS id, 'n' || (vec_id % 7) AS node, 'u' || (vec_id % 4) AS unit_, 't' || label AS type, CAST(60 * (1 + vec_id % 2) AS INTEGER) AS interval_seconds, vec_id % 5 = 0 AS is_derived,
      CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id IS NOT NULL),
    p AS (SELECT id, node, unit_, type, interval_seconds, is_derived, unnest(['value', 'delta', 'event']) AS space, unnest([x[1:32], x[33:48], x[49:64]]) AS x FROM v)"""


def _index(spark: SparkSession, sf_dir: str) -> tuple[vectors.Index, DataFrame]:
    """Vectors in three parts, as the spaces of an index, with a payload made of their ids and labels."""
    part = lambda a, n: F.slice("embedding", a, n)
    v = read(spark, sf_dir, "embeddings").where("vec_id is not null").select(
        F.col("vec_id").cast("string").alias("id"), F.concat(F.lit("n"), F.col("vec_id") % 7).alias("node"), F.concat(F.lit("u"), F.col("vec_id") % 4).alias("unit_"), F.concat(F.lit("t"), "label").alias("type"),
        (60 * (1 + F.col("vec_id") % 2)).cast("int").alias("interval_seconds"), (F.col("vec_id") % 5 == 0).alias("is_derived"), part(1, 32).alias("value"), part(33, 16).alias("delta"), part(49, 16).alias("event"),
    )
    v = stored(v)
    return vectors.build(v, {s: s for s in ("value", "delta", "event")}, ["node", "unit_", "type", "interval_seconds", "is_derived"]), v


@query(
    f"""WITH {_PAYLOAD}, s AS (SELECT q.id AS query_id, p.id, list_cosine_similarity(q.x, p.x) AS score FROM p AS q JOIN p ON q.space = 'value' AND p.space = 'value' AND q.id <> p.id AND (q.type IS NULL OR q.type = p.type) AND p.interval_seconds = 60 WHERE CAST(q.id AS BIGINT) % 20 = 0)
    SELECT_FROM SELECT * FROM (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS INTEGER) AS rank FROM s) WHERE rank <= 10""",
    "score",
)
def ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of the same type and an interval of a minute, by cells and their bounds."""
    index, v = _index(spark, sf_dir)
    queries = v.where("cast(id as bigint) % 20 = 0").select(F.col("id").alias("query_id"), F.lit("value").alias("space"), F.col("value").alias("vector"), F.array("id").alias("exclude"), "type")
    return vectors.search(index, queries, 10, F.col("interval_seconds") == 60, ("type",)).drop("space")


@query(
    f"""WITH {_PAYLOAD}, g AS (SELECT * FROM (VALUES (0, true, true, true, true), (1, false, true, true, true), (2, false, false, true, true), (3, false, false, false, true), (4, false, false, false, false)) AS t(stage, node, minute, type, unit_)),
      s AS (SELECT q.id AS focus, stage, q.space, p.id, list_cosine_similarity(q.x, p.x) AS score FROM p AS q CROSS JOIN g JOIN p ON q.space = p.space AND q.id <> p.id AND p.id <> '7'
            AND (NOT g.node OR p.node = q.node) AND (NOT g.minute OR p.interval_seconds = 60) AND (NOT g.type OR q.type IS NULL OR p.type = q.type) AND (NOT g.unit_ OR p.unit_ = q.unit_) WHERE CAST(q.id AS BIGINT) % 40 = 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY focus, stage, space ORDER BY round(score, 12) DESC, id) AS rank FROM s),
      f AS (SELECT * FROM r WHERE rank <= 30 * (stage + 1)),
      first AS (SELECT focus, id, min(stage) AS stage FROM f GROUP BY 1, 2),
      n AS (SELECT g.stage, focus, count(*) AS pool FROM first JOIN g ON first.stage <= g.stage GROUP BY 1, 2),
      l AS (SELECT focus, coalesce(min(stage) FILTER (WHERE pool >= 60), 4) AS last FROM n GROUP BY 1),
      c AS (SELECT f.focus, id, min(stage) AS stage, count(DISTINCT space) AS hits, max(score) AS best_score FROM f JOIN l ON f.focus = l.focus AND stage <= last GROUP BY 1, 2),
      o AS (SELECT *, count(*) OVER (PARTITION BY focus) AS pool, row_number() OVER (PARTITION BY focus ORDER BY stage, hits DESC, round(best_score, 12) DESC, id) AS rank FROM c)
    SELECT_FROM SELECT focus, id AS candidate, CAST(stage AS INTEGER) AS stage, CAST(hits AS INTEGER) AS hits, best_score, pool, CAST(rank AS INTEGER) AS rank FROM o WHERE rank <= 60""",
    "best_score",
)
def candidate_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each focus from three vectors, with filters that are given up one by one until the pool is large enough."""
    index, v = _index(spark, sf_dir)
    filters = vectors.Filters(same_node=True, same_unit=True, same_type=True, interval_seconds=60, exclude=("7",))
    return vectors.candidates(index, v.where("cast(id as bigint) % 40 = 0"), filters, 60)
