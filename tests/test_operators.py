"""Hand-checkable cases of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import expressions as X
from tidewell.functions import stats as S
from tidewell.model import US
from tidewell.operators import buckets as B
from tidewell.operators import energy, events, joins, rules, similarity
from tidewell.operators import windows as W


def series(spark, sensor, values, interval=60, start=0):
    return spark.createDataFrame([(sensor, start + interval * i, float(v)) for i, v in enumerate(values)], "sensor_id string, bucket long, agg_value double")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_gap_skip(spark):
    s = spark.createDataFrame([("a", t, v) for t, v in ((0, 0.0), (60, 0.0), (120, 1.0), (180, 1.0), (3600, 100.0), (3660, 100.0))], "sensor_id string, bucket long, agg_value double")
    assert rows(W.deltas(s, 60, gap=5), "bucket", "delta") == [(60, 0.0), (120, 1.0), (180, 0.0), (3660, 0.0)]
    assert (3600, 99.0) in rows(W.deltas(s, 60), "bucket", "delta")
    assert rows(B.coverage_stats(s, 60), "bucket_rows", "delta_count") == [(6, 4)]


def test_chunked_neighbours_equal_a_window(spark):
    from pyspark.sql import Window

    s = series(spark, "a", range(50)).unionByName(series(spark, "b", range(7), 600))
    w = Window.partitionBy("sensor_id").orderBy("bucket")
    for chunk in (60, 250, 10**6):
        got = W.previous(s, ["sensor_id"], "bucket", ["agg_value"], chunk)
        assert rows(got, "sensor_id", "bucket", "prev_agg_value") == [] or got.exceptAll(s.withColumn("prev_agg_value", F.lag("agg_value").over(w))).count() == 0
        assert W.following(s, ["sensor_id"], "bucket", ["agg_value"], chunk).exceptAll(s.withColumn("next_agg_value", F.lead("agg_value").over(w))).count() == 0


def test_circular_and_reset(spark):
    wind = series(spark, "w", (350, 10, 190))
    assert rows(W.deltas(wind, 60, mode="circular"), "delta") == [(20.0,), (180.0,)]
    rain = series(spark, "r", (3, 5, 0, 1))
    assert rows(W.deltas(rain, 60, mode="reset"), "bucket", "delta") == [(60, 2.0), (120, 0.0), (180, 1.0)]


@pytest.mark.parametrize(
    ("name", "mode", "delta"),
    [(None, "avg", "linear"), ("Wind-Direction", "last", "circular"), ("rain rate", "avg", "linear"), ("rain gauge", "sum", "linear"), ("rain", "last", "reset"), ("flow meter", "sum", "linear"), ("door switch", "last", "linear"), ("precip", "sum", "linear"), ("temperature", "avg", "linear")],
)
def test_modes_of_types(spark, name, mode, delta):
    df = spark.createDataFrame([(name,)], "t string")
    assert df.select(B.mode_of_type("t"), B.delta_mode_of_type("t")).first()[:] == (mode, delta)


def test_fdr(spark):
    df = spark.createDataFrame([(0.01,), (0.02,), (0.5,)], "p double")
    assert [round(r[1], 10) for r in rows(S.benjamini_hochberg(df, "p"), "p", "q")] == [0.03, 0.03, 0.5]
    bad = spark.createDataFrame([(-0.1,), (float("nan"),), (1.2,), (0.2,)], "p double")
    assert [r["q"] for r in S.benjamini_hochberg(bad, "p").where("p = 0.2").collect()] == [0.2]
    assert S.benjamini_hochberg(bad, "p").where("q is not null").count() == 1


def test_best_lag(spark):
    a, b = series(spark, "a", range(20)), series(spark, "b", range(20), start=60)
    cells = S.correlations(a.unionByName(b), "agg_value", [-2, -1, 0, 1, 2], 60)
    best = S.best_lag(cells).first()
    assert best["r"] > 0.999
    constant = S.correlations(a.unionByName(series(spark, "c", [1] * 20)), "agg_value").first()
    assert constant["n"] == 20 and constant["r"] is None


def test_p_values(spark):
    df = spark.createDataFrame([(0.5, 30.0), (0.0, 10.0), (1.0, 10.0), (0.5, 3.0), (None, 9.0)], "r double, n double")
    got = df.select(S.fisher_p("r", "n").alias("p"), S.student_p("r", "n").alias("t")).collect()
    assert got[0]["p"] == pytest.approx(2 * (1 - 0.99785248), abs=1e-3)
    assert got[0]["t"] == pytest.approx(0.00489, abs=1e-4)
    assert got[1]["p"] == pytest.approx(1.0) and got[1]["t"] == pytest.approx(1.0)
    assert got[2]["p"] > 0 and got[3]["p"] is None and got[4]["p"] is None
    n = spark.range(1).select(S.effective_n(F.lit(100), F.lit(0.9), F.lit(0.9)).alias("a"), S.effective_n(F.lit(100), F.lit(None).cast("double"), F.lit(0.9)).alias("b")).first()
    assert 3 <= n["a"] <= 100 and n["b"] == 100


def test_ranks_and_scale(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 2.0, 3.0)], "k string, value double")
    assert [r[1] for r in rows(W.average_ranks(df, ["k"], "value"), "value", "avg_rank")] == [1.0, 2.5, 2.5, 4.0]
    assert B.robust_scale(df.limit(2), ["k"]).first()["scale"] is None
    flat = spark.createDataFrame([("a", 1.0)] * 5, "k string, value double")
    assert B.robust_scale(flat, ["k"]).first()["scale"] == 1.0


def test_asof(spark):
    left = spark.createDataFrame([("a", t) for t in (0, 5, 10, 99, 1000)], "k string, t long")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 9, "y"), ("b", 1, "z")], "k string, u long, v string")
    for bucket in (1, 7, 10**6):
        got = joins.asof(left, right, ["k"], "t", "u", ["v"], bucket)
        assert rows(got, "t", "v") == sorted([(0, None), (5, "x"), (10, "y"), (99, "y"), (1000, "y")], key=lambda r: r[0])


def test_merge_ranges(spark):
    df = spark.createDataFrame([("s", 1, 3), ("s", 4, 6), ("s", 5, 5), ("s", 9, 9)], "k string, a long, b long")
    assert rows(joins.merge_ranges(df, ["k"], "a", "b"), "a", "b") == [(1, 6), (9, 9)]


def test_derived(spark):
    b = series(spark, "a", (1, 2, 3)).unionByName(series(spark, "b", (0, 4))).withColumn("samples", F.lit(1).cast("long"))
    ratio = X.Derived("r", {"a": ("a", 0), "b": ("b", 0)}, lambda c: X.divide(c["a"], c["b"]))
    assert rows(X.evaluate(b, ratio, 60), "bucket", "agg_value") == [(60, 0.5)]
    late = X.Derived("l", {"a": ("a", 60)}, "a * 2")
    assert rows(X.evaluate(b, late, 60), "bucket", "agg_value") == [(60, 2.0), (120, 4.0)]
    chain = X.Derived("c", {"x": ("l", 0)}, "x + 1")
    assert rows(X.evaluate_all(b, [chain, late], 60).where("sensor_id = 'c'"), "agg_value") == [(3.0,), (5.0,)]
    assert X.dependents([chain, late], "a") == {"l", "c"}
    with pytest.raises(Exception, match="cycle"):
        X.in_order([X.Derived("p", {"x": ("q", 0)}, "x"), X.Derived("q", {"x": ("p", 0)}, "x")])


def test_loop_and_pulses(spark):
    df = spark.createDataFrame([(2.0, 5.0, 3.0), (0.1, 2.0, 5.0), (None, 2.0, None)], "v double, total double, before double")
    depth, quality = X.loop_depth(F.col("v"), 150.0, 5.0)
    got = df.select(depth.alias("d"), quality.alias("q"), X.pulse_delta(F.col("total"), F.col("before")).alias("p")).collect()
    assert [r["q"] for r in got] == [0, 1, 3] and [r["p"] for r in got] == [2.0, 2.0, 2.0]
    assert got[0]["d"] == pytest.approx((2 / 150 * 1000 - 4) / 16 * 5)


def test_one_to_one_matching(spark):
    f = spark.createDataFrame([("f", t, 4.0) for t in (0, 600)], "sensor_id string, bucket long, z double")
    c = spark.createDataFrame([("c", t, -5.0) for t in (50, 60, 660)], "sensor_id string, bucket long, z double")
    assert events.match(f, c, [0]).count() == 0
    got = events.match_scores(f, c, [0], tolerance=60).first()
    assert got["pairs"] == 2 and got["agreement"] == 0.0 and got["score"] == pytest.approx(2 * 8 / (8 + 15))
    assert events.best_matches(events.match_scores(f, c, [0, 60], tolerance=0)).first()["direction"] == "unknown"


def test_suppression(spark):
    e = spark.createDataFrame([("a", t, z, z) for t, z in ((0, 3.0), (60, 5.0), (120, 4.0), (600, 3.0))], "sensor_id string, bucket long, value double, z double")
    assert rows(events.suppress(e, 60), "bucket") == [(60,), (600,)]


def test_group_score(spark):
    def of(n):
        e = spark.createDataFrame([(f"s{i}", 0, 10.0 / n) for i in range(n)], "sensor_id string, bucket long, z double")
        return events.cooccurrence(e, 60, sensors=100).first()["score"]

    assert of(3) > of(20) and abs(of(100)) < 1e-9


def test_savitzky_golay(spark):
    x = np.arange(21)
    got = rows(events.savitzky_golay(series(spark, "a", x**2 + 2 * x + 3), 7, 2, chunk=5), "bucket", "smooth")
    assert [g[1] for g in got] == pytest.approx((x**2 + 2 * x + 3).tolist())
    line = rows(events.savitzky_golay(series(spark, "a", 3 * np.arange(25) + 5), 9, 3, derivative=1), "smooth")
    assert [g[0] for g in line] == pytest.approx([3.0] * 25)


def test_matrix_profile_finds_the_repeat():
    rng = np.random.default_rng(1)
    v = rng.normal(size=120)
    v[80:96] = v[20:36]
    distance, nearest = events.profile(v, 16, 8)
    assert nearest[20] == 80 and nearest[80] == 20 and distance[20] < 1e-6


def test_matrix_profile_covers_the_whole_series(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=700)
    v[640:672] = v[10:42]  # repeats a part that the last 512 buckets do not hold
    v[300:350] = 2.0
    short = rng.normal(size=40)
    both = series(spark, "a", v, 3600).unionByName(series(spark, None, short, 3600)).unionByName(series(spark, "c", range(20), 3600))
    for options in ({}, {"block": 128}, {"block": 20}):
        got = {(r["sensor_id"], r["bucket"] // 3600): r for r in events.matrix_profile(both, **options).collect()}
        assert len(got) == (700 - 31) + (40 - 31)
        for name, values in (("a", v), (None, short)):
            distance, nearest = events.profile(values, 32, 16)
            assert [got[name, k]["distance"] for k in range(len(distance))] == pytest.approx(distance.tolist(), abs=1e-5)
            assert all((got[name, k]["nearest"] is None) == (n < 0) for k, n in enumerate(nearest))
        assert got["a", 10]["nearest"] == 640 * 3600 and got["a", 640]["nearest"] == 10 * 3600
    assert events.matrix_profile(both, points=512).where("sensor_id = 'a'").agg(F.min("bucket"), F.count("*")).first()[:] == (188 * 3600, 512 - 31)


def test_all_events_are_detected(spark):
    d = spark.range(9000).select(F.lit("a").alias("sensor_id"), (F.col("id") * 3600).alias("bucket"), (F.when(F.col("id") % 3 == 0, 10.0).otherwise(1.0) * F.when(F.col("id") % 2 == 0, 1).otherwise(-1)).alias("delta"))
    assert events.detect(d).count() == 3000 and events.detect(d, cap=2000).count() == 2000


def test_firing(spark):
    s = spark.createDataFrame([("a", 60 * i, m == "1") for i, m in enumerate("0110111100101")], "sensor_id string, bucket long, met boolean")
    assert rows(rules.firing(s, 60, debounce=120, clear=60), "start", "end") == [(420, 600)]
    assert rows(rules.firing(s, 60), "start", "end")[0] == (120, 240)


def test_rules_are_validated():
    with pytest.raises(ValueError, match="low is below high"):
        rules.validate({"type": "range", "low": 3, "high": 1})
    with pytest.raises(ValueError, match="deep"):
        node = {"type": "threshold", "op": "gt", "value": 1}
        for _ in range(6):
            node = {"type": "not", "of": node}
        rules.validate(node)
    with pytest.raises(ValueError, match="not finite"):
        rules.validate({"type": "threshold", "op": "gt", "value": math.inf})


def test_offline_is_true_for_sensors_never_seen(spark):
    df = spark.createDataFrame([(None, 100), (50, 100), (99, 100)], "last_seen long, now long").withColumn("value", F.lit(None).cast("double"))
    assert [r[0] for r in df.select(rules.condition({"type": "offline", "seconds": 10})).collect()] == [True, True, False]
    assert not df.select(rules.condition({"type": "threshold", "op": "gt", "value": 1})).first()[0]


def test_incident_rollover(spark):
    e = spark.createDataFrame([("k", 0, 1, False), ("k", 1000, 3, False), ("k", 9000, 1, True), ("k", 20000, 2, False)], "k string, t long, s int, r boolean")
    assert rows(rules.incidents(e, ["k"], "t", "s", "r"), "start", "end", "severity") == [(0, 9000, 3), (20000, 20000, 2)]


def test_incidents_do_not_depend_on_the_order_of_events_at_one_time(spark):
    e = [("k", 0, 1, False), ("k", 9000, 1, True), ("k", 9000, 2, False), ("k", 9000, 2, False), ("k", 20000, 3, True)]
    for order in (e, e[::-1], [e[2], e[1], e[0], e[4], e[3]]):
        df = spark.createDataFrame(order, "k string, t long, s int, r boolean").coalesce(1)
        assert rows(rules.incidents(df, ["k"], "t", "s", "r"), "start", "end", "events", "severity") == [(0, 0, 1, 1), (9000, 20000, 4, 3)]


def test_runway(spark):
    df = spark.range(1).select(F.array(*[F.lit(-100.0)] * 24).alias("n"), F.array(*[F.lit(5.0)] * 24).alias("up"))
    got = df.select(energy.runway_hours(F.col("n"), F.lit(450.0), F.lit(200.0)).alias("a"), energy.runway_hours(F.col("up"), F.lit(450.0), F.lit(200.0)).alias("b"), energy.runway_hours(F.col("n"), F.lit(100.0), F.lit(200.0)).alias("c")).first()
    assert got["a"] == pytest.approx(2.5) and got["b"] == 24.0 and got["c"] == 0.0


def test_cosine(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [-1.0, 0.0]), (4, [0.0, 0.0]), (5, None)], "vec_id long, embedding array<double>")
    got = rows(similarity.cosine_top_k(v, v.where("vec_id in (1, 4)"), 2, row_block=2), "query_id", "rank", "vec_id")
    assert got == [(1, 1, 2), (1, 2, 3)]


def test_integrate(spark):
    m = spark.createDataFrame([("a", 0, 1000.0, 0), ("a", 3600 * US, 500.0, 0)], "sensor_id string, us long, value double, quality int")
    assert B.integrate(m, 7200 * US).first()["kwh"] == 1.5
    assert B.bucket_agg(m.limit(0), 60).count() == 0


def test_quantiles_of_a_hot_key(spark):
    """Exact, whatever share of the rows a key has and however often a value repeats."""
    import numpy as np

    from tidewell.operators.quantiles import quantiles

    rng = np.random.default_rng(2)
    groups = {"hot": np.concatenate((rng.lognormal(0, 3, 3000), np.full(2000, 7.0), [1e12])), "even": rng.integers(0, 4, 900).astype(float), "one": np.array([3.0]), "two": np.array([1.0, 2.0])}
    probabilities = [0.0, 0.01, 0.25, 0.5, 0.9, 0.95, 1.0]
    rows = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v] + [("none", None), ("two", None)], "k string, x double")
    for accuracy in (10_000, 300):  # with the lower one the larger groups go through their sketch
        got = {r["k"]: r for r in quantiles(rows, ["k"], "x", probabilities, accuracy=accuracy).collect()}
        assert set(got) == set(groups)
        for k, v in groups.items():
            assert got[k]["n"] == len(v) and np.allclose(got[k]["_q"], np.quantile(v, probabilities)), (k, accuracy)


def test_asof_in_one_bucket(spark):
    from tidewell.operators.joins import asof

    left = spark.createDataFrame([("a", t) for t in (0, 5, 5, 9, 40, 77)] + [("b", 3)], "k string, t long")
    right = spark.createDataFrame([("a", 5, 1.0), ("a", 5, 2.0), ("a", 8, 3.0), ("a", 50, 4.0)], "k string, s long, v double")
    for bucket in (1000, 7):
        got = sorted((r["k"], r["t"], r["s"], r["v"]) for r in asof(left, right, ["k"], "t", "s", ["v"], bucket).where("s is not null").collect())
        assert got == [("a", 5, 5, 2.0), ("a", 5, 5, 2.0), ("a", 9, 8, 3.0), ("a", 40, 8, 3.0), ("a", 77, 50, 4.0)]


def test_fdr_against_the_definition(spark):
    import numpy as np

    from tidewell.functions.stats import benjamini_hochberg

    rng = np.random.default_rng(3)
    p = np.concatenate((rng.random(200) ** 6, [0.0, 1.0, 0.5, 0.5, 1e-300]))
    got = {i: q for i, _, q in benjamini_hochberg(spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)] + [(999, 1.5), (998, float("nan"))], "i long, p double"), "p").select("i", "p", "q").collect()}
    order = np.argsort(p, kind="stable")
    ranks = np.array([(p <= x).sum() for x in p])
    q = np.array([min(1.0, *(p[j] * len(p) / ranks[j] for j in range(len(p)) if p[j] >= p[i])) for i in range(len(p))])
    assert order is not None and all(abs(got[i] - q[i]) < 1e-12 for i in range(len(p))) and got[999] is None and got[998] is None


def test_consecutive_periods_across_chunks(spark):
    import numpy as np

    from tidewell.operators.rules import consecutive

    rng = np.random.default_rng(7)
    rows, want = [], {}
    for sensor, share in (("a", 0.9), ("b", 0.995), ("c", 1.0)):
        at, streak, hours, last = 0, 0, 0, None
        for _ in range(400):
            at += int(rng.choice([600, 1200, 3600, 9000], p=[0.5, 0.3, 0.17, 0.03]))
            met = bool(rng.random() < share)
            rows.append((sensor, at, met))
            streak = streak + 1 if met else 0
            hour = at // 3600
            if not met:
                hours = 0
            elif last is None or hours == 0 or hour - last > 1:
                hours = 1
            else:
                hours += hour - last
            last = hour
            want[sensor, at] = (streak, hours)
    states = spark.createDataFrame(rows, "sensor_id string, bucket long, met boolean")
    for k, period in enumerate(("eval", "hour")):
        for interval in (3600, 10):  # with the shorter one the series are cut into many chunks
            got = {(r["sensor_id"], r["bucket"]): r["streak"] for r in consecutive(states, 3, period, interval).collect()}
            assert got == {key: v[k] for key, v in want.items()}, (period, interval)


def test_window_facts_across_chunks(spark):
    import numpy as np

    from tidewell.operators.rules import window_facts

    rng = np.random.default_rng(8)
    at = np.cumsum(rng.integers(1, 40, 500))
    v = rng.normal(size=500)
    got = {r["bucket"]: r for r in window_facts(spark.createDataFrame([("s", int(t), float(x)) for t, x in zip(at, v)], "sensor_id string, bucket long, agg_value double"), [50]).collect()}
    assert len(got) == 500
    for t in at.tolist():
        inside = v[(at > t - 50) & (at <= t)]
        assert np.isclose(got[t]["mean_50"], inside.mean()) and np.isclose(got[t]["median_50"], np.median(inside)) and got[t]["min_50"] == inside.min()


def test_targets_of_rules(spark):
    from tidewell.operators.rules import met_targets, targets

    sensors = spark.createDataFrame([("a", "n1", "temp", '{"provider": "x"}', None), ("b", "n1", "flow", None, None), ("c", "n2", "temp", '{"provider": " x "}', None), ("d", "n1", "temp", None, 5)], "sensor_id string, node_id string, type string, config string, deleted_at long")
    of = lambda s: sorted((r["target_key"], r["sensor_id"]) for r in targets(sensors, s).collect())
    assert of({"kind": "sensor", "sensor_id": " a "}) == [("sensor:a", "a")] and of({"kind": "sensor", "sensor_id": "d"}) == []
    assert of({"kind": "sensor_set", "sensor_ids": ["a", "", "c"], "match": "any"}) == [("selector:any", "a"), ("selector:any", "c")]
    assert of({"kind": "node_sensors", "node_id": "n1"}) == [("sensor:a", "a"), ("sensor:b", "b")]
    assert of({"kind": "node_sensors", "node_id": "n1", "types": ["temp"]}) == [("sensor:a", "a")]
    assert of({"kind": "filter", "provider": "x", "type": "temp"}) == [("sensor:a", "a"), ("sensor:c", "c")]
    states = spark.createDataFrame([("t", "a", True), ("t", "b", None), ("u", "c", True)], "target_key string, sensor_id string, met boolean")
    assert {r["target_key"]: r["met"] for r in met_targets(states, "all").collect()} == {"t": False, "u": True}
    assert {r["target_key"]: r["met"] for r in met_targets(states, "any").collect()} == {"t": True, "u": True}


def test_greedy_separation_moves_its_anchor(spark):
    from tidewell.operators.events import separate

    rows = [("s", t, float(z), float(z), "up") for t, z in ((0, 3), (50, 5), (100, 4), (140, 6), (400, 2), (450, 1))]
    got = separate(spark.createDataFrame(rows, "sensor_id string, bucket long, value double, z double, direction string"), 60)
    # 50 replaces 0, 100 is weaker and goes, 140 is beyond 60 of 50.
    assert sorted(r["bucket"] for r in got.collect()) == [50, 140, 400]


def test_detector_skips_gaps(spark):
    from tidewell.operators.events import detect_changes

    steps = [(0, 0.0), (60, 0.0), (120, 1.0), (180, 1.0), (3600, 100.0), (3660, 100.0)]
    b = spark.createDataFrame([("s", t, v) for t, v in steps], "sensor_id string, bucket long, agg_value double")
    assert 3600 in {r["bucket"] for r in detect_changes(b, 60, "delta", 3.0, gap=0).collect()}
    assert 3600 not in {r["bucket"] for r in detect_changes(b, 60, "delta", 3.0, gap=5).collect()}


def test_intermediate_tables_are_removed(spark):
    from tidewell.operators import storage

    storage.clean_up(spark)
    df = storage.stored(spark.range(5))
    assert df.count() == 5
    folder = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert storage.clean_up(spark) == 1 and not __import__("os").path.exists(folder) and storage.clean_up(spark) == 0
