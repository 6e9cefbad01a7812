"""Sliding percentiles against NumPy."""

import time

import numpy as np
import pytest

from tidewell.operators import rules, sliding


def test_kth_of_any_stretch():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 300):
        ranks = rng.integers(0, max(1, n // 2), n)
        low = rng.integers(0, n, 200)
        high = np.minimum(n, low + rng.integers(1, n + 1, 200))
        k = rng.integers(0, high - low)
        assert sliding.kth_values(ranks, low, high, k).tolist() == [int(np.sort(ranks[a:b])[i]) for a, b, i in zip(low, high, k, strict=True)]


def test_a_window_of_half_a_million_rows():
    rng = np.random.default_rng(2)
    times, values = np.arange(1_000_000), rng.normal(size=1_000_000)
    began = time.process_time()
    got = sliding.percentiles_of(times, values, 500_000, [0.5, 0.95])
    assert time.process_time() - began < 60
    for at in (0, 10, 499_999, 700_001, 999_999):
        assert got[at] == pytest.approx(np.quantile(values[max(0, at - 499_999) : at + 1], [0.5, 0.95]))


@pytest.mark.parametrize("chunks", [1, 4, 100])
def test_rolling_percentiles(spark, chunks):
    rng = np.random.default_rng(3)
    rows = [(k, int(t), None if rng.random() < 0.1 else float(rng.integers(0, 30)), "x") for k in "ab" for t in rng.integers(-3000, 5000, 400)] + [("a", None, 1.0, "x"), ("c", 5, None, "x"), (None, 5, 2.0, "x")]
    df = spark.createDataFrame(rows, "k string, t long, v double, _home string").drop("_home")
    got = sorted(((r["k"] or "", r["t"], -1.0 if r["v"] is None else r["v"]), r["q"]) for r in sliding.rolling_percentiles(df, ["k"], "t", "v", 300, [0.0, 0.5, 0.9], "q", chunks).collect())
    want = []
    for k, t, v, _ in rows:
        if t is not None:
            inside = [x for a, s, x, _ in rows if a == k and s is not None and t - 300 < s <= t and x is not None]
            want.append(((k or "", t, -1.0 if v is None else v), [float(x) for x in np.quantile(inside, [0.0, 0.5, 0.9])] if inside else [None] * 3))
    assert [g[0] for g in got] == [w[0] for w in sorted(want, key=lambda w: w[0])]
    for (key, a), (_, b) in zip(got, sorted(want, key=lambda w: w[0]), strict=True):
        assert a == b or a == pytest.approx(b), key
    assert sliding.rolling_percentiles(df.limit(0), ["k"], "t", "v", 300, [0.5]).count() == 0


def test_median_windows_of_rules(spark):
    rows = [("s", 3600 * i, float(i % 7)) for i in range(100)]
    got = {r["bucket"]: r["median_36000"] for r in rules.window_facts(spark.createDataFrame(rows, "sensor_id string, bucket long, agg_value double"), [36_000]).collect()}
    assert got == {3600 * i: float(np.median([j % 7 for j in range(max(0, i - 9), i + 1)])) for i in range(100)}


def test_moments_against_numpy():
    rng = np.random.default_rng(6)
    times, values, known = np.sort(rng.integers(0, 300, 500)), np.round(rng.normal(1e6, 3, 500)), rng.random(500) > 0.2
    for width in (1, 7, 100, 1000):
        mean, deviation = sliding.moments_of(times, values, known, width)
        for i, t in enumerate(times):
            x = values[known & (times > t - width) & (times <= t)]
            assert len(x) and (mean[i], deviation[i]) == pytest.approx((x.mean(), x.std()), rel=1e-9, abs=1e-9) or not len(x) and np.isnan(mean[i]) and np.isnan(deviation[i])
    assert not sliding.moments_of(times, np.full(500, 0.1), known, 50)[1][known].any()


def test_uptime_and_jitter_of_many_samples_a_day(spark, tmp_path):
    """A window frame that is gone through for each row takes hours for these; samples of unknown quality are not good."""
    from tidewell.plans import catalogue

    n = 400_000
    e = spark.range(n).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id * 0.4) AS ts", "1L AS user_id", "'click' AS event_type", "CAST(id % 7 AS DOUBLE) AS value", "IF(id % 4 = 0, NULL, concat('{\"k\": ', id % 3, '}')) AS props")
    e.write.parquet(str(tmp_path / "events.parquet"))
    began = time.monotonic()
    rows = {r["us"]: (r["uptime"], r["jitter"]) for r in catalogue.QUERIES["uptime_and_jitter"](spark, str(tmp_path)).where("us % 20000000 = 0").collect()}
    assert time.monotonic() - began < 60
    for at in (0, 50, 215_950, 216_000, 399_950):
        ids = np.arange(max(0, at - 215_999), at + 1)
        assert rows[1_704_067_200_000_000 + at * 400_000] == pytest.approx((100 * np.mean((ids % 4 != 0) & (ids % 3 == 0)), (ids % 7).std()), abs=2e-6)
