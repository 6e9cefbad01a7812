"""Related series against a plain computation, planted relations, clock changes and odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.model import day_start, local_time
from tidewell.operators import related as R

HOUR = 3600
SCHEMA = "sensor_id string, bucket long, agg_value double, samples long"


@pytest.fixture(scope="module")
def series(spark):
    """focus, a copy of it two hours later, one that follows it for a third of the time, and noise; with gaps."""
    rng = random.Random(3)
    level = [math.sin(i / 5) + rng.random() for i in range(300)]
    rows = []
    for i in range(300):
        if i % 37:
            rows.append(("focus", i * HOUR, level[i], 1))
        rows.append(("later", i * HOUR, 3 * level[i - 2] + 1 if i >= 2 else 0.0, 1))
        rows.append(("partly", i * HOUR, level[i] if 100 <= i < 200 else rng.random(), 1))
        rows.append(("noise", i * HOUR, rng.random(), 1))
    rows += [("short", 0, 1.0, 1), ("short", HOUR, 2.0, 1)]
    return spark.createDataFrame(rows, SCHEMA)


def plain_episodes(x, y, at, window, horizon, threshold):
    """Episodes of one window length, window by window."""
    points = max(3, window // HOUR)
    r = []
    for s in range(len(at) - points + 1):
        a, b = x[s : s + points], y[s : s + points]
        if np.std(a) > 1e-9 and np.std(b) > 1e-9:
            r.append((at[s], abs(np.corrcoef(a, b)[0, 1])))
    runs, run = [], []
    for t, v in [*r[:: max(1, points // 4)], (None, 0.0)]:
        if v >= threshold:
            run.append((t, v))
        elif run:
            runs.append((run[0][0], run[-1][0] + window, round(max(v for _, v in run), 9), round(sum(v for _, v in run) / len(run), 9), len(run) * points))
            run = []
    return runs


@pytest.mark.parametrize("chunk", [8, 1 << 14])
def test_episodes(spark, series, chunk):
    z = R.robust_z(series)
    lags = spark.createDataFrame([("later", 2), ("partly", 0), ("noise", -1)], "candidate string, lag int")
    horizon = 300 * HOUR
    got = {}
    for row in R.episodes(z, "focus", lags, HOUR, horizon, 0.6, chunk=chunk).collect():
        assert row["coverage"] == pytest.approx(min(1, (row["end"] - row["start"]) / horizon))
        got.setdefault((row["candidate"], row["window_s"]), []).append((row["start"], row["end"], round(row["peak"], 9), round(row["mean"], 9), row["points"]))
    values = {}
    for row in z.collect():
        values.setdefault(row["sensor_id"], {})[row["bucket"]] = row["z"]
    want = {}
    for name, lag in [("later", 2), ("partly", 0), ("noise", -1)]:
        at = sorted(t for t in values["focus"] if t + lag * HOUR in values[name])
        x, y = np.array([values["focus"][t] for t in at]), np.array([values[name][t + lag * HOUR] for t in at])
        for window in R.window_lengths(horizon, HOUR):
            if found := plain_episodes(x, y, at, window, horizon, 0.6):
                want[name, window] = found
    assert want and {k: sorted(v) for k, v in got.items()} == want


def test_inference_and_scores(spark, series):
    z = R.robust_z(series)
    assert z.where("sensor_id = 'short'").count() == 0  # under three values: no scale
    inference = R.lag_inference(z, "focus", list(range(-3, 4)), HOUR).cache()
    rows = {r["candidate"]: r for r in inference.collect()}
    assert set(rows) == {"later", "partly", "noise"}
    assert rows["later"]["lag"] == 2 and rows["later"]["r"] > 0.95 and rows["later"]["m_lag"] == 7
    assert all(r["p_raw"] <= r["p_lag"] + 1e-12 <= r["q"] + 2e-12 and r["low"] <= min(r["r"], 0.999999) <= r["high"] + 1e-12 for r in rows.values())
    passed = R.significant(inference)
    found = R.episodes(z, "focus", passed, HOUR, 300 * HOUR)
    scored = {r["candidate"]: r for r in R.scores(passed, found, HOUR).collect()}
    assert "noise" not in scored and scored["later"]["score"] > scored["partly"]["score"] > 0
    alone = {r["candidate"]: r for r in R.scores(passed, found.where("false"), HOUR).collect()}
    assert alone["later"]["episodes"] == 0 and alone["later"]["score"] == 0.0 and alone["later"]["best_window"] is None


def test_no_rows(spark, series):
    z = R.robust_z(series.where("false"))
    inference = R.lag_inference(z, "focus", [0, 1], HOUR)
    assert R.scores(R.significant(inference), R.episodes(z, "focus", inference, HOUR, HOUR), HOUR).count() == 0
    z = R.robust_z(series.where("sensor_id <> 'focus'"))  # a focus without points relates to nothing
    assert R.lag_inference(z, "focus", [0, 1], HOUR).count() == 0


def test_daily_lag(spark):
    rows = spark.createDataFrame([(0,), (1800,), (86_400,), (-88_200,), (88_201,), (172_000,), (43_200,)], "s long")
    assert [r[0] for r in rows.select(R.daily_lag(F.col("s"))).collect()] == [False, False, True, True, False, True, False]


def test_clock_changes(spark):
    """Days of 23, 24 and 25 hours; a time in the repeated hour keeps its day."""
    days = spark.sql("SELECT explode(array(DATE '2024-03-10', DATE '2024-07-01', DATE '2024-11-03')) AS day")
    length = day_start(F.date_add("day", 1), "America/New_York") - day_start(F.col("day"), "America/New_York")
    assert [r[0] // 3_600_000_000 for r in days.select(length).collect()] == [23, 24, 25]
    times = spark.createDataFrame([(1710054000_000000,), (1730613600_000000,), (None,), (-1,)], "us long")
    assert [str(r[0]) for r in times.select(local_time(F.col("us"), "America/New_York")).collect()] == ["2024-03-10 03:00:00", "2024-11-03 01:00:00", "None", "1969-12-31 18:59:59.999999"]
