"""Motifs and anomalies, top lags, durations, cooldown, pages, horizon of deseasoning."""

import numpy as np
import pytest

from tidewell.operators import events, rules
from tidewell.operators import windows as W
from tidewell.sources import pages


def test_motifs_and_anomalies(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=160)
    v[100:116] = v[20:36] + 1e-3 * rng.normal(size=16)  # the motif
    rows = [("s", 60 * i, float(x)) for i, x in enumerate(v)] + [("short", 60 * i, 1.0 * i) for i in range(9)]
    b = spark.createDataFrame(rows, "sensor_id string, bucket long, agg_value double")
    profile = events.matrix_profile(b, window=16)
    got = events.profile_extremes(profile, b, 16, 60, most=3).collect()
    assert sorted((r["kind"], r["place"]) for r in got) == [(k, p) for k in ("anomaly", "motif") for p in (1, 2, 3)]
    best = next(r for r in got if r["kind"] == "motif" and r["place"] == 1)
    assert {best["start"], best["match_start"]} == {20 * 60, 100 * 60} and best["end"] == best["start"] + 16 * 60 and best["match_end"] == best["match_start"] + 16 * 60
    d = {r["bucket"]: r["distance"] for r in profile.collect() if r["sensor_id"] == "s"}
    assert next(r for r in got if r["kind"] == "anomaly" and r["place"] == 1)["distance"] == pytest.approx(max(d.values()))
    assert events.profile_extremes(profile.limit(0), b, 16, 60).count() == 0


def test_top_lags(spark):
    rows = [("a", 60, 5, 0.5), ("a", -60, 5, 0.5), ("a", 0, 9, 0.9), ("a", 120, 9, 0.1), ("a", 60, 4, 0.4), ("b", 60, 1, 0.2)]
    got = sorted((r["candidate"], r["place"], r["lag"]) for r in events.top_lags(spark.createDataFrame(rows, "candidate string, lag int, pairs long, score double")).collect())
    assert got == [("a", 1, 0), ("a", 2, -60), ("a", 3, 60), ("b", 1, 60)]


def test_durations_and_cooldown(spark):
    f = spark.createDataFrame([("s", 0, 100), ("s", 200, 500), ("s", 900, None), ("t", 5, 5)], "sensor_id string, start long, end long")
    got = {r["sensor_id"]: r[1:] for r in rules.durations(f, 1000).collect()}
    assert got == {"s": (3, 1, 500, pytest.approx(500 / 3), 100, 300, 100.0, pytest.approx(280.0)), "t": (1, 0, 0, 0.0, 0, 0, 0.0, 0.0)}
    alarms = [("n", t) for t in (0, 100, 299, 300, 550, 599, 600, 2000)] + [("m", 10)]
    got = sorted((r["k"], r["t"]) for r in rules.with_cooldown(spark.createDataFrame(alarms, "k string, t long"), ["k"], "t", 300).collect())
    assert got == [("m", 10), ("n", 0), ("n", 300), ("n", 600), ("n", 2000)]


def test_pages_of_whole_buckets(spark):
    assert pages.page_window(0, 3600, 60, 2) == pages.Page(0, 3600, None)
    first = pages.page_window(30, 100_000, 60, 5, most=500)  # 100 buckets a page
    assert first == pages.Page(30, 6000, 6000) and pages.page_window(30, 100_000, 60, 5, first.cursor, 500) == pages.Page(6000, 12_000, 12_000)
    assert pages.page_window(0, 100_000, 60, 1000, most=500).end == 25 * 60  # never under 25 buckets
    for cursor in (-1, 100_000):
        with pytest.raises(ValueError, match="cursor"):
            pages.page_window(0, 100_000, 60, 1, cursor)
    rows = [(s, t) for s in "ab" for t in range(0, 12_001, 60)]
    df = spark.createDataFrame(rows, "sensor_id string, bucket long")
    seen, cursor, n = [], None, 0
    numbered = {(r["sensor_id"], r["bucket"]): r["page"] for r in pages.pages(df, 0, 12_000, 60, 2, 100).collect()}
    while True:
        w = pages.page_window(0, 12_000, 60, 2, cursor, 100)
        part = [(r["sensor_id"], r["bucket"]) for r in pages.page(df, w).collect()]
        assert part == sorted(part) and {numbered[x] for x in part} == {n} and len(part) <= 102
        seen, cursor, n = seen + part, w.cursor, n + 1
        if cursor is None:
            break
    assert sorted(seen) == sorted(rows) and n == 4


def test_hours_are_not_compared_within_two_days(spark):
    b = spark.createDataFrame([("s", 3600 * i, float(i)) for i in range(30)], "sensor_id string, bucket long, agg_value double")
    got = [r["residual"] for r in W.hour_residual(b, horizon=86_400).orderBy("bucket").collect()]
    assert got == [float(i) for i in range(30)]
    assert sum(r["residual"] == 0 for r in W.hour_residual(b, horizon=2 * 86_400).collect()) == 18
