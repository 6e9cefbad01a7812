"""Greedy selection with a minimum distance against the plain loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import events, selection


def loop(rows, window):
    """(key, at, rank): from the best down."""
    taken, kept = {}, []
    for key, at, rank in sorted(rows, key=lambda r: (r[2], r[1])):
        near = taken.setdefault(key, set())
        if not any(at + d in near for d in range(-window, window + 1)):
            near.add(at)
            kept.append((key, at, rank))
    return sorted(kept)


def chosen(spark, rows, window, **options):
    df = spark.createDataFrame([(k, int(a), float(r)) for k, a, r in rows], "k string, at long, rank double").repartition(5)
    return sorted((r["k"], r["at"], r["rank"]) for r in selection.greedy(df, ["k"], "at", window, [F.col("rank")], **options).collect())


def test_one_run_of_many_close_events(spark):
    rng = np.random.default_rng(3)
    rows = [("a", i, float(x)) for i, x in enumerate(rng.permutation(100_000))]
    assert chosen(spark, rows, 3) == loop(rows, 3)


@pytest.mark.parametrize(("margin", "chunk"), [(1, 2), (2, 5), (16, 1024)])
def test_chunks_and_margins_make_no_difference(spark, margin, chunk):
    rng = np.random.default_rng(margin)
    rows = [(k, int(a), float(r)) for k in "xy" for a, r in zip(np.unique(rng.integers(-500, 900, 400)), rng.integers(0, 9, 400), strict=False)]  # ties
    rows += [("up", i, float(-i)) for i in range(60)] + [("down", i, float(i)) for i in range(60)] + [("same", 5, 1.0), ("far", 10**12, 1.0), ("far", -(10**12), 2.0)]
    assert chosen(spark, rows, 7, margin=margin, chunk=chunk) == loop(rows, 7)


def test_window_of_nothing_nulls_and_empty(spark):
    rows = [("a", i, float(i % 3)) for i in range(50)]
    assert chosen(spark, rows, 0) == sorted(rows) and chosen(spark, [], 5) == []
    df = spark.createDataFrame([("a", None, 1.0, [1]), (None, 3, 1.0, None), (None, 4, 0.0, [2])], "k string, at long, rank double, _at array<int>")
    got = selection.greedy(df, ["k"], "at", 2, [F.col("rank")]).collect()
    assert [(r["at"], r["_at"]) for r in got] == [(4, [2])]


def test_suppression_and_buckets(spark):
    e = spark.createDataFrame([("s", 0, 1.0, 3.0), ("s", 100, 1.0, -5.0), ("s", 200, 1.0, 5.0), ("s", 900, 1.0, 1.0), ("t", 100, 1.0, 1.0)], "sensor_id string, bucket long, value double, z double")
    assert sorted((r["sensor_id"], r["bucket"]) for r in events.suppress(e, 100).collect()) == [("s", 100), ("s", 900), ("t", 100)]
    g = spark.createDataFrame([(0, 3, 1.0, 0.0), (60, 2, 1.0, 0.0), (120, 2, 1.0, 2.0), (500, 2, 0.5, 0.0)], "bucket long, group_size long, score double, strength double")
    assert sorted(r["bucket"] for r in events.select_buckets(g, 60).collect()) == [0, 120, 500]
    assert sorted(r["bucket"] for r in events.select_buckets(g, 60, most=1).collect()) == [120]
    assert sorted(r["bucket"] for r in events.select_buckets(g, 200, focus="strength").collect()) == [120, 500]
