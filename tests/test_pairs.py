"""Sums over pairs in blocks against plain joins."""

import numpy as np
import pytest

from tidewell.operators.pairs import pair_sums


@pytest.mark.parametrize(("block", "buckets"), [(128, 4096), (3, 7), (1, 1000)])
def test_pair_sums(spark, block, buckets):
    rng = np.random.default_rng(block)
    values = {(f"s{k}", int(t) * 60): float(rng.integers(-9, 9)) for k in range(9) for t in np.unique(rng.integers(-40, 60, 50))}
    values |= {("alone", 10**9): 1.0}
    rows = [(s, t, v, 0) for (s, t), v in values.items()] + [("s0", 600_000, None, 0), ("s1", 600_000, float("nan"), 0), (None, 0, 1.0, 0), ("s2", None, 1.0, 0)]
    lags = [-12, -1, 0, 2, 9]
    got = {(r["a"], r["b"], r["lag"]): r[3:] for r in pair_sums(spark.createDataFrame(rows, "sensor_id string, bucket long, v double, n int"), "v", lags, 60, block, buckets).collect()}
    want = {}
    for (a, t), x in values.items():
        for lag in lags:
            for b in {s for s, _ in values if s > a}:
                y = values.get((b, t + lag * 60))
                if y is not None:
                    w = want.setdefault((a, b, lag), np.zeros(6))
                    w += [1, x, y, x * x, y * y, x * y]
    assert got.keys() == want.keys() and len(got) > 100
    for k in want:
        assert list(got[k]) == want[k].tolist(), k


def test_pair_sums_of_nothing(spark):
    assert pair_sums(spark.createDataFrame([], "sensor_id string, bucket long, v double"), "v").count() == 0
    assert pair_sums(spark.createDataFrame([("a", 0, 1.0)], "sensor_id string, bucket long, v double"), "v").count() == 0
