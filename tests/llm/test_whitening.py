"""Whitening against NumPy, with odd rows."""

import math

import numpy as np
import pytest

from tidewell.llm import whitening
from tidewell.llm.registry import op11_whitening

SCHEMA = "vec_id long, embedding array<double>, x string, n long, row string"


def rows_of(vectors):
    return [(k, None if v is None else [None if c is None else float(c) for c in v], "x", 1, "r") for k, v in vectors]


def brute(vectors, k=8):
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    off = n * x - s
    centred = (off / n).astype(float)
    e, u = np.linalg.eigh(centred.T @ centred / n)
    return n, (off * off).sum(axis=1).tolist(), centred, e[::-1][:k], u.T[::-1][:k]


def check(got, ids, vectors):
    n, deviation, centred, e, u = brute(vectors)
    total = sum(deviation) / n**3
    by = {}
    for r in got:
        by.setdefault(r["component"], {})[r["vec_id"]] = r
    assert sorted(by) == list(range(1, 1 + len(by)))
    for c, rows in by.items():
        want = centred @ u[c - 1] / np.sqrt(e[c - 1])
        have = np.array([rows[i]["whitened"] for i in ids])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-6
        assert [rows[i]["deviation"] for i in ids] == deviation and all(r["n"] == n for r in rows.values())
        assert all(r["explained"] == pytest.approx(e[c - 1] / total, rel=1e-9) and r["identity_error"] < 1e-9 for r in rows.values())
    return by


def test_query_equals_numpy(spark, sf_dir):
    table = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    good = [(k, v) for k, v in table if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    by = check(op11_whitening(spark, sf_dir).collect(), [k for k, _ in good], [v for _, v in good])
    assert len(by) == 8 and len(good) > 100


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(50, 5)) * [100, 10, 1, 1, 0.5]).tolist()
    odd = [(100, None), (101, [1, 2, None, 4, 5]), (102, [1, 2, math.nan, 4, 5]), (103, [1, 2, -math.inf, 4, 5]), (104, []), (105, [1.0, 2.0]), (106, [1e300] * 5)]
    got = whitening.whiten(spark.createDataFrame(rows_of([*enumerate(v), *odd]), SCHEMA)).collect()
    assert len(check(got, range(50), v)) == 5 and len(got) == 250
    # A repeated row and a null id count as other rows.
    got = whitening.whiten(spark.createDataFrame(rows_of([*enumerate(v), (0, v[0]), (None, v[1])]), SCHEMA)).collect()
    assert len(got) == 260 and {r["n"] for r in got} == {52} and sum(r["vec_id"] is None for r in got) == 5


def test_dimensions_without_variance_are_left_out(spark):
    v = [[i % 7, 5.0, 2.0 * (i % 7), i % 3] for i in range(60)]  # two dimensions of four
    got = whitening.whiten(spark.createDataFrame(rows_of(enumerate(v)), SCHEMA)).collect()
    assert {r["component"] for r in got} == {1, 2} and all(r["identity_error"] < 1e-9 for r in got)
    assert sum({r["component"]: r["explained"] for r in got}.values()) == pytest.approx(1)
    for same in ([(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [], [(1, [])], [(1, None)]):
        df = whitening.whiten(spark.createDataFrame(rows_of(same), SCHEMA))
        assert df.count() == 0 and df.columns[:3] == ["vec_id", "component", "n"]


def test_far_off_means_and_wide_ranges(spark):
    rng = np.random.default_rng(5)
    v = (1e9 + rng.normal(size=(200, 3)) * [50.0, 0.5, 0.01]).tolist()  # the mean is large beside the spread
    check(whitening.whiten(spark.createDataFrame(rows_of(enumerate(v)), SCHEMA)).collect(), range(200), v)
    big = [[float(c) for c in row] for row in rng.integers(-(1 << 49), 1 << 49, (40, 2))]
    got = whitening.whiten(spark.createDataFrame(rows_of(enumerate(big)), SCHEMA)).collect()
    _, deviation, *_ = brute(big)
    assert all(r["deviation"] is None and int(r["exact"]) == deviation[r["vec_id"]] for r in got) and len(got) == 80
