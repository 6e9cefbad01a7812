"""The vector index against brute force, and the plan of its filters."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import vectors

SCHEMA = "id string, value array<double>, delta array<double>, node string, unit_ string, type string, interval_seconds int, is_derived boolean, is_public boolean"


@pytest.fixture(scope="module")
def clustered(spark):
    """Forty tight groups, ties, and rows without a usable vector."""
    rng = np.random.default_rng(1)
    mid = rng.normal(size=(40, 12))
    rows = []
    for k in range(1200):
        v = mid[k % 40] + 0.05 * rng.normal(size=12)
        rows.append((f"s{k:04}", v.tolist(), v[:5].tolist(), f"n{k % 3}", "W" if k % 2 else None, f"t{k % 5}", 60 if k % 4 else 300, bool(k % 7 == 0), None))
    rows[41] = ("s0041", [2 * x for x in rows[1][1]], *rows[41][2:])  # the same direction
    odd = [None, [], [0.0] * 12, [math.nan] * 12, [1.0, None] + [0.0] * 10, [1.0] * 3]
    rows += [(f"odd{k}", v, None, "n0", "W", "t0", 60, False, None) for k, v in enumerate(odd)] + [(None, rows[0][1], None, "n0", "W", "t0", 60, False, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df, {r[0]: r for r in rows if r[0] and not r[0].startswith("odd")}


def brute(rows, q, k, space=1, keep=lambda r: True, exclude=()):
    x = np.array(rows[q][space])
    x = x / np.linalg.norm(x)
    found = []
    for key, r in rows.items():
        if r[space] is not None and key not in exclude and keep(r):
            y = np.array(r[space])
            found.append((-round(float(x @ y / np.linalg.norm(y)), 12), key))
    return [key for _, key in sorted(found)[:k]]


@pytest.mark.parametrize(("cells", "block"), [(40, 4096), (3, 50), (None, 7)])
def test_search_equals_brute_force(spark, clustered, cells, block):
    df, rows = clustered
    index = vectors.build(df, {"value": "value"}, ["node", "type", "interval_seconds"], cells=cells, block=block)
    queries = df.where("id like 's00_5'").select(F.col("id").alias("query_id"), F.lit("value").alias("space"), F.col("value").alias("vector"), F.array("id").alias("exclude"))
    found = vectors.search(index, queries, 6)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got == {q: brute(rows, q, 6, exclude=(q,)) for q in got} and len(got) == 10
    if cells == 40:
        assert found.visited < 0.2  # the bounds of the cells end the search
    assert vectors.search(index, queries.limit(0), 6).count() == 0


def test_search_with_filters(spark, clustered):
    df, rows = clustered
    index = vectors.build(df, {"value": "value", "delta": "delta"}, ["node", "unit_", "type", "interval_seconds"], cells=10)
    queries = df.where("id in ('s0003', 's0004', 's0041')").select(F.col("id").alias("query_id"), F.explode(F.array(F.lit("value"), F.lit("delta"))).alias("space"), "value", "delta", "node", "unit_")
    queries = queries.select("query_id", "space", F.when(F.col("space") == "value", F.col("value")).otherwise(F.col("delta")).alias("vector"), F.array(F.lit("s0001")).alias("exclude"), "node", "unit_")
    got = {}
    for r in vectors.search(index, queries, 200, F.col("interval_seconds") == 60, ("node", "unit_")).orderBy("rank").collect():
        got.setdefault((r["query_id"], r["space"]), []).append(r["id"])
    for (q, space), ids in got.items():
        want = brute(rows, q, 200, {"value": 1, "delta": 2}[space], lambda r, q=q: r[6] == 60 and r[3] == rows[q][3] and rows[q][4] in (None, r[4]), ("s0001",))
        assert ids == want, (q, space)
    assert len(got) == 6
    # The same index, read again; a space without any vector finds nothing.
    odd = queries.where("space = 'value'").withColumn("space", F.lit("other"))
    assert vectors.search(index, odd, 3).count() == 0
    assert vectors.search(index, queries.withColumn("vector", F.array(F.lit(1.0))), 3).count() == 0


def test_an_index_of_nothing(spark, clustered):
    df, _ = clustered
    index = vectors.build(df.limit(0), {"value": "value"}, ["node"])
    queries = df.limit(3).select(F.col("id").alias("query_id"), F.lit("value").alias("space"), F.col("value").alias("vector"))
    assert vectors.search(index, queries, 3).count() == 0


def test_filters_are_given_up_in_order():
    f = vectors.Filters(True, True, True, 60, True, False)
    plan = vectors.widen_plan(f)
    assert len(plan) == 7 and plan[0] == f and plan[-1] == vectors.Filters()
    assert [p.same_node for p in plan] == [True] + [False] * 6 and [p.is_public for p in plan] == [False] * 4 + [None] * 3 and plan[-2].same_unit and not plan[-2].same_type
    assert vectors.widen_plan(vectors.Filters(same_unit=True)) == [vectors.Filters(same_unit=True), vectors.Filters()]
    assert vectors.widen_plan(vectors.Filters()) == [vectors.Filters()] * 2


def test_candidates_stop_where_the_pool_is_large_enough(spark, clustered):
    df, rows = clustered
    index = vectors.build(df, {"value": "value", "delta": "delta"}, ["node", "unit_", "type", "interval_seconds", "is_derived", "is_public"], cells=20)
    focus = df.where("id in ('s0001', 's0010')")
    wide = vectors.candidates(index, focus, vectors.Filters(same_type=True, exclude=("s0041",)), 12).collect()
    assert {r["stage"] for r in wide} == {0} and all(rows[r["candidate"]][5] == rows[r["focus"]][5] and r["candidate"] not in (r["focus"], "s0041") for r in wide) and len(wide) == 24
    narrow = vectors.candidates(index, focus, vectors.Filters(is_public=True, same_unit=True), 12).collect()  # no row is public, so the filter goes
    assert {r["stage"] for r in narrow} == {1} and all(r["candidate"].startswith("s") for r in narrow) and len(narrow) == 24
    assert sorted((r["focus"], r["rank"]) for r in narrow) == [(f, k) for f in ("s0001", "s0010") for k in range(1, 13)]
    assert vectors.candidates(index, focus.limit(0), vectors.Filters(), 12).count() == 0


@pytest.mark.parametrize("most", [8192, 90, 5])
def test_search_in_a_class_needs_no_cells(spark, clustered, monkeypatch, most):
    """Classes of node and type have 80 rows; a query's null asks for nothing, so that query goes by cells."""
    monkeypatch.setattr(vectors, "_CLASS", most)
    df, rows = clustered
    index = vectors.build(df, {"value": "value"}, ["node", "type"], cells=12)
    queries = df.where("id like 's0%'").select(F.col("id").alias("query_id"), F.lit("value").alias("space"), F.col("value").alias("vector"), F.array("id").alias("exclude"), "node", F.expr("if(id = 's0077', null, type)").alias("type"))
    found = vectors.search(index, queries, 100, None, ("node", "type"))
    got = {}
    for r in found.where("query_id like '%7' and query_id < 's0200'").orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert len(got) == 20
    for q, ids in got.items():
        assert ids == brute(rows, q, 100, keep=lambda r, q=q: r[3] == rows[q][3] and (q == "s0077" or r[5] == rows[q][5]), exclude=(q,))
    assert (found.visited < 0.01) == (most > 80)
