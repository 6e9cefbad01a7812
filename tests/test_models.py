"""Dependency paths, battery charge, temperature models and embeddings against plain versions."""

import math
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import battery, graphs

US = 1_000_000


def first_path(edges, candidate, focus, depth, visited):
    """Breadth-first search with sorted inputs."""
    inputs = {}
    for a, b in sorted(set(edges)):
        inputs.setdefault(a, []).append(b)
    seen, queue = {candidate}, deque([[candidate]])
    while queue:
        path = queue.popleft()
        if len(path) - 1 >= depth:
            continue
        for b in inputs.get(path[-1], ()):
            if b == focus:
                return [*path, b]
            if len(seen) < visited and b not in seen:
                seen.add(b)
                queue.append([*path, b])
    return None


@pytest.mark.parametrize(("depth", "visited"), [(10, 5000), (2, 5000), (5, 9)])
def test_dependency_paths(spark, depth, visited):
    rng = np.random.default_rng(depth + visited)
    edges = [(f"d{a}", f"d{b}") for a, b in rng.integers(0, 40, (90, 2))] + [("d1", "d1"), (" d2 ", "d39 "), ("d3", ""), (None, "d3"), ("d3", None)]
    pairs = [(f"d{a}", f"d{b}") for a in range(0, 40, 2) for b in (5, 17, 39)] + [("d5", "d5"), ("", "d5"), (None, "d5"), ("none", "d5"), (" d2", "d39")]
    got = {(r["candidate"], r["focus"]): r["path"] for r in graphs.dependency_paths(spark.createDataFrame(edges, "node string, input string"), spark.createDataFrame(pairs, "candidate string, focus string"), depth, visited).collect()}
    clean = [(a.strip(), b.strip()) for a, b in edges if a and b and b.strip()]
    want = {(a, b): first_path(clean, a, b, depth, visited) for a, b in {(a.strip(), b) for a, b in pairs if a and a.strip()} if a != b}
    assert got == {k: v for k, v in want.items() if v} and len(got) >= 5


def test_dependency_paths_of_a_long_chain_and_of_nothing(spark):
    chain = spark.createDataFrame([(f"d{i}", f"d{i + 1}") for i in range(20)], "node string, input string")
    pairs = spark.createDataFrame([("d0", "d9"), ("d0", "d10"), ("d0", "d11")], "candidate string, focus string")
    got = {r["focus"]: (r["depth"], r["short"]) for r in graphs.dependency_paths(chain, pairs).withColumn("short", graphs.shortened()).collect()}
    assert got == {"d9": (9, [*(f"d{i}" for i in range(7)), "d9"]), "d10": (10, [*(f"d{i}" for i in range(7)), "d10"])}
    assert graphs.dependency_paths(chain.limit(0), pairs).count() == graphs.dependency_paths(chain, pairs.limit(0)).count() == 0


def test_dependency_paths_to_few_focuses_do_not_follow_what_leads_elsewhere(spark):
    """200 candidates share 200 inputs, of which one leads to the focus: what is written does not grow with their product."""
    edges = [(f"c{i}", f"m{j}") for i in range(200) for j in range(200)] + [("m7", "x"), ("x", "f"), ("m3", "y"), ("y", "f")]
    pairs = [(f"c{i}", "f") for i in range(200)]
    written = []
    stored, graphs.stored = graphs.stored, lambda df: written.append(stored(df)) or written[-1]
    try:
        got = graphs.dependency_paths(spark.createDataFrame(edges, "node string, input string"), spark.createDataFrame(pairs, "candidate string, focus string"), 3).collect()
    finally:
        graphs.stored = stored
    assert {(r["candidate"], r["focus"], *r["path"]) for r in got} == {(c, f, c, "m3", "y", f) for c, f in pairs}
    assert sum(df.count() for df in written[1:]) < 2_000  # written[0] are the edges themselves


def fold(samples, m):
    """Row by row, as a battery's estimator goes."""
    out, by_node = {}, {}
    for node, us, i, q in samples:
        if us is not None and i is not None and math.isfinite(i):
            by_node.setdefault(node, []).append((us, i, q if q is not None and math.isfinite(q) else None))
    for node, rows in by_node.items():
        soc = cap = anchor = seg = before = last_q = rest = None
        pos = neg = 0
        sign, locked = (m.sign or 1), m.sign is not None
        for us, i, q in sorted(rows):
            if before is None:
                soc, cap, anchor, seg = battery.clamped(q or 0.0), m.capacity_ah, q, 0.0
            else:
                if not locked and q is not None and last_q is not None and abs(q - last_q) >= 1 and abs(i) >= 0.05:
                    pos, neg = (pos + 1, neg) if (q > last_q) == (i > 0) else (pos, neg + 1)
                    if pos >= 3 and pos >= neg + 2:
                        sign, locked = 1, True
                    elif neg >= 3 and neg >= pos + 2:
                        sign, locked = -1, True
                if us - before > m.max_gap_s * US:
                    if q is not None:
                        soc, anchor = battery.clamped(q), q
                    seg = 0.0
                else:
                    ah = sign * i * (us - before) / 3.6e9
                    seg += ah
                    soc = battery.clamped(soc + ah / cap * 100)
            rest = (us if rest is None else rest) if abs(i) <= m.rest_current else None
            if rest is not None and us - rest >= m.rest_minutes * 60 * US and q is not None:
                soc = battery.drawn(soc, q, m.anchor_step)
                if m.learn:
                    if anchor is None:
                        anchor, seg = q, 0.0
                    elif abs(q - anchor) >= m.learn.span:
                        cap, anchor, seg = battery.learned(cap, seg, q - anchor, m.learn), q, 0.0
            before, last_q = us, q
            out[node, us] = soc, cap
    return out


@pytest.mark.parametrize("model", [
    battery.Model(100.0),
    battery.Model(60.0, sign=None, rest_current=3.0, rest_minutes=5, learn=battery.Capacity(span=8.0, alpha=0.3, low_ah=20.0, high_ah=300.0)),
    battery.Model(40.0, sign=-1, rest_current=20.0, anchor_step=2.0, learn=battery.Capacity(span=3.0)),
    battery.Model(40.0, sign=None, rest_current=1.0, anchor_step=0.0),
], ids=["plain", "votes", "often", "no_draw"])
def test_state_of_charge_equals_a_plain_fold(spark, model):
    """Series of many chunks, without any gap, with gaps, and without reported charge."""
    rng = np.random.default_rng(8)
    rows = []
    for node, (n, gaps, missing) in {"steady": (900, 0, 0.0), "gaps": (500, 0.02, 0.3), "silent": (120, 0.05, 1.0), "one": (1, 0, 0.0), "late": (200, 0.01, 0.97)}.items():
        us = np.cumsum(np.where(rng.random(n) < gaps, 5000, rng.integers(20, 300, n))) * US
        current = np.where(rng.random(n) < 0.5, rng.normal(0, 2, n), 15 * np.sin(np.arange(n) / 40) + rng.normal(0, 1, n))
        q = np.clip(50 + 45 * np.sin(np.arange(n) / 60) + rng.normal(0, 1.5, n), -3, 104)
        rows += [(node, int(t), float(c), None if rng.random() < missing else float(x)) for t, c, x in zip(us, current, q, strict=True)]
    rows += [("steady", None, 1.0, 2.0), ("odd", 5, None, 3.0), ("odd", 7, math.nan, 3.0), ("odd", 9, 1.0, math.nan), ("odd", 11 * US, 2.0, 120.0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "node_id string, us long, current_a double, soc_pct double, chunk string")
    want = fold(rows, model)
    for chunk_s in (1800, 10**9):
        got = {(r["node_id"], r["us"]): (r["soc"], r["capacity_ah"]) for r in battery.state_of_charge(df, model, chunk_s).collect()}
        assert got.keys() == want.keys()
        for k in want:
            assert got[k] == pytest.approx(want[k], abs=1e-6), k
    assert battery.state_of_charge(df.limit(0), model).count() == 0


def test_steps_of_charge_compose():
    rng = np.random.default_rng(4)
    for _ in range(60):
        steps = [(float(rng.normal(0, 8)), math.nan if rng.random() < 0.2 else float(rng.uniform(-20, 120)), int(rng.random() < 0.03), bool(rng.random() < 0.5)) for _ in range(rng.integers(1, 30))]
        most = float(rng.choice([0.0, 0.5, 3.0]))
        xs, ys = battery.composed(steps, most)
        for start in rng.uniform(0, 100, 8):
            soc = start
            for rise, q, kind, resting in steps:
                soc = battery.clamped(soc + rise) if kind == battery.FOLLOWS else soc if math.isnan(q) else battery.clamped(q)
                soc = battery.drawn(soc, q, most) if resting and not math.isnan(q) else soc
            assert np.interp(start, xs, ys) == pytest.approx(soc, abs=1e-9)
        assert all(a <= b for a, b in zip(ys, ys[1:], strict=False))


@pytest.mark.parametrize(("degree", "slope"), [(1, False), (2, True), (3, True)])
def test_temperature_fit_is_least_squares(spark, degree, slope):
    from tidewell.operators import temperature

    rng = np.random.default_rng(degree)
    rows, want = [], {}
    for k in range(3):
        x, t = rng.normal(1000 + k, 5, 200), np.sort(rng.integers(1_700_000_000, 1_710_000_000, 200))
        y = 3 + 0.5 * (x - 1000) + 0.02 * (x - 1000) ** 2 + 1e-7 * (t - t[0]) + rng.normal(0, 0.1, 200)
        rows += [(f"s{k}", int(a), float(b), float(c)) for a, b, c in zip(t, x, y, strict=True)]
        basis = np.column_stack([*((x - x.mean()) ** p for p in range(degree + 1)), *([(t - t.mean()) / 86400] if slope else [])])
        beta = np.linalg.lstsq(basis, y, rcond=None)[0]
        want[f"s{k}"] = beta, 1 - ((y - basis @ beta) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    rows += [("few", i, float(i), 1.0) for i in range(9)] + [("flat", i, 5.0, float(i)) for i in range(50)]  # too few; no solution
    points = spark.createDataFrame(rows, "sensor_id string, t long, x double, y double")
    fits = temperature.fit(points, ["sensor_id"], degree, slope)
    r2 = {r["sensor_id"]: r["r2"] for r in temperature.explained(points, fits, ["sensor_id"], degree).collect()}
    got = {r["sensor_id"]: r for r in fits.collect()}
    assert got.keys() == want.keys()
    for k, (beta, explained) in want.items():
        assert got[k]["beta"] == pytest.approx(beta[: degree + 1].tolist(), rel=1e-6, abs=1e-8) and r2[k] == pytest.approx(explained)
        assert got[k]["slope"] == (pytest.approx(beta[-1], rel=1e-5) if slope else None)


def test_the_lag_of_the_temperature_is_found(spark):
    from tidewell.operators import temperature

    rng = np.random.default_rng(2)
    n, step = 400, 3600
    heat = 20 + 8 * np.sin(np.arange(n) / 24 * 2 * np.pi) + rng.normal(0, 1, n)
    late = np.concatenate((np.full(3, heat[0]), heat[:-3]))
    raw = [("late", i * step, float(5 + 0.4 * late[i] + rng.normal(0, 0.05))) for i in range(n)] + [("none", i * step, float(rng.normal())) for i in range(n)] + [("still", i * step, 7.0) for i in range(n)] + [("short", i * step, 1.0 * i) for i in range(12)] + [("late", 5, math.nan)]
    t = spark.createDataFrame([(i * step, float(v)) for i, v in enumerate(heat)], "t long, x double")
    points = temperature.align(spark.createDataFrame(raw, "sensor_id string, t long, y double"), t, [k * step for k in range(7)])
    scores = temperature.lag_scores(points, 1)
    got = {r["sensor_id"]: r for r in temperature.choose_lag(scores).collect()}
    assert got["late"]["lag"] == 3 * step and got["late"]["reduction_pct"] > 90 and got["none"]["lag"] == 0
    assert got["still"]["lag"] == 0 and got["still"]["reduction_pct"] is None and "short" not in got
    assert temperature.choose_lag(temperature.lag_scores(points.limit(0))).count() == 0
    formula = temperature.expression("y", "x", 20.0, [1.0, 0.5, 0.25], 3.0)
    got = spark.createDataFrame([(10.0, 22.0), (10.0, 40.0), (10.0, 10.0)], "y double, x double").select(F.expr(formula).alias("v")).collect()
    assert [r["v"] for r in got] == [8.0, 7.0, 7.0]


def robust_z(x, clip=6.0):
    m = np.median(x)
    mad, iqr = np.median(np.abs(x - m)), np.quantile(x, 0.75) - np.quantile(x, 0.25)
    return np.abs(np.clip((x - m) / (mad * 1.4826 if mad > 1e-9 else iqr / 1.349 if iqr > 1e-9 else 1.0), -clip, clip))


def embedding(points, windows):
    """The three vectors of one series, by NumPy."""
    points = sorted((t, v) for t, v in points if v is not None and math.isfinite(v))
    t, v = np.array([p[0] for p in points]), np.array([p[1] for p in points])
    values, changes, events = [], [], []
    for w in [*windows, 1 << 62]:
        inside = t >= t[-1] - w
        a, b = v[inside], np.diff(v[inside]) / np.maximum(1, np.diff(t[inside]))
        for x, out in ((a, values), (b, changes)):
            if len(x) < 3:
                out += [0.0] * 10
                events += [0.0] * 4
                continue
            q, z = (lambda p, x=x: np.quantile(x, p)), robust_z(x)
            out += [np.median(x), np.median(np.abs(x - np.median(x))), q(0.05), q(0.5), q(0.95), q(0.75) - q(0.25), x.mean(), x.std(), z.mean(), np.quantile(z, 0.95)]
            events += [(z >= 2.5).mean(), (z >= 4).mean(), z.max(), np.quantile(z, 0.95)]
    vectors = [np.resize(np.array([*x, *np.zeros(n)]), n) for x, n in ((values[:-10], 128), (changes[:-10], 128), (events, 64))]
    return [x / (np.linalg.norm(x) or 1.0) for x in vectors]


def test_embeddings_equal_numpy(spark):
    from tidewell.operators import similarity

    rng = np.random.default_rng(6)
    series = {
        "noise": [(int(t), float(x)) for t, x in zip(np.cumsum(rng.integers(60, 9000, 400)), rng.standard_t(2, 400), strict=True)],
        "steps": [(60 * i, float(i // 50 * 10)) for i in range(300)],
        "still": [(i * 100_000, 4.0) for i in range(50)],
        "short": [(0, 1.0), (400, 5.0), (800, 2.0)],
        "two": [(0, 1.0), (60, 2.0), (120, None), (180, math.nan)],
    }
    df = spark.createDataFrame([(k, t, x) for k, p in series.items() for t, x in p], "sensor_id string, bucket long, agg_value double")
    got = {r["sensor_id"]: r for r in similarity.embed(df).collect()}
    assert got.keys() == series.keys() - {"two"}
    for k, r in got.items():
        for name, want in zip(("value", "delta", "event"), embedding(series[k], similarity.WINDOWS), strict=True):
            assert r[name] == pytest.approx(want.tolist(), abs=1e-9), (k, name)
    short = similarity.embed(df, windows=(3600,), sizes=(4, 20, 8)).where("sensor_id = 'noise'").first()
    assert [len(short[c]) for c in ("value", "delta", "event")] == [4, 20, 8]
    assert similarity.embed(df.limit(0)).count() == 0
