"""State of charge of batteries: coulomb counting that takes over the reported charge at rest.

The estimate is a fold, but no task folds a whole series:

1. Which way the current counts follows from votes, whose running sums are taken in chunks of time; a battery's
   direction is settled at the first row where they suffice. Rest begins at the first row of a run of low currents.
2. Capacity. A chunk is reduced to the rows at which an anchor from before it could end: of the reported
   charges at rest those that are higher or lower than all before, since the first of them that is far enough from the
   anchor ends it, whatever the anchor is. What happens after such a row depends on that row alone. One row a
   chunk then goes through a fold.
3. Charge. With the capacities known, each step raises or lowers, clamps, or draws toward a reported charge:
   rising, piecewise linear functions. A chunk's steps are composed to one such function of
   the charge that it begins with; one row a chunk is folded, and then every chunk runs from its own start.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.storage import stored
from tidewell.operators.windows import previous

US = 1_000_000
FOLLOWS, RESETS, BEGINS = 0, 1, 2


@dataclass(frozen=True)
class Capacity:
    """How the capacity is learned: from at least ``span`` percent between anchors, with weight ``alpha``, within bounds."""

    span: float = 20.0
    alpha: float = 0.1
    low_ah: float = 1.0
    high_ah: float = 10_000.0


@dataclass(frozen=True)
class Model:
    capacity_ah: float
    max_gap_s: int = 900
    anchor_step: float = 0.5
    rest_current: float = 2.0
    rest_minutes: int = 0
    sign: int | None = 1  # None: by votes
    learn: Capacity | None = None


# ---- one step -----------------------------------------------------------------------------


def clamped(x: float) -> float:
    return min(max(x, 0.0), 100.0) if math.isfinite(x) else 0.0


def drawn(soc: float, reported: float, most: float) -> float:
    """A tenth of the way to the reported charge, at most ``most``."""
    return clamped(soc + min(max((reported - soc) * 0.1, -most), most)) if most > 1e-12 else soc


def learned(capacity: float, ah: float, change: float, by: Capacity) -> float:
    """The capacity after ``ah`` were counted between anchors ``change`` percent apart."""
    implied = min(max(abs(ah) / (abs(change) / 100), by.low_ah), by.high_ah)
    return (1 - by.alpha) * capacity + by.alpha * implied


# ---- rows ---------------------------------------------------------------------------------


def _running(df: DataFrame, keys: list[str], order: str, chunk: str, sums: dict[str, str], last: dict[str, str]) -> DataFrame:
    """``df`` with running sums, and with the last value so far that is not null, across chunks."""
    inside = Window.partitionBy(*keys, chunk).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    ends = df.groupBy(*keys, chunk).agg(*(F.sum(c).alias(f"_s_{n}") for n, c in sums.items()), *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_l_{n}") for n, c in last.items()))
    carried = ends.select(*keys, chunk, *(F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in sums), *(F.last(f"_l_{n}", ignorenulls=True).over(before).alias(f"_l_{n}") for n in last))
    out = df.select("*", *(F.sum(c).over(inside).alias(f"_i_{n}") for n, c in sums.items()), *(F.last(c, ignorenulls=True).over(inside).alias(f"_j_{n}") for n, c in last.items()))
    out = out.join(carried, [*keys, chunk])
    return out.select(*df.columns, *((F.col(f"_i_{n}") + F.col(f"_s_{n}")).alias(n) for n in sums), *(F.coalesce(f"_j_{n}", f"_l_{n}").alias(n) for n in last))


def prepared(samples: DataFrame, model: Model, chunk_us: int) -> DataFrame:
    """node_id, chunk, us, reported (null: none), ah (counted since the row before), kind, resting."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c).cast("double"))
    whole = samples.select("node_id", F.col("us").cast("long").alias("us"), finite("current_a").alias("i"), finite("soc_pct").alias("reported")).where("us is not null and i is not null")
    whole = whole.groupBy("node_id", "us").agg(F.max(F.struct("i", "reported")).alias("v")).select("node_id", "us", "v.i", "v.reported")
    steps = previous(whole, ["node_id"], "us", ["us", "i", "reported"], chunk_us)
    change = F.col("reported") - F.col("prev_reported")
    votes = (F.abs(change) >= 1) & (F.abs("i") >= 0.05)
    agrees = F.coalesce(votes & ((change > 0) == (F.col("i") > 0)), F.lit(False)).cast("int")
    differs = F.coalesce(votes & ((change > 0) != (F.col("i") > 0)), F.lit(False)).cast("int")
    low = F.abs("i") <= max(model.rest_current, 0.0)
    starts = F.when(low & F.coalesce(F.abs("prev_i") > max(model.rest_current, 0.0), F.lit(True)), F.col("us"))
    rows = steps.select("*", F.floor(F.col("us") / chunk_us).alias("chunk"), agrees.alias("a"), differs.alias("d"), low.alias("low"), starts.alias("starts"))
    rows = _running(rows, ["node_id"], "us", "chunk", {"pos": "a", "neg": "d"}, {"rest_from": "starts"})
    sign = F.lit(model.sign)
    if model.sign is None:  # the first row at which three votes are two ahead
        settles = F.when((F.col("pos") >= 3) & (F.col("pos") >= F.col("neg") + 2), 1).when((F.col("neg") >= 3) & (F.col("neg") >= F.col("pos") + 2), -1)
        rows = stored(rows)
        lock = rows.withColumn("settles", settles).where("settles is not null").groupBy("node_id").agg(F.min_by("settles", "us").alias("settled"), F.min("us").alias("since"))
        rows = rows.join(lock, "node_id", "left")
        sign = F.when(F.col("us") >= F.col("since"), F.col("settled")).otherwise(1)
    kind = F.when(F.col("prev_us").isNull(), BEGINS).when(F.col("us") - F.col("prev_us") > model.max_gap_s * US, RESETS).otherwise(FOLLOWS)
    ah = F.when(kind == FOLLOWS, sign * F.col("i") * (F.col("us") - F.col("prev_us")) / 3.6e9).otherwise(0.0)
    resting = F.col("low") & (F.col("us") - F.col("rest_from") >= model.rest_minutes * 60 * US)
    return rows.select("node_id", "chunk", "us", "reported", ah.alias("ah"), kind.alias("kind"), resting.alias("resting"))


# ---- capacity -----------------------------------------------------------------------------

_PATHS = "node_id string, chunk long, anchors array<double>, ah array<double>, open array<boolean>, always array<boolean>, at array<long>, later_us array<array<long>>, later_ah array<array<double>>, later_change array<array<double>>, end_anchor array<double>, end_ah array<double>, rest_ah double, rest_open boolean"
_CAPACITIES = "node_id string, chunk long, capacity double, change_us array<long>, change_to array<double>"


def _chunk_paths(rows: pd.DataFrame, span: float) -> pd.DataFrame:
    """The rows of a chunk at which an anchor from before it may end, and what follows each of them."""
    rows = rows.sort_values("us", ignore_index=True)
    us, reported, ah, kind, resting = (rows[c].to_numpy() for c in ("us", "reported", "ah", "kind", "resting"))
    known = ~np.isnan(reported)
    sets = (kind == BEGINS) | ((kind == RESETS) & known)  # the anchor is new, whatever it was
    count = np.cumsum(ah)
    restart = np.flatnonzero(kind > FOLLOWS)  # where the count begins again
    base = np.zeros(len(us))
    for k in restart:
        base[k:] = count[k]
    at_rest = np.flatnonzero(resting & known)

    memo: dict[int, tuple[int, bool]] = {}

    def after(k: int) -> tuple[int, bool]:
        """(the next row that ends the anchor set at row k, or the end; does it teach a capacity)."""
        if k not in memo:
            anchor, found = (reported[k] if known[k] else None), (len(us), False)
            for j in range(k + 1, len(us)):
                if sets[j]:
                    found = j, False
                    break
                if resting[j] and known[j] and (anchor is None or abs(reported[j] - anchor) >= span):
                    found = j, anchor is not None
                    break
            memo[k] = found
        return memo[k]

    def since(k: int, j: int) -> float:
        """Counted from row k, whose own count is not included, to row j."""
        anew = np.searchsorted(restart, j, "right") > np.searchsorted(restart, k, "right")
        return count[j] - (base[j] if anew else count[k])

    def path(k: int) -> tuple[list[int], list[float], list[float], float, float]:
        times, counted, changes = [], [], []
        while True:
            j, teaches = after(k)
            if j >= len(us):
                return times, counted, changes, float(reported[k]), float(since(k, len(us) - 1))
            if teaches:
                times.append(int(us[j]))
                counted.append(float(since(k, j)))
                changes.append(float(reported[j] - reported[k]))
            k = j

    records: list[int] = []
    low, high = np.inf, -np.inf
    first_set = int(np.flatnonzero(sets)[0]) if sets.any() else len(us)
    for k in at_rest[at_rest < first_set]:
        if reported[k] < low or reported[k] > high:
            records.append(int(k))
            low, high = min(low, reported[k]), max(high, reported[k])
    chosen = [*records, *([first_set] if first_set < len(us) else [])]
    paths = [path(k) for k in chosen]
    first_restart = int(restart[0]) if len(restart) else len(us)
    return pd.DataFrame({
        "node_id": [rows["node_id"].iloc[0]], "chunk": [rows["chunk"].iloc[0]], "anchors": [[float(reported[k]) for k in chosen]], "ah": [[float(count[k] - base[k]) for k in chosen]],
        "open": [[k < first_restart for k in chosen]], "always": [[bool(sets[k]) for k in chosen]], "at": [[int(us[k]) for k in chosen]],
        "later_us": [[p[0] for p in paths]], "later_ah": [[p[1] for p in paths]], "later_change": [[p[2] for p in paths]], "end_anchor": [[p[3] for p in paths]], "end_ah": [[p[4] for p in paths]],
        "rest_ah": [float(count[-1] - base[-1])], "rest_open": [first_restart >= len(us)],
    })


def _fold_capacities(chunks: pd.DataFrame, capacity: float, by: Capacity) -> pd.DataFrame:
    """The capacity that each chunk of one battery begins with, and its changes within."""
    out, anchor, ah, now = [], math.nan, 0.0, capacity
    for row in chunks.sort_values("chunk").itertuples(index=False):
        begins, times, values = now, [], []
        for k, new in enumerate(row.anchors):
            if row.always[k] or math.isnan(anchor) or abs(new - anchor) >= by.span:
                if not row.always[k] and not math.isnan(anchor):
                    now = learned(now, row.ah[k] + (ah if row.open[k] else 0.0), new - anchor, by)
                    times.append(row.at[k])
                    values.append(now)
                for us, counted, change in zip(row.later_us[k], row.later_ah[k], row.later_change[k], strict=True):
                    now = learned(now, counted, change, by)
                    times.append(us)
                    values.append(now)
                anchor, ah = row.end_anchor[k], row.end_ah[k]
                break
        else:
            ah = row.rest_ah + (ah if row.rest_open else 0.0)
        out.append((row.node_id, row.chunk, begins, times, values))
    return pd.DataFrame(out, columns=["node_id", "chunk", "capacity", "change_us", "change_to"])


# ---- charge -------------------------------------------------------------------------------


def composed(steps: list[tuple[float, float, int, bool]], most: float) -> tuple[list[float], list[float]]:
    """Knots (xs, ys) of the charge after ``steps`` as a function of the charge before, over 0 to 100.

    steps: (rise in percent, reported or nan, kind, resting).
    """
    xs, ys = [0.0, 100.0], [0.0, 100.0]

    def apply(bends: list[float], f) -> None:
        nonlocal xs, ys
        out_x, out_y = [xs[0]], [ys[0]]
        for k in range(1, len(xs)):
            for bend in bends:
                if ys[k - 1] < bend < ys[k]:
                    out_x.append(xs[k - 1] + (xs[k] - xs[k - 1]) * (bend - ys[k - 1]) / (ys[k] - ys[k - 1]))
                    out_y.append(bend)
            out_x.append(xs[k])
            out_y.append(ys[k])
        values = [f(y) for y in out_y]
        keep = [k for k in range(len(values)) if k in (0, len(values) - 1) or not values[k - 1] == values[k] == values[k + 1]]
        xs, ys = [out_x[k] for k in keep], [values[k] for k in keep]

    for rise, reported, kind, resting in steps:
        if kind != FOLLOWS:
            if kind == BEGINS or not math.isnan(reported):
                start = clamped(reported)
                xs, ys = [0.0, 100.0], [start, start]
        elif rise:
            apply([-rise] if rise < 0 else [100 - rise], lambda y, d=rise: clamped(y + d))
        if resting and not math.isnan(reported) and most > 1e-12:
            bends = [reported - 10 * most, reported + 10 * most]
            if not 0 <= reported <= 100:
                bends += [most, 100 - most, -reported / 9, (100 - 0.1 * reported) / 0.9]
            apply(sorted(bends), lambda y, r=reported: drawn(y, r, most))
    return xs, ys


def _steps(rows: pd.DataFrame, change_us: list[int], change_to: list[float], capacity: float) -> tuple[pd.DataFrame, list[float], list[float]]:
    """The rows in order, the capacity after each, and its rise in percent by the capacity before."""
    rows = rows.sort_values("us", ignore_index=True)
    changes, now, after, rises = dict(zip(change_us, change_to, strict=True)), capacity, [], []
    for us, ah in zip(rows["us"], rows["ah"], strict=True):
        rises.append(ah / now * 100)
        now = changes.get(us, now)
        after.append(now)
    return rows, after, rises


def state_of_charge(samples: DataFrame, model: Model, chunk_s: int = 86_400) -> DataFrame:
    """node_id, us, soc, capacity_ah of ``samples(node_id, us, current_a, soc_pct)``.

    A step of more than ``max_gap_s`` starts anew from the reported charge, or goes on where it was if there is none. At
    rest (a current of at most ``rest_current`` for ``rest_minutes``) a tenth of the difference to the reported charge is
    taken over, at most ``anchor_step``, and the capacity is learned. Rows without a current are left out; a battery
    without any reported charge begins empty. Of equal times of a battery the greatest current counts.
    """
    rows = stored(prepared(samples, model, chunk_s * US))
    most, by = model.anchor_step, model.learn
    if by is None:
        none = (F.lit(model.capacity_ah).cast("double").alias("capacity"), F.expr("cast(array() as array<long>)").alias("change_us"), F.expr("cast(array() as array<double>)").alias("change_to"))
        capacities = stored(rows.select("node_id", "chunk").distinct().select("node_id", "chunk", *none))
    else:
        paths = rows.groupBy("node_id", "chunk").applyInPandas(lambda r: _chunk_paths(r, by.span), _PATHS)
        capacities = stored(paths.groupBy("node_id").applyInPandas(lambda r: _fold_capacities(r, model.capacity_ah, by), _CAPACITIES))

    def function(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        known = right.iloc[0]
        own, _, rises = _steps(left, known["change_us"], known["change_to"], known["capacity"])
        xs, ys = composed(list(zip(rises, own["reported"], own["kind"], own["resting"], strict=True)), most)
        return pd.DataFrame({"node_id": [known["node_id"]], "chunk": [known["chunk"]], "xs": [xs], "ys": [ys]})

    def starts(chunks: pd.DataFrame) -> pd.DataFrame:
        chunks, now, out = chunks.sort_values("chunk", ignore_index=True), 0.0, []
        for xs, ys in zip(chunks["xs"], chunks["ys"], strict=True):
            out.append(now)
            now = float(np.interp(now, xs, ys))
        return pd.DataFrame({"node_id": chunks["node_id"], "chunk": chunks["chunk"], "start": out})

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        known = right.iloc[0]
        own, after, rises = _steps(left, known["change_us"], known["change_to"], known["capacity"])
        soc, out = known["start"], []
        for rise, reported, kind, resting in zip(rises, own["reported"], own["kind"], own["resting"], strict=True):
            if kind == FOLLOWS:
                soc = clamped(soc + rise)
            elif kind == BEGINS or not math.isnan(reported):
                soc = clamped(reported)
            if resting and not math.isnan(reported):
                soc = drawn(soc, reported, most)
            out.append(soc)
        return pd.DataFrame({"node_id": own["node_id"], "us": own["us"], "soc": out, "capacity_ah": after})

    key = ["node_id", "chunk"]
    functions = rows.groupBy(*key).cogroup(capacities.groupBy(*key)).applyInPandas(function, "node_id string, chunk long, xs array<double>, ys array<double>")
    begun = functions.groupBy("node_id").applyInPandas(starts, "node_id string, chunk long, start double")
    known = stored(capacities.join(begun, key))
    return rows.groupBy(*key).cogroup(known.groupBy(*key)).applyInPandas(run, "node_id string, us long, soc double, capacity_ah double")
