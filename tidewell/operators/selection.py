"""Greedy selection with a minimum distance: the best stays and shuts out all that is near, then the next best.

What becomes of a row depends on better rows near it, on better ones near those, and so on, which seldom goes far.
Time is cut into chunks; a task sees its chunk and a margin on either side, goes through its rows from the best down and
settles those for which nothing beyond the margin can matter. Rows that are still open go into the next round, with the
rows chosen so far beside them. Every round settles the best open row at least, and usually all but a few; only ranks that rise
steadily over many chunks take a round for each.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.storage import stored

OPEN, CHOSEN, SHUT_OUT = 0, 1, 2


def _near(times: list[int], at: int, window: int) -> bool:
    k = bisect_left(times, at - window)
    return k < len(times) and times[k] <= at + window


def settle(times: list[int], states: list[int], window: int, low: int, high: int) -> list[int]:
    """States of rows that come from the best down: only what lies within [low, high] is known to be all there."""
    chosen = sorted(t for t, s in zip(times, states, strict=True) if s == CHOSEN)
    doubtful: list[int] = []
    out = []
    for at, state in zip(times, states, strict=True):
        if state == OPEN:
            if _near(chosen, at, window):
                state = SHUT_OUT
            elif at - window < low or at + window > high or _near(doubtful, at, window):
                insort(doubtful, at)
            else:
                state = CHOSEN
                insort(chosen, at)
        out.append(state)
    return out


def greedy(rows: DataFrame, keys: list[str], order: str, window: int, best: list[Column], margin: int = 16, chunk: int = 1024) -> DataFrame:
    """The rows of ``rows`` that are left when of each ``keys`` the best shuts out those at most ``window`` away by ``order``
    (whole numbers), and so on; ``best``: ascending columns that put the best first, then ``order``.

    Rows with a null order are left out. Rows of equal rank at one place are alike, and the first met stays. margin and chunk are in windows.
    """
    unit = max(1, window)
    columns = rows.columns
    width = unit * chunk
    number = stored(rows.where(F.col(order).isNotNull()).select(F.struct(*columns).alias("_row"), F.struct(*best, F.col(order).cast("long")).alias("_best"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(order).cast("long").alias("_at")))
    number = number.select("*", F.monotonically_increasing_id().alias("_id"))
    names = [f"_k{i}" for i in range(len(keys))]
    table = stored(number)
    open_ = table.select(*names, "_at", "_best", "_id", F.lit(OPEN).alias("_state"))
    chosen = None
    home = F.floor(F.col("_at") / width)

    def one(part: pa.Table) -> pa.Table:
        c = part.column("_c")[0].as_py()
        part = part.append_column("_n", pa.array(range(part.num_rows), pa.int64()))
        ranked = part.flatten()
        by = [(n, "ascending") for n in ranked.schema.names if n.startswith("_best.")] + [("_id", "ascending")]
        ranked = ranked.sort_by(by)
        states = settle(ranked.column("_at").to_pylist(), ranked.column("_state").to_pylist(), window, c * width - margin * unit, (c + 1) * width - 1 + margin * unit)
        done = pa.table([ranked.column("_id"), pa.array(states, pa.int32()), ranked.column("_home")], ["_id", "_state", "_home"])
        return done.filter(pa.array([h == c for h in done.column("_home").to_pylist()], pa.bool_())).select(["_id", "_state"])

    while True:
        edge = F.pmod(F.col("_at"), F.lit(width))
        seen = F.array_compact(F.array(home, F.when(edge < margin * unit, home - 1), F.when(edge >= width - margin * unit, home + 1)))
        spread = open_.withColumn("_home", home).withColumn("_c", F.explode(seen))
        settled = stored(spread.groupBy(*names, "_c").applyInArrow(lambda part: one(part), "_id long, _state int"))
        decided = open_.where(F.col("_state") == OPEN).drop("_state").join(settled, "_id")
        now = stored(decided.where(F.col("_state") != SHUT_OUT))
        picked = now.where(F.col("_state") == CHOSEN)
        chosen = picked if chosen is None else chosen.unionByName(picked)
        left = now.where(F.col("_state") == OPEN)
        if left.isEmpty():
            return table.join(chosen.select("_id"), "_id", "left_semi").select("_row.*")
        # Of the chosen rows, those in or beside a chunk with an open row go along.
        about = left.select(*names, F.explode(F.array(home - 1, home, home + 1)).alias("_h")).distinct()
        along = chosen.withColumn("_h", home).join(about, [*names, "_h"], "left_semi").drop("_h")
        open_ = stored(left.unionByName(along.select(left.columns)))
