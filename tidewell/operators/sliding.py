"""Exact percentiles, means and deviations of trailing windows, without going through any window row by row.

A task holds a chunk of time and what its first windows reach back to. Its values are ranked once, and counted by
halves of their ranges: which of them are in the lower half, then in the lower half of either, and so on (a wavelet
matrix). The kth value of any stretch of rows is then found by one step a level, for all windows at once, so
the work grows with the rows times the logarithm of their number, however many rows a window holds.

Means and deviations are merged from stretches of 1, 2, 4, 8... rows, as many as the window's number of rows has binary
digits. Nothing is taken away from a sum, so no digits cancel, and a window of equal values deviates by zero.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kth_values(ranks: np.ndarray, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
    """For each stretch [low, high) of ``ranks`` the kth smallest (from 0), where it has so many."""
    low, high, k, out = low.astype(np.int64), high.astype(np.int64), k.astype(np.int64), np.zeros(len(k), np.int64)
    for bit in reversed(range(max(1, int(ranks.max(initial=0)).bit_length()))):
        lower = (ranks >> bit) & 1 == 0
        upto = np.concatenate(([0], np.cumsum(lower)))
        a, b = upto[low], upto[high]
        right = k >= b - a
        k = np.where(right, k - (b - a), k)
        out |= right.astype(np.int64) << bit
        low, high = np.where(right, upto[-1] + low - a, a), np.where(right, upto[-1] + high - b, b)
        ranks = np.concatenate((ranks[lower], ranks[~lower]))
    return out


def percentiles_of(times: np.ndarray, values: np.ndarray, width: int, probabilities: list[float]) -> np.ndarray:
    """A row for each time (sorted), a column for each percentile of the values in (time - width, time]; nan for none.

    Values that are nan do not count.
    """
    known = ~np.isnan(values)
    at = times[known]
    low, high = np.searchsorted(at, times - width, "right"), np.searchsorted(at, times, "right")
    distinct, ranks = np.unique(values[known], return_inverse=True)
    n = high - low
    some, out = n > 0, np.full((len(times), len(probabilities)), np.nan)
    for column, p in enumerate(probabilities):
        place = p * (n[some] - 1)
        floor = np.floor(place).astype(np.int64)
        first, second = (distinct[kth_values(ranks, low[some], high[some], k)] for k in (floor, np.ceil(place).astype(np.int64)))
        out[some, column] = first + (second - first) * (place - floor)
    return out


def moments_of(times: np.ndarray, values: np.ndarray, known: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each time (sorted) the mean and the population's deviation of the known values in (time - width, time]; nan for none."""
    at = times[known]
    start, n = np.searchsorted(at, times - width, "right"), np.searchsorted(at, times, "right")
    n -= start
    mean, square, done = np.zeros(len(times)), np.zeros(len(times)), np.zeros(len(times))
    means, squares = values[known].astype(float), np.zeros(len(at))  # of the ``size`` rows from each on
    for bit in range(int(n.max(initial=0)).bit_length()):
        size = 1 << bit
        if bit:
            half = size // 2
            apart = means[half:] - means[:-half]
            squares = squares[:-half] + squares[half:] + apart * apart * (half / 2)
            means = means[:-half] + apart / 2
        own = np.flatnonzero((n >> bit) & 1)
        first, had = start[own], done[own]
        apart, total = means[first] - mean[own], had + size
        mean[own] += apart * size / total
        square[own] += squares[first] + apart * apart * (had * size / total)
        done[own], start[own] = total, first + size
    some = n > 0
    return np.where(some, mean, np.nan), np.where(some, np.sqrt(square / np.maximum(n, 1)), np.nan)


def _in_chunks(df: DataFrame, keys: list[str], order: str, width: int, chunks: int, added: dict[str, str], columns: Callable[[pa.Table, np.ndarray], list[pa.Array]]) -> DataFrame:
    """``df`` with the columns ``added`` (name: type) that ``columns`` makes of the rows of a chunk and the window before it, in their order."""
    size = width * chunks
    chunk = F.floor(F.col(order) / size)
    back = F.when(F.pmod(F.col(order), F.lit(size)) > size - width, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    spread = df.where(F.col(order).isNotNull()).withColumn("_home", chunk).withColumn("_c", F.explode(back))
    kinds = ", ".join(f"`{c}` {t}" for c, t in [*df.dtypes, *added.items()])

    def one(part: pa.Table) -> pa.Table:
        part = part.sort_by(order)
        own = pa.array(part.column("_home").to_numpy() == part.column("_c").to_numpy())
        out = part.drop_columns(["_home", "_c"])
        for name, column in zip(added, columns(part, part.column(order).to_numpy()), strict=True):
            out = out.append_column(name, column)
        return out.filter(own)

    return spread.groupBy(*keys, "_c").applyInArrow(lambda part: one(part), kinds)


def rolling_percentiles(df: DataFrame, keys: list[str], order: str, value: str, width: int, probabilities: list[float], name: str = "percentiles", chunks: int = 4) -> DataFrame:
    """``df`` with an array of percentiles (linear interpolation) of the values in (order - width, order] of each ``keys``.

    Null values do not count; a window without a value has nulls. Rows without an order are left out. Rows at equal times are in
    each other's windows. A task holds ``chunks`` + 1 windows of one key.
    """
    k = len(probabilities)

    def columns(part: pa.Table, times: np.ndarray) -> list[pa.Array]:
        values = part.column(value).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)
        found = percentiles_of(times, values, width, probabilities)
        return [pa.FixedSizeListArray.from_arrays(pa.array(np.where(np.isnan(found), np.nan, found).ravel(), pa.float64(), from_pandas=True), k).cast(pa.list_(pa.float64()))]

    return _in_chunks(df, keys, order, width, chunks, {name: "array<double>"}, columns)


def rolling_moments(df: DataFrame, keys: list[str], order: str, values: list[str], width: int, chunks: int = 2) -> DataFrame:
    """``df`` with <value>_mean and <value>_deviation (of the population) in (order - width, order] of each ``keys``.

    What holds of null values, orders and equal times is as in ``rolling_percentiles``.
    """

    def columns(part: pa.Table, times: np.ndarray) -> list[pa.Array]:
        out = []
        for value in values:
            column = part.column(value).cast(pa.float64())
            known = pc.is_valid(column).to_numpy()
            mean, deviation = moments_of(times, column.to_numpy(zero_copy_only=False), known, width)
            none = np.searchsorted(times[known], times - width, "right") == np.searchsorted(times[known], times, "right")
            out += [pa.array(mean, mask=none), pa.array(deviation, mask=none)]
        return out

    return _in_chunks(df, keys, order, width, chunks, {f"{v}_{stat}": "double" for v in values for stat in ("mean", "deviation")}, columns)
