"""Pages of whole buckets: a cursor in time, and a bound on the points of a page."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The most points of a page, and the fewest buckets.
MAX_POINTS, MIN_BUCKETS = 10_000_000, 25


@dataclass(frozen=True)
class Page:
    """Seconds [start, end] of a page, and where the next begins (None: this is the last)."""

    start: int
    end: int
    cursor: int | None


def page_window(start: int, end: int, interval: int, series: int, cursor: int | None = None, most: int = MAX_POINTS) -> Page:
    """The page of [start, end] at ``cursor`` for so many series; ValueError for a cursor outside [start, end).

    Where all points of the range are more than ``most``, a page has as many whole buckets as keep it below, at least 25.
    """
    at = start if cursor is None else cursor
    if not start <= at < max(end, start + 1):
        raise ValueError("a cursor lies within the range")
    interval, series = max(1, interval), max(1, series)
    buckets = max(0, (end - start) // interval) + 1
    if buckets * series > most:
        buckets = max(MIN_BUCKETS, max(1, most // series))
    stop = min(at // interval * interval + interval * buckets, end)
    return Page(at, stop, stop if stop < end else None)


def page(buckets: DataFrame, window: Page) -> DataFrame:
    """The rows of one page in order of series and time: its last bucket is whole, and the next page begins with the one after."""
    upto = F.col("bucket") < window.end if window.cursor is not None else F.col("bucket") <= window.end
    return buckets.where((F.col("bucket") >= window.start) & upto).orderBy("sensor_id", "bucket")


def pages(buckets: DataFrame, start: int, end: int, interval: int, series: int, most: int = MAX_POINTS) -> DataFrame:
    """``buckets`` of [start, end] with the number of the page that each row lies on, from 0."""
    first = page_window(start, end, interval, series, None, most)
    inside = buckets.where((F.col("bucket") >= start) & (F.col("bucket") <= end))
    if first.cursor is None:
        return inside.withColumn("page", F.lit(0).cast("long"))
    length = first.end - start // interval * interval
    number = F.floor((F.col("bucket") - start // interval * interval) / length)
    last = (end - 1 - start // interval * interval) // length  # an end on an edge belongs to the page before
    return inside.withColumn("page", F.least(number, F.lit(last)).cast("long"))
