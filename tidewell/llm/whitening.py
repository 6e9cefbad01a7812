"""Whitening of embeddings by the singular values of the centred rows.

1. A row whose vector is null, or holds null or non-finite entries, is dropped. Each entry c becomes
   the whole number x = floor(1024 * c) + 100000. n and the sums S of each dimension are exact.
2. The rows (n * x - S) / n, centred before anything is multiplied, are an MLlib ``RowMatrix``, whose
   ``computeSVD`` gives the singular values s and the right singular vectors. With divisor n the
   covariance has eigenvalues s^2 / n. All singular values are asked for, so MLlib solves its
   d by d Gramian by LAPACK to double precision; only that and n, S and the components meet on the driver.
3. The total variance is not taken from the eigenvalues but from the exact sums of (n * x - S)^2.
4. Every row is projected on the components, and the covariance of the results is compared with the
   identity in a second pass.

Components with less than ``least`` of the greatest variance (none at all, but for rounding) can't be
whitened and are left out, so equal vectors, a single vector and an empty table give no rows. Vectors of
another length than the most frequent one (of equals, the longer) count as malformed and are dropped too.
Repeated rows count as often as they occur and null ids stay null; other columns are ignored. A deviation
beyond a long is null (``exact`` holds it still); entries beyond 2^62 / 1024 count as non-finite.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import materialize

SCALE, SHIFT = 1024, 100_000
_UNIT = 10**18  # sums of squares are added up in two parts, each within a decimal
_LIMIT = float(1 << 52)  # of an entry: 1024 times it fits a long


@dataclass(frozen=True)
class Whitening:
    """n, the exact sums of each dimension, the components (a row each), their variances, and the total variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    total: float


def whole_numbers(embeddings: DataFrame) -> DataFrame:
    """vec_id and x (array of long) of the rows that have a usable vector, of whatever length."""
    c = F.col("embedding").cast("array<double>")
    usable = c.isNotNull() & F.forall(c, lambda v: F.coalesce(F.abs(v) < _LIMIT, F.lit(False)))  # nan is greater than any number
    return embeddings.where(usable).select("vec_id", F.transform(c, lambda v: F.floor(v * SCALE).cast("long") + SHIFT).alias("x"))


def of_one_length(rows: DataFrame) -> tuple[DataFrame, int]:
    """The rows of the most frequent length, and that length."""
    found = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = found["d"] if found else 0
    return rows.where(F.size("x") == d), d


def fit(rows: DataFrame, d: int, least: float = 1e-10) -> Whitening | None:
    """Whitening of ``rows(x)``, all of length d; None if there is no row or no variance."""
    spark = rows.sparkSession
    whole = F.col("v").cast("decimal(20,0)")
    sums = [int(r["s"]) for r in rows.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.sum(whole).alias("s")).orderBy("k").collect()]
    n = rows.count()
    if not sums:
        return None
    shared = spark.sparkContext.broadcast(sums)

    def centre(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            off = offsets(batch.column(0), n, shared.value)
            yield pa.RecordBatch.from_arrays([pa.array((off / n).astype(float).tolist(), pa.list_(pa.float64())), *(pa.array([str(part) for part in parts], pa.string()) for parts in zip(*(divmod(q, _UNIT) for q in exact_squares(off)), strict=True))], ["row", "high", "low"])

    centred = materialize(rows.select("x").mapInArrow(centre, "row array<double>, high string, low string"))
    high, low = centred.agg(*(F.sum(F.col(part).cast("decimal(38,0)")) for part in ("high", "low"))).first()
    total = (int(high) * _UNIT + int(low)) / n**3  # whole numbers, rounded once
    if not total:
        return None
    vectors = MLUtils.convertVectorColumnsFromML(centred.select(array_to_vector("row").alias("row")), "row")
    found = RowMatrix(vectors, n, d).computeSVD(d, computeU=False, rCond=least**0.5)
    return Whitening(n, sums, found.V.toArray().T, found.s.toArray() ** 2 / n, total)


def offsets(column: pa.Array, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S of a column of vectors, exact: longs where they are sure to fit, else whole numbers of Python."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    most = n * int(np.abs(flat).max(initial=0)) + max(map(abs, sums))
    kind = np.int64 if most < 1 << 62 else object
    return n * flat.reshape(-1, len(sums)).astype(kind) - np.array(sums, kind)


def exact_squares(off: np.ndarray) -> list[int]:
    """The sum of squares of each row."""
    most = int(np.abs(off).max(initial=0))
    if off.dtype == object or most * most * off.shape[1] >= 1 << 63:
        off = off.astype(object)
    return (off * off).sum(axis=1).tolist()


def whiten(embeddings: DataFrame, components: int = 8, least: float = 1e-10) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error and exact (the deviation as
    text) of ``embeddings(vec_id, embedding)``, for each of the first ``components`` components."""
    spark = embeddings.sparkSession
    rows, d = of_one_length(materialize(whole_numbers(embeddings)))
    model = fit(rows, d, least)
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, exact string")
    k = min(components, len(model.variances))
    shared = spark.sparkContext.broadcast((model.sums, model.components[:k] / np.sqrt(model.variances[:k])[:, None]))
    n = model.n

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, axes = shared.value
        for batch in batches:
            off = offsets(batch.column(1), n, sums)
            white = (off / n).astype(float) @ axes.T
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(str, exact_squares(off)), pa.string()), pa.array(white.tolist(), pa.list_(pa.float64()))], ["vec_id", "exact", "white"])

    white = materialize(rows.select("vec_id", "x").mapInArrow(project, f"vec_id {dict(rows.dtypes)['vec_id']}, exact string, white array<double>"))
    off = identity_error(white, k)
    explained = F.array(*(F.lit(float(v / model.total)) for v in model.variances[:k]))
    spread = white.select("vec_id", "exact", F.posexplode("white").alias("at", "whitened"))
    long = F.expr("try_cast(exact as bigint)")
    return spread.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), long.alias("deviation"), "whitened", explained[F.col("at")].alias("explained"), F.lit(off).alias("identity_error"), "exact")


def identity_error(white: DataFrame, k: int) -> float:
    """The largest absolute entry of the covariance (divisor n, centred first) of ``white`` minus the identity."""
    parts = [F.col("white")[i] for i in range(k)]
    means = white.agg(*(F.avg(p).alias(f"m{i}") for i, p in enumerate(parts))).first()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = white.agg(*(F.avg((parts[i] - means[i]) * (parts[j] - means[j])).alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max(abs(v - (i == j)) for (i, j), v in zip(pairs, found, strict=True))
