"""A vector index with payload, exact filtered nearest neighbours, and candidates of related series.

Vectors of unit length lie in cells around centres. A cell's radius is the distance of its farthest vector,
so no vector in it is nearer to a query than the query's distance from the centre less the radius. A
search visits cells in the order of that bound, twice as many in each round, and a query is done when its kth
neighbour is nearer than the bound of the next cell. A round is a shuffle by cell and block of those queries
that are not done yet, and of what is found only scores that reach the query's kth so far leave a task, so rows
found do not grow with the cells that are visited; filters on the payload hold before anything is compared.
A query with columns that must be equal meets the rows of its class alone, without cells, where these are few:
it would have to visit every cell, since a class that has fewer than k rows gives no bound.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators.storage import shared_folder, stored

_SLACK = 1e-9
#: Rows of a class, and queries of a task, that are compared without cells.
_CLASS = 8192


@dataclass
class Index:
    """rows: space, cell, block, id, unit (doubles as bytes) and the payload; centres, radii and numbers of blocks by space."""

    rows: DataFrame
    centres: dict[str, np.ndarray]
    radii: dict[str, np.ndarray]
    blocks: dict[str, np.ndarray]


def unit(vector: list[float] | None) -> bytes | None:
    """The vector at length one; None for null, empty, zero or non-finite vectors."""
    x = np.array([np.nan if v is None else v for v in vector], float) if vector else np.zeros(0)
    if not len(x) or not np.isfinite(x).all() or not x.any():
        return None
    x = x / np.abs(x).max()
    return (x / np.sqrt(x @ x)).tobytes()


def _centres(sample: np.ndarray, cells: int, turns: int = 8) -> np.ndarray:
    """Spherical k-means of a bounded sample."""
    centres = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)].copy()
    for _ in range(turns):
        nearest = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        size = np.linalg.norm(sums, axis=1)
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    return centres


def build(vectors: DataFrame, spaces: dict[str, str], payload: list[str], path: str | None = None, cells: int | None = None, block: int = 4096, sample: int = 8192) -> Index:
    """Write an index of ``vectors(id, payload...)`` to ``path``; spaces: name -> column of the vector.

    cells: for each space, by default one for some 512 vectors, at most 256. Centres come from at most ``sample`` vectors; all
    are indexed. Vectors that are null, empty, zero or not finite have no neighbours; nor have those of another length than
    the first of the sample.
    """
    spark = vectors.sparkSession
    path = path or shared_folder(spark)
    long = reduce(DataFrame.unionByName, (vectors.where("id is not null").select(F.lit(s).alias("space"), F.col("id").cast("string").alias("id"), F.col(c).cast("array<double>").alias("vector"), *payload) for s, c in spaces.items()))
    every = stored(_units(long))
    centres: dict[str, np.ndarray] = {}
    for space in spaces:
        own = every.where(F.col("space") == space)
        drawn = [np.frombuffer(bytes(r["unit"])) for r in own.orderBy(F.xxhash64("id"), "id").select("unit").limit(sample).collect()]
        drawn = [x for x in drawn if len(x) == len(drawn[0])]
        if drawn:
            centres[space] = _centres(np.array(drawn), cells or min(256, max(1, own.count() // 512)))
    shared = spark.sparkContext.broadcast(centres)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = [], []
            for space, u in zip(batch.column("space").to_pylist(), batch.column("unit").to_pylist(), strict=True):
                mid, x = shared.value.get(space), np.frombuffer(u)
                if mid is None or mid.shape[1] != len(x):
                    cell.append(None)
                    far.append(None)
                    continue
                apart = np.linalg.norm(mid - x, axis=1)
                cell.append(int(apart.argmin()))
                far.append(float(apart.min()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far, pa.float64())], [*batch.schema.names, "cell", "far"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in every.dtypes)
    placed = stored(every.mapInArrow(place, kinds + ", cell int, far double").where("cell is not null"))
    sizes = placed.groupBy("space", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    table = sizes.select("space", "cell", "radius", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    middle = spark.createDataFrame([(s, i, x.tolist()) for s, m in centres.items() for i, x in enumerate(m)] or [("", 0, [0.0])], "space string, cell int, centre array<double>")
    middle.join(table, ["space", "cell"], "left").write.parquet(f"{path}/cells")
    dealt = placed.join(F.broadcast(table.select("space", "cell", "blocks")), ["space", "cell"])  # at most 256 rows a space
    dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks", "far").repartition("space", "cell", "block").write.partitionBy("space", "cell").parquet(f"{path}/rows")
    return load(spark, path, every)


def _units(long: DataFrame) -> DataFrame:
    """``long`` with unit for vector, without the rows that have none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = pa.array([unit(v) for v in batch.column("vector").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([units if n == "vector" else batch.column(n) for n in batch.schema.names], ["unit" if n == "vector" else n for n in batch.schema.names])

    return long.mapInArrow(run, ", ".join("unit binary" if c == "vector" else f"`{c}` {t}" for c, t in long.dtypes)).where("unit is not null")


def load(spark: SparkSession, path: str, like: DataFrame | None = None) -> Index:
    """An index that ``build`` has written."""
    centres: dict[str, dict[int, Any]] = {}
    for r in spark.read.schema("space string, cell int, centre array<double>, radius double, blocks int").parquet(f"{path}/cells").collect():  # at most 256 a space
        if r["space"]:
            centres.setdefault(r["space"], {})[r["cell"]] = (r["centre"], -1.0 if r["radius"] is None else r["radius"], r["blocks"] or 0)
    schema = None if like is None else ", ".join(f"`{c}` {t}" for c, t in like.dtypes if c != "space") + ", block int, space string, cell int"
    rows = (spark.read.schema(schema) if schema else spark.read).parquet(f"{path}/rows")
    of = lambda k: {s: np.array([c[i][k] for i in range(len(c))]) for s, c in centres.items()}
    return Index(rows, of(0), of(1), of(2))


def search(index: Index, queries: DataFrame, k: int, where: Column | None = None, same: tuple[str, ...] = (), first: int = 2) -> DataFrame:
    """query_id, space, id, score, rank: the k rows with the greatest cosine for each of ``queries(query_id, space, vector)``.

    where: a condition on the payload. same: columns of the queries and the payload that must be equal; a query's null asks for
    nothing. A column ``exclude`` (array of ids) names rows that a query is not to find. Ties go to the smallest id.
    ``searched.visited`` of the result is the share of cells that were visited; queries that meet their class visit none.
    """
    spark = queries.sparkSession
    if "exclude" not in queries.columns:
        queries = queries.withColumn("exclude", F.expr("cast(array() as array<string>)"))
    asked = queries.where("query_id is not null").select(F.col("query_id").cast("string").alias("query_id"), "space", F.col("vector").cast("array<double>").alias("vector"), "exclude", *(F.col(c).cast("string").alias(c) for c in same))
    shared = spark.sparkContext.broadcast((index.centres, index.radii))

    def bounds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radii = shared.value
        for batch in batches:
            order, low = [], []
            for space, u in zip(batch.column("space").to_pylist(), batch.column("unit").to_pylist(), strict=True):
                x, mid = np.frombuffer(u), centres.get(space)
                if mid is None or mid.shape[1] != len(x):
                    order.append([])
                    low.append([])
                    continue
                used = np.flatnonzero(radii[space] >= 0)
                bound = np.maximum(0.0, np.linalg.norm(mid[used] - x, axis=1) - radii[space][used])
                at = np.argsort(bound, kind="stable")
                order.append(used[at].tolist())
                low.append(bound[at].tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(order, pa.list_(pa.int32())), pa.array(low, pa.list_(pa.float64()))], [*batch.schema.names, "cells", "bounds"])

    ready = _units(asked)
    state = stored(ready.mapInArrow(bounds, ", ".join(f"`{c}` {t}" for c, t in ready.dtypes) + ", cells array<int>, bounds array<double>").withColumn("least", F.lit(-1.0)))
    rows = index.rows if where is None else index.rows.where(where)
    rows = rows.select("space", "cell", "block", "id", "unit", *(F.col(c).cast("string").alias(c) for c in same))
    blocks = spark.createDataFrame([(s, c, int(n)) for s, b in index.blocks.items() for c, n in enumerate(b) if n] or [("", 0, 0)], "space string, cell int, blocks int")
    names = list(same)

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        asking, spaces, found, scores = [], [], [], []
        if left.num_rows and right.num_rows:
            left = left.sort_by("id")
            x, ids = np.frombuffer(b"".join(left.column("unit").to_pylist())).reshape(left.num_rows, -1), np.array(left.column("id").to_pylist(), object)
            held = {c: np.array(left.column(c).to_pylist(), object) for c in names}
            for row in right.to_pylist():
                score = np.clip(x @ np.frombuffer(row["unit"]), -1.0, 1.0)
                good = score >= row["least"]
                for e in row["exclude"] or []:
                    good[slice(*np.searchsorted(ids, [e, e + "\0"]))] = False
                for c in names:
                    if row[c] is not None:
                        good &= held[c] == row[c]
                at = np.flatnonzero(good)
                at = at[np.argsort(-score[at], kind="stable")[:k]]
                asking += [row["query_id"]] * len(at)
                spaces += [row["space"]] * len(at)
                found += ids[at].tolist()
                scores += score[at].tolist()
        return pa.table([pa.array(asking, pa.string()), pa.array(spaces, pa.string()), pa.array(found, pa.string()), pa.array(scores, pa.float64())], ["query_id", "space", "id", "score"])

    rank = F.row_number().over(Window.partitionBy("query_id", "space").orderBy(F.desc("score"), "id"))
    hit = "query_id string, space string, id string, score double"
    within = None
    if names:
        kind = ["space", *names]
        sizes = rows.groupBy(*kind).agg(F.count("*").alias("_n"))
        sized = stored(state.join(sizes, kind, "left").withColumn("_few", reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in names)) & (F.coalesce("_n", F.lit(0)) <= _CLASS)))
        few, state = sized.where("_few and _n > 0").drop("_n", "_few"), sized.where("not _few").select(*state.columns)
        parts = few.groupBy(*kind).agg(F.ceil(F.count("*") / _CLASS).cast("int").alias("parts"))
        asking = few.join(parts, kind).withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int")).drop("parts")
        answering = rows.join(parts, kind).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        met = answering.groupBy(*kind, "part").cogroup(asking.groupBy(*kind, "part")).applyInArrow(lambda a, b: best(a, b), hit)
        within = stored(met.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"))
    found, at, step, visits = None, 0, first, 0
    while True:
        going = state.select("query_id", "space", "unit", "exclude", "least", *names, F.explode(F.slice("cells", at + 1, step)).alias("cell"))
        going = stored(going)
        near = {(r["space"], r["cell"]): r["count"] for r in going.groupBy("space", "cell").count().collect()}  # at most 256 a space
        visits += sum(near.values())
        if not near:
            break
        here = reduce(lambda a, b: a | b, ((F.col("space") == s) & F.col("cell").isin([c for t, c in near if t == s]) for s in {s for s, _ in near}))
        spread = going.join(F.broadcast(blocks), ["space", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        key = ["space", "cell", "block"]
        met = rows.where(here).groupBy(*key).cogroup(spread.groupBy(*key)).applyInArrow(lambda a, b: best(a, b), hit)
        merged = met if found is None else met.unionByName(found)
        found = stored(merged.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"))
        at += step
        step *= 2
        kth = found.groupBy("query_id", "space").agg(F.count("*").alias("_n"), F.min("score").alias("_s"))
        open_ = (F.size("cells") > at) & (F.coalesce("_n", F.lit(0)) < k) | (F.get("bounds", F.lit(at)) <= F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("_s"))) + _SLACK)
        state = stored(state.join(kth, ["query_id", "space"], "left").where(open_).withColumn("least", F.when(F.col("_n") >= k, F.col("_s")).otherwise(-1.0)).drop("_n", "_s"))
    if within is not None:
        found = within if found is None else found.unionByName(within)
    if found is None:
        found = spark.createDataFrame([], hit)
    out = found.withColumn("rank", rank)
    total = sum(int((r >= 0).sum()) for r in index.radii.values()) / max(1, len(index.radii)) * asked.count()
    out.visited = visits / total if total else 0.0
    return out


# ---- candidates ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Filters:
    """What a candidate must have in common with the focus, or have itself; None or False: nothing asked."""

    same_node: bool = False
    same_unit: bool = False
    same_type: bool = False
    interval_seconds: int | None = None
    is_derived: bool | None = None
    is_public: bool | None = None
    exclude: tuple[str, ...] = ()


#: In this order filters are given up: what a series is (unit, type) stays the longest.
_RELAXED = (("same_node", False), ("interval_seconds", None), ("is_derived", None), ("is_public", None), ("same_type", False), ("same_unit", False))


def widen_plan(filters: Filters) -> list[Filters]:
    """The filters of each stage: as given, then with one more given up; a plan of nothing to give up has two equal stages."""
    plan = [filters]
    for name, off in _RELAXED:
        if getattr(plan[-1], name) not in (None, False) or (off is None and getattr(plan[-1], name) is not None):
            plan.append(replace(plan[-1], **{name: off}))
    return plan if len(plan) > 1 else [*plan, filters]


def candidates(index: Index, focuses: DataFrame, filters: Filters, limit: int, min_pool: int = 0) -> DataFrame:
    """focus, candidate, stage, hits, best_score, pool, rank: at most ``limit`` candidates of each of ``focuses(id, node, unit,
    type, <space>...)``, whose columns named like the index's spaces are vectors.

    A stage searches every space with its filters and adds what it finds to the pool of each focus; a focus whose pool is large enough goes
    through no further stage. Candidates come in the order of the stage that found them first, the number of spaces
    that did, and the best cosine.
    """
    spark = focuses.sparkSession
    target = max(min_pool, limit, 10)
    base = min(1000, max(25, target // 2))
    spaces = list(index.centres)
    left = F.array(*(F.lit(x) for x in filters.exclude)).cast("array<string>") if filters.exclude else F.expr("cast(array() as array<string>)")
    asked = stored(reduce(DataFrame.unionByName, (focuses.select(F.col("id").cast("string").alias("query_id"), F.lit(s).alias("space"), F.col(s).alias("vector"), F.concat(left, F.array(F.col("id").cast("string"))).alias("exclude"), "node", "unit_", "type") for s in spaces)))
    hits = None
    for stage, f in enumerate(widen_plan(filters)):
        where = F.lit(True)
        for name in ("interval_seconds", "is_derived", "is_public"):
            if getattr(f, name) is not None:
                where = where & (F.col(name) == F.lit(getattr(f, name)))
        same = tuple(c for c, on in (("node", f.same_node), ("unit_", f.same_unit), ("type", f.same_type)) if on)
        got = search(index, asked, min(2000, max(25, base * (stage + 1))), where, same)
        got = got.select("query_id", "space", "id", "score", "rank", F.lit(stage).alias("stage"))
        hits = stored(got if hits is None else hits.unionByName(got))
        pools = hits.groupBy("query_id").agg(F.count_distinct("id").alias("pool"))
        asked = stored(asked.join(pools.where(F.col("pool") >= target).select("query_id"), "query_id", "left_anti"))
        if asked.isEmpty():
            break
    pool = hits.groupBy("query_id", "id").agg(F.min("stage").alias("stage"), F.count_distinct("space").cast("int").alias("hits"), F.max("score").alias("best_score"))
    sizes = pool.groupBy("query_id").agg(F.count("*").alias("pool"))
    order = Window.partitionBy("query_id").orderBy("stage", F.desc("hits"), F.desc("best_score"), "id")
    best = pool.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return best.join(sizes, "query_id").select(F.col("query_id").alias("focus"), F.col("id").alias("candidate"), "stage", "hits", "best_score", "pool", "rank")
