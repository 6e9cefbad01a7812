"""Near-duplicate vectors above a cosine threshold, by dual traversal of cover trees.

Vectors are scaled to length one, where cosine >= t is distance <= eps = sqrt(2 - 2t). Vectors of
one label that are equal component by component form one class and go on as one.

1. Upper levels. From at most ``sample`` vectors of all labels together, nested nets with halving
   radii are chosen for each label; those of its deepest level with at most ``centres`` nets are
   its cells. Every vector goes to its nearest cell; a cell's covering radius is that of all its
   vectors. A label without a sampled vector is one cell.
2. Cells with more than ``block`` vectors are cut into blocks. A vector visits those cells whose
   covering radius plus eps it is within, which is the first pruning of node pairs. Each pair of
   blocks in which both sides visit the other's cell is a task of its own.
3. Lower levels. A task builds a cover tree of either block (levels with halving radii, each
   node with the radius that covers its points) and goes down both at once: a pair of nodes whose
   centres are farther apart than both radii and eps is dropped with all that is below it. What is
   left at the bottom is compared in double precision: products within 1e-12 of the threshold are
   decided by one fixed sum over the two unit vectors, so that no pair below it is linked.

A task returns each member's number of links and one edge into its component, never the pairs.

Null labels, and vectors that are null, empty, zero or hold null or non-finite components, link
with nothing; nor do vectors of different length. Null ids are classes of their own and null in
the result. Repeated rows count as other vectors. Ties go to the smallest id. An empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import materialize
from tidewell.llm.components import connected_components

_SLACK = 1e-9


# ---- trees --------------------------------------------------------------------------------


def net(points: np.ndarray, radius: float) -> np.ndarray:
    """For each point the first chosen centre (a row number) within ``radius``; greedy."""
    owner = np.full(len(points), -1, np.int64)
    open_ = np.arange(len(points))
    while len(open_):
        centre = open_[0]
        near = 2 - 2 * (points[open_] @ points[centre]) <= radius * radius + _SLACK
        near[0] = True
        owner[open_[near]] = centre
        open_ = open_[~near]
    return owner


class CoverTree:
    """Levels of nodes over unit vectors; a node is (centre row, covering radius, children)."""

    def __init__(self, points: np.ndarray, leaf: float):
        """leaf: a node with a covering radius of at most this is not divided further."""
        self.points = points
        #: Of each level: centre rows, covering radii, first and last + 1 child on the next level.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        groups, radius = [np.arange(len(points))], 2.0
        while True:
            centres = np.array([g[0] for g in groups])
            covers = np.array([float(np.sqrt(np.maximum(0, 2 - 2 * (points[g] @ points[g[0]])).max())) if len(g) > 1 else 0.0 for g in groups])
            if (covers <= leaf).all():
                self.levels.append((centres, covers, np.zeros(0, np.int64), np.zeros(0, np.int64)))
                self.members = groups
                return
            radius /= 2
            below: list[np.ndarray] = []
            first, last = np.zeros(len(groups), np.int64), np.zeros(len(groups), np.int64)
            for k, g in enumerate(groups):
                first[k] = len(below)
                if covers[k] <= leaf:
                    below.append(g)
                else:
                    owner = net(points[g], radius)
                    order = np.argsort(owner, kind="stable")
                    below.extend(g[part] for part in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1))
                last[k] = len(below)
            self.levels.append((centres, covers, first, last))
            groups = below


def _products(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x[a] . y[b] row by row: from one product of matrices where most pairs are asked for."""
    ua, ia = np.unique(a, return_inverse=True)
    ub, ib = np.unique(b, return_inverse=True)
    if len(ua) * len(ub) <= 16 * len(a):
        return (x[ua] @ y[ub].T)[ia, ib]
    step = 1 << 15
    return np.concatenate([np.einsum("ij,ij->i", x[a[k : k + step]], y[b[k : k + step]]) for k in range(0, len(a), step)]) if len(a) else np.zeros(0)


def _reaches(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Is x[a] . y[b] at least the threshold? What is close to it is summed exactly and rounded once."""
    product = _products(x, y, a, b)
    good = product >= threshold
    for k in np.flatnonzero(np.abs(product - threshold) <= 1e-12).tolist():
        good[k] = math.fsum((x[a[k]] * y[b[k]]).tolist()) >= threshold
    return good


def _children(first: np.ndarray, last: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in nodes, child) of all children."""
    size = last[nodes] - first[nodes]
    at = np.repeat(np.arange(len(nodes)), size)
    return at, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + first[nodes][at]


def dual_traversal(left: CoverTree, right: CoverTree, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (of left, of right) that may be within ``eps``: those under node pairs that
    no bound of covering radii has pruned."""
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    depth = max(len(left.levels), len(right.levels))
    for level in range(depth):
        one, two = (t.levels[min(level, len(t.levels) - 1)] for t in (left, right))
        apart = np.sqrt(np.maximum(0, 2 - 2 * _products(left.points, right.points, one[0][a], two[0][b])))
        near = apart <= one[1][a] + two[1][b] + eps + _SLACK
        a, b = a[near], b[near]
        if level < len(left.levels) - 1:
            at, a = _children(one[2], one[3], a)
            b = b[at]
        if level < len(right.levels) - 1:
            at, b = _children(two[2], two[3], b)
            a = a[at]
    first, sizes = (np.array([len(m) for m in t.members]) for t in (left, right))
    rows, columns = np.concatenate(left.members), np.concatenate(right.members)
    ends, others = np.cumsum(first), np.cumsum(sizes)
    at, i = _children(ends - first, ends, a)
    b = b[at]
    at, j = _children(others - sizes, others, b)
    return rows[i[at]], columns[j]


# ---- spreading ----------------------------------------------------------------------------


def unit_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, class_key (null if it links with nothing), label and unit vector as bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch, keys, units = whole.slice(at, 4096), [], []
                for label, vector in zip(batch.column(1), batch.column(2), strict=True):
                    x = np.array([np.nan if v is None else v for v in vector.as_py()], float) if label.is_valid and vector.is_valid else np.zeros(0)
                    if not len(x) or not np.isfinite(x).all() or not x.any():
                        keys.append(None)
                        units.append(None)
                        continue
                    scaled = x / np.abs(x).max()  # no overflow in the squares
                    unit = scaled / np.sqrt(scaled @ scaled)
                    keys.append(hashlib.blake2b(repr(label.as_py()).encode() + b"\0" + (x + 0.0).tobytes(), digest_size=16).digest())
                    units.append(unit.tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(units, pa.binary())], ["vec_id", "label", "class_key", "unit"])

    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, label string, class_key binary, unit binary")


def cells_of(sampled: Iterable[tuple[str, bytes]], centres: int) -> dict[tuple[str, int], np.ndarray]:
    """Cell centres by (label, bytes of a vector): the deepest nested net with at most so many."""
    groups: dict[tuple[str, int], list[bytes]] = {}
    for label, unit in sampled:
        groups.setdefault((label, len(unit)), []).append(unit)
    out = {}
    for key, units in groups.items():
        points = np.frombuffer(b"".join(units)).reshape(len(units), -1)
        chosen, radius = points[:1], 1.0
        while radius > 1e-3:
            found = points[np.unique(net(points, radius))]
            if len(found) > centres:
                break
            chosen, radius = found, radius / 2
        out[key] = chosen
    return out


def near_duplicates(embeddings: DataFrame, threshold: float = 0.93, sample: int = 4096, centres: int = 32, block: int = 1024) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``embeddings(vec_id, label, embedding)``."""
    spark = embeddings.sparkSession
    eps = float(np.sqrt(2 - 2 * threshold))
    every = materialize(unit_vectors(embeddings))
    usable = every.where("class_key is not null and vec_id is not null")
    classes = usable.groupBy("class_key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("unit").alias("unit"))
    # An id that stands for several different vectors leads its own class only once.
    classes = materialize(classes.withColumn("node", F.concat_ws("/", "rep", F.hex("class_key"))))
    drawn = classes.select("label", "unit", F.xxhash64("class_key").alias("h"), "class_key").orderBy("h", "class_key").limit(sample)
    shared = spark.sparkContext.broadcast(cells_of([(r["label"], bytes(r["unit"])) for r in drawn.collect()], centres))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = [], []
            for label, unit in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                mid = shared.value.get((label, len(unit.as_py())))
                if mid is None:
                    cell.append(0)
                    far.append(2.0)
                else:
                    product = mid @ np.frombuffer(unit.as_py())
                    cell.append(int(product.argmax()))
                    far.append(float(np.sqrt(max(0.0, 2 - 2 * product.max()))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far, pa.float64())], ["label", "unit", "class_key", "cell", "far"])

    placed = materialize(classes.select("label", "unit", "class_key").mapInArrow(place, "label string, unit binary, class_key binary, cell int, far double"))
    dims = F.octet_length("unit")
    sizes = placed.groupBy("label", dims.alias("dims"), "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    # Labels with centres have at most ``centres`` cells each and ``sample`` together: the bound of this table.
    tops = {(r["label"], r["dims"]): {} for r in sizes.limit(0).collect()}
    known = spark.createDataFrame([(label, dims) for label, dims in shared.value] or [("", -1)], "label string, dims int")
    for r in sizes.join(F.broadcast(known), ["label", "dims"], "left_semi").collect():
        tops.setdefault((r["label"], r["dims"]), {})[r["cell"]] = (r["radius"], -(-r["n"] // block))
    cells = spark.sparkContext.broadcast(tops)
    alone = sizes.join(F.broadcast(known), ["label", "dims"], "left_anti").select("label", F.col("dims"), F.ceil(F.col("n") / block).cast("int").alias("blocks"))

    def visits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Own block, and the blocks of all cells within reach."""
        for batch in batches:
            own, others = [], []
            for label, unit, key, cell, blocks in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                vector = unit.as_py()
                here = cells.value.get((label, len(vector)))
                number = int.from_bytes(key[:8], "little")
                if here is None:
                    own.append(number % blocks)
                    others.append(list(range(blocks)))
                    continue
                apart = np.sqrt(np.maximum(0, 2 - 2 * (shared.value[label, len(vector)] @ np.frombuffer(vector))))
                own.append((cell << 32) + number % here[cell][1])
                others.append([(c << 32) + k for c, (radius, n) in here.items() if apart[c] <= radius + eps + _SLACK for k in range(n)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(own, pa.int64()), pa.array(others, pa.list_(pa.int64()))], ["label", "unit", "class_key", "own", "others"])

    reach = placed.withColumn("dims", dims).join(alone, ["label", "dims"], "left").select("label", "unit", "class_key", "cell", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    reach = reach.mapInArrow(visits, "label string, unit binary, class_key binary, own long, others array<long>")
    numbered = reach.join(classes.select("class_key", "rep", "copies"), "class_key")
    dealt = numbered.select("label", F.octet_length("unit").alias("dims"), "own", F.explode("others").alias("other"), "unit", "class_key", "rep", "copies")
    low, high = F.least("own", "other"), F.greatest("own", "other")
    dealt = dealt.select("label", "dims", low.alias("i"), high.alias("j"), "own", "unit", "class_key", "rep", "copies")

    def compare(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        own, rep, copies = (table.column(c).to_numpy() for c in ("own", "rep", "copies"))
        units = np.frombuffer(b"".join(table.column("unit").to_pylist())).reshape(table.num_rows, -1)
        sides = [np.flatnonzero(own == i), np.flatnonzero(own == j)]
        n, root = np.zeros(len(own), np.int64), rep.copy()
        if len(sides[0]) and len(sides[1]):
            trees = [CoverTree(units[s], eps / 4) for s in (sides if i != j else sides[:1])]
            a, b = dual_traversal(trees[0], trees[-1], eps)
            good = _reaches(units[sides[0]], units[sides[1]], a, b, threshold)
            a, b = sides[0][a[good]], sides[1][b[good]]
            if i == j:
                a, b = a[a != b], b[a != b]  # both orders of each pair are there
            else:
                a, b = np.concatenate((a, b)), np.concatenate((b, a))
            n = np.bincount(a, copies[b], len(own)).astype(np.int64)
            while True:
                lower = root.copy()
                np.minimum.at(lower, a, root[b])
                if (lower == root).all():
                    break
                root = lower
        return pa.table([table.column("class_key"), pa.array(rep), pa.array(root), pa.array(n)], ["class_key", "rep", "root", "n"])

    checked = materialize(dealt.groupBy("label", "dims", "i", "j").applyInArrow(compare, "class_key binary, rep long, root long, n long"))
    links = checked.groupBy("class_key").agg(F.sum("n").alias("n"))
    joined = connected_components(checked.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    facts = classes.select("class_key", "rep", "copies").join(links, "class_key", "left").join(joined.withColumnRenamed("id", "rep"), "rep", "left")
    facts = facts.select("class_key", F.coalesce("component", "rep").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"))
    found = every.select("vec_id", "class_key").join(facts, "class_key", "left")
    component = F.coalesce(F.when(F.col("vec_id").isNotNull(), F.col("component")), F.col("vec_id"))
    n_links = F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n", F.lit(0))).cast("long")
    return found.select("vec_id", n_links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
