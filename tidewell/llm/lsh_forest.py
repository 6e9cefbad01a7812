"""Jaccard self-join of documents on word shingles, by a MinHash LSH forest.

1. A document's shingles are its runs of ``width`` lower-cased words (of a shorter text all its
   words, once), as 64-bit hashes. Documents with the same set of shingles form one class and go
   on as one, however many they are.
2. Forest: each of ``trees`` tries holds the classes under a label of ``depth`` MinHash values. All
   labels are sorted, by ranges of (tree, label), so that the classes below a node of a trie, that is
   those with a common prefix, stand in a row. One pass over a sorted part gives each entry the
   length of the prefix that it has in common with the one before, and an edge to the first entry
   below that node; edges with a prefix of at least d values make up the nodes of depth d of all tries.
3. Adaptive prefixes: the candidates below the deepest nodes are verified first. A linked pair of
   index s meets at depth d in some tree with probability p(d, s) = 1 - (1 - s^d)^trees, so the links
   found stand for sum of 1 / p(d, s) links, and the recall at any shorter prefix can be read off
   them. The prefixes are shortened to the longest with the wanted ``recall``, verified again, and so
   on until the recall measured on the links found is reached.
4. Exact verification of candidates by their whole shingle sets. Candidates that hang together form a
   group. A small group is compared as a whole. Of a large one, either its trie nodes are compared, a
   pair in the first tree in which it meets, or all of its pairs, whichever is less work. What is larger
   than a block is cut into blocks, and every pair of blocks is a task of its own; a task returns each
   member's number of links and one edge into its component, never the pairs.

A text without words, or a null text, links with nothing. Null ids are classes of their own and
null in the result. Repeated rows are documents of their own, also where an id stands on different
texts. Ties go to the smallest doc_id. Very long texts are compared whole. An empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import materialize
from tidewell.llm.components import connected_components

_PRIMES = np.random.default_rng(5).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    found = (text or "").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = pd.util.hash_array(np.array(found, object), categorize=False)
    if len(h) < width:
        return np.array([(h * _PRIMES[: len(h)]).sum(dtype=np.uint64) ^ np.uint64(len(h))])
    n = len(h) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out += h[k : k + n] * _PRIMES[k]
    return np.unique(out ^ (out >> np.uint64(29)))


def signature(items: np.ndarray, size: int, step: int = 2048) -> np.ndarray:
    """``size`` MinHash values of a set of hashes."""
    coins = np.random.default_rng(11)
    odd, plus = coins.integers(1, 2**63, size, dtype=np.uint64) | np.uint64(1), coins.integers(0, 2**63, size, dtype=np.uint64)
    least = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), step):
        part = items[at : at + step, None] * odd[None, :]
        part += plus[None, :]
        np.minimum(least, part.min(axis=0), out=least)
    return least


def meeting(depth: int, similarity, trees: int):
    """Probability that a pair of this Jaccard index has a prefix of ``depth`` values in common in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def _labels(values: np.ndarray) -> bytes:
    """The labels of all trees, four bytes a value, from the root on."""
    return (values >> np.uint64(32)).astype(">u4").tobytes()


def _signed(docs: DataFrame, width: int, trees: int, depth: int) -> DataFrame:
    """doc_id, text_key, set_id (null without words), labels."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch, names, labels = whole.slice(at, 512), [], []
                for text in batch.column(2):
                    items = shingles(text.as_py(), width)
                    names.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None)
                    labels.append(_labels(signature(items, trees * depth)) if len(items) else None)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.binary()), pa.array(labels, pa.binary())], ["doc_id", "text_key", "set_id", "labels"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, "doc_id long, text_key long, set_id binary, labels binary")


def _linked(sets: list[np.ndarray], threshold: float, columns: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """(which sets have a Jaccard index of the threshold or more, the index), as square matrices."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    terms, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(n > 1)
    place = np.full(len(terms), -1, np.int64)
    place[shared] = np.arange(len(shared))
    column = place[at]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float64)
    for start in range(0, len(shared), columns):
        low, high = np.searchsorted(column, [start, start + columns])
        part = np.zeros((len(sets), columns), np.float32)  # sums below 2**24 are exact
        part[owner[low:high], column[low:high] - start] = 1
        common += part @ part.T
    union = sizes[:, None] + sizes[None, :] - common
    return (common >= threshold * union - 1e-9) & ~np.eye(len(sets), dtype=bool), common / union


def _roots(names: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """The smallest name of each member's component."""
    root = names.copy()
    while True:
        lower = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (lower == root).all():
            return root
        root = lower


def forest(classes: DataFrame, trees: int, depth: int) -> DataFrame:
    """(a, b, prefix): an edge from each entry of the sorted tries into the node of its longest common
    prefix with the entry before it, of ``prefix`` values."""
    spark = classes.sparkSession
    entries = classes.select("node", "labels", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    entries = entries.select("tree", F.expr(f"substring(labels, tree * {4 * depth} + 1, {4 * depth})").alias("label"), "node")
    in_order = entries.repartitionByRange("tree", "label", "node").sortWithinPartitions("tree", "label", "node")

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        names = ["a", "b", "prefix", "part", "tree", "label"]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        last: tuple[int, bytes, int] | None = None
        heads = np.zeros(depth + 1, np.int64)  # first entry of the current node of each depth

        def edge_of_part(entry: tuple[int, bytes, int], which: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((entry[2], None, which, part, entry[0], entry[1]), kinds, strict=True)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            tree, node = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u4").reshape(-1, depth)
            if last is None:
                last = (int(tree[0]), values[0].tobytes(), int(node[0]))
                heads[:] = node[0]
                yield edge_of_part(last, -1)
                prefix = np.full(1, -1)
            else:
                same = int((np.frombuffer(last[1], ">u4") == values[0]).cumprod().sum()) if last[0] == tree[0] else 0
                prefix = np.array([same])
            between = np.cumprod(values[1:] == values[:-1], axis=1).sum(axis=1) * (tree[1:] == tree[:-1])
            prefix = np.concatenate((prefix, between))
            root = np.empty(len(node), np.int64)
            for k, (n, same) in enumerate(zip(node.tolist(), prefix.tolist(), strict=True)):
                if same >= 0:
                    root[k] = heads[same]
                    heads[same + 1 :] = n
            last = (int(tree[-1]), values[-1].tobytes(), int(node[-1]))
            met = np.flatnonzero(prefix > 0)
            yield pa.RecordBatch.from_arrays([pa.array(node[met]), pa.array(root[met]), pa.array(prefix[met], pa.int32()), *(pa.nulls(len(met), t) for t in kinds[3:])], names)
        if last is not None:
            yield edge_of_part(last, -2)

    found = materialize(in_order.mapInArrow(walk, "a long, b long, prefix int, part int, tree int, label binary"))
    ends: dict[int, dict[int, tuple[int, bytes, int]]] = {}
    for r in found.where("part is not null").collect():  # two rows for each part
        ends.setdefault(r["part"], {})[r["prefix"]] = (r["tree"], bytes(r["label"]), r["a"])
    joints, before = [], None
    for part in sorted(ends):
        first = ends[part][-1]
        if before is not None and before[0] == first[0]:
            same = int((np.frombuffer(before[1], ">u4") == np.frombuffer(first[1], ">u4")).cumprod().sum())
            joints.append((first[2], before[2], same))
        before = ends[part][-2]
    edges = found.where("part is null").select("a", "b", "prefix")
    return edges.unionByName(spark.createDataFrame(joints, "a long, b long, prefix int")) if joints else edges


def _prefixes(labels: list[bytes], trees: int, depth: int, used: int) -> np.ndarray:
    """One number for each label's prefix in each tree."""
    values = np.frombuffer(b"".join(labels), ">u4").reshape(len(labels), trees, depth)[:, :, :used].astype(np.uint64)
    return (values * _PRIMES[:used]).sum(axis=2, dtype=np.uint64)


def _checked(docs: DataFrame, classes: DataFrame, edges: DataFrame, threshold: float, width: int, trees: int, depth: int, used: int, block: int) -> DataFrame:
    """node, root, n, links, and expected0 to expected<depth>: what the exact comparison finds.

    n counts linked documents, ``links`` linked classes that share a prefix; of each of these,
    ``expected<d>`` is how often it is met at depth d for each time that it is met at depth ``used``.
    All pairs meet at depth 0, so expected0 estimates the number of all links.
    """
    met = connected_components(edges.where(F.col("prefix") >= used).select("a", "b"))
    members = met.select(F.col("id").alias("node"), F.col("component").alias("grp")).unionByName(met.select(F.col("component").alias("node"), F.col("component").alias("grp")).distinct())
    sizes = members.groupBy("grp").agg(F.count("*").alias("size"))
    placed = materialize(members.join(sizes, "grp").join(classes.select("node", "rep", "copies", "labels"), "node"))
    small = placed.where(F.col("size") <= block).withColumn("tree", F.lit(-1)).withColumn("unit", F.col("grp"))
    large = placed.where(F.col("size") > block)
    if not large.isEmpty():
        own = large.select("node", "grp", "labels", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
        own = own.select("node", "grp", "tree", F.xxhash64("tree", F.expr(f"substring(labels, tree * {4 * depth} + 1, {4 * used})")).alias("unit"))
        nodes = materialize(own.groupBy("grp", "tree", "unit").agg(F.count("*").alias("n")).where("n > 1"))
        work = nodes.groupBy("grp").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("work"))
        large = materialize(large.join(work, "grp").withColumn("whole", F.col("work") >= F.col("size").cast("double") * F.col("size")))
        whole = large.where("whole").withColumn("tree", F.lit(-1)).withColumn("unit", F.col("grp")).select(small.columns)
        by_node = own.join(nodes, ["grp", "tree", "unit"]).join(large.where("not whole").drop("grp", "size"), "node").withColumn("size", F.col("n")).select(small.columns)
        small = small.unionByName(whole).unionByName(by_node)
    blocks = F.ceil(F.col("size") / F.lit(block)).cast("int")
    units = materialize(small.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")))
    tasks = max(1, units.where("blocks = 1").count() // 1500)
    other = F.when(F.col("blocks") > 1, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0)))
    bodies = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    bodies = bodies.join(placed.select("node", "rep.doc_id", "rep.text_key"), ["doc_id", "text_key"]).dropDuplicates(["node"]).select("node", "text")
    dealt = units.join(bodies, "node").withColumn("with", F.explode(other)).select(
        "unit", "tree", "node", "copies", "labels", "text",
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("tree", "unit"), F.lit(tasks))).otherwise(F.xxhash64("tree", "unit", F.least("own", "with"), F.greatest("own", "with"))).alias("task"),
        F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own",
    )
    depths = range(depth + 1)

    def verify(table: pa.Table) -> pa.Table:
        rows = table.select(["unit", "tree", "i", "j", "own", "node", "copies"]).to_pandas()
        texts, labels = table.column("text"), table.column("labels")
        out = []
        for (_, tree, i, j), part in rows.groupby(["unit", "tree", "i", "j"], sort=False):
            names, at = part["node"].to_numpy(), part.index
            linked, similarity = _linked([shingles(texts[k].as_py(), width) for k in at], threshold)
            if i != j:  # pairs across the two blocks only
                side = part["own"].to_numpy() == j
                linked &= side[:, None] != side[None, :]
            prefix = _prefixes([labels[k].as_py() for k in at], trees, depth, used)
            a, b = np.nonzero(linked)
            common = prefix[a] == prefix[b]
            meets = common.any(axis=1)
            if tree >= 0:  # not the first tree in which the pair meets
                later = common.argmax(axis=1) != tree
                linked[a[later], b[later]] = False
                meets &= ~later
            a, s = a[meets], similarity[a[meets], b[meets]]
            share = meeting(used, s, trees)
            out.append((names, _roots(names, linked), linked @ part["copies"].to_numpy(), np.bincount(a, minlength=len(names)), *(np.bincount(a, meeting(d, s, trees) / share, len(names)) for d in depths)))
        kinds = [pa.int64()] * 4 + [pa.float64()] * (depth + 1)
        return pa.table([pa.array(np.concatenate([o[k] for o in out]), t) for k, t in enumerate(kinds)], ["node", "root", "n", "links", *(f"expected{d}" for d in depths)])

    return materialize(dealt.groupBy("task").applyInArrow(verify, "node long, root long, n long, links long, " + ", ".join(f"expected{d} double" for d in depths)))


def link_classes(docs: DataFrame, threshold: float = 0.8, width: int = 5, trees: int = 16, depth: int = 9, recall: float = 0.999, block: int = 192) -> tuple[DataFrame, DataFrame, DataFrame, list[tuple[int, float]]]:
    """(signed documents, classes, what the comparison found, [(prefix, recall measured with it)])."""
    signed = materialize(_signed(docs, width, trees, depth))
    usable = signed.where(F.col("set_id").isNotNull() & F.col("doc_id").isNotNull())
    classes = usable.groupBy("set_id").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.count("*").alias("copies"), F.first("labels").alias("labels"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()))
    edges = forest(classes, trees, depth)
    used, steps = depth, []
    while True:
        checked = _checked(docs, classes, edges, threshold, width, trees, depth, used, block)
        links, every, *expected = checked.agg(F.sum("links"), *(F.sum(f"expected{d}") for d in range(depth + 1))).first()
        if links:
            at = [e / every for e in expected]
            measured = links / every
        else:  # no link tells how similar the linked ones are: as if all were at the threshold
            at = [meeting(d, threshold, trees) for d in range(1, depth + 1)]
            measured = at[used - 1]
        steps.append((used, float(measured)))
        if measured >= recall or used == 1:
            return signed, classes, checked, steps
        used = next((d for d in range(used - 1, 0, -1) if at[d - 1] >= recall), 1)


def _found(docs: DataFrame, **options) -> DataFrame:
    """doc_id, text_key, class_id, n_links, kept."""
    signed, classes, checked, _ = link_classes(docs, **options)
    links = checked.groupBy("node").agg(F.sum("n").alias("n"))
    joined = connected_components(checked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    facts = classes.select("set_id", "node", "copies", F.col("rep.doc_id").alias("rep")).join(links, "node", "left").join(joined.withColumnRenamed("id", "node"), "node", "left")
    facts = materialize(facts.select("set_id", "rep", F.coalesce("component", "node").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n")))
    smallest = facts.groupBy("component").agg(F.min("rep").alias("class"))
    facts = facts.join(smallest, "component").select("set_id", "class", "n")
    found = signed.select("doc_id", "text_key", "set_id").join(facts, "set_id", "left")
    class_id = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("class")), F.col("doc_id"))
    return found.select("doc_id", "text_key", class_id.alias("class_id"), F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_links"), F.coalesce(F.col("doc_id") == class_id, F.lit(True)).alias("kept"))


def jaccard_classes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, n_links, kept of every row of ``docs(doc_id, text)``.

    class_id: the smallest doc_id that links lead to, the document's own included. n_links: other
    documents with a Jaccard index of at least ``threshold``. kept: doc_id = class_id. Options are
    those of ``link_classes``.
    """
    return _found(docs, **options).drop("text_key")


def without_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one of each class stays.

    Rows without an id stay; of rows that repeat an id and its text one stays.
    """
    found = materialize(_found(docs, **options))
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("__gone"), F.col("text_key").alias("__text")).distinct()
    key = F.xxhash64("text")
    rest = docs.where(F.col("doc_id").isNotNull()).join(gone, (F.col("doc_id") == F.col("__gone")) & (key == F.col("__text")), "left_anti")
    if not found.where("doc_id is not null").groupBy("doc_id", "text_key").count().where("count > 1").isEmpty():
        rest = rest.withColumn("__text", key).dropDuplicates(["doc_id", "__text"]).drop("__text")
    return rest.unionByName(docs.where(F.col("doc_id").isNull()))
