"""Exact top-k search in Hamming space by incremental multi-index hashing.

A code of any number of bits is cut into m segments, each within one 64-bit word, of about log2 of
the number of rows. Two codes that differ in at most ``m * r + i`` bits agree, up to r bits, in one
of the segments 0 to i, or up to r - 1 bits in one of the others. So the search radius grows from
0, and in each round a query probes only as many segments as its kth verified distance still asks
for; it is done when that distance is provably covered.

How it is spread. Index rows are dealt by segment and by the leading bits of the segment's value;
parts with more than ``part_rows`` rows are cut further, whatever value makes them large. A query
goes to the parts whose leading bits are within the radius, looks the values at exactly this
radius up, verifies whole codes, and returns its best k of the part, none worse than what it has.
Only a part that more than ``query_rows`` probes of a round go to is read by several tasks.
Of rows with one code only the k + 1 smallest ids can ever be among the best; that is all that is
indexed of them, so a very common code costs no more than others.

Vectors of different lengths have codes of different lengths, each of which is searched among its
own. Rows with a null id or without a code are neither searched nor found. Vectors that are null,
empty or hold null or non-finite components have no code. A row does not find its own id; repeated
rows are found once. Ties go to the smallest id. Fewer than k other rows: all of them. An empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import materialize

WORD = 64
FOUND = "query_id long, vec_id long, distance int"
RANKED = "query_id long, rank int, vec_id long, distance int"


def sign_code(vector: str) -> Column:
    """The signs of a vector's components as 64-bit numbers, the first component of each in front."""
    v = F.col(vector)
    usable = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    words = F.sequence(F.lit(0), F.ceil(F.size(v) / WORD).cast("int") - 1)
    bits = F.transform(v, lambda x: F.when(x > 0, "1").otherwise("0"))
    return F.when(F.coalesce(usable, F.lit(False)), F.transform(words, lambda w: F.conv(F.array_join(F.slice(bits, w * WORD + 1, F.lit(WORD)), ""), 2, -10).cast("long")))


def segments(bits: int, rows: int) -> list[tuple[int, int, int]]:
    """(word, shift, width) of each segment of a code, for an index of so many rows."""
    out = []
    for word in range(-(-bits // WORD)):
        own = min(WORD, bits - word * WORD)
        m = max(1, min(8, own, max(2, round(own / math.log2(max(rows, 2))))))
        ends = [own * k // m for k in range(m + 1)]
        out += [(word, a, b - a) for a, b in zip(ends, ends[1:], strict=False)]
    return out


def masks(width: int, radius: int) -> np.ndarray:
    """All numbers of ``width`` bits of which ``radius`` are set."""
    if radius > width:
        return np.zeros(0, np.uint64)
    places = np.array(list(combinations(range(width), radius)), np.uint64).reshape(math.comb(width, radius), radius)
    return (np.uint64(1) << places).sum(axis=1, dtype=np.uint64)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """A column of arrays of longs as a matrix of words."""
    flat = column.combine_chunks().flatten().to_numpy().view(np.uint64)
    return flat.reshape(len(column), -1)


def _probe(table: dict[str, np.ndarray], ids: np.ndarray, codes: np.ndarray, worst: np.ndarray, own: np.ndarray, flips: np.ndarray, k: int) -> list[np.ndarray]:
    """(query, id, distance) of the best k rows of a part for each query, at this radius."""
    probes = (own[:, None] ^ flips[None, :]).ravel()
    at = np.minimum(np.searchsorted(table["value"], probes), len(table["value"]) - 1)
    hit = np.flatnonzero(table["value"][at] == probes)
    start, size = table["start"][at[hit]], table["size"][at[hit]]
    query = np.repeat(hit // len(flips), size)
    row = np.arange(size.sum()) + np.repeat(start - np.concatenate(([0], np.cumsum(size)))[:-1], size)
    distance = np.bitwise_count(codes[query] ^ table["code"][row]).sum(axis=1, dtype=np.int32)
    good = np.flatnonzero((distance <= worst[query]) & (ids[query] != table["id"][row]))
    query, row, distance = query[good], row[good], distance[good]
    order = np.lexsort((table["id"][row], distance, query))
    query, row, distance = query[order], row[order], distance[order]
    first = np.searchsorted(query, query)
    best = np.arange(len(query)) - first < k
    return [ids[query[best]], table["id"][row[best]], distance[best]]


def search(rows: DataFrame, queries: DataFrame, k: int = 10, bits: int = WORD, part_rows: int = 1 << 17, query_rows: int = 1 << 16) -> DataFrame:
    """query_id, rank, vec_id, distance: the k nearest rows of ``rows(vec_id, code)`` for each of
    ``queries(query_id, code)``, all codes being of ``bits`` bits; see the module."""
    spark = rows.sparkSession
    by_code = Window.partitionBy("code").orderBy("vec_id")
    usable = rows.select("vec_id", "code").where("vec_id is not null and code is not null").distinct()
    index = materialize(usable.withColumn("n", F.row_number().over(by_code)).where(F.col("n") <= k + 1).drop("n"))
    asked = queries.select("query_id", "code").where("query_id is not null and code is not null").distinct()
    total = index.count()
    cuts = segments(bits, total)
    lead = min(min(w for _, _, w in cuts), max(0, math.ceil(math.log2(max(1, total) / max(2048, total >> 12)))))

    def value(segment: int) -> Column:
        word, shift, width = cuts[segment]
        return F.shiftrightunsigned(F.col("code")[word], shift).bitwiseAND(F.lit((1 << width) - 1 if width < WORD else -1))

    every = F.array(*(F.struct(F.lit(s).alias("segment"), value(s).alias("value"), F.shiftrightunsigned(value(s), w - lead).cast("int").alias("part")) for s, (_, _, w) in enumerate(cuts)))
    dealt = materialize(index.select("vec_id", "code", F.explode(every).alias("e")).select("vec_id", "code", "e.*"))
    # 2^lead parts of each segment at most, lead being 12 or less: the bound of this table and of the one of probes.
    sizes = materialize(dealt.groupBy("segment", "part").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("pieces")))
    key = ["segment", "part", "piece", "block"]

    best: DataFrame | None = None
    state = asked.select("query_id", "code", F.lit(bits).alias("worst"), F.lit(0).cast("long").alias("found"))
    for radius in range(max(w for _, _, w in cuts) + 1):
        covered = len(cuts) * radius - 1  # by the rounds before
        state = materialize(state.where((F.col("worst") > covered) & (F.col("found") < total)))
        if state.isEmpty():
            break
        last = F.least(F.lit(len(cuts) - 1), F.col("worst") - F.lit(covered + 1))
        near = F.array(*(F.lit(int(p)) for p in range(1 << lead) if p.bit_count() <= radius))
        probes = state.select("query_id", "code", "worst", F.explode(F.sequence(F.lit(0), last)).alias("segment"))
        own = F.element_at(F.array(*(value(s) for s in range(len(cuts)))), F.col("segment") + 1)
        width = F.element_at(F.array(*(F.lit(w) for _, _, w in cuts)), F.col("segment") + 1)
        probes = probes.withColumn("value", own).withColumn("lead", F.expr(f"shiftrightunsigned(value, {_sql_width(cuts)} - {lead})").cast("int"))
        probes = probes.where(width >= radius).withColumn("flip", F.explode(near)).withColumn("part", F.col("lead").bitwiseXOR(F.col("flip")))
        # Parts that many probes go to are read by several blocks of them.
        met = probes.groupBy("segment", "part").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("blocks"))
        ways = F.broadcast(materialize(sizes.join(met, ["segment", "part"])))
        probes = probes.join(ways, ["segment", "part"]).withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
        probes = probes.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select(*key, "query_id", "code", "worst", "value", "flip")
        part = dealt.join(ways, ["segment", "part"]).withColumn("piece", F.pmod(F.xxhash64("vec_id"), F.col("pieces")).cast("int"))
        part = part.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*key, "vec_id", "code", "value")

        def look_up(tables: pa.Table, probing: pa.Table) -> pa.Table:
            if not tables.num_rows or not probing.num_rows:
                return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int32())], ["query_id", "vec_id", "distance"])
            _, _, width = cuts[probing.column("segment")[0].as_py()]
            values = tables.column("value").to_numpy().astype(np.uint64)
            order = np.argsort(values, kind="stable")
            distinct, start, size = np.unique(values[order], return_index=True, return_counts=True)
            table = {"value": distinct, "start": start, "size": size, "code": _codes(tables.column("code"))[order], "id": tables.column("vec_id").to_numpy()[order]}
            asking, codes = probing.select(["query_id", "worst", "value", "flip"]).to_pandas(), _codes(probing.column("code"))
            out = []
            for flip, some in asking.groupby("flip"):
                # Bits outside the leading ones that complete the radius.
                flips = masks(width - lead, radius - int(flip).bit_count()) | np.uint64(int(flip) << (width - lead))
                if not len(flips):
                    continue
                step = max(1, (1 << 19) // len(flips))
                for at in range(0, len(some), step):
                    now = some.iloc[at : at + step]
                    out.append(_probe(table, now["query_id"].to_numpy(), codes[now.index], now["worst"].to_numpy(), now["value"].to_numpy().astype(np.uint64), flips, k))
            if not out:
                return look_up(tables.slice(0, 0), probing)
            query, row, distance = (np.concatenate([o[j] for o in out]) for j in range(3))
            frame = pd.DataFrame({"query_id": query, "vec_id": row, "distance": distance}).sort_values(["query_id", "distance", "vec_id"])
            frame = frame[frame.groupby("query_id").cumcount() < k]
            return pa.Table.from_pandas(frame, pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("distance", pa.int32())]), preserve_index=False)

        found = part.groupBy(*key).cogroup(probes.groupBy(*key)).applyInArrow(look_up, FOUND)
        merged = (found if best is None else best.drop("rank").unionByName(found)).groupBy("query_id", "vec_id").agg(F.min("distance").alias("distance"))
        by_query = Window.partitionBy("query_id").orderBy("distance", "vec_id")
        best = materialize(merged.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k))
        reached = best.groupBy("query_id").agg(F.max("distance").alias("kth"), F.count("*").alias("n"))
        state = state.join(reached, "query_id", "left").select("query_id", "code", F.when(F.col("n") >= k, F.col("kth")).otherwise(F.lit(bits)).alias("worst"), F.when(F.col("n") >= total - 1, F.lit(total)).otherwise(F.lit(0)).cast("long").alias("found"))
    if best is None:
        return spark.createDataFrame([], RANKED)
    return best.select("query_id", "rank", "vec_id", "distance")


def _sql_width(cuts: list[tuple[int, int, int]]) -> str:
    return f"element_at(array({', '.join(str(w) for _, _, w in cuts)}), segment + 1)"


def search_table(embeddings: DataFrame, k: int = 10, every: int = 20) -> DataFrame:
    """The k nearest rows, by the signs of their components, of each row of ``embeddings(vec_id,
    embedding)`` whose id is divisible by ``every``, among all rows of its length."""
    coded = embeddings.select("vec_id", F.size("embedding").alias("bits"), sign_code("embedding").alias("code")).where(F.col("code").isNotNull())
    lengths = sorted(r["bits"] for r in coded.select("bits").distinct().collect())  # a table of vectors has a few
    found = embeddings.sparkSession.createDataFrame([], RANKED)
    for bits in lengths:
        own = coded.where(F.col("bits") == bits)
        found = found.unionByName(search(own, own.where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id"), k, bits))
    return found
