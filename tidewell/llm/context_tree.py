"""Language-model scoring by context-tree weighting over bytes.

A text is lower-cased (A-Z) and read as its words joined by one space and closed by a line feed.
Each byte is eight binary decisions, each a node of a tree that is kept for every context of 0 to
``DEPTH`` preceding bytes. A node predicts by the Krichevsky-Trofimov estimate of its counts;
context-tree weighting mixes the estimates of all depths with the posterior weights that the
training documents give them:

    P_w(s) = 1/2 KT(s) + 1/2 prod P_w(s with one more byte of context).

The mixture for a byte goes down its contexts as far as they occur in the training documents, so
the probabilities of the bytes after any context add up to one.

How it is spread. Documents are hashed into blocks of some MB. A block reports its distinct
byte strings of DEPTH + 1 (context and byte), packed into one row for each part of the tree, and its
distinct words, with their training counts. A part holds the strings with the same three latest context
bytes; it is built where the rows of all blocks are merged, in two steps where blocks are many.
Only the top levels, at most 2^16 contexts, go through the driver. The probability of each string
goes back, packed as well, to the blocks that hold it, where the texts are added up. What is shuffled is
linear in the corpus, and a task holds a block, one part of the tree, or what ``FAN`` blocks ask a part.

``base_score`` is the unigram model of words (c + 0.5) / (N + 0.5 (V + 1)) over training words and
text ends.

Null texts are empty: their only token is the end. Rows with a null id are never learned from.
Repeated rows are learned from as often as they occur. Very long texts are scored whole. An empty
table gives no rows; without training documents every bit costs one bit. Other columns are ignored.
Logarithms travel in single precision and are summed in double.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import fold, materialize

DEPTH = 6  # bytes of context, six at most; a string of DEPTH + 1 bytes is one number, latest context byte first
SHARED = 3  # a part of the tree holds all strings with these latest context bytes
FAN = 512  # blocks whose rows for one part meet in a task
CHUNK = 2 << 20  # bytes of text whose strings are in memory at once
PACKED = "block int, part int, n long, keys binary, counts binary"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def strings_of(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(strings at all positions of all streams, where each stream begins among them)."""
    pad = b"\n" * DEPTH
    sizes = np.array([len(s) for s in streams], np.int64)
    x = np.frombuffer(b"".join(pad + s for s in streams), np.uint8).astype(np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    at = np.arange(sizes.sum()) + np.repeat(DEPTH * (1 + np.arange(len(sizes))), sizes)
    key = x[at]
    for back in range(1, DEPTH + 1):
        key |= x[at - back] << (8 * (DEPTH + 1 - back))
    return key, starts


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)


def pack(values: np.ndarray) -> bytes:
    """Rising or small numbers, as compressed planes of the bytes of their differences."""
    steps = np.diff(values.astype("<i8"), prepend=0)
    return pa.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def unpack(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 8 * n, "zstd"), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i8")[:, 0])


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of the tree that a string belongs to, by its latest context bytes."""
    return ((keys >> (8 * (DEPTH + 1 - SHARED))) * 0x9E3779B1 >> 12) % parts


def block_counts(table: pa.Table, parts: int) -> pa.Table:
    """Distinct strings and words of one block, with their counts in its training documents."""
    block = table.column("block")[0].as_py()
    train = table.column("train").to_pylist()
    merged: list[tuple[np.ndarray, np.ndarray]] = []
    seen, others = Counter(), set()
    texts = table.column("text")
    waiting: dict[bool, list[bytes]] = {True: [], False: []}
    size = {True: 0, False: 0}

    def flush(used: bool) -> None:
        if waiting[used]:
            keys, n = np.unique(strings_of(waiting[used])[0], return_counts=True)
            merged.append((keys, n if used else np.zeros(len(n), np.int64)))
            waiting[used], size[used] = [], 0
            if len(merged) >= 8:
                merged[:] = [_merged(merged)]

    for k, used in enumerate(train):
        found = words_of(texts[k].as_py())
        if used:
            seen.update(found)
        else:
            others.update(found)
        waiting[used].append(b" ".join(found) + b"\n")
        size[used] += len(waiting[used][-1]) + DEPTH
        if size[used] >= CHUNK:
            flush(used)
    flush(True)
    flush(False)
    keys, n = _merged(merged)
    part = part_of(keys, parts)
    order = np.argsort(part, kind="stable")
    ends = np.flatnonzero(np.diff(part[order], append=-1)) + 1
    rows = [(int(part[own[0]]), len(own), pack(keys[own]), pack(n[own])) for own in np.split(order, ends[:-1])]
    others.difference_update(seen)
    tokens = pa.array([*seen, *others], pa.binary())
    counts = pa.array(np.concatenate((np.fromiter(seen.values(), np.int64, len(seen)), np.zeros(len(others), np.int64))))
    none = lambda kind: pa.nulls(len(tokens), kind)
    return pa.table(
        [
            pa.array(np.full(len(rows) + len(tokens), block, np.int32)),
            pa.concat_arrays([pa.array([r[0] for r in rows], pa.int32()), none(pa.int32())]),
            pa.concat_arrays([pa.array([r[1] for r in rows], pa.int64()), counts]),
            pa.concat_arrays([pa.array([r[2] for r in rows], pa.binary()), none(pa.binary())]),
            pa.concat_arrays([pa.array([r[3] for r in rows], pa.binary()), none(pa.binary())]),
            pa.concat_arrays([pa.nulls(len(rows), pa.binary()), tokens]),
        ],
        ["block", "part", "n", "keys", "counts", "token"],
    )


# ---- the tree -----------------------------------------------------------------------------


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma(x) for x > 0, by Stirling's series at x + 7."""
    z = x + 7
    shift = np.log(x)
    for k in range(1, 7):
        shift = shift + np.log(x + k)
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


def decisions(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node in the byte's tree, bit) of the eight decisions of each string's last byte."""
    byte = keys & 255
    j = np.arange(8)
    return (1 << j)[None, :] | (byte[:, None] >> (8 - j)[None, :]), (byte[:, None] >> (7 - j)[None, :]) & 1


class Level:
    """Nodes of all contexts of one depth: key = context << 8 | node, and their counts."""

    def __init__(self, keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None = None):
        self.keys, at = np.unique(keys, return_inverse=True)
        self.n0, self.n1 = (np.bincount(at, n, len(self.keys)) for n in (n0, n1))
        own = log_kt(self.n0, self.n1)
        if below is None:
            self.log_w, self.share = own, np.ones(len(own))
        else:
            self.log_w = np.logaddexp(own, np.bincount(at, below, len(self.keys))) - np.log(2)
            self.share = np.exp(own - np.log(2) - self.log_w)  # weight of the node's own estimate

    def parents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What the nodes with one byte less of context are made of."""
        return (self.keys >> 16 << 8) | (self.keys & 255), self.n0, self.n1, self.log_w

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(is it there, its estimate for a one, the weight of that)."""
        if not len(self.keys):
            return np.zeros(keys.shape, bool), np.full(keys.shape, 0.5), np.ones(keys.shape)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, (self.n1[at] + 0.5) / (self.n0[at] + self.n1[at] + 1), self.share[at]


def deep_levels(keys: np.ndarray, n: np.ndarray) -> list[Level]:
    """Levels DEPTH down to SHARED of the strings of one part (training counts n > 0 only)."""
    keys, n = keys[n > 0], n[n > 0].astype(float)
    node, bit = decisions(keys)
    at = ((keys >> 8)[:, None] << 8 | node).ravel()
    ones = (n[:, None] * bit).ravel()
    levels = [Level(at, np.repeat(n, 8) - ones, ones)]
    while DEPTH - len(levels) >= SHARED:
        levels.append(Level(*levels[-1].parents()))
    return levels


def top_levels(keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray) -> list[Level]:
    """Levels SHARED - 1 down to 0, from what the parts report."""
    levels = [Level(keys, n0, n1, below)]
    while len(levels) < SHARED:
        levels.append(Level(*levels[-1].parents()))
    return levels


def log_probability(keys: np.ndarray, levels: list[Level]) -> np.ndarray:
    """log10 of the mixture's probability of each string's last byte; levels from DEPTH to 0."""
    node, bit = decisions(keys)
    one = np.full(node.shape, 0.5)
    deeper = np.zeros(node.shape, bool)
    for depth, level in zip(range(DEPTH, -1, -1), levels, strict=True):
        there, estimate, share = level.find((keys >> (8 * (DEPTH + 1 - depth)))[:, None] << 8 | node)
        one = np.where(there, np.where(deeper, share * estimate + (1 - share) * one, estimate), one)
        deeper |= there
    return np.log10(np.where(bit == 1, one, 1 - one)).sum(axis=1)


def _unpacked(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """(strings, counts) of each row."""
    return [(unpack(k.as_py(), n), unpack(c.as_py(), n)) for n, k, c in zip(table.column("n").to_pylist(), table.column("keys"), table.column("counts"), strict=True)]


def merge_rows(table: pa.Table) -> pa.Table:
    """The strings of one part that occur in training documents, in one row."""
    keys, n = _merged(_unpacked(table))
    keys, n = keys[n > 0], n[n > 0]
    return pa.table([pa.array([0], pa.int32()), table.column("part").slice(0, 1), pa.array([len(keys)], pa.int64()), pa.array([pack(keys)], pa.binary()), pa.array([pack(n)], pa.binary())], ["block", "part", "n", "keys", "counts"])


def string_probabilities(packed: DataFrame, blocks: int) -> DataFrame:
    """(block, keys, n, logp) for every row of ``packed`` (PACKED)."""
    spark = packed.sparkSession
    groups = -(-blocks // FAN)
    salted = packed.withColumn("salt", F.col("block") % groups)
    merged = salted.groupBy("part", "salt").applyInArrow(merge_rows, PACKED)
    if groups > 1:
        merged = merged.groupBy("part").applyInArrow(merge_rows, PACKED)
    merged = materialize(merged)

    def report(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, n in _unpacked(pa.Table.from_batches([batch])):
                level = deep_levels(keys, n)[-1]
                up, at = np.unique(level.parents()[0], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(up, pa.int64()), *(pa.array(np.bincount(at, v, len(up)), pa.float64()) for v in (level.n0, level.n1, level.log_w))], ["node", "n0", "n1", "below"])

    top = merged.mapInArrow(report, "node long, n0 double, n1 double, below double").groupBy("node").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "below"))).toPandas()
    upper = spark.sparkContext.broadcast(top_levels(*(top[c].to_numpy() for c in ("node", "n0", "n1", "below"))))  # of 2^16 contexts at most

    def price(asked: pa.Table, part: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int32(), pa.int64(), pa.binary(), pa.binary())], ["block", "n", "keys", "logp"])
        levels = [*deep_levels(*_unpacked(part)[0]), *upper.value]
        sizes = asked.column("n").to_pylist()
        own = [unpack(k.as_py(), n) for n, k in zip(sizes, asked.column("keys"), strict=True)]
        keys = np.unique(np.concatenate(own))
        logp = np.concatenate([log_probability(keys[at : at + (1 << 17)], levels) for at in range(0, len(keys), 1 << 17)]).astype("<f4")
        return pa.table([asked.column("block"), asked.column("n"), asked.column("keys"), pa.array([logp[np.searchsorted(keys, k)].tobytes() for k in own], pa.binary())], ["block", "n", "keys", "logp"])

    parts = merged.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return salted.select("block", "part", "n", "keys", "salt").groupBy("part", "salt").cogroup(parts.groupBy("part", "salt")).applyInArrow(price, "block int, n long, keys binary, logp binary")


# ---- documents ----------------------------------------------------------------------------


def held_out() -> Column:
    """Documents that are not learned from: a fifth, by the checksum of their id."""
    return F.coalesce(fold("doc_id") == 1, F.lit(True))


def score_documents(docs: DataFrame, block_bytes: int = 24 << 20) -> DataFrame:
    """SCORED for every row of ``docs(doc_id, text)``."""
    total = docs.agg(F.sum(F.octet_length("text")), F.sum((~held_out()).cast("long"))).first()
    size, train_docs = total[0] or 0, total[1] or 0
    # Small inputs are cut finer, so that all cores have work; the results are the same.
    blocks = max(1, -(-size // block_bytes), min(docs.sparkSession.sparkContext.defaultParallelism, -(-8 * size // block_bytes)))
    parts = min(4096, blocks)
    dealt = docs.select("doc_id", "text", held_out().alias("held_out"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"))
    counts = materialize(dealt.select("text", (~F.col("held_out")).alias("train"), "block").groupBy("block").applyInArrow(lambda t: block_counts(t, parts), PACKED + ", token binary"))
    packed, tokens = counts.where("part is not null").drop("token"), counts.where("token is not null").select("block", "token", "n")

    known = materialize(tokens.groupBy("token").agg(F.sum("n").alias("c")))
    sums = known.agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1))).first()
    n_tokens, n_kinds = (sums[0] or 0) + train_docs, (sums[1] or 0) + (train_docs > 0)
    base = F.log10((F.col("c") + 0.5) / F.lit(n_tokens + 0.5 * (n_kinds + 1)))
    values = string_probabilities(packed, blocks).select("block", "n", "keys", "logp", F.lit(None).cast("binary").alias("token"), F.lit(None).cast("double").alias("value"), F.lit(True).alias("known")).unionByName(
        tokens.select("block", "token").join(known, "token").select("block", F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("logp"), "token", base.alias("value"), (F.col("c") > 0).alias("known"))
    )
    end = float(np.log10((train_docs + 0.5) / (n_tokens + 0.5 * (n_kinds + 1))))

    def add_up(texts: pa.Table, facts: pa.Table) -> pa.Table:
        is_token = facts.column("token").is_valid()
        words, strings = facts.select(["token", "value", "known"]).filter(is_token), facts.select(["n", "keys", "logp"]).filter(facts.column("keys").is_valid())
        price = dict(zip(words.column("token").to_pylist(), words.column("value").to_pylist(), strict=True))
        unknown = {t for t, k in zip(words.column("token").to_pylist(), words.column("known").to_pylist(), strict=True) if not k}
        sizes = strings.column("n").to_pylist()
        keys = np.concatenate([unpack(k.as_py(), n) for n, k in zip(sizes, strings.column("keys"), strict=True)])
        logp = np.concatenate([np.frombuffer(x.as_py(), "<f4") for x in strings.column("logp")]).astype(np.float64)
        order = np.argsort(keys)
        keys, logp = keys[order], logp[order]
        bodies = texts.column("text")
        rows: list[tuple[int, int, float, int]] = []
        scores: list[np.ndarray] = []
        waiting: list[bytes] = []
        size = 0

        def flush() -> None:
            if waiting:
                found, starts = strings_of(waiting)
                by_key = np.argsort(found)  # sorted look-ups stay in the processor's cache
                cost = np.empty(len(found))
                cost[by_key] = logp[np.searchsorted(keys, found[by_key])]
                scores.append(np.add.reduceat(cost, starts))
                waiting.clear()

        for k in range(len(bodies)):
            found = words_of(bodies[k].as_py())
            fresh = 0 if unknown.isdisjoint(found) else sum(w in unknown for w in found)
            waiting.append(b" ".join(found) + b"\n")
            rows.append((len(found) + 1, len(found) + (train_docs > 0) - fresh, sum(map(price.__getitem__, found)) + end, len(waiting[-1])))
            size += len(waiting[-1])
            if size >= CHUNK:
                flush()
                size = 0
        flush()
        n_tok, n_known, based, n_bytes = (np.array(c) for c in zip(*rows, strict=True))
        score = np.concatenate(scores)
        return pa.table(
            [texts.column("doc_id"), texts.column("held_out"), pa.array(n_tok, pa.int64()), pa.array(n_known, pa.int64()), pa.array(np.full(len(rows), n_tokens), pa.int64()), pa.array(based, pa.float64()), pa.array(score), pa.array(n_bytes, pa.int64()), pa.array(score * -np.log2(10) / n_bytes)],
            [c.split()[0] for c in SCORED.split(", ")],
        )

    return dealt.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(add_up, SCORED)
