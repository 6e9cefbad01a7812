"""Spelling variants: words of a corpus that differ by one character, found by Aho-Corasick halves.

1. ``word_table``: runs of letters, lower-cased, counted (partial sums before the shuffle).
2. ``routes``: a word is cut into two segments, of which a single edit leaves one as it is. A word of
   length L holds its front L // 2 characters and the rest; a word looks for the segments of words of its
   length, one less and one more. A segment that more than ``crowd`` words look for is divided further: its
   words share it, so the edit is in what is left of them, and that is cut into two again, round after
   round, until no segment is crowded. So a frequent prefix is no large group, and no pair is made twice.
3. ``scan``: segments are dealt into shards by hash. A shard is a task, whose Aho-Corasick automaton holds
   the segments; all words that look for one of them run through it. A hit must lie at the front or the
   end, as its segment did, and the lengths must agree; what is left is compared letter by letter, in blocks.
   Each word leaves a count and its best neighbour per shard, never its pairs.
4. A form has at least ``ratio`` times the count, so chains of forms are short; roots are found by doubling.

Only letters U+0041 to U+00FF are words' letters, so a word is one byte a letter here. Null and empty texts
hold no words; a null id counts as the empty string. Repeated rows count as often as they occur; ties go to
the smallest word in code-point order. An empty table gives no rows. Very long texts are read whole, very
long words are words too. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FREE = 1 << 20  # no limit for the common front


# ---- words --------------------------------------------------------------------------------


def word_table(docs: DataFrame, shortest: int = 7, fewest: int = 2, drop: int = 31) -> DataFrame:
    """word and n of all words of ``docs(doc_id, text)``.

    A run loses a letter where ``drop`` divides the crc32 of ``<doc_id>:<run>``. Runs under ``shortest``
    letters can't be words, so the pattern does not return them.
    """
    runs = F.regexp_extract_all("text", F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{shortest},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    found = found.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "utf-8"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = found.select(F.when(h % drop == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= fewest)


# ---- segments -----------------------------------------------------------------------------

# A route is a word that looks for the segments of words of ``size`` letters: their first ``a`` and last ``b``.
# Where the size is its own, it holds the segment too. ``before`` keeps a pair from being met twice: a pair
# that has so many letters in front in common is another segment's.
ROUTE = "word", "n", "size", "a", "b", "before"


def _key(word: str = "word") -> Column:
    return F.xxhash64("size", "a", "b", F.substring(word, F.lit(1), F.col("a")), F.substring(word, F.length(word) - F.col("b") + 1, F.col("b")))


def _own() -> Column:
    return F.col("size") == F.length("word")


def first_routes(words: DataFrame, shortest: int) -> DataFrame:
    size, half = F.length("word"), lambda s: (s / 2).cast("int")
    both = []
    for step in (-1, 0, 1):
        s = (size + step).cast("int")
        both += [F.struct(s.alias("size"), half(s).alias("a"), F.lit(0).alias("b"), F.lit(_FREE).alias("before")), F.struct(s.alias("size"), F.lit(0).alias("a"), (s - half(s)).alias("b"), half(s).alias("before"))]
    routes = words.select("word", "n", F.inline(F.array(*both))).where(F.col("size") >= shortest)
    return routes.withColumn("key", _key())


def divided(routes: DataFrame) -> DataFrame:
    """The routes to both parts of what their segments leave open."""
    left = F.col("size") - F.col("a") - F.col("b")
    front = (left / 2).cast("int")
    near = F.struct("size", (F.col("a") + front).alias("a"), "b", "before")
    far = F.struct("size", "a", (F.col("b") + left - front).alias("b"), F.least("before", F.col("a") + front).alias("before"))
    return routes.select("word", "n", F.inline(F.array(near, far))).withColumn("key", _key())


def settled_routes(words: DataFrame, shortest: int, crowd: int) -> DataFrame:
    """Routes to segments that at most ``crowd`` words look for, or that leave one letter open."""
    routes, done = first_routes(words, shortest), None
    while True:
        open_ = F.col("size") - F.col("a") - F.col("b") > 1
        crowded = materialize(routes.where(open_).groupBy("key").agg(F.count("*").alias("c"), F.max(_own()).alias("held")).where(F.col("held") & (F.col("c") > crowd)).select("key", F.lit(True).alias("crowded")))
        if crowded.isEmpty():
            return routes if done is None else done.unionByName(routes)
        marked = materialize(routes.join(crowded, "key", "left"))
        calm = marked.where("crowded is null or size - a - b <= 1").select(*ROUTE, "key")
        done = calm if done is None else done.unionByName(calm)
        routes = divided(marked.where("crowded and size - a - b > 1"))


# ---- shards -------------------------------------------------------------------------------


class Shard:
    """An automaton of segments, and the words that hold each."""

    def __init__(self, words: list[str], size: np.ndarray, a: np.ndarray, b: np.ndarray, before: np.ndarray):
        """words: those that hold the segment given by their first a and last b letters."""
        import ahocorasick

        groups: dict[tuple[int, str, str], list[int]] = {}
        for k, (word, m, front, back) in enumerate(zip(words, size.tolist(), a.tolist(), b.tolist(), strict=True)):
            groups.setdefault((m, word[:front], word[m - back :]), []).append(k)
        #: Of each segment in the automaton: is it in front, the size, the other segment, the group's number.
        at: dict[str, list[tuple[bool, int, str, int]]] = {}
        for g, (m, front, back) in enumerate(groups):
            in_front = len(front) >= len(back)
            at.setdefault(front if in_front else back, []).append((in_front, m, back if in_front else front, g))
        self.automaton = ahocorasick.Automaton()
        for segment, found in at.items():
            self.automaton.add_word(segment, (len(segment), found))
        if at:
            self.automaton.make_automaton()
        self.members = np.array([k for g in groups.values() for k in g], np.int64)
        self.counts = np.array([len(g) for g in groups.values()], np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.before = np.array([before[g[0]] for g in groups.values()], np.int64)

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, group) wherever a segment lies in a text where a word one edit away has it."""
        who: list[int] = []
        group: list[int] = []
        if not len(self.counts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        for t, text in enumerate(texts):
            n = len(text)
            for end, (length, found) in self.automaton.iter(text):
                in_front, at_end = end + 1 == length, end + 1 == n
                if in_front or at_end:
                    for front, m, other, g in found:
                        if (in_front if front else at_end) and -1 <= n - m <= 1 and (not other or (text.endswith(other) if front else text.startswith(other))):
                            who.append(t)
                            group.append(g)
        return np.array(who, np.int64), np.array(group, np.int64)


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of bytes for each word, filled up with zeros on the right, and the lengths."""
    sizes = np.array([len(w) for w in words], np.int64)
    width = int(sizes.max(initial=0)) + 1
    return np.frombuffer(b"".join(w.encode("latin-1").ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width), sizes


def one_edit(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Does row x differ from row y by exactly one inserted, deleted or replaced letter; letters in common in front."""
    width = x.shape[1]
    differs = x != y
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    good = (nx == ny) & (differs.sum(axis=1) == 1)
    for short, long, rows in ((x, y, np.flatnonzero(ny == nx + 1)), (y, x, np.flatnonzero(nx == ny + 1))):
        shifted = short[rows, :-1] == long[rows, 1:]
        good[rows] = (shifted | (np.arange(width - 1) < common[rows, None])).all(axis=1)
    return good, common


def _pairs(hits: tuple[np.ndarray, np.ndarray], shard: Shard, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (text, member, group) of all hits."""
    who, group = hits
    ends = np.cumsum(shard.counts[group])
    at = 0
    while at < len(who):
        base = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, base + block, "right")))
        g = group[at:upto]
        size = shard.counts[g]
        offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        yield np.repeat(who[at:upto], size), shard.members[np.repeat(shard.starts[g], size) + offset], np.repeat(g, size)
        at = upto


def scan(table: pa.Table, block: int = 200_000) -> pa.Table:
    """word, n_near, best_n, best of the words of one shard that have a neighbour in it."""
    columns = {c: table.column(c).to_numpy() for c in ("n", "size", "a", "b", "before")}
    every = table.column("word").to_pylist()
    own = np.flatnonzero(columns["size"] == np.array([len(w) for w in every]))
    shard = Shard([every[k] for k in own], *(columns[c][own] for c in ("size", "a", "b", "before")))
    texts = sorted(set(every))
    place = {w: t for t, w in enumerate(texts)}
    number = np.array([place[w] for w in every], np.int64)
    n = np.zeros(len(texts), np.int64)
    n[number] = columns["n"]
    rows, sizes = letters(texts)
    near, best = np.zeros(len(texts), np.int64), np.full(len(texts), -1, np.int64)
    order = np.lexsort((np.arange(len(texts))[::-1], n))  # the last is the best: largest n, then smallest word
    rank = np.empty(len(texts), np.int64)
    rank[order] = np.arange(len(texts))
    for t, member, g in _pairs(shard.hits(texts), shard, block):
        w = number[own[member]]
        good, common = one_edit(rows[t], sizes[t], rows[w], sizes[w])
        good &= common < shard.before[g]
        near += np.bincount(t[good], minlength=len(texts))
        np.maximum.at(best, t[good], rank[w[good]])
    found = np.flatnonzero(near)
    chosen = order[best[found]] if len(found) else found
    return pa.table([pa.array([texts[k] for k in found], pa.string()), pa.array(near[found]), pa.array(n[chosen]), pa.array([texts[k] for k in chosen], pa.string())], ["word", "n_near", "best_n", "best"])


# ---- forms --------------------------------------------------------------------------------


def neighbours(words: DataFrame, shortest: int = 7, crowd: int = 512, shard_rows: int = 60_000) -> DataFrame:
    """word, n_near, best and best_n of those of ``words(word, n)`` that have a word one edit away; words are distinct."""
    routes = settled_routes(words, shortest, crowd)
    shards = max(1, -(-routes.count() // shard_rows))
    dealt = routes.select(*ROUTE, F.pmod("key", F.lit(shards)).alias("shard"))
    found = dealt.groupBy("shard").applyInArrow(lambda rows: scan(rows), "word string, n_near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("n"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("first")).select("word", "n_near", F.col("first.best").alias("best"), (-F.col("first.n")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms(word, form)``, each word once and no cycles; every turn doubles the steps taken."""
    now = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if now.join(on, "root", "left_semi").isEmpty():
            return now
        now = materialize(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")))


def variants(docs: DataFrame, shortest: int = 7, ratio: int = 10, crowd: int = 512) -> DataFrame:
    """word, form, root, n, n_near and form_n of all words of ``docs(doc_id, text)``."""
    words = materialize(word_table(docs, shortest))
    near = neighbours(words, shortest, crowd)
    enough = F.col("best_n") >= ratio * F.col("n")
    formed = materialize(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best")).alias("form"), F.when(enough, F.col("best_n")).alias("form_n")))
    root = roots(formed.where("form is not null"))
    return formed.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
