"""Toxicity severity by cumulative-link (proportional-odds) regression on word features.

P(grade > k) = sigmoid(w . x - threshold_k): the weights are shared by all thresholds, which are
ordered. The expected severity is the sum of these probabilities.

Grades. The labels say only whether a document is toxic, so the ordinal target has to be made of them:
grade 0 is a document labelled clean; a document labelled toxic gets grade 1, 2 or 3 by the third of the
labelled toxic documents that its share of words that mark toxic documents falls in. How severe a
toxic document is follows its density of such words by that definition; whether it is toxic does not.

Features are sparse: words, and beginnings of words of 4 to 7 letters, each as log(1 + its
occurrences per hundred words). The vocabulary holds the ``vocabulary`` terms with the greatest
likelihood-ratio statistic, at least ``significance``, of those at least three times as frequent in toxic
documents as in clean ones, or the other way round. Terms are counted in all documents of the sample.
The model is fitted on at most ``sample`` labelled documents, in the order of a hash of doc_id; identical texts
count once. Every document is scored whole, however long.

Null and empty texts have severity 0 and are not toxic. Several labels of one document: toxic if
any says so; null labels are not used. Where no mark of toxic documents reaches ``significance``, as with
a dozen labels, those that reach ``LEAST`` are taken; where none does, and without labels of both kinds,
nothing is toxic. Repeated rows and rows
without an id give repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import FragmentCache

GRADES = 4
LEAST = 3.84  # chance makes one term in twenty as telling
SCORED = "severity double, grade int, toxic_probability double"
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def terms(word: str) -> list[str]:
    """A word and its beginnings, as features."""
    return [word, *(f"{word[:k]}*" for k in range(4, 8) if len(word) > k)]


def features(text: str, columns: dict[str, int], known: dict[str, tuple[int, ...]], marks: frozenset[int] | set[int] = frozenset()) -> tuple[dict[int, float], float]:
    """({column: value}, share of the text's words with a column in ``marks``). known: the columns of words met before."""
    every = words(text)
    counts: dict[int, int] = {}
    marked = 0
    for word, n in Counter(every).items():
        for column in (at := known[word]):
            counts[column] = counts.get(column, 0) + n
        if not marks.isdisjoint(at):
            marked += n
    size = max(1, len(every))
    return {c: float(np.log1p(100 * n / size)) for c, n in counts.items()}, marked / size


def word_columns(columns: dict[str, int]) -> FragmentCache:
    return FragmentCache(lambda word: tuple(columns[t] for t in terms(word) if t in columns), 100_000)


@dataclass
class Model:
    """Word weights, and the thresholds between grades in rising order."""

    columns: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.full(GRADES - 1, 30.0))

    known: FragmentCache | None = None

    def exceed(self, text: str | None) -> np.ndarray:
        """P(grade > k) for k = 0, 1, 2."""
        if self.known is None:
            self.known = word_columns(self.columns)
        found = features(text, self.columns, self.known)[0] if text and self.columns else {}
        margin = sum(x * self.weights[c] for c, x in found.items())
        return 1 / (1 + np.exp(np.clip(self.thresholds - margin, -50, 50)))


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, width: int, l2: float = 1e-3, steps: int = 600, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of the cumulative-link model by Adam on the mean log-loss.

    Thresholds are the first one plus running sums of exponentials, which keeps them ordered.
    """
    n, levels = len(grades), GRADES - 1
    share = np.array([np.clip((grades > k).mean(), 1e-3, 1 - 1e-3) for k in range(levels)])
    start = -np.log(share / (1 - share))
    free = np.concatenate((start[:1], np.log(np.maximum(np.diff(start), 0.05))))
    w = np.zeros(width)
    moments = [np.zeros(width), np.zeros(width), np.zeros(levels), np.zeros(levels)]
    for step in range(1, steps + 1):
        theta = np.cumsum(np.concatenate((free[:1], np.exp(free[1:]))))
        margin = np.bincount(rows, values * w[columns], minlength=n)
        above = 1 / (1 + np.exp(np.clip(theta[None, :] - margin[:, None], -50, 50)))  # P(y > k)
        padded = np.concatenate((np.ones((n, 1)), above, np.zeros((n, 1))), axis=1)
        slope = padded * (1 - padded)
        i = np.arange(n)
        p = np.maximum(padded[i, grades] - padded[i, grades + 1], 1e-12)
        by_margin = -(slope[i, grades] - slope[i, grades + 1]) / p / n
        by_theta = np.zeros(levels)
        upper, lower = grades > 0, grades < levels
        np.add.at(by_theta, grades[upper] - 1, (slope[i, grades] / p / n)[upper])
        np.add.at(by_theta, grades[lower], -(slope[i, grades + 1] / p / n)[lower])
        by_w = np.bincount(columns, values * by_margin[rows], minlength=width) + l2 * w
        by_free = np.concatenate(([by_theta.sum()], [by_theta[k:].sum() * np.exp(free[k]) for k in range(1, levels)]))
        for value, gradient, first, second in ((w, by_w, *moments[:2]), (free, by_free, *moments[2:])):
            first += 0.1 * (gradient - first)
            second += 0.001 * (gradient * gradient - second)
            value -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return w, np.cumsum(np.concatenate((free[:1], np.exp(free[1:]))))


def _likelihood_ratio(na: float, nb: float) -> Column:
    """G statistic of a term in ``toxic`` of na and ``clean`` of nb documents."""

    def part(k: Column, n: float) -> Column:
        expected = n * (F.col("toxic") + F.col("clean")) / (na + nb)
        rest = n - k
        return F.when(k > 0, k * F.log(k / expected)).otherwise(0.0) + F.when(rest > 0, rest * F.log(rest / (n - expected))).otherwise(0.0)

    return 2 * (part(F.col("toxic"), na) + part(F.col("clean"), nb))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, vocabulary: int = 1000, significance: float = 15.0) -> Model:
    """Learn from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("is_toxic"))
    drawn = F.broadcast(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    labelled = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(drawn, "doc_id").groupBy(F.sha2("text", 256).alias("same")).agg(F.first("text").alias("text"), F.max("is_toxic").alias("is_toxic")).select("text", "is_toxic").persist()

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean, toxic = Counter(), Counter()
            for text, mark in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                (toxic if mark else clean).update({t for w in set(words(text.as_py())) for t in terms(w)})
            found = list({*clean, *toxic})
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([toxic[t] for t in found], pa.int64()), pa.array([clean[t] for t in found], pa.int64())], ["term", "toxic", "clean"])

    sizes = {r["is_toxic"]: r["n"] for r in labelled.groupBy("is_toxic").agg(F.count("*").alias("n")).collect()}
    na, nb = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    if not na or not nb:
        labelled.unpersist()
        return Model()
    counts = labelled.mapInArrow(spread, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    lift = (F.col("toxic") + 0.5) / na / ((F.col("clean") + 0.5) / nb)
    telling = (F.col("toxic") + F.col("clean") >= 3) & ((lift >= 3) | (lift <= 1 / 3)) & (F.col("g") >= min(significance, LEAST))
    marked = counts.withColumn("g", _likelihood_ratio(na, nb)).where(telling).orderBy(F.desc("g"), "term").limit(vocabulary).select("term", (lift >= 3).alias("marks"), "g").toPandas()
    strong = marked[marked["g"] >= significance].reset_index(drop=True)
    marked = strong if strong["marks"].any() else marked
    if not marked["marks"].any():
        labelled.unpersist()
        return Model()
    columns = {term: k for k, term in enumerate(marked["term"])}
    marks = set(np.flatnonzero(marked["marks"]).tolist())

    def sparse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_columns(columns)
        for batch in batches:
            out = []
            for text, mark in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found, share = features(text.as_py(), columns, known, marks)
                out.append((mark, share, list(found), list(found.values())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.float64())), strict=True)] if out else [pa.array([], t) for t in (pa.int32(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.float64()))], ["is_toxic", "density", "at", "x"])

    picked = labelled.mapInArrow(sparse, "is_toxic int, density double, at array<int>, x array<double>").toPandas()
    labelled.unpersist()
    picked = picked.sort_values(["is_toxic", "density"], kind="stable", ignore_index=True)
    toxic, density = picked["is_toxic"].to_numpy() > 0, picked["density"].to_numpy()
    grades = np.where(toxic, 1 + np.searchsorted(np.quantile(density[toxic], [1 / 3, 2 / 3]), density, side="right"), 0)
    lengths = picked["at"].map(len).to_numpy()
    rows = np.repeat(np.arange(len(picked)), lengths)
    at = np.concatenate([np.asarray(x, np.int64) for x in picked["at"]]) if lengths.sum() else np.zeros(0, np.int64)
    x = np.concatenate([np.asarray(v, float) for v in picked["x"]]) if lengths.sum() else np.zeros(0)
    w, theta = fit_ordinal(rows, at, x, grades.astype(np.int64), len(columns))
    return Model(columns, w, theta)


def scorer(spark, model: Model):
    """A function of a text column: struct(severity, grade, toxic_probability)."""
    from pyspark.sql.functions import arrow_udf

    shared = spark.sparkContext.broadcast(model)  # at most ``vocabulary`` words

    @arrow_udf(SCORED)
    def score(texts: pa.Array) -> pa.Array:
        above = [shared.value.exceed(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([float(p.sum()) for p in above], pa.float64()), pa.array([int((p >= 0.5).sum()) for p in above], pa.int32()), pa.array([float(p[0]) for p in above], pa.float64())], ["severity", "grade", "toxic_probability"])

    return score


def grade_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, severity (0 to 3), grade, toxic_probability, toxic of every row of ``docs``."""
    score = scorer(docs.sparkSession, fit(docs, labels, **options))
    return docs.select("doc_id", score("text").alias("s")).select("doc_id", "s.severity", "s.grade", "s.toxic_probability", (F.col("s.grade") >= 1).alias("toxic"))


def without_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose predicted grade is 0."""
    score = scorer(docs.sparkSession, fit(docs, labels, **options))
    return docs.where(score("text")["grade"] < 1)
