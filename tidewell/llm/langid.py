"""Language identification by sparse multinomial logistic regression.

Features are counts of character 1-, 2- and 3-grams of the lower-cased letters (everything else
is one space), hashed to ``2**bits`` columns, damped (1 + log count), weighted by inverse document
frequency and scaled to length one. Document frequencies come from every training document. The
weights are trained on at most ``sample`` of them with follow-the-regularised-leader (FTRL-proximal)
under an elastic-net penalty; the rest of that sample sets the temperature of the probabilities.

A text that is null or has no letter gives ``und`` with score 0. Ties between languages go to
the alphabetically first. Training rows with a null text or language are not learned from. With
no training row at all, every text is ``und``. Long texts are used whole. Every language of the
sample is learned, however many there are; the model takes 2**bits numbers for each. Repeated rows
are learned from and predicted as often as they occur. An empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import fold

UNKNOWN = "und"
PREDICTION = "lang string, score double, familiar double"


# ---- features -----------------------------------------------------------------------------

_SPACE = 32
_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or the space."""
    global _LETTERS
    if _LETTERS is None:
        out = np.full(0x110000, _SPACE, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _LETTERS = out
    return _LETTERS


def gram_columns(text: str, bits: int) -> np.ndarray | None:
    """Hashed columns of all n-grams of a text, with repeats; None if it has no letter."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = _letters()[points]
    spaces = letters == _SPACE
    keep = ~spaces
    keep[1:] |= spaces[1:] & ~spaces[:-1]  # of a run of spaces the first
    if spaces.all():
        return None
    s = np.concatenate(([_SPACE], letters[keep], [_SPACE])).astype(np.uint32)
    two = s[:-1] * np.uint32(0x9E3779B1) + s[1:]
    three = two[:-1] * np.uint32(0x85EBCA6B) + s[2:]
    every = np.concatenate((s[1:-1], two + np.uint32(0x51ED270B), three + np.uint32(0x2545F491)))
    every = (every ^ (every >> np.uint32(15))) * np.uint32(0xC2B2AE35)
    return every >> np.uint32(32 - bits)


def damped(text: str, bits: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(columns, 1 + log count) of a text."""
    columns = gram_columns(text, bits)
    if columns is None:
        return None
    if len(columns) * 8 < 1 << bits:
        found, n = np.unique(columns, return_counts=True)
    else:
        counts = np.bincount(columns, minlength=1 << bits)
        found = np.flatnonzero(counts)
        n = counts[found]
    return found.astype(np.int32), (1 + np.log(n)).astype(np.float32)


def document_frequencies(docs: DataFrame, bits: int) -> DataFrame:
    """column, df and (as column -1) the number of documents with letters."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                found = damped(text.as_py(), bits)
                if found is not None:
                    total[found[0]] += 1
                    n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], n), pa.int64())], ["column", "df"])

    return docs.select("text").mapInArrow(run, "column int, df long").groupBy("column").agg(F.sum("df").alias("df"))


# ---- model --------------------------------------------------------------------------------


@dataclass
class Model:
    """Weights by column and language, with what scales features and probabilities."""

    languages: list[str]
    bits: int
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    seen: np.ndarray | None = None  # columns that occur in any training document

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        found = damped(text, self.bits)
        if found is None:
            return None
        x = found[1] * self.idf[found[0]]
        return found[0], x / max(float(np.sqrt(x @ x)), 1e-12)

    def logits(self, found: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return found[1] @ self.weights[found[0]] + self.bias

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, its probability, share of the text's distinct n-grams that training documents have)."""
        found = self.features(text) if text and self.languages else None
        if found is None:
            return UNKNOWN, 0.0, 0.0
        p = _softmax(self.logits(found) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best]), float(self.seen[found[0]].mean()) if self.seen is not None else 1.0


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], classes: int, columns: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) by FTRL-proximal with an elastic net; the bias is not penalised."""
    z, n = np.zeros((columns + 1, classes), np.float64), np.zeros((columns + 1, classes), np.float64)
    order = np.random.default_rng(seed)

    def weights(zs: np.ndarray, ns: np.ndarray, l1s: np.ndarray | float) -> np.ndarray:
        return np.where(np.abs(zs) <= l1s, 0.0, -(zs - np.sign(zs) * l1s) / ((beta + np.sqrt(ns)) / alpha + l2))

    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, x = np.append(rows[k][0], columns), np.append(rows[k][1], 1.0)
            penalty = np.full((len(at), 1), l1)
            penalty[-1] = 0.0
            w = weights(z[at], n[at], penalty)
            error = _softmax(x @ w)
            error[labels[k]] -= 1.0
            g = x[:, None] * error[None, :]
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    penalty = np.full((columns + 1, 1), l1)
    penalty[-1] = 0.0
    w = weights(z, n, penalty)
    return w[:-1].astype(np.float32), w[-1]


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood, between 1/20 and 20."""

    def loss(t: float) -> float:
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), labels]))

    grid = np.geomspace(0.05, 20, 121)
    return float(grid[int(np.argmin([loss(t) for t in grid]))]) if len(logits) else 1.0


def fit(docs: DataFrame, sample: int = 4000, calibration: float = 0.2, bits: int = 16) -> Model:
    """Learn from ``docs(doc_id, text, lang)``, all of whose rows may be learned from.

    ``sample`` bounds the documents that reach the trainer, split evenly over the languages as
    far as each has rows, in the order of a hash of doc_id.
    """
    spark = docs.sparkSession
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    df = {r["column"]: r["df"] for r in document_frequencies(known, bits).toLocalIterator()}  # 2**bits rows at most
    n = df.pop(-1, 0)
    idf = np.full(1 << bits, np.log(1.0 + n), np.float32)
    seen = np.zeros(1 << bits, bool)
    if df:
        seen[list(df)] = True
        idf[list(df)] = np.log((1.0 + n) / (1.0 + np.array(list(df.values())))) + 1.0
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    kinds = sizes.count()
    if not kinds:
        return Model([], bits, idf, np.zeros((1 << bits, 0), np.float32), np.zeros(0))
    share = max(1, sample // kinds)
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = known.select("doc_id", "lang").join(sizes, "lang").where(rank < F.lit(1.2 * share) / F.col("n")).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key, lang.as_py(), found) for key, text, lang in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True) if (found := damped(text.as_py(), bits)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2][0].tobytes() for r in rows], pa.binary()), pa.array([r[2][1].tobytes() for r in rows], pa.binary())], ["doc_id", "lang", "at", "x"])

    picked = known.join(F.broadcast(drawn), "doc_id", "left_semi").mapInArrow(run, "doc_id long, lang string, at binary, x binary").toPandas()
    picked = picked.sort_values(["doc_id", "lang"], kind="stable")
    languages = sorted(set(picked["lang"]))
    if not languages:
        return Model([], bits, idf, np.zeros((1 << bits, 0), np.float32), np.zeros(0))
    rows = []
    for at, x in zip(picked["at"], picked["x"], strict=True):
        at, x = np.frombuffer(at, np.int32), np.frombuffer(x, np.float32)
        x = x * idf[at]
        rows.append((at, x / np.sqrt(x @ x)))
    labels = [languages.index(lang) for lang in picked["lang"]]
    cut = int(len(rows) * calibration) if len(rows) >= 50 else 0
    order = np.random.default_rng(3).permutation(len(rows))
    held, used = order[:cut], order[cut:]
    w, b = ftrl([rows[i] for i in used], [labels[i] for i in used], len(languages), 1 << bits)
    model = Model(languages, bits, idf, w, b, seen=seen)
    if cut:
        model.temperature = temperature(np.array([model.logits(rows[i]) for i in held]), np.array([labels[i] for i in held]))
    return model


def predictor(spark, model: Model):
    """A function of a text column: struct(lang, score, familiar)."""
    from pyspark.sql.functions import arrow_udf

    shared = spark.sparkContext.broadcast(model)  # 2**bits rows by the number of languages

    @arrow_udf(PREDICTION)
    def predict(texts: pa.Array) -> pa.Array:
        found = [shared.value.predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.float64())], ["lang", "score", "familiar"])

    return predict


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Documents that are never learned from: a fifth, by the checksum of their id."""
    return F.coalesce(fold(doc_id) == 0, F.lit(True))


def identify(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs(doc_id, text, lang)``."""
    model = fit(docs.where(~held_out()), **options)
    predict = predictor(docs.sparkSession, model)
    return docs.select("doc_id", held_out().alias("held_out"), predict("text").alias("p")).select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def without_unknown(docs: DataFrame, least_score: float = 0.35, least_familiar: float = 0.5, least_letters: int = 40, **options) -> DataFrame:
    """The rows of ``docs(doc_id, text, lang)``, with all their columns, that are in a language that the
    model knows.

    Rejected are texts without a letter, and texts of at least ``least_letters`` letters whose calibrated
    probability is under ``least_score`` for every learned language, or of whose distinct n-grams fewer than
    the share ``least_familiar`` occur in any training document, as in another script. A shorter text says too little to
    be rejected. Where nothing was learned, texts with letters stay.
    """
    model = fit(docs.where(~held_out()), **options)
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    if not model.languages:
        return docs.where(letters > 0)
    found = predictor(docs.sparkSession, model)("text")
    return docs.where((found["lang"] != UNKNOWN) & ((found["score"] >= least_score) & (found["familiar"] >= least_familiar) | (letters < least_letters)))
