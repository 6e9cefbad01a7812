"""Spelling variants against brute force, with odd rows."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import spelling
from tidewell.llm.registry import ORACLE_SQL, op13_spelling_variants


def brute_words(rows, shortest=7):
    count = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= shortest:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


def result(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_query_equals_sql_and_brute_words(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    got = op13_spelling_variants(spark, sf_dir).collect()
    assert {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got} == set(con.execute(f"select word, form, root, n, n_near, form_n from ({ORACLE_SQL['op13_spelling_variants']})").fetchall())
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert {r["word"]: r["n"] for r in got} == brute_words(rows) and len(got) > 500


def test_odd_rows(spark):
    long = "x" * 3000
    texts = ["", None, "Zürich Verschlüsselung Verschlüsselung, verschlusselung verschlusselung; Verschlüsselungen Verschlüsselungen", "short words only", f"{long} {long}y {long} {long}y", "×÷Àbcdefg ×÷Àbcdefg", "lİterals literals literals"]
    rows = [*enumerate(texts), (2, texts[2]), (None, "nothing nothing nothin9 Nothing"), (50, "repeated " * 30 + "repeatde repeatde repeate repeate repeatee repeatee"), (51, "literals123literals " * 40_000)]
    docs = spark.createDataFrame([(k, t, "w", 1) for k, t in rows], "doc_id long, text string, word string, n int")
    assert result(spelling.variants(docs)) == brute(brute_words(rows))
    assert spelling.variants(docs.limit(0)).count() == 0 and spelling.variants(docs.where("doc_id = 3")).count() == 0


@pytest.mark.parametrize("crowd", [3, 40, 512])
def test_crowded_segments_lose_no_pair(spark, crowd):
    """Words that share their front, their end or both, and runs of one letter."""
    rng = np.random.default_rng(11)
    words = {"".join(rng.choice(list("ab"), rng.integers(7, 11))) for _ in range(300)}
    words |= {"prefixab" + "".join(rng.choice(list("abc"), rng.integers(1, 6))) for _ in range(150)}
    words |= {"".join(rng.choice(list("abc"), rng.integers(1, 6))) + "endingxy" for _ in range(150)}
    words |= {"front" + "".join(rng.choice(list("xyé"), 3)) + "back" for _ in range(60)} | {"z" * k for k in range(7, 20)}
    counts = {w: int(n) for w, n in zip(sorted(words), 2 + rng.pareto(0.5, len(words)).clip(0, 1e6), strict=True)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r["word"]: (r["n_near"], r["best"], r["best_n"]) for r in spelling.neighbours(df, crowd=crowd, shard_rows=700).collect()}
    want = {}
    for w in words:
        near = [x for x in words if one_edit(w, x)]
        if near:
            best = min(near, key=lambda x: (-counts[x], x))
            want[w] = len(near), best, counts[best]
    assert got == want
    if crowd < 512:  # no segment that could be divided is left with more
        left = spelling.settled_routes(df, 7, crowd).where("size - a - b > 1").groupBy("key").agg(F.count("*").alias("c"), F.max(F.col("size") == F.length("word")).alias("held"))
        assert left.where("held").agg(F.max("c")).first()[0] <= crowd


def test_roots_follow_long_chains(spark):
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(23)] + [("x", "w20"), ("a", "b")], "word string, form string")
    got = {r["word"]: r["root"] for r in spelling.roots(chain).collect()}
    assert got == {**{f"w{i}": "w23" for i in range(23)}, "x": "w23", "a": "b"}
    assert spelling.roots(chain.limit(0)).count() == 0
