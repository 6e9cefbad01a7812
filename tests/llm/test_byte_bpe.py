"""Byte-level BPE against the tokenizers library."""

import hashlib

import numpy as np
import pytest

from tidewell.llm import byte_bpe
from tidewell.llm.registry import op12_byte_bpe, tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def want(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_query_equals_the_library(spark, sf_dir, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in op12_byte_bpe(spark, sf_dir).collect()}
    assert got == {k: want(library, t) for k, t in texts.items()}


def test_odd_rows(spark, library):
    odd = ["", None, "  a  b \n\n c", "<|endoftext|> x<|endoftext|>", "it's we'll I'D", "x" * 300_000, " \t" * 1000, "漢字 ㎏ ²½ ٣", "\x1c\x85　", "👋🏽‍🚀", "ᲉꟋ", "same", "same", "ab " * 350_000]
    rows = [(i, t, "n") for i, t in enumerate(odd)] + [(None, "no id", None), (0, "", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in byte_bpe.token_digests(docs, PATH).collect())
    assert got == sorted((str(k), *want(library, t)) for k, t, _ in rows)
    assert byte_bpe.token_digests(docs.limit(0), PATH).count() == 0
    back = byte_bpe.decode_ids(byte_bpe.encode_documents(docs, PATH), PATH)
    assert sorted((str(r["doc_id"]), r["text"]) for r in back.collect()) == sorted((str(k), t or "") for k, t, _ in rows)


def test_splitting_does_not_depend_on_unicode_tables():
    own, letters = byte_bpe.coder(byte_bpe.read_file(PATH)), byte_bpe.byte_letters()
    for point in (p for p in range(0xE000) if not 0xD800 <= p and byte_bpe._PLAIN.fullmatch(chr(p))):
        text = f"a{chr(point)}b 1{chr(point)}2 .{chr(point)}. {chr(point)} {chr(point) * 2}\n"
        assert [piece for piece, _ in own.splitter.pre_tokenize_str(text)] == ["".join(letters[b] for b in f.encode()) for f in byte_bpe._FRAGMENTS.findall(text)], hex(point)


def test_any_characters_and_ids(library):
    own, rng = byte_bpe.coder(byte_bpe.read_file(PATH)), np.random.default_rng(7)
    points = [p for p in range(0x20, 0x33000) if not 0xD800 <= p < 0xE000]
    for k in range(3000):
        pool = points if k % 2 else points[:500]
        text = "".join(chr(pool[i]) if rng.random() < 0.8 else " 's\n"[i % 4] for i in rng.integers(0, len(pool), rng.integers(0, 30)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids and own.decode(ids) == library.decode(ids, skip_special_tokens=False)
        some = rng.integers(0, 50_300 if k % 3 else 300, rng.integers(0, 9)).tolist()  # bytes that make up no text too
        assert own.decode(some) == library.decode(some, skip_special_tokens=False)
