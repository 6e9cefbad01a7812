"""Byte-level BPE encoding and decoding with a public tokenizer file.

Encoding. A text is cut at the strings of added tokens, then into fragments (words with the space
before them, numbers, other signs, white space) that no merge crosses. A fragment's bytes are a
doubly linked list of symbols, and the ranks of its adjacent pairs are a priority queue: the
least rank, the leftmost of equals, is merged next; an entry whose symbols have been merged
meanwhile is stale and skipped. A worker remembers the fragments that it has met.

Decoding concatenates the vocabulary's strings and reads them as UTF-8, where bytes that make up no
character become U+FFFD, as in the library. Ids beyond the vocabulary decode to nothing.

Texts made of ``_PLAIN`` characters alone, whose kinds (letter, number, space) are settled in every
Unicode version, are cut by Python's re; all others by the library's own splitter, so that the ids do
not depend on the Unicode tables of this Python.

Null and empty texts have no ids and decode to the empty string. Repeated rows and rows without an
id give repeated results; other columns are ignored. An empty table gives no rows. Very long texts are
encoded whole; fragments of over ``LONG`` characters are never remembered, which bounds a worker's memory.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator, Sequence
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewell.llm.common import FragmentCache

LONG = 256
ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

#: Characters on which Python's re and the library's splitter agree: ASCII but for control characters,
#: Latin, Greek and Cyrillic letters, kana, common ideographs, and general punctuation (tested one by one).
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ȳΑ-ΡΣ-ϿЀ-҂Ҋ-ԯ‐-‧‰-⁞€ぁ-ゖァ-ヺ一-龥가-힣]*")
# The pattern of such files, as Python's re has it for plain characters.
_FRAGMENTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def byte_letters() -> list[str]:
    """The character that stands for each byte in the vocabulary: itself if it is visible, else the next from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class ByteCoder:
    """Encoder and decoder of one tokenizer file (JSON)."""

    def __init__(self, file: bytes, cache_size: int = 400_000):
        from tokenizers.pre_tokenizers import ByteLevel

        spec = json.loads(file)
        model, split = spec["model"], spec["pre_tokenizer"]
        unusual = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or unusual or spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split.get("use_regex", True):
            raise ValueError("only byte-level BPE without normalizer and prefix space is supported")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must match as they are written")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.splitter = ByteLevel(add_prefix_space=False, use_regex=True)
        vocabulary: dict[str, int] = model["vocab"]
        letters = byte_letters()
        self.value = {c: b for b, c in enumerate(letters)}
        self.first = [vocabulary[c] for c in letters]  # id of each byte
        self.bytes_of = [b""] * (1 + max([*vocabulary.values(), *self.added.values()]))
        for token, i in vocabulary.items():
            self.bytes_of[i] = bytes(map(self.value.__getitem__, token)) if self.value.keys() >= set(token) else token.encode()
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        #: (left id << 32 | right id): rank; the union's id by rank
        self.rank: dict[int, int] = {}
        self.union: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocabulary[left] << 32 | vocabulary[right]] = rank
            self.union.append(vocabulary[left + right])
        spelled = [f"{i},".encode() for i in range(len(self.bytes_of))]
        width = max(map(len, spelled))
        self.digits = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in spelled), np.uint8).reshape(-1, width)
        self.cache = FragmentCache(self._packed, cache_size)

    def merge(self, data: bytes) -> list[int]:
        """Ids of one fragment's bytes. An entry of the queue is rank << 32 | place; it is stale
        if the pair at that place has another rank by now, or none."""
        first, rank, union = self.first, self.rank.get, self.union
        symbols, n = [first[b] for b in data], len(data)
        ranks = [rank(a << 32 | b, -1) for a, b in pairwise(symbols)]
        ranks.append(-1)
        queue = [r << 32 | i for i, r in enumerate(ranks) if r >= 0]
        if not queue:
            return symbols
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapify(queue)
        while queue:
            entry = heappop(queue)
            i, r = entry & 0xFFFFFFFF, entry >> 32
            if ranks[i] != r:
                continue
            symbols[i] = new = union[r]
            j = after[i]
            symbols[j] = ranks[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                ranks[i] = r = rank(new << 32 | symbols[k], -1)
                if r >= 0:
                    heappush(queue, r << 32 | i)
            else:
                ranks[i] = -1
            h = before[i]
            if h >= 0:
                ranks[h] = r = rank(symbols[h] << 32 | new, -1)
                if r >= 0:
                    heappush(queue, r << 32 | h)
        return [s for s in symbols if s >= 0]

    def _packed(self, fragment: str) -> bytes:
        return array("I", self.merge(fragment.encode("utf-8"))).tobytes()

    def fragments(self, text: str) -> list[str]:
        """Fragments of a text that holds no added token."""
        if _PLAIN.fullmatch(text):
            return _FRAGMENTS.findall(text)
        value = self.value
        return [bytes(map(value.__getitem__, piece)).decode("utf-8") for piece, _ in self.splitter.pre_tokenize_str(text)]

    def packed(self, text: str | None) -> bytes:
        """All ids of a text, as 32-bit numbers."""
        if not text:
            return b""
        out: list[bytes] = []
        for k, part in enumerate(self.at_added.split(text) if self.at_added else [text]):
            if k % 2:
                out.append(np.array([self.added[part]], "<u4").tobytes())
            elif part:
                fragments = self.fragments(part)
                if max(map(len, fragments)) <= LONG:
                    out.extend(map(self.cache.__getitem__, fragments))
                else:
                    out.extend(self.cache[f] if len(f) <= LONG else self._packed(f) for f in fragments)
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode(self, ids: Sequence[int]) -> str:
        known = self.bytes_of
        if ids and not 0 <= min(ids) <= max(ids) < len(known):
            ids = [i for i in ids if 0 <= i < len(known)]
        return b"".join(map(known.__getitem__, ids)).decode("utf-8", "replace")

    def spelled(self, packed: bytes) -> bytes:
        """Decimal ids joined by commas."""
        digits = self.digits[np.frombuffer(packed, "<u4")]
        return digits[digits > 0].tobytes()[:-1]


_CODERS: dict[str, ByteCoder] = {}


def coder(file: bytes) -> ByteCoder:
    """The worker's coder of this file."""
    key = hashlib.sha256(file).hexdigest()
    if key not in _CODERS:
        _CODERS[key] = ByteCoder(file)
    return _CODERS[key]


def read_file(path: str) -> bytes:
    """A tokenizer file of a few MB, read by the driver from the tokenizer package."""
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids (array of int) and decoded text of every row of ``docs(doc_id, text)``."""
    file = docs.sparkSession.sparkContext.broadcast(read_file(tokenizer_path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(file.value)
        for batch in _slices(batches):
            ids = [own.encode(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(own.decode, ids), pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def decode_ids(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and text of every row of ``encoded(doc_id, ids)``; null ids are empty."""
    file = encoded.sparkSession.sparkContext.broadcast(read_file(tokenizer_path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(file.value)
        for batch in _slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode([i for i in ids.as_py() or [] if i is not None]) for ids in batch.column(1)], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def token_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of ``docs(doc_id, text)``."""
    file = docs.sparkSession.sparkContext.broadcast(read_file(tokenizer_path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(file.value)
        gc.disable()  # the remembered fragments hold no cycles, and there are many of them
        try:
            for batch in _slices(batches):
                sizes, ids, decoded = [], [], []
                for text in batch.column(1):
                    packed = own.packed(text.as_py())
                    sizes.append(len(packed) // 4)
                    ids.append(hashlib.sha256(own.spelled(packed)).hexdigest())
                    decoded.append(hashlib.sha256(own.decode(np.frombuffer(packed, "<u4").tolist()).encode("utf-8")).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            gc.enable()

    return docs.select("doc_id", "text").mapInArrow(run, ENCODED)


def _slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)
