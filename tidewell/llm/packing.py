"""Best-fit packing of tokenized documents by swap-based local search.

1. ``piece_table``: each document's ids (and its closing id) are cut into pieces of at most
   ``capacity`` ids; only documents longer than that are cut. Ids are made and dropped inside a
   task; a row keeps a piece's length and checksum.
2. ``pack``: pieces that fill a sequence stand alone. The others are dealt into groups of some
   thousands, each of which starts from best-fit decreasing and then exchanges pieces between
   its underfull bins (one for one, two for one, or a move) whenever that raises the sum of
   squared fills, until no exchange does; emptied bins vanish.
3. The bins that are still underfull are dissolved and dealt anew with those of other groups, round
   after round, until one group is left or a round frees no bin. The number of groups follows the
   number of pieces left, so no task gets more than its share.

Null texts are empty; an empty document is its closing id alone. Ties go by doc_id and piece.
Repeated rows, and rows without an id, are packed as often as they occur: pieces are dealt by a
row number, so equal ones spread over the groups too. Which group a piece meets first depends on
how the rows are partitioned; its place in a sequence may, its ids never do. Very long texts are
cut into pieces in the task that holds them. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import count, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import FragmentCache, materialize

_AT_ONCE = 1 << 20  # bytes of text that a task tokenizes at once
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"
CAPACITY, END_ID = 4096, 1


# ---- tokens -------------------------------------------------------------------------------


class WordIds:
    """Ids of whole texts by a word-end BPE tokenizer file, as bytes of 32-bit numbers.

    The file's normalizer (NFC, white space, lower case) and its pattern cut a text into words
    whose ids do not depend on each other, so a worker tokenizes each word once. Many texts are
    taken at once: Arrow cuts them at white space, each distinct fragment is looked up once, and
    the ids are dealt back by number. Texts with the strings of special tokens, or with characters
    that are not ``settled``, go to the library whole.
    """

    def __init__(self, file: bytes, cache_size: int = 200_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(file.decode("utf-8"))
        self.model = self.library.model
        spec = json.loads(file)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.plain = spec["normalizer"] == _NORMALIZER and spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] == _PATTERN
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        self.letters = {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.cache = FragmentCache(self._word, cache_size)

    def _word(self, word: str) -> bytes:
        if word.isalnum() and not word.isalpha() and not word.isdecimal():  # letters beside other number signs
            parts = regex.findall(_PATTERN, word)
            if len(parts) > 1:
                return b"".join(map(self._word, parts))
        spelled = word if word.isascii() and word.isprintable() else "".join(self.letters[b] for b in word.encode("utf-8"))
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def ids(self, text: str | None) -> bytes:
        return self.many([text])[0].tobytes()

    def many(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        whole: dict[int, np.ndarray] = {}
        split = []
        for k, text in enumerate(texts):
            if not text:
                split.append("")
            elif not self.plain or any(x in text for x in self.specials) or not settled(text):
                whole[k] = np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
                split.append("")
            else:
                split.append(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        parts = pc.ascii_split_whitespace(pa.array(split, pa.large_string()))  # other white space stays in a fragment
        coded = parts.values.dictionary_encode()
        kind = coded.indices.to_numpy()
        cache, words, found = self.cache, _WORDS.findall, []
        for x in coded.dictionary.to_numpy(zero_copy_only=False).tolist():
            if x.isalpha():
                found.append(cache[x])
            elif x[-1:] in _STOPS and x[:-1].isalpha():
                found.append(cache[x[:-1]] + cache[x[-1]])
            else:
                found.append(b"".join(map(cache.__getitem__, words(x))))
        size = np.fromiter((len(x) >> 2 for x in found), np.int32, len(found))
        sizes = size[kind]
        ends = np.cumsum(sizes, dtype=np.int64)
        at = np.repeat(((np.cumsum(size, dtype=np.int64) - size)[kind] - (ends - sizes)), sizes)
        at += np.arange(len(at))
        flat = np.frombuffer(b"".join(found), "<u4")[at]
        cut = np.concatenate([[0], ends])[parts.offsets.to_numpy()].tolist()
        return [whole[k] if k in whole else flat[cut[k] : cut[k + 1]] for k in range(len(texts))]


_LATIN = re.compile("[\\x00-\u021f]*")


def settled(text: str) -> bool:
    """Has every character been assigned since Unicode 3.2, so that case, kind and composition are the same
    in the tables of any Python and of the library?"""
    return _LATIN.fullmatch(text) is not None or all(unicodedata.ucd_3_2_0.category(c) != "Cn" for c in set(text))


# The normalizer and pattern for which words may be tokenized one by one.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: The same for Python's re, whose letters include number signs that are no decimal digits; _word cuts these off.
_WORDS = re.compile(r"[^\W\d_]+|'(?:[stmd]|re|ve|ll)|(?:[^\w\s]|[_\x1c-\x1f])+|\d")
_STOPS = frozenset(".,;:!?")

_TOKENIZERS: dict[str, WordIds] = {}


def word_ids(file: bytes) -> WordIds:
    key = hashlib.sha256(file).hexdigest()
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = WordIds(file)
    return _TOKENIZERS[key]


def piece_table(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of ``docs(doc_id, text)``."""
    with open(tokenizer_path, "rb") as f:  # some MB, from the tokenizer package on the driver
        file = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = word_ids(file.value), np.array([end_id], "<u4")
        for whole in batches:
            filled = np.cumsum(pc.fill_null(pc.binary_length(whole.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // _AT_ONCE
            borders = sorted({0, *(np.flatnonzero(np.diff(filled)) + 1).tolist(), whole.num_rows})
            for low, high in pairwise(borders):
                batch = whole.slice(low, high - low)
                rows = []
                for key, ids in zip(batch.column(0).to_pylist(), own.many(batch.column(1).to_pylist()), strict=True):
                    ids = np.concatenate([ids, end])
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        rows.append((key, piece, start, len(part), zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
                pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


# ---- packing ------------------------------------------------------------------------------


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: each item, longest first, goes where least room is left."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []  # (room, bin), sorted
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = bisect.bisect_left(rooms, (lengths[item], -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(item)
        if room > lengths[item]:
            bisect.insort(rooms, (room - lengths[item], b))
    return bins


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Local search on the underfull bins; every step raises the sum of squared fills.

    The emptiest bin gives: it moves an item into another bin's room, or swaps an item for a
    smaller one, or for two smaller ones, of a fuller bin. A bin that has given all is gone.
    All are tried again until no exchange is left, which ends since fills are whole numbers and the
    sum of squares is bounded.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    live = [k for k in range(len(bins)) if 0 < fill[k] < capacity]
    changed = False
    falling: dict[int, list[int]] = {}  # items of a bin by length, until it changes
    rising: dict[int, list[tuple[int, int]]] = {}
    stamp = list(range(len(bins)))  # another number whenever a bin changes
    stamps = count(len(bins))
    vain: set[int] = set()  # two bins, as they are, without an exchange; emptied when large
    while len(live) > 1 or changed:
        if len(live) <= 1:  # what could not be emptied may be emptied now
            live, changed = [k for k in range(len(bins)) if 0 < fill[k] < capacity], False
            continue
        live.sort(key=lambda k: fill[k])
        giver = live[0]
        for taker in reversed(live[1:]):
            if stamp[giver] << 32 | stamp[taker] in vain:
                continue
            room = capacity - fill[taker]
            if giver not in falling:
                falling[giver] = sorted(bins[giver], key=lambda i: -lengths[i])
            if taker not in rising:
                rising[taker] = sorted((lengths[j], j) for j in bins[taker])
            step = _best_exchange(falling[giver], rising[taker], lengths, room, fill[giver], fill[taker])
            if step is None:
                if len(vain) >= 1 << 18:
                    vain.clear()
                vain.add(stamp[giver] << 32 | stamp[taker])
                continue
            out, back = step
            gain = sum(lengths[i] for i in out) - sum(lengths[i] for i in back)
            bins[giver] = [i for i in bins[giver] if i not in out] + back
            bins[taker] = [i for i in bins[taker] if i not in back] + out
            fill[giver] -= gain
            fill[taker] += gain
            for k in (giver, taker):
                falling.pop(k, None)
                rising.pop(k, None)
                stamp[k] = next(stamps)
            live = [k for k in live if 0 < fill[k] < capacity]
            changed = True
            break
        else:
            live = live[1:]  # this bin can't be emptied further by any other
    return [b for b in bins if b]


def _exchange(give: list[int], take: list[int], lengths: list[int], room: int, giver_fill: int, taker_fill: int) -> tuple[list[int], list[int]] | None:
    """(items that go to the taker, items that come back) with the best gain, or None."""
    return _best_exchange(sorted(give, key=lambda i: -lengths[i]), sorted((lengths[j], j) for j in take), lengths, room, giver_fill, taker_fill)


def _best_exchange(give: list[int], ordered: list[tuple[int, int]], lengths: list[int], room: int, giver_fill: int, taker_fill: int) -> tuple[list[int], list[int]] | None:
    """The same, of the giver's items by falling and the taker's (length, item) by rising length."""
    best, found = 0, None
    for i in give:
        size = lengths[i]
        if size <= room:
            return [i], []  # a move
        if best == room:
            continue  # no exchange gains more, but a move would go before
        # The gain size - back must be at most room: back is the least sum that is enough.
        at = bisect.bisect_left(ordered, (size - room, -1))
        if at < len(ordered) and best < (gain := size - ordered[at][0]):
            best, found = gain, ([i], [ordered[at][1]])
        low, high = 0, len(ordered) - 1  # two for one
        while low < high:
            total = ordered[low][0] + ordered[high][0]
            if total >= size - room:
                if best < size - total:
                    best, found = size - total, ([i], [ordered[low][1], ordered[high][1]])
                high -= 1
            else:
                low += 1
    return found if best > 0 and taker_fill + best > giver_fill else None


def _pack_group(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """bin (within the group), offset and fill for the pieces of one group."""
    rows = rows.sort_values(["doc_id", "piece", "ids_crc32", "row"], kind="stable", ignore_index=True)
    lengths = rows["length"].tolist()
    bins = improve(best_fit(lengths, capacity), lengths, capacity)
    number, offset, fill = np.zeros(len(rows), "int64"), np.zeros(len(rows), "int64"), np.zeros(len(rows), "int64")
    for b, items in enumerate(bins):
        at = 0
        for i in items:
            number[i], offset[i] = b, at
            at += lengths[i]
        fill[items] = at
    return rows.assign(bin=number, offset=offset, fill=fill)


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_size: int = 4000) -> DataFrame:
    """``pieces`` (as of ``piece_table``) with sequence_id and offset.

    A sequence id is round * 2^56 + group * 2^24 + bin, or for a full piece its own number.
    """
    names = [c.strip().split()[0] for c in PIECES.split(",")]
    pieces = materialize(pieces.select(*names, F.monotonically_increasing_id().alias("row")))
    done = pieces.where(F.col("length") >= capacity).select(*names, F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = pieces.where(F.col("length") < capacity)
    schema = PIECES + ", row long, bin long, offset long, fill long, grp long"

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        return _pack_group(rows.drop(columns="grp"), capacity).assign(grp=rows["grp"].iloc[0])

    before: tuple[int, DataFrame] | None = None  # underfull bins of the last round, and their pieces in place
    for turn in count(1):
        groups = max(1, -(-left.count() // group_size))
        dealt = left.withColumn("grp", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(groups)).cast("long"))
        base = F.lit(turn).cast("long") * (1 << 56) + F.col("grp") * (1 << 24) + F.col("bin")
        # By number, since groups are small in bytes and long in work: they are not to be put together.
        packed = materialize(dealt.repartition(min(groups, 4096), "grp").groupBy("grp").applyInPandas(one, schema).withColumn("sequence_id", base))
        first = F.col("offset") == 0
        bins, underfull = packed.agg(F.count(F.when(first, 1)), F.count(F.when(first & (F.col("fill") < capacity), 1))).first()
        if before is not None and bins >= before[0]:
            return done.unionByName(before[1].select(*names, "sequence_id", "offset"))
        if groups == 1:
            return done.unionByName(packed.select(*names, "sequence_id", "offset"))
        done = done.unionByName(packed.where(F.col("fill") == capacity).select(*names, "sequence_id", "offset"))
        before = underfull, packed.where(F.col("fill") < capacity)
        left = before[1].select(*names, "row")
    raise AssertionError("not reached")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their places; see the module."""
    return pack(piece_table(docs, tokenizer_path, capacity, end_id), capacity)
