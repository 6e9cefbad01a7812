"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding keeps a score-ordered agenda of adjacent symbol pairs: the pair whose union is the
best-scored piece is merged first, the leftmost of equals, until no union is a piece. Symbols
that are not pieces fall back to byte pieces, or to the unknown piece.

A piece of such a vocabulary carries the space mark only in front, so no merge crosses from
another character to a space mark; where no piece holds a letter beside another character, none
crosses there either. Texts are cut at these places, and a worker remembers the fragments
that it has encoded. In each Arrow batch every ``verify``-th new fragment and one whole text are
compared with the sentencepiece library, and a difference stops the job.

Decoding maps the ids back to the bytes of their pieces; where byte pieces do not make up valid
UTF-8, each stray byte becomes U+FFFD, as in the library.

Null and empty texts have no ids and decode to the empty string. Repeated rows and rows without
an id give repeated results; other columns are ignored. An empty table gives no rows. Very long texts
are encoded whole; a fragment of over ``LONG`` characters is forgotten after its batch, which
bounds what a worker remembers.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
BPE = 2
_NEVER = np.iinfo(np.int32).max
LONG = 256
_SIDE, _SHIFT = 1 << 16, 1 << 15  # a pair of symbols as one 32-bit number
ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message's fields; lengths as bytes, the rest as ints."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, message[at : at + size]
            at += size


class PieceCoder:
    """Encoder and decoder of one serialized merge-type model."""

    def __init__(self, model: bytes, cache_size: int = 700_000):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        top = dict(_fields(model))  # of repeated fields the last; specs occur once
        trainer, normalizer = dict(_fields(top.get(2, b""))), dict(_fields(top.get(3, b"")))
        if trainer.get(3, 1) != BPE or trainer.get(24, 0):
            raise ValueError("the model is not of the merge type with leading space marks")
        if normalizer.get(2) or not normalizer.get(5, 1):
            raise ValueError("only the identity normalizer with escaped spaces is supported")
        self.dummy_prefix, self.squeeze = bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1))
        lib, n = self.library, self.library.get_piece_size()
        self.unk = lib.unk_id()
        self.text: list[str] = []
        self.ids: dict[str, int] = {}
        self.byte_ids: dict[int, int] = {}
        scores: dict[str, float] = {}
        for i in range(n):
            piece = lib.id_to_piece(i)
            self.text.append(piece.replace(SPACE, " "))
            if lib.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_ids[value] = i
                self.text[i] = chr(value)
            elif lib.is_control(i):
                self.text[i] = ""
            elif lib.is_unknown(i):
                self.text[i] = " ⁇ "
            else:
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError(f"piece {piece!r} has an inner space mark")
                self.ids[piece] = i
                scores[piece] = lib.get_score(i)
        mixed = any(bool(_LETTER.match(a)) != bool(_LETTER.match(b)) for p in self.ids for a, b in pairwise(p.lstrip(SPACE)))
        self.cut = _BY_SPACE if mixed else _BY_SPACE_AND_LETTERS
        ranks = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {piece: ranks[s] for piece, s in scores.items()}
        self.value_of = {i: b for b, i in self.byte_ids.items()}
        self.wide_bytes = {i for b, i in self.byte_ids.items() if b > 127}
        self.bytes_of = [bytes([self.value_of[i]]) if i in self.value_of else t.encode("utf-8") for i, t in enumerate(self.text)]
        self._bulk_tables()
        self.cache_size = cache_size
        self.cache: dict[str, bytes] = {}  # fragment: its ids as 32-bit numbers

    def _bulk_tables(self) -> None:
        """Arrays for merging many fragments at once. A symbol is a piece id, or a number beyond
        the vocabulary for a character that is no piece and never merges."""
        if len(self.text) > _SIDE:
            raise ValueError(f"a vocabulary of {len(self.text)} pieces; at most {_SIDE} are supported")
        pairs = {}
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                a, b = self.ids.get(piece[:k]), self.ids.get(piece[k:])
                if a is not None and b is not None:
                    pairs[(a - _SHIFT) * _SIDE + b] = (self.rank[piece], i)
        keys = sorted(pairs)
        self.pair_keys = np.array([*keys, _NEVER], np.int32)
        self.pair_ranks = np.array([*(pairs[k][0] for k in keys), _NEVER], np.int32)
        self.pair_unions = np.array([*(pairs[k][1] for k in keys), 0], np.int32)
        self.symbol_of = np.full(0x110000, -1, np.int32)  # -1: not met yet
        self.others: list[bytes] = []  # ids of the characters that are no pieces
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.symbol_of[ord(piece)] = i
        self.symbol_of[ord(" ")] = self.symbol_of[ord(SPACE)]
        spelled = [f"{i},".encode() for i in range(len(self.text))]
        width = max(map(len, spelled))
        self.digits = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in spelled), np.uint8).reshape(-1, width)

    def _symbols(self, points: np.ndarray) -> np.ndarray:
        """Symbols of code points; -1 if there are no numbers left for such a character."""
        for point in np.unique(points[self.symbol_of[points] < 0]).tolist():
            number = len(self.text) + len(self.others)
            if number < _SIDE:
                self.symbol_of[point] = number
                self.others.append(np.array(self.merge(chr(point)), "<u4").tobytes())
        return self.symbol_of[points]

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places in pair_ranks of pairs of symbols; the last one for pairs that are no piece."""
        keys = (left - np.int32(_SHIFT)) * np.int32(_SIDE) + right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, at, len(self.pair_keys) - 1)

    def merge_many(self, rows: np.ndarray) -> np.ndarray:
        """Merged symbols of fragments of equal length, filled up with -1. Each fragment has its
        agenda in a row of ranks, whose least, the leftmost of equals, is its next merge."""
        width = rows.shape[1]
        if width > 1:
            ranks = self.pair_ranks[self._lookup(rows[:, :-1], rows[:, 1:])]
            ranks = np.concatenate((ranks, np.full((len(rows), 1), _NEVER, np.int32)), axis=1)
            rows = np.concatenate((rows, np.full((len(rows), 1), -1, np.int32)), axis=1)
            done, live = rows.copy(), np.arange(len(rows))
            while True:
                i = ranks.argmin(axis=1)
                goes = ranks[np.arange(len(ranks)), i] < _NEVER
                if not goes.all():
                    done[live[~goes], : rows.shape[1]] = rows[~goes]
                    done[live[~goes], rows.shape[1] :] = -1
                    rows, ranks, live, i = rows[goes], ranks[goes], live[goes], i[goes]
                if not len(live):
                    break
                every = np.arange(len(live))
                union = self.pair_unions[self._lookup(rows[every, i], rows[every, i + 1])]
                columns = np.arange(rows.shape[1] - 1)
                from_ = columns[None, :] + (columns[None, :] > i[:, None])
                rows = np.take_along_axis(rows, from_, 1)
                rows[every, i] = union
                ranks = np.take_along_axis(ranks, from_[:, : ranks.shape[1] - 1] + (columns[None, : ranks.shape[1] - 1] == i[:, None]), 1)
                ranks[every, i] = self._ranks(union, rows[every, i + 1]) if rows.shape[1] > 1 else _NEVER
                back = np.flatnonzero(i > 0)
                ranks[back, i[back] - 1] = self._ranks(rows[back, i[back] - 1], union[back])
            rows = done
        return rows

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(right < 0, _NEVER, self.pair_ranks[self._lookup(left, right)])

    def remember(self, fragments: set[str]) -> list[str]:
        """Encode those fragments that are not remembered yet, and return them."""
        fresh = [f for f in fragments if f not in self.cache]
        if len(self.cache) + len(fresh) > self.cache_size:
            self.cache = {f: self.cache[f] for f in fragments if f in self.cache}
        by_length: dict[int, list[str]] = {}
        for fragment in fresh:
            by_length.setdefault(len(fragment), []).append(fragment)
        for length, group in by_length.items():
            if length <= 48:
                points = np.frombuffer("".join(group).encode("utf-32-le"), np.uint32)
                symbols = self._symbols(points).reshape(-1, length)
                plain = (symbols >= 0).all(axis=1)
                for at in range(0, len(group), 8192):
                    chosen = np.flatnonzero(plain[at : at + 8192]) + at
                    if len(chosen):
                        rows = self.merge_many(symbols[chosen])
                        used = rows >= 0
                        ends = (4 * np.cumsum(used.sum(axis=1))).tolist()
                        blob, start = rows[used].astype("<u4").tobytes(), 0
                        for k, end in zip(chosen.tolist(), ends, strict=True):
                            self.cache[group[k]] = blob[start:end]
                            start = end
                        for j in np.flatnonzero((rows >= len(self.text)).any(axis=1)).tolist():
                            self.cache[group[chosen[j]]] = b"".join(self.others[i - len(self.text)] if i >= len(self.text) else i.to_bytes(4, "little") for i in rows[j].tolist() if i >= 0)
                group = [group[k] for k in np.flatnonzero(~plain).tolist()]
            for fragment in group:  # long ones
                self.cache[fragment] = np.array(self.merge(fragment.replace(" ", SPACE)), "<u4").tobytes()
        return fresh

    def merge(self, fragment: str) -> tuple[int, ...]:
        """Ids of a fragment with its space marks, by the agenda."""
        whole = self.ids.get(fragment) if len(fragment) == 1 else None
        if whole is not None:
            return (whole,)
        symbols = list(fragment)
        (self._merge_short if len(symbols) <= 64 else self._merge_long)(symbols)
        out: list[int] = []
        for symbol in symbols:
            if not symbol:
                continue
            found = self.ids.get(symbol)
            if found is not None:
                out.append(found)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in symbol.encode("utf-8"))
            else:
                out.append(self.unk)
        return tuple(out)

    def _merge_short(self, symbols: list[str]) -> None:
        """The agenda as a list of the adjacent pairs' ranks: its minimum is the next merge."""
        rank, none = self.rank.get, len(self.rank)
        agenda = [rank(a + b, none) for a, b in pairwise(symbols)]
        while agenda and (best := min(agenda)) < none:
            i = agenda.index(best)
            symbols[i] += symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = rank(symbols[i] + symbols[i + 1], none)
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + symbols[i], none)

    def _merge_long(self, symbols: list[str]) -> None:
        """The agenda as a heap, which long fragments need; merged symbols become empty."""
        rank, n = self.rank, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(rank[a + b], i, a + b) for i, (a, b) in enumerate(pairwise(symbols)) if a + b in rank]
        heapq.heapify(agenda)
        while agenda:
            _, i, union = heapq.heappop(agenda)
            j = after[i]
            if not symbols[i] or j >= n or symbols[i] + symbols[j] != union:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = union, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (wider := union + symbols[k]) in rank:
                    heapq.heappush(agenda, (rank[wider], i, wider))
            if (h := before[i]) >= 0 and (wider := symbols[h] + union) in rank:
                heapq.heappush(agenda, (rank[wider], h, wider))

    def fragments(self, text: str) -> list[str]:
        """The text's fragments, with spaces for space marks."""
        text = text.replace(SPACE, " ")
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return []
        return self.cut.findall(" " + text if self.dummy_prefix else text)

    def encode(self, text: str | None) -> list[int]:
        """All ids of a text."""
        return list(chain.from_iterable(map(self.merge, (f.replace(" ", SPACE) for f in self.fragments(text or "")))))

    def decode(self, ids: list[int]) -> str:
        """The text of any ids, as the library's decode gives it."""
        try:
            text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8")
        except UnicodeDecodeError:  # only if a run of byte pieces is not valid by itself
            text = self._decode(ids)
        if self.dummy_prefix and ids and self.text[ids[0]].startswith(" ") and ids[0] not in self.value_of and ids[0] != self.unk:
            text = text[1:]
        return text

    def round_trip(self, fragments: list[str]) -> tuple[int, bytes, str]:
        """Of a text's remembered fragments: the number of ids, the ids as decimal numbers joined
        by commas, and what they decode to."""
        ids = np.frombuffer(b"".join(map(self.cache.__getitem__, fragments)), "<u4")
        spelled = self.digits[ids]
        numbers = spelled[spelled > 0].tobytes()[:-1]
        return len(ids), numbers, self.decode(ids.tolist())

    def _decode(self, ids: Sequence[int]) -> str:
        if self.wide_bytes.isdisjoint(ids):
            return "".join(map(self.text.__getitem__, ids))
        parts: list[str] = []
        run = bytearray()
        for i in ids:
            if i in self.value_of:
                run.append(self.value_of[i])
                continue
            if run:
                parts.append(_utf8(bytes(run)))
                run.clear()
            parts.append(self.text[i])
        return "".join(parts) + _utf8(bytes(run))

    def check_fragments(self, fragments: list[str]) -> None:
        """Compare fragments with what the library makes of them."""
        spaced = [f for f in fragments if f[0] == " " and len(f) > 1] if self.dummy_prefix and not self.squeeze else []
        for fragment, theirs in zip(spaced, self.library.encode([f[1:] for f in spaced], num_threads=1), strict=True):
            if self.cache[fragment] != np.array(theirs, "<u4").tobytes():
                raise ValueError(f"{fragment!r}: {np.frombuffer(self.cache[fragment], '<u4')} here, {theirs} in the library")

    def check_text(self, text: str | None, numbers: bytes, decoded: str) -> None:
        theirs = self.library.encode(text, num_threads=1) if text else []
        if ",".join(map(str, theirs)).encode() != numbers or (self.library.decode(theirs) if theirs else "") != decoded or self.decode(theirs) != decoded:
            raise ValueError(f"a text of {len(text or '')} characters differs from the library")


_LETTER = re.compile(r"[^\W\d_]")
_BY_SPACE = re.compile(r" *[^ ]+| +")
_BY_SPACE_AND_LETTERS = re.compile(r" *[^\W\d_]+| *(?:[^\w ]|[\d_])+| +")


def _utf8(run: bytes) -> str:
    """UTF-8 text; a byte that starts no valid character becomes U+FFFD."""
    out, at = [], 0
    while at < len(run):
        for width in (1, 2, 3, 4):
            try:
                out.append(run[at : at + width].decode("utf-8"))
                at += width
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�")
            at += 1
    return "".join(out)


_CODERS: dict[str, PieceCoder] = {}


def coder(model: bytes) -> PieceCoder:
    """The worker's coder of this model."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _CODERS:
        _CODERS[key] = PieceCoder(model)
    return _CODERS[key]


def read_model(path: str) -> bytes:
    """A model file of some hundred kB, read by the driver from the tokenizer package."""
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, model_path: str, verify: int = 8) -> DataFrame:
    """doc_id, ids (array of int) and decoded text of every row of ``docs(doc_id, text)``."""
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, rows in _coded(batches, model.value, verify):
            ids = [list(map(int, numbers.split(b","))) if numbers else [] for _, numbers, _ in rows]
            yield pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.list_(pa.int32())), pa.array([d for _, _, d in rows], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def token_digests(docs: DataFrame, model_path: str, verify: int = 8) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of ``docs(doc_id, text)``."""
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, rows in _coded(batches, model.value, verify):
            yield pa.RecordBatch.from_arrays(
                [
                    keys,
                    pa.array([n for n, _, _ in rows], pa.int64()),
                    pa.array([hashlib.sha256(numbers).hexdigest() for _, numbers, _ in rows], pa.string()),
                    pa.array([hashlib.sha256(decoded.encode("utf-8")).hexdigest() for _, _, decoded in rows], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, ENCODED)


def _coded(batches: Iterable[pa.RecordBatch], model: bytes, verify: int, step: int = 1024) -> Iterator[tuple[pa.Array, list[tuple[int, bytes, str]]]]:
    """(doc_ids, round trips) for some rows at a time."""
    own = coder(model)
    gc.disable()  # the remembered fragments hold no cycles, and there are many of them
    try:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                texts = [own.fragments(text.as_py() or "") for text in batch.column(1)]
                fresh = own.remember(set().union(*texts))
                rows = [own.round_trip(fragments) for fragments in texts]
                if verify:
                    own.check_fragments(fresh[::verify])
                    if at == 0:
                        own.check_text(batch.column(1)[0].as_py(), *rows[0][1:])
                for fragment in fresh:
                    if len(fragment) > LONG:
                        del own.cache[fragment]
                yield batch.column(0), rows
    finally:
        gc.enable()
