"""WARC archives: write, normalise from monolithic gzip, index, and read back.

* ``write_archives`` writes WARC/1.1 files, each one gzip stream over the whole file: a response
  record for a payload, and a revisit record (identical payload digest) for later copies of it.
* ``normalise`` inflates such a stream once from front to back, rewrites each record as a gzip
  member of its own, and writes a sidecar index (id, offset, length) next to it. Memory is one
  record and one read buffer.
* ``read_records`` opens the archives through their indexes, inflates each member alone and
  returns what its headers and block say.

Files go to a folder that all executors share, under names made from the partition and a random
part, and become known only by the rows that a finished task returns; a repeated task writes
other files, so a lost executor leaves at most unused ones.

Null html is an empty payload. Payloads under ``least`` bytes are always responses. Of records
with equal payloads the smallest page_id is the response; rows that repeat that page_id are
responses too. Null page_ids are written and read back as null, never deduplicated. Urls that are
null or hold line breaks are written percent-encoded. An empty table writes nothing.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import materialize, shared_dir

READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"


def record_table(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, html, digest and refers_to (null for responses) of every page."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8")
    facts = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    first = pages.where(F.col("page_id").isNotNull()).select("page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n")).where(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    refers = F.when(F.col("page_id") != F.col("first"), F.col("first"))
    return facts.join(first, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


# ---- records ------------------------------------------------------------------------------


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record with its closing blank lines. A revisit holds the HTTP head alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    name = "null" if page_id is None else str(page_id)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + _END + block + _END


def headers(head: bytes) -> dict[str, str]:
    """Named fields of a record's or an HTTP message's head."""
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8").split("\r\n")[1:])}


def split_records(stream: Iterable[bytes]) -> Iterator[bytes]:
    """Whole records, with their closing blank lines, of an inflated stream."""
    buffer = bytearray()
    need = None  # bytes of the record at the buffer's front
    searched = 0
    for part in stream:
        buffer += part
        while True:
            if need is None:
                at = buffer.find(_END, max(0, searched - 3))
                searched = len(buffer)
                if at < 0:
                    break
                need = at + 4 + int(headers(bytes(buffer[:at]))["content-length"]) + 4
            if len(buffer) < need:
                break
            yield bytes(buffer[:need])
            del buffer[:need]
            need, searched = None, 0
    if buffer:
        raise ValueError(f"the archive ends within a record, {len(buffer)} bytes after the last one")


def inflate(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """What a gzip file holds, whether in one member or many."""
    inflater = zlib.decompressobj(31)
    for chunk in chunks:
        while chunk:
            yield inflater.decompress(chunk)
            chunk = inflater.unused_data
            if inflater.eof:
                inflater = zlib.decompressobj(31)


def parse_record(record: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload length, digest, type and refers_to of one record.

    A response's digest is computed from its payload and must equal the header's.
    """
    head, _, rest = record.partition(_END)
    fields = headers(head)
    block = memoryview(rest)[: int(fields["content-length"])]
    http_end = rest.index(_END) + 4
    size = int(headers(rest[: http_end - 4])["content-length"])
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    if fields["warc-type"] == "response":
        payload = block[http_end:]
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"{fields['warc-record-id']}: the payload does not match its digest")
    page, refers = (_page(fields[k]) if k in fields else None for k in ("warc-record-id", "warc-refers-to"))
    return page, size, digest, fields["warc-type"], refers


def _page(urn: str) -> int | None:
    name = urn[1:-1].rpartition(":")[2]
    return None if name == "null" else int(name)


# ---- files --------------------------------------------------------------------------------


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _chunks(file, size: int = 1 << 20) -> Iterator[bytes]:
    while part := file.read(size):
        yield part


def write_archives(records: DataFrame, folder: str, archive_bytes: int = 64 << 20) -> DataFrame:
    """path of each monolithic archive of the rows of ``record_table``; new ones begin at ``archive_bytes``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        paths, out, packer, size = [], None, None, 0
        for batch in batches:
            for row in zip(*(batch.column(k) for k in range(5)), strict=True):
                page, url, payload, digest, refers = (x.as_py() for x in row)
                if out is None:
                    paths.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, packer, size = fs.open_output_stream(f"{base}/{paths[-1]}", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31), 0
                record = warc_record(page, url, payload, digest, refers)
                out.write(packer.compress(record))
                size += len(record)
                if size >= archive_bytes:
                    out.write(packer.flush())
                    out.close()
                    out = None
        if out is not None:
            out.write(packer.flush())
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    return records.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "path string")


def _member(record: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


_ENTRY = "<QQ"


def normalise(archives: DataFrame, source: str, target: str) -> DataFrame:
    """path of each archive of ``archives(path)`` rewritten in ``target``, with ``path.idx`` beside it.

    The index is a row of (offset, length) in little-endian 64-bit numbers for each record.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, old = _open(source)
        _, new = _open(target)
        fs.create_dir(new, recursive=True)
        for batch in batches:
            made = []
            for path in batch.column(0).to_pylist():
                name, at, index = f"{uuid.uuid4().hex}.warc.gz", 0, io.BytesIO()
                with fs.open_input_stream(f"{old}/{path}", compression=None) as file, fs.open_output_stream(f"{new}/{name}", compression=None) as out:
                    for record in split_records(inflate(_chunks(file))):
                        member = _member(record)
                        out.write(member)
                        index.write(struct.pack(_ENTRY, at, len(member)))
                        at += len(member)
                with fs.open_output_stream(f"{new}/{name}.idx", compression=None) as out:
                    out.write(index.getvalue())
                made.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["path"])

    return archives.select("path").mapInArrow(run, "path string")


def read_records(archives: DataFrame, folder: str) -> DataFrame:
    """What the records of the normalised archives say, each opened at its index entry."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_file(f"{base}/{path}.idx") as file:
                    entries = list(struct.iter_unpack(_ENTRY, file.read()))
                with fs.open_input_stream(f"{base}/{path}", compression=None, buffer_size=1 << 20) as file:
                    for at in range(0, len(entries), 1024):
                        rows = [parse_record(zlib.decompress(file.read(length), 31)) for _, length in entries[at : at + 1024]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], [f.split()[0] for f in READ.split(", ")])

    return archives.select("path").mapInArrow(run, READ)


def read_record_at(folder: str, path: str, number: int) -> bytes:
    """One record by its place in the index, without reading the others."""
    fs, base = _open(folder)
    with fs.open_input_file(f"{base}/{path}.idx") as file:
        file.seek(number * struct.calcsize(_ENTRY))
        offset, length = struct.unpack(_ENTRY, file.read(struct.calcsize(_ENTRY)))
    with fs.open_input_file(f"{base}/{path}") as file:
        file.seek(offset)
        return zlib.decompress(file.read(length), 31)


def archive_pages(pages: DataFrame, least: int = 100) -> DataFrame:
    """Write all pages, normalise the archives and read them back: a row per record."""
    base = shared_dir(pages.sparkSession)
    written = materialize(write_archives(record_table(pages, least), f"{base}/whole"))
    tasks = max(1, written.count())
    normal = materialize(normalise(written.repartition(tasks), f"{base}/whole", f"{base}/members"))
    return read_records(normal.repartition(tasks), f"{base}/members")
