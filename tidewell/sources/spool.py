"""Spool segments: binary files of framed samples that a forwarder keeps until they are acknowledged.

A Spark data source (``spark.read.format("spool")``): a segment is a partition. A frame is its length and CRC-32C, then a
sample; a segment ends at its first frame that is short, of another length or fails its checksum, as a forwarder
would cut it. Segments are read and written through pyarrow's file systems, so a path may be any URI these know.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

# The format of a segment.
MAGIC, VERSION, HEADER = b"FDSPOOL1", 1, 64
_HEAD = np.dtype([("magic", "S8"), ("version", "<u4"), ("size", "<u4"), ("stream", "V16"), ("created_ms", "<i8"), ("start_seq", "<u8"), ("rest", "V16")])
_FRAME = np.dtype([("length", "<u4"), ("crc", "<u4"), ("sensor", "<u4"), ("seq", "<u8"), ("ms", "<i8"), ("value", "<f8"), ("quality", "<i2"), ("time_quality", "<u2"), ("monotonic_ms", "<u8")])
SAMPLE = _FRAME.itemsize - 8
POLYNOMIAL = 0x82F63B78  # CRC-32C, reflected

SAMPLES = "stream_id string, start_seq long, sensor_idx long, seq long, ms long, value double, quality int, time_quality int, monotonic_ms long"


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


_TABLE = _crc_table()


def checksums(rows: np.ndarray) -> np.ndarray:
    """CRC-32C of each row of bytes, all rows at once."""
    crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for column in rows.T:
        crc = _TABLE[(crc ^ column) & 0xFF] ^ (crc >> 8)
    return crc ^ np.uint32(0xFFFFFFFF)


def decode(data: bytes) -> tuple[str, int, np.ndarray] | None:
    """(stream, first number, whole frames up to the first that is broken); None if it is no segment."""
    if len(data) < HEADER:
        return None
    head = np.frombuffer(data, _HEAD, 1)[0]
    if bytes(head["magic"]) != MAGIC or head["version"] != VERSION or head["size"] != HEADER:
        return None
    frames = np.frombuffer(data, _FRAME, (len(data) - HEADER) // _FRAME.itemsize, HEADER)
    payload = np.frombuffer(data, np.uint8, len(frames) * _FRAME.itemsize, HEADER).reshape(-1, _FRAME.itemsize)[:, 8:]
    broken = np.flatnonzero((frames["length"] != SAMPLE) | (frames["crc"] != checksums(payload)))
    return str(uuid.UUID(bytes=head["stream"].tobytes())), int(head["start_seq"]), frames[: broken[0]] if len(broken) else frames


def encode(stream_id: str, samples: dict[str, np.ndarray], created_ms: int = 0) -> bytes:
    """A segment of samples (sensor_idx, seq, ms, value, quality, time_quality, monotonic_ms) in order of their numbers."""
    order = np.argsort(samples["seq"], kind="stable")
    frames = np.zeros(len(order), _FRAME)
    for name, column in (("sensor", "sensor_idx"), ("seq", "seq"), ("ms", "ms"), ("value", "value"), ("quality", "quality"), ("time_quality", "time_quality"), ("monotonic_ms", "monotonic_ms")):
        frames[name] = samples[column][order]
    frames["length"] = SAMPLE
    frames["crc"] = checksums(frames.view(np.uint8).reshape(-1, _FRAME.itemsize)[:, 8:])
    head = np.zeros(1, _HEAD)
    head["magic"], head["version"], head["size"], head["created_ms"] = MAGIC, VERSION, HEADER, created_ms
    head["stream"], head["start_seq"] = np.void(uuid.UUID(stream_id).bytes), frames["seq"][0] if len(frames) else 0
    return head.tobytes() + frames.tobytes()


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


@dataclass
class Segment(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        """One for each segment, closed or still open."""
        from pyarrow import fs

        files, root = _files(self.path)
        found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return [Segment(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.base_name.startswith("seg-") and f.extension in ("seg", "open")]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        files, _ = _files(self.path)
        with files.open_input_stream(partition.path) as f:
            found = decode(f.read())
        if found is None:
            return
        stream, start, frames = found
        names = ("sensor", "seq", "ms", "value", "quality", "time_quality", "monotonic_ms")
        for at in range(0, len(frames), 65_536):
            some = frames[at : at + 65_536]
            columns = [pa.array([stream] * len(some), pa.string()), pa.array(np.full(len(some), start), pa.int64())]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int64())
            columns += [pa.array(np.ascontiguousarray(some[n]).astype(kind.to_pandas_dtype()), kind) for n, kind in zip(names, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SAMPLES.split(", ")])


class _Writer(DataSourceArrowWriter):
    """A segment for each stream of a task's rows, in order of their numbers; it appears under its name when it is whole."""

    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        waiting: dict[str, pa.Table] = {}
        for batch in iterator:
            table = pa.Table.from_batches([batch])
            for stream in table.column("stream_id").unique().to_pylist():
                own = table.filter(pc.equal(table.column("stream_id"), stream))
                own = pa.concat_tables([waiting[stream], own]) if stream in waiting else own
                while own.num_rows >= self.most:
                    self._put(stream, own.slice(0, self.most))
                    own = own.slice(self.most)
                waiting[stream] = own
        for stream, table in waiting.items():
            if table.num_rows:
                self._put(stream, table)
        return WriterCommitMessage()

    def _put(self, stream: str, table: pa.Table) -> None:
        columns = {c: table.column(c).to_numpy() for c in table.schema.names if c not in ("stream_id", "start_seq")}
        files, root = _files(self.path)
        files.create_dir(root, recursive=True)
        name = f"seg-{stream}-{columns['seq'].min()}-{columns['seq'].max()}.seg"
        hidden = f"{root}/.{name}.{uuid.uuid4().hex}"
        with files.open_output_stream(hidden) as f:
            f.write(encode(stream, columns))
        files.move(hidden, f"{root}/{name}")


class SpoolSource(DataSource):
    """Options: path; max_samples, of a written segment (1,000,000)."""

    @classmethod
    def name(cls) -> str:
        return "spool"

    def schema(self) -> str:
        return SAMPLES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], int(self.options.get("max_samples", 1_000_000)))


def read_spool(spark: SparkSession, path: str) -> DataFrame:
    """Samples of all segments in a folder; a sample that lies in two segments twice."""
    spark.dataSource.register(SpoolSource)
    return spark.read.format("spool").option("path", path).load()


def write_spool(samples: DataFrame, path: str, max_samples: int = 1_000_000) -> None:
    """Segments of ``samples`` (as ``SAMPLES`` has them, without start_seq), a stream's samples together in order."""
    samples.sparkSession.dataSource.register(SpoolSource)
    names = [c.split()[0] for c in SAMPLES.split(", ")]
    whole = samples.withColumn("start_seq", F.lit(0).cast("long")).select(*names)
    whole.repartition("stream_id", F.floor(F.col("seq") / max_samples)).sortWithinPartitions("stream_id", "seq").write.format("spool").option("path", path).option("max_samples", max_samples).mode("append").save()


def replay(samples: DataFrame, acked: DataFrame) -> DataFrame:
    """What is still to be sent: each sample once, of those after the number that ``acked(stream_id, acked)`` holds for its stream."""
    left = samples.join(acked, "stream_id", "left").where(F.col("seq") > F.coalesce("acked", F.lit(0))).drop("acked", "start_seq")
    return left.groupBy("stream_id", "seq").agg(F.min(F.struct("sensor_idx", "ms", "value", "quality", "time_quality", "monotonic_ms")).alias("s")).select("stream_id", "seq", "s.*")
