"""Append-only segments of RAW frames: scan, reads that seek, and a distributed sink.

A frame: magic, id, length and checksum (8 bytes each, little-endian), then the payload. A segment isn't splittable, so
a scan has one task a segment; files are read through Spark, wherever they are. The first bad frame ends its segment.
Reads by coordinate open a segment and seek, without reading the rest of it; the sink writes each segment in one task.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from ..functions.fills import filled
from ..functions.hashes import fnv64
from ..session import local_path, scratch_folder

#: The segment format (fixed values).
MAGIC, HEADER = b"MAARC001", struct.Struct("<8sQQQ")
SEGMENT_BYTES = 64 * 1024 * 1024
#: Bytes of segments from which on a partition of the source is full: small segments share a task.
PART_BYTES = SEGMENT_BYTES // 8
FRAMES = "segment string, offset long, frame_bytes long, doc_id decimal(20,0), raw binary, raw_digest binary, status string, reason string"


def frame(doc_id: int, raw: bytes) -> bytes:
    return HEADER.pack(MAGIC, doc_id, len(raw), fnv64(raw)) + raw


def scan(segment: str, data: bytes) -> Iterator[tuple]:
    """``segment, offset, frame_bytes, doc_id, raw, status, reason``: valid frames, then at most one fault (corrupt or tail)."""
    at = 0
    while at < len(data):
        left = len(data) - at
        fault = lambda status, reason, at=at, left=left: (segment, at, left, None, None, status, reason)
        if left < HEADER.size:
            yield fault("tail", "incomplete frame header")
            return
        magic, doc_id, length, checksum = HEADER.unpack_from(data, at)
        if magic != MAGIC:
            yield fault("corrupt", "frame magic mismatch")
            return
        if length > (1 << 63) - 1 - HEADER.size - at:
            yield fault("corrupt", "frame length overflow")
            return
        if length > left - HEADER.size:
            yield fault("corrupt", "frame body exceeds the segment")
            return
        raw = data[at + HEADER.size : at + HEADER.size + length]
        if fnv64(raw) != checksum:
            yield fault("corrupt", "frame checksum mismatch")
            return
        yield segment, at, HEADER.size + length, doc_id, raw, "valid", None
        at += HEADER.size + length


_FOUND = "segment string, offset long, frame_bytes long, doc_id decimal(20,0), raw binary, status string, reason string"
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.decimal128(20, 0), pa.binary(), pa.string(), pa.string()]
#: Payload bytes and frames that go to Spark at once.
_BATCH_BYTES, _BATCH_ROWS = 16 << 20, 4096


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append((*row[:3], None if row[3] is None else Decimal(row[3]), *row[4:]))
        size += len(row[4] or b"")
        if size >= _BATCH_BYTES or len(held) >= _BATCH_ROWS:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [part.split()[0] for part in _FOUND.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], names)


def _with_digest(rows: DataFrame) -> DataFrame:
    return rows.withColumn("raw_digest", F.unhex(F.sha2("raw", 256))).select("segment", "offset", "frame_bytes", "doc_id", "raw", "raw_digest", "status", "reason")


def read_frames(spark: SparkSession, folder: str) -> DataFrame:
    """All frames and faults of a folder's segments (FRAMES)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from _batches(scan(path.rsplit("/", 1)[-1], data.as_py()))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.arc").load(folder).select("path", "content")
    return _with_digest(files.mapInArrow(run, _FOUND))


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, local or by its URI, and the folder's path there."""
    folder = local_path(folder)
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def _frame_at(file, size: int, segment: str, at: int) -> tuple:
    """The frame or fault at an offset; only its own bytes are read."""
    fault = lambda status, reason: (segment, at, max(size - at, 0), None, None, status, reason)
    if at < 0 or at >= size:
        return fault("missing", "no frame at the coordinate")
    file.seek(at)
    head = file.read(HEADER.size)
    if len(head) < HEADER.size:
        return fault("tail", "incomplete frame header")
    length = HEADER.unpack(head)[2]
    body = file.read(length) if length <= size - at - HEADER.size else b""
    found = next(scan(segment, head + body))
    status, reason = found[5:]
    if status != "valid":
        return fault(status, reason)
    return segment, at, *found[2:]


def seek_frames(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """FRAMES at the coordinates ``wanted(segment, offset)``, each read by a seek; equal ones once.

    A coordinate without a sound frame gives a row with its fault; ``missing``: nothing is there. Segments that hold many
    wanted frames are read by several tasks.
    """
    run_bytes = SEGMENT_BYTES // 8
    rows = wanted.select("segment", F.col("offset").cast("long").alias("offset")).distinct()
    rows = rows.repartition("segment", F.expr(f"offset div {run_bytes}")).sortWithinPartitions("segment", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        system, root = _opened(folder)
        name, file, size = None, None, 0
        for batch in batches:
            for segment, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if segment != name:
                    if file is not None:
                        file.close()
                    name, file, size = segment, None, 0
                    if segment and "/" not in segment and system.get_file_info(f"{root}/{segment}").is_file:
                        file = system.open_input_file(f"{root}/{segment}")
                        size = file.size()
                yield _frame_at(file, size, segment, -1 if at is None else at)
        if file is not None:
            file.close()

    return _with_digest(rows.mapInArrow(lambda batches: _batches(read(batches)), _FOUND))


def segment_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """``segment, bytes``: the files, without their contents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.arc").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("segment"), F.col("length").alias("bytes"))


def directory_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """``bytes``: of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("bytes"))


def read_at(spark: SparkSession, folder: str, segment: str, offset: int) -> DataFrame:
    """The frame at a coordinate, by a seek."""
    return seek_frames(spark, folder, spark.createDataFrame([(segment, offset)], "segment string, offset long"))


def read_range(spark: SparkSession, folder: str, messages: DataFrame, start: int, end: int) -> DataFrame:
    """Frames of start <= doc_id < end with the catalogue's ``claimed_id``, by that id; only these are read."""
    wanted = messages.filter((F.col("doc_id") >= start) & (F.col("doc_id") < end)).select("segment", F.col("archive_offset").alias("offset"), F.col("doc_id").alias("claimed_id"))
    return seek_frames(spark, folder, wanted).join(wanted, ["segment", "offset"]).orderBy("claimed_id")


def _rotated(limit: int):
    def step(state: tuple[int, int], size: int) -> tuple[tuple, tuple]:
        number, at = state
        if at > 0 and at + size > limit:
            number, at = number + 1, 0
        return (number, at + size), (number, at)

    return step


def assign_segments(records: DataFrame, order: str, size: str, writer: str, limit: int = SEGMENT_BYTES) -> DataFrame:
    """``writer, order, size, segment_number, offset``: frames in order; a frame that would pass the limit starts a segment.

    A frame larger than the limit stands alone. Filling is sequential within a writer and keeps a running offset only.
    """
    placed = filled(records, order, size, writer, "segment_number long, offset long", (0, 0), _rotated(limit))
    return placed.withColumn("segment_number", F.col("segment_number").cast("int"))


def _written(system: fs.FileSystem, root: str, segment: str, rows: Iterator[tuple[int, bytes]]) -> list[tuple[int, str, int, int]]:
    """Write one segment under another name, and give it its own once it is whole: a repeated task leaves the same file."""
    path, at, placed = f"{root}/.{segment}.{uuid.uuid4().hex}", 0, []
    with system.open_output_stream(path) as file:
        for doc_id, raw in rows:
            data = frame(doc_id, raw)
            file.write(data)
            placed.append((doc_id, segment, at, len(data)))
            at += len(data)
    if isinstance(system, fs.LocalFileSystem):
        held = os.open(path, os.O_RDONLY)
        os.fsync(held)
        os.close(held)
    system.move(path, f"{root}/{segment}")
    return placed


def write_segments(records: DataFrame, folder: str, limit: int = SEGMENT_BYTES, first: int = 0, writers: int | None = None) -> DataFrame:
    """Write ``records(doc_id, raw)`` as new segments, numbered from ``first``: ``doc_id, segment, offset, frame_bytes``.

    A doc_id names one record, as in the catalogue. Records are dealt into ranges of doc_id, one a writer; each writer fills
    segments in order; a null RAW is an empty frame. Places are computed from the sizes first, so a segment has one name and one content whichever task writes it, and as often as it does. The
    receipt is a table in the shared folder; it exists once all segments do.
    """
    spark = records.sparkSession
    records = records.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("raw", F.lit(b"")).alias("raw"))
    bounds = writers or int(spark.conf.get("spark.sql.shuffle.partitions"))
    scratch = scratch_folder(spark)
    sizes = records.select("doc_id", (F.octet_length("raw") + HEADER.size).cast("long").alias("size"))
    ranged = sizes.repartitionByRange(bounds, "doc_id").withColumn("writer", F.spark_partition_id())
    ranged.write.parquet(f"{scratch}/sizes")
    assign_segments(spark.read.parquet(f"{scratch}/sizes"), "doc_id", "size", "writer", limit).write.parquet(f"{scratch}/places")
    places = spark.read.parquet(f"{scratch}/places")
    used = {r["writer"]: r["n"] for r in places.groupBy("writer").agg((F.max("segment_number") + 1).alias("n")).collect()}  # a row a writer
    before, base = first, []
    for writer in sorted(used):
        base.append((writer, before))
        before += used[writer]
    places = places.join(F.broadcast(spark.createDataFrame(base, "writer int, base int")), "writer") if base else places.withColumn("base", F.lit(first))
    places = places.select("doc_id", "offset", F.format_string("segment-%06d.arc", F.col("segment_number") + F.col("base")).alias("segment"))
    rows = records.join(places, "doc_id").repartition("segment").sortWithinPartitions("segment", "offset").select("doc_id", "raw", "segment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _opened(folder)
        system.create_dir(root, recursive=True)
        all_rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for segment, members in groupby(all_rows, key=lambda r: r[2]):
            placed = _written(system, root, segment, ((i, raw) for i, raw, _ in members))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in placed], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["doc_id", "segment", "offset", "frame_bytes"])

    rows.mapInArrow(run, "doc_id long, segment string, offset long, frame_bytes long").write.parquet(f"{scratch}/receipt")
    return spark.read.parquet(f"{scratch}/receipt")


def next_segment(on_disk: list[str], claimed: list[str]) -> int:
    """A segment number above all on disk and in the catalogue."""
    numbers = [int(n[8:-4]) for n in (*on_disk, *claimed) if n.startswith("segment-") and n.endswith(".arc") and n[8:-4].isdigit()]
    return max(numbers, default=-1) + 1


class SegmentSource(DataSource):
    """``read_segments``: whole segments of PART_BYTES together or one a partition, only those that the filters leave; a coordinate is read by a seek."""

    @classmethod
    def name(cls) -> str:
        return "segments"

    def schema(self) -> str:
        return _FOUND

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def read_segments(spark: SparkSession, folder: str) -> DataFrame:
    """The frames of a folder's segments, on any file system that Arrow opens, with filters on segment and offset pushed down.

    A filter on both by equality reads the bytes of those frames alone. As it doesn't look at what stands before them, it also
    finds a frame behind a corrupt one, where a scan ends. Spark keeps pushed filters with the loaded source: for two filters
    in one query, load it twice.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SegmentSource)
    return spark.read.format("segments").load(folder)


@dataclass
class _Part(InputPartition):
    segments: tuple[str, ...]
    offsets: tuple[int, ...] | None  # frames to seek in each; None: all


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.segments: set[str] | None = None
        self.offsets: set[int] | None = None
        self.least, self.most = 0, (1 << 63) - 1

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and membership of segment and offset, and bounds of offset; Spark applies the others."""
        both = lambda held, new: set(new) if held is None else held & set(new)
        for one in filters:
            column = one.attribute if isinstance(one, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) else None
            values = one.value if isinstance(one, In) else (one.value,) if column else ()
            if column == ("segment",) and isinstance(one, (EqualTo, In)):
                self.segments = both(self.segments, values)
            elif column == ("offset",) and isinstance(one, (EqualTo, In)):
                self.offsets = both(self.offsets, values)
            elif column == ("offset",) and isinstance(one, (GreaterThan, GreaterThanOrEqual)):
                self.least = max(self.least, one.value + isinstance(one, GreaterThan))
            elif column == ("offset",):
                self.most = min(self.most, one.value - isinstance(one, LessThan))
            elif not (isinstance(one, IsNotNull) and one.attribute in (("segment",), ("offset",))):
                yield one

    def partitions(self) -> list[InputPartition]:
        system, root = _opened(self.path)
        sizes = sorted((f.base_name, f.size) for f in system.get_file_info(fs.FileSelector(root)) if f.is_file and f.base_name.endswith(".arc") and not f.base_name.startswith("."))
        wanted = [x for x in sizes if self.segments is None or x[0] in self.segments]
        spots = None if self.offsets is None else tuple(sorted(x for x in self.offsets if x is not None and self.least <= x <= self.most))
        parts, held = [], PART_BYTES
        for name, size in wanted if spots is None or spots else []:
            if held >= PART_BYTES:
                parts.append([])
                held = 0
            parts[-1].append(name)
            held += size or 0
        return [_Part(tuple(names), spots) for names in parts]

    def read(self, partition: _Part) -> Iterator[tuple]:
        system, root = _opened(self.path)
        for segment in partition.segments:
            with system.open_input_file(f"{root}/{segment}") as file:
                for row in self._rows(file, segment, partition.offsets):
                    yield (*row[:3], None if row[3] is None else Decimal(row[3]), *row[4:])

    def _rows(self, file, segment: str, offsets: tuple[int, ...] | None) -> Iterator[tuple]:
        if offsets is None:
            yield from (r for r in scan(segment, file.read()) if self.least <= r[1] <= self.most)
            return
        size, rest = file.size(), set()
        for at in offsets:
            row = _frame_at(file, size, segment, at)
            if row[5] == "valid":
                yield row
            elif row[5] != "missing":
                rest.add(at)
        if rest:  # a fault, or no frame's start: a scan tells
            file.seek(0)
            yield from (r for r in scan(segment, file.read()) if r[1] in rest)
