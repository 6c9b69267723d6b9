"""Token ids in Arrow files of fixed-size-list batches: zero-copy access to equal-length sequences and masks.

Documents are range-partitioned and sorted by doc_id; each partition's ids, every document closed by an end id, are
packed into sequences of equal length. A file holds whole documents, so only its last sequence is padded. Its columns:

* ``input_ids``: fixed-size list of the smallest unsigned type that holds the vocabulary;
* ``mask``: fixed-size list of booleans, true for ids, false for padding;
* ``ends``: fixed-size list of booleans, true at each document's end id;
* ``doc_ids``: the documents that end in the sequence, in order.

Schema metadata: ``part`` (the partition, in doc_id order), ``start`` (ids of the partition before this file).

A file is one row of Spark's text writer, which ends each row with a separator of the user's choice: the closing magic
of an Arrow file. So files go through Spark's own commit protocol to any file system it knows, and a lost or repeated
task leaves no stray file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.ipc as ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .pretokens import library_encoder
from .shared import shared_folder, small_batches, written

#: Ids in a sequence, sequences in a batch, and ids after which a file ends with the document at hand.
LENGTH, BATCH, FILE_IDS = 2048, 256, 2_000_000
#: The last bytes of an Arrow file.
MAGIC = "ARROW1"


def _lists(values: pa.Array) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(values, LENGTH)


def _bits(flags: np.ndarray) -> pa.Array:
    packed = np.packbits(flags, bitorder="little").tobytes()
    return _lists(pa.Array.from_buffers(pa.bool_(), len(flags), [None, pa.py_buffer(packed)]))


def arrow_file(ids: np.ndarray, sizes: list[int], doc_ids: list[int | None], part: int, start: int) -> bytes:
    """The bytes of a file with these documents."""
    rows = -(-len(ids) // LENGTH)
    padded = np.zeros(rows * LENGTH, ids.dtype)
    padded[: len(ids)] = ids
    mask, ends = np.zeros(len(padded), bool), np.zeros(len(padded), bool)
    mask[: len(ids)] = True
    last = np.cumsum(sizes, dtype=np.int64) - 1
    ends[last] = True
    offsets = np.searchsorted(last, np.arange(rows + 1, dtype=np.int64) * LENGTH)
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(doc_ids, pa.int64()))
    columns = {"input_ids": _lists(pa.array(padded)), "mask": _bits(mask), "ends": _bits(ends), "doc_ids": lists}
    found = pa.table(columns).replace_schema_metadata({"part": str(part), "start": str(start)})
    out = pa.BufferOutputStream()
    with ipc.new_file(out, found.schema) as writer:
        writer.write_table(found, max_chunksize=BATCH)
    return out.getvalue().to_pybytes()


def _packed(path: str, pattern: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library_encoder(path, pattern)
        end = np.array([end_id], encode.kind).tobytes()
        width, part, start = encode.kind.itemsize, TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        sizes: list[int] = []
        doc_ids: list[int | None] = []
        count = 0

        def file() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), encode.kind)
            value = arrow_file(ids, sizes, doc_ids, part, start)
            return pa.RecordBatch.from_arrays([pa.array([value.removesuffix(MAGIC.encode())], pa.binary())], ["value"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                held.append(ids)
                sizes.append(len(ids) // width)
                doc_ids.append(doc_id)
                count += sizes[-1]
                if count >= FILE_IDS:
                    yield file()
                    start += count
                    held, sizes, doc_ids, count = [], [], [], 0
        if sizes:
            yield file()

    return run


def write_token_files(docs: DataFrame, tokenizer: str, pattern: str, folder: str, end_id: int = 0) -> None:
    """Write the ids of every row of ``docs(doc_id, text)`` to Arrow files in ``folder``, in ascending doc_id order.

    A null text counts as empty; null doc_ids come first; rows of equal doc_id are ordered by text. No rows: no files.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = dealt.mapInArrow(_packed(tokenizer, pattern, end_id), "value binary").select(F.col("value").cast("string").alias("value"))
    files.write.option("lineSep", MAGIC).option("maxRecordsPerFile", 1).text(folder)


class SequenceFile:
    """Random access to the sequences of a file, from its path (memory-mapped) or its bytes; nothing is copied."""

    def __init__(self, source: str | bytes | pa.Buffer):
        self.file = ipc.open_file(pa.memory_map(source) if isinstance(source, str) else source)
        self.part, self.start = (int(self.file.schema.metadata[k]) for k in (b"part", b"start"))

    def batch(self, number: int) -> pa.RecordBatch:
        return self.file.get_batch(number)

    def __getitem__(self, number: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of one sequence: views of the file."""
        batch, row = self.batch(number // BATCH), number % BATCH
        values = batch.column("input_ids").values.to_numpy()[row * LENGTH : (row + 1) * LENGTH]
        return values, batch.column("mask").values.slice(row * LENGTH, LENGTH)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, start within the partition and ids (with the end id) of each document."""
        found = self.file.read_all()
        flat = lambda c: found[c].combine_chunks().flatten()
        ids = flat("input_ids").to_numpy()
        last = np.flatnonzero(flat("ends").to_numpy(zero_copy_only=False))
        begin = 0
        for doc_id, end in zip(flat("doc_ids").to_pylist(), last.tolist(), strict=True):
            yield doc_id, self.start + begin, ids[begin : end + 1]
            begin = end + 1


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            file = SequenceFile(content.as_buffer())
            rows = [(file.part, doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for doc_id, start, ids in file.documents()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["part", "doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files; ``start`` counts all ids before it."""
    kinds = "part long, doc_id long, start long, n_tokens long, ids_crc32 long"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    documents = written(files.mapInArrow(_summaries, kinds), "summaries")
    parts = documents.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each partition written
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("before"))
    return documents.join(parts, "part").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, pattern: str) -> DataFrame:
    """Write the files to the shared folder and read them back."""
    folder = f"{shared_folder(docs.sparkSession)}/tokens"
    write_token_files(docs, tokenizer, pattern, folder)
    return read_token_files(docs.sparkSession, folder)
