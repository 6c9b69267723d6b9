"""Helpers that every training-data operator uses: the shared folder, row counts as sizes, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch handed to Python; long texts make larger batches costly.
BATCH_ROWS = 1024


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors see.

    A folder of this machine is only taken in a local session without that setting (tests).
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        kept = context._jsc.sc().getCheckpointDir()
        if not kept.isDefined():
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="lettermill-"))
            kept = context._jsc.sc().getCheckpointDir()
        root = kept.get()
    return f"{root.rstrip('/')}/lettermill-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """``written`` with sums over its rows, which are taken while they are written."""
    seen = Observation()
    table = written(df.observe(seen, *[value.alias(key) for key, value in metrics.items()]), name)
    return table, seen.get


def discard(table: DataFrame) -> None:
    """Remove the files of a written table that nothing will read again: what was made of it is written, too."""
    spark = table.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Bytes of files up to which a written table is broadcast.
BROADCAST_BYTES = 16 << 20


def broadcast_if_small(table: DataFrame) -> DataFrame:
    """A written table with the hint to broadcast it, if its files say that it is small; else as it is."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts, unless the session asks for smaller ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def by_batch(make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: ``make`` runs once a task and gives the function for its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield step(batch)
        del step
        release()

    return run


def release() -> None:
    """Give freed memory back to the system at a task's end: worker processes live on and would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)
