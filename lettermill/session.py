"""Sessions and table access."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings that the library's results rely on (UTC, ANSI, AQE)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lettermill")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, where PYTHONPATH doesn't hold it already."""
    context = spark.sparkContext
    on_path = any(p and Path(p).resolve() == _PACKAGE.parent for p in os.environ.get("PYTHONPATH", "").split(os.pathsep))
    if not on_path and not getattr(context, "_lettermill_shipped", False):
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "lettermill"), "zip", _PACKAGE.parent, _PACKAGE.name)
        context.addPyFile(archive)
        context._lettermill_shipped = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors see. Only a local session does without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="lettermill-")
    return f"{root.rstrip('/')}/lettermill-{uuid.uuid4().hex}"


def local_path(folder: str) -> str:
    """A folder without the scheme of local files; other folders as they are."""
    return "/" + folder.removeprefix("file:").lstrip("/") if folder.startswith("file:") else folder


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in a scratch folder, read back: computed once, and still there when an executor is lost."""
    return placed(df, name)[0]


def placed(df: DataFrame, name: str, **options: str) -> tuple[DataFrame, str]:
    """As ``kept``, and its folder: for ``removed``, once nothing reads it any more."""
    path = f"{scratch_folder(df.sparkSession)}/{name}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Remove a folder through Spark's own file systems."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if it comes in fewer partitions: for costly expressions over small files."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Bytes of files up to which a written table is broadcast.
BROADCAST_BYTES = 16 << 20


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """A table on disk with the hint to broadcast it, if its files say that it is small; else as it is."""
    return df.hint("broadcast") if is_small(df) else df


def is_small(df: DataFrame) -> bool:
    """Whether the files of a table on disk say that it can be broadcast."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= BROADCAST_BYTES
