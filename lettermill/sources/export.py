"""EML files and manifests written by the executors' tasks, with a result row for each message."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import format_ms
from ..functions.formatting import collision_free, eml_filename
from ..session import local_path

RESULT = "doc_id long, destination string, ok boolean, error string"


def named_eml(messages: DataFrame) -> DataFrame:
    """``doc_id, destination, raw``: file names without collisions, for ``messages(doc_id, subject, timestamp_ms, raw)``."""
    day = F.substring(format_ms(F.col("timestamp_ms"), ""), 1, 10)
    named = messages.withColumn("name", eml_filename(F.when(day != "", day), F.col("subject"), F.col("doc_id")))
    return collision_free(named, "name", "doc_id").select("doc_id", "destination", "raw")


def write_eml(files: DataFrame, folder: str) -> DataFrame:
    """Write each row's bytes as they are below ``folder`` (a file system that executors mount); existing files stay.

    A file that can't be written is a row with its error; the others are still written.
    """
    folder = local_path(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, name, raw in zip(batch["doc_id"], batch["destination"], batch["raw"], strict=True):
                try:
                    if "/" in name or name in (".", ".."):
                        raise ValueError("not a file name")
                    Path(folder).mkdir(parents=True, exist_ok=True)
                    with open(Path(folder) / name, "xb") as file:
                        file.write(bytes(raw))
                    out.append((doc_id, name, True, None))
                except (OSError, ValueError, TypeError) as error:
                    out.append((doc_id, name, False, str(error)))
            yield pd.DataFrame(out, columns=["doc_id", "destination", "ok", "error"])

    return files.select("doc_id", "destination", "raw").mapInPandas(run, RESULT)


def batch_summary(results: DataFrame) -> DataFrame:
    """``written, failed``."""
    return results.agg(F.count_if("ok").alias("written"), F.count_if(~F.col("ok")).alias("failed"))


def export_orphan(classified: DataFrame, segment: str, offset: int, destination: str, archive: str) -> dict[str, str]:
    """Salvage one orphan frame: its bytes and a manifest of ``key=value`` lines, both new; returns the manifest.

    The frame is looked up again and must still be an orphan; the destination must be outside the archive.
    """
    target = Path(local_path(destination)).resolve()
    if target.is_relative_to(Path(local_path(archive)).resolve()):
        raise ValueError("the destination is inside the archive")
    rows = classified.filter((F.col("segment") == segment) & (F.col("offset") == offset) & (F.col("state") == "orphan")).select("doc_id", "raw", F.hex("raw_digest").alias("digest")).take(2)
    if len(rows) != 1:
        raise ValueError("no such orphan")
    manifest = {"doc_id": str(rows[0]["doc_id"]), "offset": str(offset), "segment": segment, "sha256": rows[0]["digest"].lower()}
    notes = target.with_name(target.name + ".manifest")
    if notes.exists():
        raise FileExistsError(notes)
    with open(target, "xb") as file:
        file.write(bytes(rows[0]["raw"]))
    try:
        with open(notes, "x", encoding="utf-8") as file:
            file.write("".join(f"{k}={v}\n" for k, v in sorted(manifest.items())))
    except OSError:
        target.unlink()
        raise
    return manifest
