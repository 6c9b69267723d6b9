"""Content-addressed storage: attachments of raw messages as blobs stored once, and byte-exact reconstruction."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import ddl

MARKER = b"\r\n--attachment;"
PIECES = T.ArrayType(ddl("ord int, kind string, bytes binary, blob_hash string, size long"))
_HEADER = re.compile(rb"\r\n--attachment;[^\r]*(?:\r(?!\n)[^\r]*)*\r\n")


def pieces(raw: bytes, threshold: int | None) -> list[tuple]:
    """Inline and blob pieces in order; payloads of at least ``threshold`` bytes are blobs; None: all inline."""
    out, at = [], 0

    def add(kind: str, data: bytes) -> None:
        out.append((len(out), kind, data, hashlib.sha256(data).hexdigest() if kind == "blob" else None, len(data)))

    if threshold is not None:
        heads = [m.end() for m in _HEADER.finditer(raw)]
        marks = [m.start() for m in re.finditer(re.escape(MARKER), raw)]
        for start in heads:
            end = next((m for m in marks if m >= start), len(raw))
            if start >= at:
                add("inline", raw[at:start])
                add("blob" if end - start >= threshold else "inline", raw[start:end])
                at = end
    add("inline", raw[at:])
    return out


def externalise(messages: DataFrame, threshold: int | None = 0) -> DataFrame:
    """``doc_id, ord, kind, bytes, blob_hash, size`` of each piece of ``messages(doc_id, raw)``."""

    @F.pandas_udf(PIECES)
    def cut(raw: pd.Series) -> pd.Series:
        return raw.map(lambda r: [] if r is None else pieces(bytes(r), threshold))

    return messages.select("doc_id", F.inline(cut("raw")))


def blobs(cut: DataFrame) -> DataFrame:
    """``blob_hash, bytes``: each blob once."""
    return cut.filter("kind = 'blob'").groupBy("blob_hash").agg(F.first("bytes").alias("bytes"))


def references(cut: DataFrame) -> DataFrame:
    """Pieces as they are stored: a blob is only its hash."""
    return cut.withColumn("bytes", F.when(F.col("kind") == "inline", F.col("bytes")))


def reconstruct(refs: DataFrame, store: DataFrame) -> DataFrame:
    """``doc_id, raw``: pieces put together; a blob that the store lacks is an error."""
    rows = refs.join(store.withColumnRenamed("bytes", "blob"), "blob_hash", "left")
    missing = F.raise_error(F.concat(F.lit("blob is missing: "), F.col("blob_hash"))).cast("binary")
    data = F.when(F.col("kind") == "inline", F.col("bytes")).when(F.col("blob").isNotNull(), F.col("blob")).otherwise(missing)
    ordered = F.array_sort(F.collect_list(F.struct("ord", data.cast("string").alias("bytes"))))  # a cast doesn't touch the bytes
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["bytes"]), "").cast("binary").alias("raw"))


def sizes(messages: DataFrame, cut: DataFrame) -> DataFrame:
    """``messages, raw_bytes, inline_bytes, blob_references, blobs, blob_bytes, largest_blob, stored_bytes``."""
    inline, blob = F.col("kind") == "inline", F.col("kind") == "blob"
    raw = messages.agg(F.count("*").alias("messages"), F.coalesce(F.sum(F.octet_length("raw")), F.lit(0)).cast("long").alias("raw_bytes"))
    cuts = cut.agg(F.coalesce(F.sum(F.when(inline, F.col("size"))), F.lit(0)).cast("long").alias("inline_bytes"), F.count_if(blob).alias("blob_references"))
    unique = cut.filter(blob).groupBy("blob_hash").agg(F.min("size").alias("size")).agg(F.count("*").alias("blobs"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("blob_bytes"), F.coalesce(F.max("size"), F.lit(0)).cast("long").alias("largest_blob"))
    return raw.crossJoin(cuts).crossJoin(unique).withColumn("stored_bytes", F.col("inline_bytes") + F.col("blob_bytes"))  # one row each
