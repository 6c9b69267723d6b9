"""File names, sizes and labels for people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import kept

#: Device names that some systems reserve (fixed values).
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))
#: File name extensions by MIME type (fixed values).
EXTENSIONS = {
    "application/pdf": "pdf",
    "application/zip": "zip",
    "image/gif": "gif",
    "image/jpeg": "jpg",
    "image/png": "png",
    "message/rfc822": "eml",
    "text/calendar": "ics",
    "text/csv": "csv",
    "text/html": "html",
    "text/plain": "txt",
}


def _safe(value: Column) -> Column:
    """Without characters that file systems refuse, single spaces, no spaces or dots at the ends."""
    text = F.regexp_replace(value, r'[\x00-\x1f\x7f<>:"/\\|?*]', "_")
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"^[ .]+|[ .]+$", "")


def eml_filename(date: Column, subject: Column, doc_id: Column) -> Column:
    """``date subject.eml`` of at most 96 characters before the extension; reserved or empty names get the id."""
    stem = F.regexp_replace(F.substring(_safe(F.concat_ws(" ", date, F.coalesce(subject, F.lit("")))), 1, 96), r"[ .]+$", "")
    fallback = F.concat(F.lit("message-"), doc_id.cast("string"))
    named = F.when((stem == "") | F.upper(stem).isin(*RESERVED), fallback).otherwise(stem)
    return F.concat(named, F.lit(".eml"))


def attachment_filename(filename: Column, mime: Column, part_id: Column) -> Column:
    """The sanitised name; without one, ``attachment-N`` and an extension by MIME type."""
    pairs = [F.lit(x) for pair in EXTENSIONS.items() for x in pair]
    extension = F.coalesce(F.element_at(F.create_map(*pairs), F.lower(mime)), F.lit("bin"))
    name = _safe(F.coalesce(filename, F.lit("")))
    return F.when(name == "", F.concat(F.lit("attachment-"), part_id.cast("string"), F.lit("."), extension)).otherwise(name)


def collision_free(files: DataFrame, name: str, order: str) -> DataFrame:
    """``files`` with a column ``destination``: the second file of a name, in ``order``, gets ``stem-2.ext``, and so on.

    ``order`` is unique. Names are dealt into ranges of name and order and numbered there, with the counts of the ranges
    before: the rows of a frequent name needn't meet in one task. A null name gives a null destination.
    """
    keys = files.select(name, order).filter(F.col(name).isNotNull())
    keys = kept(keys.repartitionByRange(name, order).withColumn("_range", F.spark_partition_id()), "names")
    counts = keys.groupBy(name, "_range").agg(F.count("*").alias("_count"))
    before = F.coalesce(F.sum("_count").over(W.partitionBy(name).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(W.partitionBy("_range", name).orderBy(order))
    numbers = keys.withColumn("_place", place).join(counts.select(name, "_range", before.alias("_before")), [name, "_range"]).select(order, (F.col("_place") + F.col("_before")).alias("_number"))
    stem, dot = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    named = F.when(F.col("_number") == 1, F.col(name)).otherwise(F.concat(stem, F.lit("-"), F.col("_number").cast("string"), dot))
    return files.join(numbers, order, "left").withColumn("destination", named).drop("_number")


def human_bytes(value: Column) -> Column:
    """Bytes in steps of 1024 with one decimal above a step."""
    value = value.cast("long")
    out = F.concat(value.cast("string"), F.lit(" B"))
    for step, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        size = 1024**step
        tenths = F.floor(value * 10 / F.lit(size) + F.lit(0.5)).cast("long")
        text = F.concat(F.floor(tenths / 10).cast("long").cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"), F.lit(f" {unit}"))
        out = F.when(value >= size, text).otherwise(out)
    return out


def message_count(value: Column, language: str = "en") -> Column:
    """A count with its noun; in French zero is singular too."""
    one = value <= 1 if language == "fr" else value == 1
    return F.concat(value.cast("string"), F.when(one, " message").otherwise(" messages"))


def key_lines(values: Column) -> Column:
    """``key=value`` lines of a map, by key."""
    pairs = F.array_sort(F.map_entries(values))
    return F.array_join(F.transform(pairs, lambda x: F.concat(x["key"], F.lit("="), x["value"])), "\n")
