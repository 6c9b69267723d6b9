"""Corpus, duplicate and MIME statistics."""

from __future__ import annotations

import gzip

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import nearest_rank, ranked
from ..functions.types import ddl
from .cas import MARKER

LARGE = 64 * 1024
COMPRESSED = ddl("text_gzip long, attachment_gzip long, text_zstd long, attachment_zstd long")


def _sum(value: Column | str) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast("long")


def dedup_economics(attachments: DataFrame, hash_: str = "content_hash", size: str = "bytes") -> DataFrame:
    """``attachments, attachment_bytes, unique_hashes, unique_bytes, duplicate_objects, duplicate_bytes``."""
    by_hash = attachments.groupBy(hash_).agg(F.count("*").alias("n"), F.min(size).alias("size"), F.sum(size).alias("total"))
    sums = by_hash.agg(_sum("n").alias("attachments"), _sum("total").alias("attachment_bytes"), F.count("*").alias("unique_hashes"), _sum("size").alias("unique_bytes"))
    return sums.withColumn("duplicate_objects", F.col("attachments") - F.col("unique_hashes")).withColumn("duplicate_bytes", F.col("attachment_bytes") - F.col("unique_bytes"))


def duplicate_sizes(attachments: DataFrame, hash_: str = "content_hash", size: str = "bytes") -> DataFrame:
    """``size, n``: sizes of second and later copies, as a multiset: a size and how often it occurs."""
    by_hash = attachments.groupBy(hash_).agg(F.count("*").alias("n"), F.min(size).alias("size")).filter("n > 1")
    return by_hash.groupBy("size").agg(F.sum(F.col("n") - 1).alias("n"))


def duplicate_size_ranks(attachments: DataFrame, fractions: dict[str, float], hash_: str = "content_hash", size: str = "bytes") -> DataFrame:
    """Nearest-rank percentiles of that multiset."""
    sizes = duplicate_sizes(attachments, hash_, size)
    return nearest_rank(sizes, "size", fractions, weight="n")


def corpus_stats(messages: DataFrame, size: str = "raw_bytes", attached: str = "attachment_bytes") -> DataFrame:
    """One row: count, sizes (min, max, integer mean, middle element, nearest-rank p90 and p99), text bytes."""
    counts = messages.agg(
        F.count("*").alias("messages"), _sum(size).alias("bytes"), F.coalesce(F.min(size), F.lit(0)).alias("min_bytes"), F.coalesce(F.max(size), F.lit(0)).alias("max_bytes"),
        F.expr(f"coalesce(sum({size}), 0) div greatest(count(*), 1)").alias("mean_bytes"), _sum(F.col(size) - F.col(attached)).alias("mime_text_bytes"),
    )
    ranks = nearest_rank(messages, size, {"p90_bytes": 0.9, "p99_bytes": 0.99})
    return counts.crossJoin(ranks).crossJoin(middle_element(messages, size, "median_bytes"))  # one row each


def middle_element(df: DataFrame, value: str, name: str) -> DataFrame:
    """The value at index n div 2 of the sorted values; 0 for none."""
    return ranked(df, value).agg(F.coalesce(F.min(F.when(F.expr("_upto > _all div 2"), F.col(value))), F.lit(0)).alias(name))


def mime_category(mime: Column) -> Column:
    """The first that fits: image, pdf, zip, office, other application; null for the rest."""
    low = F.lower(mime)
    office = low.rlike("officedocument|msword|ms-excel|ms-powerpoint|opendocument")
    return F.when(low.startswith("image/"), "image").when(low == "application/pdf", "pdf").when(low.contains("zip"), "zip").when(office, "office").when(low.startswith("application/"), "other_application")


def category_rollup(parts: DataFrame, mime: str = "mime", size: str = "decoded_bytes") -> DataFrame:
    """``category, n, bytes`` of parts that have a category."""
    rows = parts.select(mime_category(F.col(mime)).alias("category"), F.col(size).alias("size")).filter("category is not null")
    return rows.groupBy("category").agg(F.count("*").alias("n"), _sum("size").alias("bytes"))


def mime_report(parts: DataFrame) -> DataFrame:
    """One row of counters over ``parts(doc_id, leaf, disposition, filename, content_id, mime, encoded_bytes, decoded_bytes, digest)``."""
    leaf = F.col("leaf")
    attachment, inline = leaf & (F.col("disposition") == "attachment"), leaf & (F.col("disposition") == "inline")
    named, cid = leaf & F.col("filename").isNotNull(), leaf & F.col("content_id").isNotNull()
    candidate = attachment | named
    groups = {"attachment": attachment, "inline": inline, "named": named, "candidate": candidate, "content_id": cid, "large_candidate": candidate & (F.col("encoded_bytes") >= LARGE)}
    counters = [F.count("*").alias("parts"), F.count_if(leaf).alias("leaves")]
    for name, held in groups.items():
        counters += [F.count_if(held).alias(f"{name}_n"), _sum(F.when(held, F.col("encoded_bytes"))).alias(f"{name}_encoded"), _sum(F.when(held, F.col("decoded_bytes"))).alias(f"{name}_decoded")]
    unique = parts.filter(candidate).groupBy("digest").agg(F.min("decoded_bytes").alias("size")).agg(F.count("*").alias("unique_objects"), _sum("size").alias("unique_bytes"))
    return parts.agg(*counters).crossJoin(unique)  # one row each


@F.pandas_udf(COMPRESSED)
def compressed_parts(raw: pd.Series) -> pd.DataFrame:
    """gzip and zstd (level 3) sizes of a message up to its first attachment, and of the rest."""
    pack = zstandard.ZstdCompressor(level=3).compress
    rows = []
    for value in raw:
        text, mark, rest = bytes(value or b"").partition(MARKER)
        rows.append((len(gzip.compress(text)), len(gzip.compress(mark + rest)), len(pack(text)), len(pack(mark + rest))))
    return pd.DataFrame(rows, columns=COMPRESSED.names)


def compression_stats(messages: DataFrame, raw: str = "raw") -> DataFrame:
    """One row: summed compressed sizes of texts and attachments."""
    sizes = messages.select(compressed_parts(raw).alias("c")).select("c.*")
    return sizes.agg(*[_sum(c).alias(c) for c in COMPRESSED.names])


def extraction_stats(results: DataFrame) -> DataFrame:
    """Counters over ``results(mime, outcome, bytes, text)``: encountered, supported, extracted, unsupported, failures."""
    outcome = F.col("outcome")
    return results.agg(
        F.count("*").alias("encountered"), F.count_if(outcome != "unsupported").alias("supported"), F.count_if(outcome == "extracted").alias("extracted"),
        F.count_if(outcome == "unsupported").alias("unsupported"), F.count_if(outcome == "failed").alias("failures"), _sum("bytes").alias("bytes"), _sum(F.length("text")).alias("chars"),
    )
