"""Exact length histogram: documents by encoded length; suffix sums answer every context limit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .pretokens import PieceLengths
from .shared import by_batch, small_batches, written

#: Lengths in a span of the two-level suffix sums.
SPAN = 1024


def _lengths(path: str, pattern: str):
    def make():
        length = PieceLengths(path, pattern).of

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes = np.fromiter(map(length, batch.column(0).to_pylist()), np.int64, batch.num_rows)
            found, counts = np.unique(sizes, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts.astype(np.int64))], ["n_tokens", "n_docs"])

        return step

    return by_batch(make)


def length_histogram(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """A row for each encoded length that occurs among the rows of ``docs(text)``.

    ``n_tokens`` (the length), ``n_docs`` (documents of it), ``docs_at_least`` and ``tokens_at_least`` (documents of this
    length or more, and their tokens), ``truncated_tokens`` (all documents' tokens if each is cut to this length),
    ``docs_total``, ``tokens_total``. A null or empty text has length 0; repeated rows count each time; an empty table
    gives no rows. Texts are counted whole, however long. The rows are at most as many as the longest document's tokens. Suffix sums are taken within spans of
    lengths, then over the spans, so no task sorts all lengths.
    """
    small_batches(docs.sparkSession)
    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_lengths(ranks, pattern), "n_tokens long, n_docs long")
    counted = written(parts.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")), "lengths")  # texts are encoded once
    lengths = counted.withColumn("span", F.expr(f"n_tokens div {SPAN}"))
    within = W.partitionBy("span").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, 0)
    longer = W.orderBy(F.desc("span")).rowsBetween(W.unboundedPreceding, -1)
    weight = F.col("n_docs") * F.col("n_tokens")
    spans = lengths.groupBy("span").agg(F.sum("n_docs").alias("d"), F.sum(weight).alias("t"))
    zero = F.lit(0).cast("long")
    spans = spans.select("span", F.coalesce(F.sum("d").over(longer), zero).alias("docs_after"), F.coalesce(F.sum("t").over(longer), zero).alias("tokens_after"), F.sum("d").over(W.partitionBy()).alias("docs_total"), F.sum("t").over(W.partitionBy()).alias("tokens_total"))
    summed = lengths.withColumn("d", F.sum("n_docs").over(within)).withColumn("t", F.sum(weight).over(within)).join(spans, "span")
    summed = summed.withColumn("docs_at_least", F.col("d") + F.col("docs_after")).withColumn("tokens_at_least", F.col("t") + F.col("tokens_after"))
    truncated = F.col("tokens_total") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")
    return summed.select("n_tokens", "n_docs", "docs_at_least", "tokens_at_least", truncated.alias("truncated_tokens"), "docs_total", "tokens_total")


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """``tokens``: all documents' tokens with each cut to ``limit``, for any limit; no documents: 0."""
    return histogram.agg(F.coalesce(F.sum(F.col("n_docs") * F.least("n_tokens", F.lit(limit))), F.lit(0)).alias("tokens"))


def quantile(histogram: DataFrame, share: float) -> DataFrame:
    """``n_tokens``: the smallest length that at least ``share`` of the documents don't exceed; no documents: null."""
    reached = F.col("docs_total") - F.col("docs_at_least") + F.col("n_docs") >= F.col("docs_total") * F.lit(share)
    return histogram.filter(reached).agg(F.min("n_tokens").alias("n_tokens"))
