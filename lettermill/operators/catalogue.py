"""Catalogue rows, existence tests, id allocation, keyed merges and tombstones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import scratch_folder

PRESENT, DELETED = "present", "deleted"


def union_rows(gmail: DataFrame, imap: DataFrame, messages: DataFrame) -> DataFrame:
    """Both sources' occurrences joined with their messages: one row a doc_id, with labels ``[]`` for mailbox rows."""
    held = messages.select("doc_id", "message_id", "segment", "archive_offset", "frame_bytes", "raw_digest", "folder")
    time = F.coalesce("internal_date_ms", F.lit(0).cast("long")).alias("timestamp_ms")
    first = gmail.select("doc_id", "source_account", "source_state", "label_ids", time, "message_history_id")
    second = imap.select("doc_id", "source_account", "source_state", F.lit("[]").alias("label_ids"), time, F.lit(None).cast("string").alias("message_history_id"))
    return first.join(held, "doc_id").unionByName(second.join(held, "doc_id"))


def next_doc_id(messages: DataFrame) -> DataFrame:
    """``next_id``: one above the largest doc_id; 0 for no rows."""
    return messages.agg((F.coalesce(F.max("doc_id"), F.lit(-1)) + 1).cast("long").alias("next_id"))


def allocate_ids(new: DataFrame, order: list[str], first: int) -> DataFrame:
    """``new`` with contiguous ``doc_id`` in the given order, from ``first``.

    Rows are range-partitioned and numbered within their partition; partition sizes, one row each, give the offsets. The
    numbered rows are written once to the shared folder, since another run could set other ranges.
    """
    dealt = new.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    dealt = dealt.withColumn("_number", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33))
    path = f"{scratch_folder(new.sparkSession)}/numbered"
    dealt.write.parquet(path)
    dealt = new.sparkSession.read.schema(dealt.schema).parquet(path)
    sizes = dealt.groupBy("_part").agg((F.max("_number") + 1).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return dealt.join(sizes.select("_part", before.alias("_before")), "_part").withColumn("doc_id", F.lit(first).cast("long") + F.col("_before") + F.col("_number")).drop("_part", "_number", "_before")


def present_sum(gmail: DataFrame, imap: DataFrame) -> DataFrame:
    """``n``: present rows of both sources."""
    state = F.col("source_state") == PRESENT
    return gmail.filter(state).select("doc_id").union(imap.filter(state).select("doc_id")).agg(F.count("*").alias("n"))


def merge(table: DataFrame, changes: DataFrame, key: list[str], update: dict[str, Column] | None = None) -> DataFrame:
    """Upsert: rows of ``changes`` replace rows of ``table`` with the same key; the rest stays.

    ``update`` gives a column's new value where both have the row, from columns ``old`` and ``new`` (structs).
    """
    columns = table.columns
    old = table.select(*key, F.struct(*columns).alias("old"))
    new = changes.select(*key, F.struct(*[F.col(c) for c in columns]).alias("new"))
    joined = old.join(new, key, "full_outer")
    both = F.col("old").isNotNull() & F.col("new").isNotNull()
    update = update or {}
    value = lambda c: F.when(both, update[c]).otherwise(F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}"))) if c in update else F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))
    return joined.select(*[value(c).alias(c) for c in columns])


def tombstone_at(occurrences: DataFrame, deletions: DataFrame, key: list[str]) -> DataFrame:
    """Mark rows as deleted; a deletion's history id replaces the old one unless it is null."""
    marks = deletions.select(*key, F.col("history_id").alias("_history"), F.lit(True).alias("_gone")).dropDuplicates(key)
    out = occurrences.join(marks, key, "left")
    out = out.withColumn("source_state", F.when(F.col("_gone"), DELETED).otherwise(F.col("source_state")))
    return out.withColumn("message_history_id", F.coalesce("_history", "message_history_id")).drop("_history", "_gone").select(*occurrences.columns)


def tombstone_missing(occurrences: DataFrame, seen: DataFrame, key: list[str]) -> DataFrame:
    """After an unbounded listing: present rows that it didn't show are deleted."""
    marks = seen.select(*key).distinct().withColumn("_seen", F.lit(True))
    out = occurrences.join(marks, key, "left")
    gone = F.col("_seen").isNull() & (F.col("source_state") == PRESENT)
    return out.withColumn("source_state", F.when(gone, DELETED).otherwise(F.col("source_state"))).select(*occurrences.columns)


def guarded(updates: DataFrame, rows: DataFrame, exact: list[str], forbidden: DataFrame, key: list[str]) -> DataFrame:
    """Updates whose row still is exactly as expected (EXISTS) and whose key no other source claims (NOT EXISTS)."""
    return updates.join(rows.select(*exact).distinct(), exact, "left_semi").join(forbidden.select(*key).distinct(), key, "left_anti")


def archive_summary(messages: DataFrame, inventory: DataFrame, frames: DataFrame) -> DataFrame:
    """``messages, available, missing, inconsistent, archive_bytes, segments``."""
    count = messages.agg(F.count("*").alias("messages"))
    states = inventory.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("available", "missing", "inconsistent")])
    sizes = frames.agg(F.coalesce(F.sum("frame_bytes"), F.lit(0)).cast("long").alias("archive_bytes"), F.count_distinct("segment").alias("segments"))
    return count.crossJoin(states).crossJoin(sizes)  # one row each
