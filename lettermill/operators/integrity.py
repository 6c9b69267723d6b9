"""Inventories: what the catalogue claims against what the archive holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import kept

HEADER_BYTES = 32
LARGEST = 2**63 - 1
_SEGMENT = r"^segment-\d+\.arc$"


def valid_segment(name: Column) -> Column:
    """A segment's own name, without any path."""
    return name.rlike(_SEGMENT)


def record_inventory(messages: DataFrame, frames: DataFrame, segments: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, status, reason`` of every catalogue row: available, missing or inconsistent; the first failing check tells.

    With ``columns``, those of the catalogue too.

    ``frames(segment, offset, frame_bytes, doc_id, raw_digest, status, reason)`` as scanned; ``segments(segment, bytes)``.
    """
    held = frames.select("segment", F.col("offset").alias("archive_offset"), F.col("doc_id").cast("decimal(20,0)").alias("f_id"), F.col("frame_bytes").alias("f_bytes"), F.col("raw_digest").alias("f_digest"), F.col("status").alias("f_status"), F.col("reason").alias("f_reason"))
    rows = messages.join(segments.select("segment", F.col("bytes").alias("s_bytes")), "segment", "left").join(held, ["segment", "archive_offset"], "left")
    end = F.col("archive_offset").cast("decimal(20,0)") + F.col("frame_bytes")
    checks = [
        (F.length("raw_digest") != 32, "inconsistent", F.lit("catalogue digest is invalid")),
        ((F.col("archive_offset") < 0) | (F.col("frame_bytes") < 0), "inconsistent", F.lit("negative catalogue archive coordinate")),
        (F.col("doc_id") < 0, "inconsistent", F.lit("negative catalogue record id")),
        (~valid_segment(F.col("segment")), "inconsistent", F.lit("invalid archive segment coordinate")),
        (F.col("s_bytes").isNull(), "missing", F.lit("")),
        (end > LARGEST, "inconsistent", F.lit("archive coordinate overflow")),
        (end > F.col("s_bytes"), "missing", F.lit("")),
        (F.col("frame_bytes") < HEADER_BYTES, "inconsistent", F.lit("catalogue frame length is smaller than the frame header")),
        (F.col("f_id").isNull(), "inconsistent", F.lit("no frame at the catalogue coordinate")),
        (F.col("f_status") != "valid", "inconsistent", F.col("f_reason")),
        (F.col("f_bytes") != F.col("frame_bytes"), "inconsistent", F.lit("frame length differs from the catalogue coordinate")),
        (F.col("f_id") != F.col("doc_id"), "inconsistent", F.concat(F.lit("catalog/frame id mismatch: frame contains "), F.col("f_id").cast("string"))),
        (F.col("f_digest") != F.col("raw_digest"), "inconsistent", F.lit("catalogue/RAW digest linkage mismatch")),
    ]
    status, reason = F.lit("available"), F.lit("")
    for failed, name, why in reversed(checks):
        status, reason = F.when(failed, name).otherwise(status), F.when(failed, why).otherwise(reason)
    return rows.select("doc_id", status.alias("status"), reason.alias("reason"), *columns)


def claims(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Coordinates that the catalogue claims, and its full keys; negative ids and lengths claim coordinates only."""
    spots = messages.filter("archive_offset >= 0").select("segment", F.col("archive_offset").alias("offset")).distinct()
    full = messages.filter("archive_offset >= 0 and doc_id >= 0 and frame_bytes >= 0")
    return spots, full.select("segment", F.col("archive_offset").alias("offset"), F.col("doc_id").cast("decimal(20,0)").alias("doc_id"), "frame_bytes", "raw_digest").distinct()


def classify_frames(frames: DataFrame, messages: DataFrame) -> DataFrame:
    """``frames`` with ``state``: validated (full key claimed), inconsistent (coordinate claimed), orphan, or its fault; and
    ``claimed``: whether the catalogue has the coordinate."""
    spots, full = claims(messages)
    out = frames.join(full.withColumn("_full", F.lit(True)), ["segment", "offset", "doc_id", "frame_bytes", "raw_digest"], "left")
    out = out.join(spots.withColumn("_spot", F.lit(True)), ["segment", "offset"], "left")
    sound = F.col("status") == "valid"
    state = F.when(~sound, F.col("status")).when(F.col("_full"), "validated").when(F.col("_spot"), "inconsistent").otherwise("orphan")
    return out.select(*frames.columns, state.alias("state"), F.coalesce("_spot", F.lit(False)).alias("claimed"))


def inventory_counters(classified: DataFrame, records: DataFrame) -> DataFrame:
    """One row: frames by state, and catalogue rows that are missing."""
    states = ("validated", "inconsistent", "orphan", "corrupt", "tail")
    frames = classified.agg(*[F.count_if(F.col("state") == s).alias(s) for s in states])
    return frames.crossJoin(records.agg(F.count_if(F.col("status") == "missing").alias("missing")))  # one row each


def overlapping(a: DataFrame, b: DataFrame, key: str, a_range: tuple[str, str], b_range: tuple[str, str]) -> DataFrame:
    """Rows of ``a`` whose half-open range meets one of ``b`` with the same key: a0 < b1 and b0 < a1.

    A sweep: both sides are dealt in order of key and place (``a`` at its end, ``b`` at its start), and a row of ``a`` is met
    if the furthest end of all ``b`` that start before it ends lies beyond its start. Equal places are dealt out, too, so a
    frequent key or range doesn't gather in a task; what earlier partitions of a key reach is a row a partition. Ranges of any
    length cost one row. A null key or bound meets nothing.
    """
    spark = a.sparkSession
    one, other = (F.col(c) for c in a_range), (F.col(c) for c in b_range)
    (a0, a1), (b0, b1) = one, other
    rows = a.select(F.col(key).alias("_key"), a1.alias("_at"), F.lit(0).alias("_side"), a0.alias("_bound"), F.struct(*a.columns).alias("_row"))
    rows = rows.unionByName(b.select(F.col(key).alias("_key"), b0.alias("_at"), F.lit(1).alias("_side"), b1.alias("_bound")), allowMissingColumns=True)
    rows = rows.filter("_key is not null and _at is not null and _bound is not null").withColumn("_n", F.monotonically_increasing_id())
    order = ["_key", "_at", "_side", "_n"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    end = F.when(F.col("_side") == 1, F.col("_bound"))
    # of the keys that a partition shares with earlier ones there is one at most: its first
    reach = dealt.groupBy("_part", "_key").agg(F.max(end).alias("_end"))
    spread = reach.join(F.broadcast(_shared_keys(reach)), "_key")
    earlier = spread.select("_part", "_key", F.max("_end").over(W.partitionBy("_key").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)).alias("_before")).filter("_before is not null")
    running = F.max(end).over(W.partitionBy("_part", "_key").orderBy("_at", "_side", "_n").rowsBetween(W.unboundedPreceding, W.currentRow))
    swept = dealt.withColumn("_reach", running).filter("_side = 0").join(F.broadcast(earlier), ["_part", "_key"], "left")
    return swept.filter(F.greatest("_reach", "_before") > F.col("_bound")).select("_row.*")


def _shared_keys(reach: DataFrame) -> DataFrame:
    """``_key``: keys in several partitions; as rows are dealt in order, fewer than there are partitions."""
    return reach.groupBy("_key").agg(F.count("*").alias("parts")).filter("parts > 1").select("_key")


def validated_raw(frames: DataFrame, messages: DataFrame) -> DataFrame:
    """``doc_id, raw`` of messages whose frame is sound and has their id and digest; any other row raises an error."""
    held = frames.select("segment", F.col("offset").alias("archive_offset"), F.col("doc_id").alias("f_id"), F.col("frame_bytes").alias("f_bytes"), F.col("raw_digest").alias("f_digest"), "raw", "status")
    rows = messages.join(held, ["segment", "archive_offset"], "left")
    sound = (F.col("status") == "valid") & (F.col("f_id") == F.col("doc_id")) & (F.col("f_bytes") == F.col("frame_bytes")) & (F.col("f_digest") == F.col("raw_digest"))
    error = F.raise_error(F.concat(F.lit("RAW of record "), F.col("doc_id").cast("string"), F.lit(" doesn't match the catalogue")))
    return rows.select("doc_id", F.when(F.coalesce(sound, F.lit(False)), F.col("raw")).otherwise(error.cast("binary")).alias("raw"))
