"""Maintenance of the derived search index: incremental or rebuild, with change detection against a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import address_values, ascii_lower, labels
from ..schemas import INDEXED_DOCS, SEARCH_DOCS
from ..session import broadcast_if_small, kept, placed, removed
from . import mime
from .block_index import PACKED
from .stored_index import StoredIndex

#: What makes an indexed row stale when it changes.
FINGERPRINT = ["source_state", "label_ids", "timestamp_ms", "message_history_id", "raw_digest"]
SKIP, INDEX, REMOVE, RECHECK = "skip", "index", "remove", "recheck"


def diff(catalogue: DataFrame, checkpoint: DataFrame, rebuild: bool = False) -> DataFrame:
    """``doc_id, action``: what each row of catalogue or checkpoint needs before its RAW is looked at.

    ``skip``: nothing; ``recheck``: present and unchanged, so only its RAW must still be sound; ``index``: new, changed
    or rebuilt; ``remove``: no longer present, or gone from the catalogue. Rows never indexed and not present are skipped.
    """
    now = catalogue.select("doc_id", F.struct(*FINGERPRINT).alias("now"))
    before = checkpoint.select("doc_id", F.struct(*FINGERPRINT).alias("before"))
    rows = now.join(before, "doc_id", "full_outer")
    present = F.col("now.source_state") == "present"
    same = F.col("now").eqNullSafe(F.col("before"))
    gone = F.when(F.col("before").isNotNull() & (F.col("now").isNull() | ~same), REMOVE).otherwise(SKIP)
    fresh = F.lit(INDEX) if rebuild else F.when(same, RECHECK).otherwise(INDEX)
    return rows.select("doc_id", F.when(F.coalesce(present, F.lit(False)), fresh).otherwise(gone).alias("action"))


def with_raw_state(actions: DataFrame, records: DataFrame) -> DataFrame:
    """``actions`` with the verdict on RAW (``available``, ``missing``, ``inconsistent``) and the final action.

    A present row with bad RAW is removed, whether it is unchanged, changed or rebuilt.
    """
    rows = actions.join(records.select("doc_id", "status"), "doc_id", "left")
    wanted = F.col("action").isin(INDEX, RECHECK)
    bad = wanted & (F.coalesce("status", F.lit("inconsistent")) != "available")
    why = F.when(bad & (F.col("status") == "missing"), "raw_unavailable").when(bad, "raw_inconsistent")
    final = F.when(bad, REMOVE).when(F.col("action") == RECHECK, SKIP).otherwise(F.col("action"))
    return rows.select("doc_id", final.alias("action"), why.alias("why"))


def search_rows(catalogue: DataFrame, raw: DataFrame) -> DataFrame:
    """Search-projection rows of parsed messages with a column ``error``; ``raw(doc_id, raw)``."""
    rows = mime.with_parsed(catalogue.join(raw, "doc_id"), fields=mime.SEARCHED)
    lower = lambda c: F.transform(c, ascii_lower)
    types = F.coalesce(F.col("parsed.attachment_types"), F.array().cast("array<string>"))
    count = F.coalesce(F.col("parsed.attachment_count"), F.lit(0).cast("long"))
    values = {
        "labels": labels("label_ids"), "attachment_types": types, "attachment_count": count, "has_attachment": (count > 0).cast("int"), "attachment_mime": F.array_distinct(lower(types)),
        "attachment_family": F.array_distinct(F.transform(lower(types), lambda x: F.split_part(x, F.lit("/"), F.lit(1)))),
        "sender_filter": address_values(F.col("parsed.sender")), "recipient_filter": address_values(F.col("parsed.recipients")), "account": F.col("source_account"),
    }
    values |= {c: F.coalesce(F.col(f"parsed.{c}"), F.lit("")) for c in ("sender", "recipients", "subject", "body", "attachment_text")}
    columns = [values.get(f.name, F.col(f.name) if f.name in catalogue.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SEARCH_DOCS]
    return rows.select(*columns, F.col("parsed.error").alias("error"))


def _planned(checkpoint: DataFrame, catalogue: DataFrame, records: DataFrame, raw: DataFrame, rebuild: bool) -> tuple[DataFrame, DataFrame, str]:
    """The actions, and the rows of messages to be indexed with their folder; both kept, as they are used several times.

    Few catalogue rows go to RAW by a broadcast, so RAW itself isn't shuffled.
    """
    actions = kept(with_raw_state(diff(catalogue, checkpoint, rebuild), records), "actions")
    todo = kept(catalogue.join(actions.filter(F.col("action") == INDEX).select("doc_id"), "doc_id", "left_semi"), "todo")
    return actions, *placed(search_rows(broadcast_if_small(todo), raw), "rows", **PACKED)


def _marked(checkpoint: DataFrame, catalogue: DataFrame, touched: DataFrame, parsed: DataFrame) -> DataFrame:
    marks = catalogue.join(parsed.select("doc_id"), "doc_id", "left_semi").select(*INDEXED_DOCS.names)
    return checkpoint.join(touched, "doc_id", "left_anti").select(*INDEXED_DOCS.names).unionByName(marks)


def maintain(index: DataFrame, checkpoint: DataFrame, catalogue: DataFrame, records: DataFrame, raw: DataFrame, rebuild: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The new index, the new checkpoint and one row of statistics.

    Only messages to be indexed are parsed. A message that can't be parsed is removed and counted.
    """
    actions, rows, _ = _planned(checkpoint, catalogue, records, raw, rebuild)
    parsed = rows.filter("error is null").drop("error")
    touched = actions.filter(F.col("action") != SKIP).select("doc_id")
    new_index = index.join(touched, "doc_id", "left_anti").select(*SEARCH_DOCS.names).unionByName(parsed.select(*SEARCH_DOCS.names))
    return new_index, _marked(checkpoint, catalogue, touched, parsed), statistics(actions, rows, checkpoint)


def maintain_stored(index: StoredIndex, checkpoint: DataFrame, catalogue: DataFrame, records: DataFrame, raw: DataFrame, rebuild: bool = False) -> tuple[StoredIndex, DataFrame, DataFrame]:
    """As ``maintain``, for an index on disk: only postings of touched messages are written. A rebuild starts it anew."""
    actions, rows, place = _planned(checkpoint, catalogue, records, raw, rebuild)
    outcome = kept(rows.select("doc_id", "error"), "outcome")
    parsed = rows.filter("error is null").drop("error").select(*SEARCH_DOCS.names)
    touched = actions.filter(F.col("action") != SKIP).select("doc_id")
    updated = StoredIndex.write(parsed, index.folder) if rebuild else index.update(parsed, touched)
    removed(rows.sparkSession, place)  # the index has them now
    return updated, _marked(checkpoint, catalogue, touched, outcome.filter("error is null")), statistics(actions, outcome, checkpoint)


def statistics(actions: DataFrame, rows: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """``indexed, skipped, removed, raw_unavailable, raw_inconsistent, parse_failures, partial``; removals are real ones."""
    failed = rows.filter("error is not null").select("doc_id", F.lit(True).alias("failed"))
    known = checkpoint.select("doc_id", F.lit(True).alias("known"))
    all_ = actions.join(failed, "doc_id", "left").join(known, "doc_id", "left")
    gone = (F.col("action") == REMOVE) | F.col("failed")
    counts = all_.agg(
        F.count_if((F.col("action") == INDEX) & F.col("failed").isNull()).alias("indexed"), F.count_if(F.col("action") == SKIP).alias("skipped"), F.count_if(gone & F.col("known")).alias("removed"),
        F.count_if(F.col("why") == "raw_unavailable").alias("raw_unavailable"), F.count_if(F.col("why") == "raw_inconsistent").alias("raw_inconsistent"), F.count_if(F.col("failed")).alias("parse_failures"),
    )
    return counts.withColumn("partial", F.expr("raw_unavailable + raw_inconsistent + parse_failures > 0"))


def has_schema(index: DataFrame) -> bool:
    """Whether a stored index can be used; else it is rebuilt from the archive."""
    return {f.name: f.dataType for f in index.schema} == {f.name: f.dataType for f in SEARCH_DOCS}
