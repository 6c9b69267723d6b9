"""Incremental sync: folding change feeds, frontiers, batch checks, full and incremental synchronisation.

A feed's events are ``page, record, kind, message_id, labels`` with kinds ``added``, ``labels`` (both positive) and
``deleted``; records are ordered by page and record number, and within a record added come before labels, labels before
deleted. The fold sums up the runs of equal records of an identity by their numbers, without holding them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fills import filled
from ..operators.catalogue import merge, tombstone_at, tombstone_missing

IMPORT, REPAIR, TOMBSTONE, IMPORT_TOMBSTONE, IGNORE = "import", "repair", "tombstone", "import-then-tombstone", "ignore"
#: Records and bytes that fill a batch.
BATCH_RECORDS, BATCH_BYTES = 64, 8 * 1024 * 1024


def flatten_history(pages: DataFrame) -> DataFrame:
    """Events of history pages ``page, history array<struct<id, messagesAdded, messagesDeleted, labelsAdded, labelsRemoved>>``."""
    records = pages.select("page", F.posexplode("history").alias("position", "h"))
    kinds = (("added", "messagesAdded", 0), ("labels", "labelsAdded", 1), ("labels", "labelsRemoved", 1), ("deleted", "messagesDeleted", 2))
    empty = F.array().cast("array<struct<kind: string, step: int, message_id: string>>")

    def listed(kind: str, name: str, step: int) -> Column:
        return F.transform(F.col(f"h.{name}"), lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(step).alias("step"), x["message"]["id"].alias("message_id")))

    events = [listed(*k) for k in kinds]
    flat = F.concat(*[F.coalesce(e, empty) for e in events])
    return records.select("page", "position", F.col("h.id").alias("record"), F.inline(flat))


def islands(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """``events`` with ``run``: consecutive events of a key with the same value have the same number, from 1."""
    window = W.partitionBy(key).orderBy(*order)
    starts = F.when(F.lag(value).over(window).eqNullSafe(F.col(value)), 0).otherwise(1)
    return events.withColumn("_starts", starts).withColumn("run", F.sum("_starts").over(window.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("_starts")


def runs(events: DataFrame, order: list[str]) -> DataFrame:
    """``message_id, run, record, positive, negative``: each run and which kinds it has."""
    marked = islands(events, "message_id", order, "record")
    negative = F.col("kind") == "deleted"
    return marked.groupBy("message_id", "run").agg(F.first("record").alias("record"), F.bool_or(~negative).alias("positive"), F.bool_or(negative).alias("negative"))


def ambiguous(found: DataFrame) -> DataFrame:
    """``message_id`` of runs with both kinds: the source has to be asked whether they exist."""
    return found.filter("positive and negative").select("message_id").distinct()


def fold(found: DataFrame, known: DataFrame, looked_up: DataFrame) -> DataFrame:
    """``message_id, action, delete_history, from_lookup``: what each identity of a feed needs.

    ``known(message_id)`` are identities of the catalogue; ``looked_up(message_id, found)`` the source's answers. A run
    with positive events makes the identity present; a deletion makes it absent and keeps an earlier need for RAW; a run
    with both follows the source. The last run holds; an unknown identity that ends absent but was present is imported
    and then marked as deleted. An ambiguous identity without an answer is an error.
    """
    rows = found.join(looked_up.select("message_id", F.col("found").alias("_found")), "message_id", "left")
    both = F.col("positive") & F.col("negative")
    answered = F.coalesce("_found", F.raise_error(F.lit("an ambiguous record needs the source's answer")).cast("boolean"))
    rows = rows.select("message_id", "run", "record", "positive", both.alias("both"), F.when(both, answered).otherwise(F.col("positive")).alias("present"))
    last = lambda value, run: F.max_by(value, run)
    state = rows.groupBy("message_id").agg(
        last("present", "run").alias("present"), last("record", "run").alias("record"),
        F.max(F.when(F.col("present"), F.col("run"))).alias("shown"), F.max(F.when(F.col("both") & ~F.col("present"), F.col("run"))).alias("cleared"),
        last(F.col("both") & F.col("present"), F.when(F.col("positive"), F.col("run"))).alias("asked"),
    )
    needed = F.col("shown").isNotNull() & (F.col("cleared").isNull() | (F.col("shown") > F.col("cleared")))
    rows = state.withColumn("needed", needed).join(known.select("message_id").distinct().withColumn("known", F.lit(True)), "message_id", "left")
    is_known = F.coalesce("known", F.lit(False))
    action = F.when(F.col("present") & is_known, REPAIR).when(F.col("present"), IMPORT).when(is_known, TOMBSTONE).when(F.col("needed"), IMPORT_TOMBSTONE).otherwise(IGNORE)
    return rows.select("message_id", action.alias("action"), F.when(~F.col("present"), F.col("record")).alias("delete_history"), F.coalesce("asked", F.lit(False)).alias("from_lookup"))


def frontier(state: DataFrame, account: str) -> tuple[str, bool] | None:
    """The history id of an account's last sync, and whether that was complete."""
    row = state.filter(F.col("source_account") == account).select("history_id", "complete").first()
    return None if row is None else (row["history_id"], bool(row["complete"]))


def with_frontier(state: DataFrame, account: str, history_id: str, complete: bool = True) -> DataFrame:
    new = state.sparkSession.createDataFrame([(account, history_id, int(complete))], state.schema)
    return merge(state, new, ["source_account"])


def choose_sync(held: tuple[str, bool] | None, bounded: bool, expired: bool = False) -> str:
    """``full`` or ``incremental``: bounded or queried syncs, and those without a complete frontier, are full."""
    return "full" if bounded or held is None or not held[1] or expired else "incremental"


def apply_full(occurrences: DataFrame, listed: DataFrame, bounded: bool) -> tuple[DataFrame, DataFrame]:
    """The updated occurrences, and the listed identities that must be imported.

    ``listed(source_account, gmail_message_id, thread_id, label_ids, internal_date_ms, message_history_id, now)``. Known
    ones get their metadata back and are present; only an unbounded listing marks what it didn't show as deleted.
    """
    key = ["source_account", "gmail_message_id"]
    listed = listed.dropDuplicates(key)
    new = listed.join(occurrences.select(*key), key, "left_anti")
    repaired = repair_metadata(occurrences, listed)
    if bounded:
        return repaired, new
    accounts = listed.select("source_account").distinct()
    mine = repaired.join(accounts, "source_account", "left_semi")
    others = repaired.join(accounts, "source_account", "left_anti")
    return tombstone_missing(mine, listed, key).unionByName(others), new


def repair_metadata(occurrences: DataFrame, listed: DataFrame) -> DataFrame:
    """Labels, thread, date and history from the source; the rows are present."""
    key = ["source_account", "gmail_message_id"]
    fresh = ("thread_id", "label_ids", "internal_date_ms", "message_history_id")
    marks = listed.select(*key, F.struct(*[F.col(c) for c in fresh], "now").alias("_new"))
    out = occurrences.join(marks, key, "left")
    known = F.col("_new").isNotNull()
    values = {c: F.when(known, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in fresh}
    values |= {"source_state": F.when(known, "present").otherwise(F.col("source_state")), "last_seen_unix": F.when(known, F.col("_new.now")).otherwise(F.col("last_seen_unix"))}
    return out.select(*[values.get(c, F.col(c)).alias(c) for c in occurrences.columns])


def apply_incremental(occurrences: DataFrame, account: str, folded: DataFrame, fetched: DataFrame) -> DataFrame:
    """Occurrences after a folded feed: repaired, imported (with the doc_id of ``fetched``) and deleted ones."""
    key = ["source_account", "gmail_message_id"]
    named = folded.select(F.lit(account).alias("source_account"), F.col("message_id").alias("gmail_message_id"), "action", F.col("delete_history").alias("history_id"))
    done = repair_metadata(occurrences, fetched.join(named.filter(F.col("action") == REPAIR), key, "left_semi"))
    new = fetched.join(named.filter(F.col("action").isin(IMPORT, IMPORT_TOMBSTONE)), key, "left_semi")
    rows = new.select(*[F.lit("present").alias(c) if c == "source_state" else F.col("now").alias(c) if c in ("first_seen_unix", "last_seen_unix") else F.col(c) for c in occurrences.columns])
    return tombstone_at(done.unionByName(rows), named.filter(F.col("action").isin(TOMBSTONE, IMPORT_TOMBSTONE)), key)


def batch_numbers(records: DataFrame, order: str, size: str, writer: str) -> DataFrame:
    """``records`` with ``batch``: filled in order, closed once it has ``BATCH_RECORDS`` records or ``BATCH_BYTES`` bytes.

    Filling is sequential within a writer and keeps two running sums only.
    """

    def step(state: tuple[int, int, int], bytes_: int) -> tuple[tuple, tuple]:
        batch, n, held = state
        n, held = n + 1, held + bytes_
        full = n >= BATCH_RECORDS or held >= BATCH_BYTES
        return ((batch + 1, 0, 0) if full else (batch, n, held)), (batch,)

    return filled(records, order, size, writer, "batch long", (0, 0, 0), step).withColumn("batch", F.col("batch").cast("int"))


def covers(staged: DataFrame, durable: DataFrame, key: list[str]) -> DataFrame:
    """``missing, extra, bytes_match``: whether a staged batch is exactly what was made durable."""
    missing = durable.join(staged, key, "left_anti").agg(F.count("*").alias("missing"))
    extra = staged.join(durable, key, "left_anti").agg(F.count("*").alias("extra"))
    total = lambda df, name: df.agg(F.coalesce(F.sum("frame_bytes"), F.lit(0)).alias(name))
    sums = total(staged, "_a").crossJoin(total(durable, "_b"))
    return missing.crossJoin(extra).crossJoin(sums).select("missing", "extra", (F.col("_a") == F.col("_b")).alias("bytes_match"))  # one row each


def new_uids(fetched: DataFrame, known: DataFrame, scanned_through: int, limit: int | None, uid_next: int) -> DataFrame:
    """Mailbox rows above the frontier; ``limit`` is the width of the UID range, not a number of rows."""
    last = uid_next - 1 if limit is None else min(scanned_through + limit, uid_next - 1)
    key = ["source_account", "mailbox", "uid_validity", "uid"]
    return fetched.filter(F.col("uid").between(scanned_through + 1, last)).dropDuplicates(key).join(known.select(*key), key, "left_anti")


def stream_feed(pages: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Run a streaming DataFrame of events to its end: each micro-batch goes to ``apply`` with its id, once to completion.

    ``apply`` must be idempotent by batch id; a restart repeats the last unfinished one.
    """
    return pages.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
