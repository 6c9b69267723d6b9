"""Publishing batches, mailbox frontiers and progress."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.catalogue import merge


def publish_batch(tables: dict[str, DataFrame], folder: str, batch_id: int) -> None:
    """Write a batch's rows of several tables, then its marker. Repeating a batch replaces it, so a retry adds nothing.

    Readers see only batches with a marker, so all tables of a batch appear together.
    """
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")
    spark = next(iter(tables.values())).sparkSession
    spark.range(1).select(F.lit(batch_id).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{folder}/_published/id={batch_id}")


def published(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The rows of all published batches of a table."""
    marks = spark.read.parquet(f"{folder}/_published").select("batch")
    rows = spark.read.option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}")
    return rows.join(marks, "batch", "left_semi").drop("batch")


def scan_state(state: DataFrame, account: str, mailbox: str) -> tuple[int, int] | None:
    """UIDVALIDITY and the last scanned UID of a mailbox."""
    row = state.filter((F.col("source_account") == account) & (F.col("mailbox") == mailbox)).orderBy(F.desc("updated_unix")).select("uid_validity", "scanned_through_uid").first()
    return None if row is None else tuple(row)


def known_uid_validity(state: DataFrame, messages: DataFrame, account: str, mailbox: str) -> int | None:
    """UIDVALIDITY from the frontier, else from any message of the mailbox."""
    held = scan_state(state, account, mailbox)
    if held is not None:
        return held[0]
    row = messages.filter((F.col("source_account") == account) & (F.col("mailbox") == mailbox)).agg(F.min("uid_validity")).first()
    return row[0]


def with_scan_state(state: DataFrame, rows: DataFrame) -> DataFrame:
    """Frontiers replaced or added, by account, mailbox and UIDVALIDITY."""
    return merge(state, rows, ["source_account", "mailbox", "uid_validity"])


def with_mailboxes(held: DataFrame, rows: DataFrame) -> DataFrame:
    """Mailboxes replaced or added."""
    return merge(held, rows, ["source_account", "mailbox"])


def advance(state: DataFrame, account: str, mailbox: str, uid_validity: int, through: int, uid_next: int, now: int) -> DataFrame:
    """The frontier after a scan, also of an empty range. Another UIDVALIDITY than the known one is an error."""
    known = scan_state(state, account, mailbox)
    if known is not None and known[0] != uid_validity:
        raise ValueError(f"UIDVALIDITY of {mailbox} changed from {known[0]} to {uid_validity}")
    return with_scan_state(state, state.sparkSession.createDataFrame([(account, mailbox, uid_validity, through, uid_next, now)], state.schema))


def sync_mailboxes(spark: SparkSession, names: Iterable[str], sync: Callable[[str], int]) -> DataFrame:
    """``mailbox, imported, error``: each mailbox is synced on its own, so one that fails doesn't stop the others."""
    rows = []
    for name in names:
        try:
            rows.append((name, sync(name), None))
        except Exception as error:  # the row tells
            rows.append((name, 0, str(error)))
    return spark.createDataFrame(rows, "mailbox string, imported long, error string")


class Progress(StreamingQueryListener):
    """Passes snapshots of a stream's progress to a callback."""

    def __init__(self, callback: Callable[[dict], None]):
        self.callback = callback

    def onQueryStarted(self, event) -> None:
        self.callback({"event": "started", "id": str(event.id)})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.callback({"event": "progress", "id": str(p.id), "batch": p.batchId, "rows": p.numInputRows})

    def onQueryIdle(self, event) -> None:
        self.callback({"event": "idle", "id": str(event.id)})

    def onQueryTerminated(self, event) -> None:
        self.callback({"event": "terminated", "id": str(event.id), "error": event.exception})
