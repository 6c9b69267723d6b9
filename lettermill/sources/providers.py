"""What mail providers return, as tables: listings, RAW, history pages, mailboxes and fetched rows. Nothing is fetched here."""

from __future__ import annotations

import re
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


from ..functions.text import decode_base64url
from ..functions.types import ddl

_REF = "struct<message: struct<id: string, threadId: string>>"
HISTORY = ddl(
    f"page long, history array<struct<id: string, messagesAdded: array<{_REF}>, messagesDeleted: array<{_REF}>, "
    "labelsAdded: array<struct<message: struct<id: string, threadId: string>, labelIds: array<string>>>, labelsRemoved: array<struct<message: struct<id: string, threadId: string>, labelIds: array<string>>>>>, "
    "nextPageToken string, historyId string"
)
RAW_MESSAGES = ddl("id string, threadId string, labelIds array<string>, historyId string, internalDate string, raw string")
#: Special uses of mailboxes that are kept (fixed values).
SPECIAL_USES = ("all", "archive", "drafts", "flagged", "junk", "sent", "trash")
_ACCOUNT = re.compile(r"imap:[^@\s]+@[^:\s]+:([0-9]{1,5})")


class Transport(Protocol):
    """A message source that users can replace; each call returns rows of the schemas above."""

    def listing(self, page: str | None, query: str | None) -> DataFrame: ...
    def raw(self, ids: DataFrame) -> DataFrame: ...
    def metadata(self, ids: DataFrame) -> DataFrame: ...
    def profile(self) -> tuple[str, str]: ...
    def history(self, start: str, page: str | None) -> DataFrame: ...


class TableTransport:
    """A transport over tables or files that were exported before."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def listing(self, page: str | None = None, query: str | None = None) -> DataFrame:
        rows = self.metadata()
        return rows.filter(F.array_contains("labelIds", query.removeprefix("label:"))) if query else rows

    def raw(self, ids: DataFrame | None = None) -> DataFrame:
        rows = self.spark.read.schema(RAW_MESSAGES).json(f"{self.folder}/raw")
        return rows if ids is None else rows.join(ids.select("id").distinct(), "id", "left_semi")

    def metadata(self, ids: DataFrame | None = None) -> DataFrame:
        return self.raw(ids).drop("raw")

    def profile(self) -> tuple[str, str]:
        row = self.spark.read.schema("emailAddress string, historyId string").json(f"{self.folder}/profile").first()
        return row["emailAddress"], row["historyId"]

    def history(self, start: str, page: str | None = None) -> DataFrame:
        pages = self.spark.read.schema(HISTORY).json(f"{self.folder}/history")
        return pages.withColumn("history", F.filter("history", lambda h: h["id"].cast("long") > int(start)))

    def history_stream(self) -> DataFrame:
        """The same pages as a stream of files."""
        return self.spark.readStream.schema(HISTORY).json(f"{self.folder}/history")


def account_of(email: str) -> str:
    """The stable name of a mailbox account: a digest of the trimmed, lower-cased address."""
    import hashlib

    return "gmail:" + hashlib.sha256(email.strip().lower().encode()).hexdigest()


def gmail_identity(account: Column, message_id: Column) -> Column:
    return F.concat_ws(":", F.lit("gmail"), account, message_id)


def imap_account(user: str, host: str, port: int) -> str:
    return f"imap:{user}@{host}:{port}"


def is_canonical_imap_account(name: str) -> bool:
    found = _ACCOUNT.fullmatch(name)
    return bool(found) and 0 < int(found[1]) < 65_536


def canonical_imap_account(name: Column) -> Column:
    """The same test as a column."""
    port = F.try_to_number(F.regexp_extract(name, r"^imap:[^@\s]+@[^:\s]+:([0-9]{1,5})$", 1), F.lit("99999"))
    return F.coalesce(port.between(1, 65_535), F.lit(False))


def imap_identity(account: Column, mailbox: Column, uid_validity: Column, uid: Column) -> Column:
    return F.concat_ws(":", F.lit("imap"), account, mailbox, uid_validity.cast("string"), uid.cast("string"))


def decoded_messages(raw_messages: DataFrame) -> DataFrame:
    """RAW rows with bytes; a row whose base64url isn't valid raises an error."""
    bytes_ = decode_base64url("raw")
    checked = F.when(bytes_.isNull() & F.col("raw").isNotNull(), F.raise_error(F.concat(F.lit("invalid RAW of "), F.col("id"))).cast("binary")).otherwise(bytes_)
    return raw_messages.select("id", F.col("threadId").alias("thread_id"), F.to_json("labelIds").alias("label_ids"), F.col("historyId").alias("message_history_id"), F.col("internalDate").cast("long").alias("internal_date_ms"), checked.alias("raw"))


def mailboxes(listed: DataFrame) -> DataFrame:
    """Mailboxes with selectable flag and special uses, from ``listed(name, delimiter, attributes)``."""
    low = F.transform("attributes", lambda a: F.lower(F.regexp_replace(a, r"^\\", "")))
    uses = F.filter(low, lambda a: a.isin(*SPECIAL_USES))
    return listed.select(F.col("name").alias("mailbox"), "delimiter", F.to_json("attributes").alias("attributes"), F.to_json(uses).alias("special_use"), (~F.array_contains(low, "noselect")).cast("int").alias("selectable"))


def fetched_rows(fetched: DataFrame) -> DataFrame:
    """``uid, flags, internal_date, internal_date_ms, rfc822_size, raw`` of ``fetched(uid, flags, internal_date, raw)`` (an instant)."""
    return fetched.select(
        "uid", F.to_json(F.array_sort("flags")).alias("flags"), F.date_format("internal_date", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("internal_date"), F.unix_millis("internal_date").alias("internal_date_ms"),
        F.octet_length("raw").cast("long").alias("rfc822_size"), "raw",
    )


def resolve_exact(responses: DataFrame, wanted: int) -> DataFrame:
    """One row ``outcome, raw`` for an exact UID: no response is unavailable, several are ambiguous, another UID is an error."""
    sums = responses.agg(F.count("*").alias("n"), F.count("uid").alias("named"), F.count("raw").alias("bodies"), F.first("uid").alias("uid"), F.first("raw", ignorenulls=True).alias("raw"))
    outcome = F.when(F.col("n") == 0, "unavailable").when((F.col("n") != 1) | (F.col("named") != 1) | (F.col("bodies") != 1), "ambiguous").when(F.col("uid") != wanted, "wrong uid").otherwise("found")
    return sums.select(outcome.alias("outcome"), F.when(outcome == "found", F.col("raw")).alias("raw"))
