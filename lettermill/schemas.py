"""Fixed table schemas of the catalogue, the search projection and parsed messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from .functions.types import ddl

_ddl = ddl

CATALOGUE = {
    "messages": _ddl(
        "doc_id long not null, message_id string not null, timestamp long not null, sender string not null, recipients string not null, subject string not null, "
        "account string not null, folder string not null, thread string not null, segment string not null, archive_offset long not null, frame_bytes long not null, raw_digest binary not null"
    ),
    "attachments": _ddl("doc_id long not null, filename string not null, mime string not null, bytes long not null, content_hash string not null"),
    "gmail_state": _ddl("source_account string not null, history_id string not null, complete int not null"),
    "gmail_messages": _ddl(
        "source_account string not null, gmail_message_id string not null, doc_id long not null, thread_id string not null, label_ids string not null, internal_date_ms long, "
        "message_history_id string, source_state string not null, first_seen_unix long not null, last_seen_unix long not null"
    ),
    "imap_messages": _ddl(
        "source_account string not null, mailbox string not null, uid_validity long not null, uid long not null, doc_id long not null, flags string not null, internal_date string, "
        "internal_date_ms long, rfc822_size long, source_state string not null, first_seen_unix long not null, last_seen_unix long not null"
    ),
    "imap_scan_state": _ddl("source_account string not null, mailbox string not null, uid_validity long not null, scanned_through_uid long not null, last_uid_next long not null, updated_unix long not null"),
    "imap_mailboxes": _ddl("source_account string not null, mailbox string not null, delimiter string, attributes string not null, special_use string not null, selectable int not null, last_seen_unix long not null"),
}
#: Primary and unique keys.
KEYS = {
    "messages": [["doc_id"], ["message_id"]],
    "attachments": [["doc_id", "filename"]],
    "gmail_state": [["source_account"]],
    "gmail_messages": [["source_account", "gmail_message_id"], ["doc_id"]],
    "imap_messages": [["source_account", "mailbox", "uid_validity", "uid"], ["doc_id"]],
    "imap_scan_state": [["source_account", "mailbox", "uid_validity"]],
    "imap_mailboxes": [["source_account", "mailbox"]],
}

FRAMES = _ddl("segment string, offset long, frame_bytes long, doc_id decimal(20,0), raw binary, status string, reason string")

#: The derived search projection.
SEARCH_DOCS = _ddl(
    "doc_id long, message_id string, timestamp_ms long, sender string, recipients string, subject string, body string, attachment_text string, folder string, account string, "
    "labels array<string>, attachment_types array<string>, attachment_count long, has_attachment int, attachment_mime array<string>, attachment_family array<string>, "
    "sender_filter array<string>, recipient_filter array<string>"
)

INDEXED_DOCS = _ddl("doc_id long, source_state string, label_ids string, timestamp_ms long, message_history_id string, raw_digest binary")


class SchemaError(ValueError):
    """A table doesn't have its fixed schema or breaks a key."""


def validate(name: str, df: DataFrame, keys: bool = True) -> None:
    """Raise SchemaError unless ``df`` has exactly the columns and types of the catalogue table, and its keys."""
    want = CATALOGUE[name]
    have = {f.name: f.dataType for f in df.schema}
    if list(have) != want.names or any(have[f.name] != f.dataType for f in want):
        raise SchemaError(f"{name}: {df.schema.simpleString()} is not {want.simpleString()}")
    empty = " or ".join(f"`{f.name}` is null" for f in want if not f.nullable)
    if df.filter(empty).limit(1).count():
        raise SchemaError(f"{name}: a required column is null")
    for key in KEYS[name] if keys else []:
        if df.groupBy(*key).count().filter("count > 1").limit(1).count():
            raise SchemaError(f"{name}: {key} is not unique")


#: What a catalogue says of itself (fixed values).
APPLICATION_ID, USER_VERSION = 0x4D454D31, 1


def validate_catalogue(tables: dict[str, DataFrame], application_id: int, user_version: int) -> None:
    """Raise SchemaError unless these are exactly the catalogue's tables, of this application and version."""
    if (application_id, user_version) != (APPLICATION_ID, USER_VERSION):
        raise SchemaError(f"another application or version: {application_id:#x}, {user_version}")
    if set(tables) != set(CATALOGUE):
        raise SchemaError(f"tables {sorted(tables)} are not {sorted(CATALOGUE)}")
    for name, df in tables.items():
        validate(name, df)
