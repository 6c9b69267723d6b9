"""MIME messages as columns: headers, text, leaf parts, attachments, HTML documents. Arrow batches, one parse a message.

Message parts of type ``message/*`` are leaves, as they are stored; a part without a Content-Disposition counts as
inline. ``text/plain`` goes into the body even if it is an attachment, ``text/html`` only if it is not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from email.header import decode_header, make_header
from email.message import Message
from email.parser import BytesParser
from email.policy import compat32

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import HIDDEN_LINK
from ..functions.types import ddl

LARGEST_TEXT = 64 * 1024 * 1024
LONGEST_EXTRACT = 8 * 1024 * 1024
#: Messages parsed at once: each is held several times, as RAW, payloads and texts.
BATCH_ROWS = 256

PART = "struct<part_id: int, mime: string, disposition: string, filename: string, content_id: string, downloadable: boolean, charset: string, encoded_bytes: long, decoded_bytes: long, payload: binary, text: string>"
PARSED = ddl(
    "subject string, sender string, recipients string, body string, attachment_types array<string>, attachment_count long, attachment_text string, multipart boolean, "
    f"parts array<{PART}>, html string, error string"
)

#: The fields that a search index needs.
SEARCHED = ("subject", "sender", "recipients", "body", "attachment_types", "attachment_count", "attachment_text", "error")


def _header(message: Message, name: str) -> str:
    value = message.get(name)
    if value is None:
        return ""
    try:
        return str(make_header(decode_header(str(value)))).replace("\r\n", "").replace("\n", "").strip()
    except (LookupError, UnicodeError, ValueError):
        return str(value).strip()


def parse(raw: bytes) -> Message:
    """The message; parts of type message/* are not opened."""
    return _Leaves(policy=compat32).parsebytes(raw)


class _Leaves(BytesParser):
    """Keeps the bytes of ``message/*`` parts as their payload."""

    def parsebytes(self, text: bytes, headersonly: bool = False) -> Message:
        message = super().parsebytes(text, headersonly)
        for part in message.walk():
            if part.get_content_maintype() == "message" and part.is_multipart():
                inner = part.get_payload()
                part.set_payload("\n".join(p.as_string() for p in inner) if part.get_content_type() != "message/delivery-status" else "\n".join(p.as_string().strip("\n") + "\n" for p in inner))
        return message


def leaves(message: Message) -> Iterator[Message]:
    """Parts without parts, depth first."""
    if isinstance(message.get_payload(), list):
        for part in message.get_payload():
            yield from leaves(part)
    else:
        yield message


def decoded(part: Message) -> bytes:
    payload = part.get_payload(decode=True)
    return payload if isinstance(payload, bytes) else str(part.get_payload()).encode("utf-8", "surrogateescape")


def decoded_text(part: Message) -> str:
    charset = part.get_content_charset() or "utf-8"
    try:
        return decoded(part).decode(charset, "replace")
    except LookupError:
        return decoded(part).decode("utf-8", "replace")


def disposition(part: Message) -> str:
    return (part.get_content_disposition() or "inline").lower()


def content_id(part: Message) -> str | None:
    return str(part.get("Content-ID", "")).strip().lstrip("<").rstrip(">") or None


def file_name(part: Message) -> str | None:
    name = part.get_filename()
    return name if name and name.strip() else None


def downloadable(part: Message) -> bool:
    return disposition(part) == "attachment" or bool(file_name(part)) and not (disposition(part) == "inline" and content_id(part))


_IGNORED = re.compile(r"<\s*(script|style)[^>]*>.*?(?:<\s*/(?:script|style)[^>]*>|\Z)", re.I | re.S)
_BREAK, _TAG = re.compile(r"<\s*(?:br|/p|/div)[^>]*>", re.I), re.compile(r"<[^>]*(?:>|\Z)")


def html_to_text(html: str) -> str:
    """The same as the column function of that name."""
    text = _TAG.sub("", _BREAK.sub("\n", _IGNORED.sub("", html)))
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = text.replace(entity, char)
    return " ".join(HIDDEN_LINK if w.startswith(("http://", "https://", "www.")) else w for w in text.split())


def extract_text(mime: str, payload: bytes, text: str | None) -> tuple[str, str]:
    """Outcome (extracted, unsupported, failed) and text of one attachment."""
    if len(payload) > LARGEST_TEXT:
        return "failed", ""
    if not mime.startswith("text/"):
        return "unsupported", ""
    if text is None:
        return "failed", ""
    found = html_to_text(text) if mime == "text/html" else text
    return "extracted", found[:LONGEST_EXTRACT]


def parsed(raw: bytes | None, with_parts: bool = True) -> dict:
    """All fields of PARSED for one message, or all but ``parts``; a message that can't be parsed has only an error."""
    blank = dict.fromkeys(PARSED.names)
    if raw is None:
        return blank | {"error": "no RAW"}
    try:
        message = parse(raw)
        body, types, texts, parts, html = [], [], [], [], None
        for number, part in enumerate(leaves(message)):
            mime, cid, name, attached, payload = part.get_content_type(), content_id(part), file_name(part), downloadable(part), decoded(part)
            text = decoded_text(part) if mime.startswith("text/") and len(payload) <= LARGEST_TEXT else None
            if attached:
                types.append(mime)
                texts.append(extract_text(mime, payload, text)[1])
            if mime == "text/plain":
                body.append((text or "") + "\n")
            elif mime == "text/html" and not attached:
                body.append(html_to_text(text or "") + "\n")
                html = text
            if not with_parts:
                continue
            encoded = len(str(part.get_payload()).encode("utf-8", "surrogateescape"))
            parts.append({
                "part_id": number, "mime": mime, "disposition": disposition(part), "filename": name, "content_id": cid, "downloadable": attached, "charset": part.get_content_charset(),
                "encoded_bytes": encoded, "decoded_bytes": len(payload), "payload": payload, "text": text,
            })
        return {
            "subject": _header(message, "Subject"), "sender": _header(message, "From"), "recipients": " ".join(x for x in (_header(message, h) for h in ("To", "Cc", "Bcc")) if x),
            "body": "".join(body), "attachment_types": types, "attachment_count": len(types), "attachment_text": "\n".join(t for t in texts if t), "multipart": message.is_multipart(), "parts": parts, "html": html, "error": None,
        }
    except Exception as error:  # whatever a hostile message makes the parser do, it is that message's error
        return blank | {"error": f"{type(error).__name__}: {error}"}


def _parser(fields: tuple[str, ...]):
    schema = T.StructType([f for f in PARSED if f.name in fields])

    @F.pandas_udf(schema)
    def parse_message(raw: pd.Series) -> pd.DataFrame:
        rows = (parsed(None if r is None else bytes(r), "parts" in fields) for r in raw)
        return pd.DataFrame([[row[n] for n in schema.names] for row in rows], columns=schema.names)

    return parse_message.asNondeterministic()  # or a filter on the result would parse every message once more


def with_parsed(df: DataFrame, raw: str = "raw", fields: tuple[str, ...] = tuple(PARSED.names)) -> DataFrame:
    """``df`` with a struct ``parsed`` of PARSED's ``fields``; only these leave Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(df.sparkSession.conf.get(key, "10000")) > BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df.withColumn("parsed", _parser(fields)(raw))


def parts(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a leaf part of parsed messages, without its text."""
    return df.select(key, F.inline("parsed.parts"))


def attachments(parts_: DataFrame) -> DataFrame:
    return parts_.filter("downloadable").select("doc_id", "part_id", "filename", "mime", "decoded_bytes", "content_id", (F.col("disposition") == "inline").alias("inline"))


def resources(parts_: DataFrame) -> DataFrame:
    return parts_.filter("content_id is not null").select("doc_id", "part_id", "mime", "content_id", "decoded_bytes")


def attachment_bytes(parts_: DataFrame, doc_id: int, part_id: int) -> DataFrame:
    """The payload of one downloadable part; no row if there is none."""
    return parts_.filter(F.col("downloadable") & (F.col("doc_id") == doc_id) & (F.col("part_id") == part_id)).select("payload")


def html_documents(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """The last HTML leaf that isn't an attachment, and all other parts with a Content-ID."""
    held = F.filter("parsed.parts", lambda p: p["content_id"].isNotNull() & ~((p["mime"] == "text/html") & ~p["downloadable"]))
    found = F.transform(held, lambda p: F.struct(p["mime"].alias("mime"), p["content_id"].alias("content_id"), p["payload"].alias("payload")))
    return df.filter(F.col("parsed.html").isNotNull()).select(key, F.col("parsed.html").alias("html"), found.alias("resources"))


EXTRACTED = ddl("outcome string, text string")


@F.pandas_udf(EXTRACTED)
def extract_attachment(mime: pd.Series, payload: pd.Series, text: pd.Series) -> pd.DataFrame:
    rows = [extract_text(m or "", b"" if p is None else bytes(p), t) for m, p, t in zip(mime, payload, text, strict=True)]
    return pd.DataFrame(rows, columns=EXTRACTED.names)


def extractions(parts_: DataFrame) -> DataFrame:
    """``doc_id, part_id, mime, bytes, outcome, text`` of each downloadable part."""
    rows = parts_.filter("downloadable").withColumn("found", extract_attachment("mime", "payload", "text"))
    return rows.select("doc_id", "part_id", "mime", F.col("decoded_bytes").alias("bytes"), "found.outcome", F.col("found.text").alias("text"))


#: What an attachment of the synthetic format begins with.
ATTACHED = "\r\n--attachment;"


def synthetic_cut(raw: str = "raw") -> dict[str, Column]:
    """``head`` and ``body`` of a message in the synthetic corpus's format: up to a blank line, and from there to the first attachment.

    Bytes are cut at the marks, which are ASCII, and only what is cut out is made text: attachments are never decoded.
    """
    head = F.substring_index(F.col(raw).cast("string"), "\r\n\r\n", 1)
    rest = F.substring(raw, F.octet_length(head) + 5, F.octet_length(raw)).cast("string")
    return {"head": F.make_valid_utf8(head), "body": F.make_valid_utf8(F.substring_index(rest, ATTACHED, 1))}


def synthetic_fields(raw: str = "raw", cut: dict[str, Column] | None = None):
    """Columns of a message in the synthetic corpus's format: headers up to a blank line, body up to the first attachment.

    Names are compared in lower case and the last of a name holds; a missing required header raises an error.
    ``cut``: columns that hold ``synthetic_cut`` already, so RAW is read once and not for each field.
    """
    cut = cut or synthetic_cut(raw)
    lines = F.filter(F.split(cut["head"], "\r?\n"), lambda x: x.contains(":"))

    def last(name: str):
        found = F.filter(lines, lambda x: F.lower(F.substring_index(x, ":", 1)) == name)
        value = F.trim(F.regexp_replace(F.element_at(found, -1), "^[^:]*:", ""))
        return F.when(F.size(found) > 0, value).otherwise(F.raise_error(F.lit(f"missing archived header {name}")).cast("string"))

    body = F.trim(F.regexp_replace(cut["body"], r"^\s+|\s+$", ""))
    names = {"timestamp": "date-unix", "sender": "from", "recipients": "to", "subject": "subject", "folder": "x-folder", "account": "x-account"}
    columns = [last(header).alias(name) for name, header in names.items()]
    columns[0] = last("date-unix").cast("long").alias("timestamp")
    return [*columns, body.alias("body"), F.octet_length(raw).cast("long").alias("raw_bytes")]


def map_messages(df: DataFrame, function, schema: str, raw: str = "raw") -> DataFrame:
    """Rows that a user's function gives for each parsed message: ``function(row, message)`` yields tuples of ``schema``."""
    names = [f.name for f in ddl(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [out for row in batch.to_dict("records") for out in function(row, parse(bytes(row[raw])))]
            yield pd.DataFrame(rows, columns=names)

    return df.mapInPandas(run, schema)
