"""Delivery reports (RFC 3464) and disposition notifications (RFC 8098): what kind a message is, and whether it is sound."""

from __future__ import annotations

import re
from email.message import Message
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import ddl
from .mime import decoded_text, parse

#: Closed vocabularies (fixed values).
ACTIONS = ("failed", "delayed", "delivered", "relayed", "expanded")
ACTION_MODES = ("automatic-action", "manual-action")
SENDING_MODES = ("mdn-sent-automatically", "mdn-sent-manually")
DISPOSITIONS = ("displayed", "deleted", "processed", "dispatched")
REPORT_TYPES = {"disposition-notification": "mdn", "delivery-status": "dsn"}
GLOBAL = {"message/global-delivery-status": "dsn", "message/global-disposition-notification": "mdn"}
PARTS = {"message/disposition-notification": "mdn", "message/delivery-status": "dsn"}
STATUS = r"[245]\.(?:0|[1-9]\d{0,2})\.(?:0|[1-9]\d{0,2})"

_RECIPIENT = (
    "struct<original_recipient: string, final_recipient: string, action: string, status: string, remote_mta: string, diagnostic_code: string, "
    "last_attempt_date: string, final_log_id: string, will_retry_until: string>"
)
REPORT = ddl(
    f"kind string, validity string, reason string, message_fields map<string, string>, recipients array<{_RECIPIENT}>, original_message_id string, "
    "disposition struct<action_mode: string, sending_mode: string, disposition_type: string, modifiers: array<string>>, has_third_part boolean"
)


class _Fault(Exception):
    """Why a report isn't sound."""


def fields(text: str) -> dict[str, str]:
    """Header-like fields: continuation lines are joined by one space, names are lower-cased, the first of a name holds."""
    found: list[list[str]] = []
    for line in text.replace("\r\n", "\n").split("\n"):
        if line[:1] in (" ", "\t") and found:
            found[-1][1] += f" {line.strip()}"
        elif ":" in line:
            name, value = line.split(":", 1)
            found.append([name.strip().lower(), value.strip()])
    return {name: value for name, value in reversed(found)}


def field_groups(text: str) -> list[dict[str, str]]:
    """Groups parted by a blank line; those without fields go."""
    return [g for g in map(fields, text.replace("\r\n", "\n").split("\n\n")) if g]


def typed_value(value: str | None) -> str | None:
    """What follows the first semicolon, if anything does."""
    return (value or "").partition(";")[2].strip() or None


def without_service(value: str | None) -> str | None:
    return value if value is None or ";" not in value else value.partition(";")[2].strip()


def disposition(value: str) -> dict | None:
    """``action-mode/sending-mode; type[/modifier,...]`` of the closed vocabularies; else None."""
    sections = [s.strip().lower() for s in value.split(";")]
    if len(sections) < 2 or "/" not in sections[0]:
        return None
    action, sending = (x.strip() for x in sections[0].split("/", 1))
    kind, *rest = sections[1].split("/")
    if action not in ACTION_MODES or sending not in SENDING_MODES or kind.strip() not in DISPOSITIONS:
        return None
    modifiers = [m.strip() for part in rest for m in part.split(",") if m.strip()]
    return {"action_mode": action, "sending_mode": sending, "disposition_type": kind.strip(), "modifiers": modifiers}


def reasonable_status(value: str) -> bool:
    return re.fullmatch(STATUS, value, re.ASCII) is not None


def _need(held: dict[str, str], name: str, typed: bool = False) -> str:
    value = typed_value(held.get(name)) if typed else held.get(name)
    if value is None:
        raise _Fault(f"{'-'.join(w.upper() if w == 'mta' else w.capitalize() for w in name.split('-'))} is required")
    return value


def _mdn(second: Message) -> dict:
    held = fields(decoded_text(second))
    final = _need(held, "final-recipient", typed=True)
    found = disposition(_need(held, "disposition"))
    if found is None:
        raise _Fault("invalid Disposition syntax or value")
    recipient = {"original_recipient": typed_value(held.get("original-recipient")), "final_recipient": final}
    known = {k: held[k] for k in ("reporting-ua",) if k in held}
    return {"message_fields": known, "recipients": [recipient], "original_message_id": held.get("original-message-id"), "disposition": found}


def _recipient(group: dict[str, str]) -> dict:
    final = _need(group, "final-recipient", typed=True)
    action = _need(group, "action").lower()
    if action not in ACTIONS:
        raise _Fault("unsupported Action value")
    status = _need(group, "status")
    if not reasonable_status(status):
        raise _Fault("invalid Status syntax")
    if "will-retry-until" in group and action != "delayed":
        raise _Fault("Will-Retry-Until is only valid for delayed delivery")
    plain = {k.replace("-", "_"): group.get(k) for k in ("remote-mta", "last-attempt-date", "final-log-id", "will-retry-until")}
    code = without_service(group.get("diagnostic-code"))
    return plain | {"original_recipient": typed_value(group.get("original-recipient")), "final_recipient": final, "action": action, "status": status, "diagnostic_code": code}


def _dsn(second: Message, parts: list[Message]) -> dict:
    groups = field_groups(decoded_text(second))
    if not groups:
        raise _Fault("message fields are missing")
    _need(groups[0], "reporting-mta")
    if len(groups) < 2:
        raise _Fault("at least one recipient is required")
    recipients = [_recipient(g) for g in groups[1:]]
    names = ("original-envelope-id", "reporting-mta", "dsn-gateway", "received-from-mta", "arrival-date")
    returned = decoded_text(parts[2]) if len(parts) > 2 and not isinstance(parts[2].get_payload(), list) else ""
    prefix = "Message-ID: "
    original = next((line[len(prefix) :] for line in returned.splitlines() if line.startswith(prefix)), None)
    return {"message_fields": {n: groups[0][n] for n in names if n in groups[0]}, "recipients": recipients, "original_message_id": original}


def analyse(raw: bytes | None) -> dict:
    """All fields of REPORT for one message."""
    blank = dict.fromkeys(REPORT.names)
    if raw is None:
        return blank | {"kind": "unparseable", "reason": "no RAW"}
    try:
        message = parse(raw)
    except Exception as error:  # a hostile message, not a fault of ours
        return blank | {"kind": "unparseable", "reason": f"MIME parse failed: {error}"}
    parts = message.get_payload() if isinstance(message.get_payload(), list) else []
    verdict = lambda kind, validity, reason=None: blank | {"kind": kind, "validity": validity, "reason": reason}
    if message.get_content_type() != "multipart/report":
        seen = {message.get_content_type(), *(p.get_content_type() for p in parts)}
        for mime, kind in PARTS.items():
            if mime in seen:
                return verdict(kind, "malformed", f"{kind.upper()} is not multipart/report")
        return verdict("ordinary", "valid")
    report_type = str(message.get_param("report-type") or "").lower()
    kind = REPORT_TYPES.get(report_type, "dsn")
    if len(parts) < 2:
        return verdict(kind, "malformed", "multipart/report has no structured report part")
    second = parts[1].get_content_type()
    if second in GLOBAL:
        return verdict(GLOBAL[second], "unsupported", "RFC 6533 global report types are not implemented")
    if second in PARTS and REPORT_TYPES.get(report_type) != PARTS[second]:
        return verdict(PARTS[second], "unsupported", f"{PARTS[second].upper()} part has an unsupported report-type")
    if second not in PARTS:
        if "global-" in second:
            return verdict(kind, "unsupported", "RFC 6533 global report type is not implemented")
        return verdict(kind, "malformed", "multipart/report has an unexpected structured report part")
    try:
        found = _mdn(parts[1]) if kind == "mdn" else _dsn(parts[1], parts)
    except _Fault as fault:
        return verdict(kind, "malformed", str(fault))
    return verdict(kind, "valid") | found | {"has_third_part": len(parts) > 2}


@F.pandas_udf(REPORT)
def analyse_report(raw: pd.Series, plain: pd.Series) -> pd.DataFrame:
    ordinary = dict.fromkeys(REPORT.names) | {"kind": "ordinary", "validity": "valid"}
    return pd.DataFrame([ordinary if p else analyse(None if r is None else bytes(r)) for r, p in zip(raw, plain, strict=True)], columns=REPORT.names)


def with_report(df: DataFrame, raw: str = "raw") -> DataFrame:
    """``df`` with a struct ``report`` (REPORT).

    A message without any of the content types of reports is ordinary: it isn't sent to Python, nor parsed.
    """
    low = F.lower(F.col(raw).cast("string"))
    plain = F.coalesce(~reduce(lambda a, b: a | b, [low.contains(t) for t in ("multipart/report", *PARTS)]), F.lit(False))
    once = analyse_report.asNondeterministic()  # or a filter on the result would parse every message once more
    return df.withColumn("report", once(F.when(~plain, F.col(raw)), plain))


def recipients(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a recipient of sound reports."""
    return df.filter("report.validity = 'valid' and report.recipients is not null").select(key, F.col("report.kind").alias("kind"), F.inline("report.recipients"))
