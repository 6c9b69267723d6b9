"""Text of attachments by provider: built-in for text, an external program for PDF where there is one."""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mime import LARGEST_TEXT, LONGEST_EXTRACT, extract_text

TIMEOUT = 10.0


@dataclass(frozen=True)
class Provider:
    """What a provider is called, how it works, which types it takes, and whether it can run here."""

    id: str
    backend: str
    types: tuple[str, ...]
    available: bool
    command: tuple[str, ...] = ()

    def takes(self, mime: str) -> bool:
        return self.available and (mime in self.types or any(t.endswith("/*") and mime.startswith(t[:-1]) for t in self.types))


def discover(path: str | None = None) -> list[Provider]:
    """The built-in text provider and ``pdftotext``, available if it is on the path."""
    program = shutil.which("pdftotext", path=path)
    command = (program, "-layout", "-enc", "UTF-8", "-", "-") if program else ()
    return [Provider("text", "built-in", ("text/*",), True), Provider("pdftotext", "command", ("application/pdf",), bool(program), command)]


def providers_for(mime: str, providers: list[Provider]) -> list[Provider]:
    return [p for p in providers if p.takes(mime)]


def selected(mime: str, providers: list[Provider], choice: dict[str, str] | None = None) -> Provider | None:
    """The provider that was chosen for the type, if it can take it; else the first that can."""
    able = providers_for(mime, providers)
    wanted = (choice or {}).get(mime)
    return next((p for p in able if p.id == wanted), able[0] if able and wanted is None else None)


def run_command(command: tuple[str, ...], payload: bytes, timeout: float = TIMEOUT) -> tuple[str, str]:
    """Outcome and text of a program that reads the payload; a late, failing or overlong one fails."""
    try:
        done = subprocess.run(command, input=payload, capture_output=True, timeout=timeout, check=True)
        text = done.stdout.decode("utf-8")
    except (OSError, subprocess.SubprocessError, UnicodeDecodeError):
        return "failed", ""
    return ("failed", "") if len(done.stdout) > LONGEST_EXTRACT else ("extracted", text)


def extract(mime: str, payload: bytes, text: str | None, providers: list[Provider], choice: dict[str, str] | None = None) -> tuple[str, str]:
    """Outcome (extracted, unsupported, failed) and text of one attachment."""
    provider = selected(mime, providers, choice)
    if len(payload) > LARGEST_TEXT:
        return "failed", ""
    if provider is None:
        return "unsupported", ""
    return run_command(provider.command, payload) if provider.command else extract_text(mime, payload, text)


def extractions(parts: DataFrame, choice: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, part_id, mime, bytes, outcome, text`` of each downloadable part; each executor uses what it has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here = discover()
        for batch in batches:
            rows = zip(batch["mime"], batch["payload"], batch["text"], strict=True)
            found = [extract(m or "", b"" if p is None else bytes(p), t, here, choice) for m, p, t in rows]
            out = batch[["doc_id", "part_id", "mime", "bytes"]].copy()
            out["outcome"], out["text"] = [o for o, _ in found], [t for _, t in found]
            yield out

    rows = parts.filter("downloadable").select("doc_id", "part_id", "mime", F.col("decoded_bytes").alias("bytes"), "payload", "text")
    return rows.mapInPandas(run, "doc_id long, part_id int, mime string, bytes long, outcome string, text string")
