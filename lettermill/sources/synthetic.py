"""Deterministic synthetic corpora: the arithmetic search population in SQL, and messages from a generator."""

from __future__ import annotations

import random
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Profiles: attachment rate and duplicate rate in percent, largest attachment in bytes (fixed values).
PROFILES = {"light": (3, 20, 64 * 1024), "personal": (30, 55, 1024 * 1024), "heavy": (65, 35, 8 * 1024 * 1024)}
#: MIME types of the population and their shares in percent (fixed values).
MIMES = {"image/jpeg": 35, "application/pdf": 25, "text/csv": 15, "application/zip": 10, "application/octet-stream": 15}
_NAMES = ("ada", "ben", "chloé", "dörte", "eve", "フミ", "gus", "inés")
_TERMS = ("agenda", "budget", "contract", "draft", "estimate", "forecast", "quorum", "zeugma")
_BODIES = {"en": "The plan is attached for your review.", "fr": "Le plan est joint pour relecture.", "de": "Der Plan liegt zur Prüfung bei.", "es": "El plan va adjunto para su revisión."}

MESSAGE = "doc_id long, message_id string, timestamp long, sender string, recipients array<string>, subject string, body string, html string, account string, folder string, thread string, attachments array<struct<filename: string, mime: string, bytes: long, content_hash: string>>, raw binary"


#: Body lengths: shares of ten thousand for short, medium and long bodies; the rest is very long (fixed values).
BODIES = {"light": (8300, 1500, 190), "personal": (7200, 2200, 500), "heavy": (6000, 2600, 1000)}
REPEATS = ((1, 3), (20, 80), (250, 750), (4000, 20_000))
#: Attachment sizes: a profile's base, and multipliers by share of a hundred (fixed values).
BASES = {"light": 512, "personal": 32 * 1024, "heavy": 256 * 1024}
MULTIPLIERS = {1: 60, 4: 25, 32: 12, 256: 3}


class Xorshift(random.Random):
    """The xorshift64* generator as a source for ``random``; a seed is any number."""

    def seed(self, a=0, version=2) -> None:
        self.state = (hash_ if (hash_ := int(a) & MASK) else 1) ^ 0x9E3779B97F4A7C15

    def next(self) -> int:
        x = self.state
        x ^= x >> 12
        x = (x ^ x << 25) & MASK
        self.state = x = x ^ x >> 27
        return x * 0x2545F4914F6CDD1D & MASK

    def getrandbits(self, k: int) -> int:
        words = [self.next() >> 32 for _ in range(0, k, 32)]
        return int.from_bytes(struct.pack(f">{len(words)}I", *words), "big") >> (-k % 32)

    def randbytes(self, n: int) -> bytes:
        """Bytes of a counter that is scrambled 64 bits at a time, from one step of this generator: any number at once."""
        with np.errstate(over="ignore"):
            x = np.uint64(self.next()) + np.arange(1, -(-n // 8) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))).astype("<u8").tobytes()[:n]

    def random(self) -> float:
        return (self.next() >> 11) / (1 << 53)


MASK = (1 << 64) - 1


def body_repeats(profile: str, rng: random.Random) -> int:
    """How often a body repeats its term."""
    roll = rng.randrange(10_000)
    for share, (least, width) in zip((*BODIES[profile], 10_000), REPEATS, strict=True):
        if roll < share:
            return least + rng.randrange(width)
        roll -= share
    raise AssertionError


def attachment_size(profile: str, rng: random.Random, largest: int) -> int:
    """The base of a profile times a multiplier, at most ``largest``."""
    return min(BASES[profile] * rng.choices([*MULTIPLIERS], [*MULTIPLIERS.values()])[0], max(largest, 512))


@dataclass(frozen=True)
class Corpus:
    messages: int
    seed: int = 42
    profile: str = "light"


def _shares(roll: Column, shares: dict[str, int]) -> Column:
    """The name whose share of a hundred the roll falls into."""
    out, top = None, 0
    for name, share in shares.items():
        top += share
        out = F.when(roll < top, name) if out is None else out.when(roll < top, name)
    return out


def population(spark: SparkSession, n: int) -> DataFrame:
    """``doc_id, sender_rank, labels, mime, size, timestamp_ms``: a skewed population computed from ids alone."""
    h = F.pmod(F.col("id") * 7919 + 104_729, F.lit(1_000_003))
    roll = lambda shift: F.pmod(F.floor(h / F.lit(shift)).cast("long"), F.lit(100))
    sender = F.when(roll(1) < 22, 0).when(roll(1) < 34, 1).when(roll(1) < 43, 2).otherwise(3 + F.pmod(h, F.lit(997)))
    marks = F.array(
        F.when(roll(1) < 55, "INBOX").otherwise("ARCHIVE"), F.when(roll(1) < 18, "SENT"), F.when(roll(1) < 30, "WORK"), F.when(roll(1) < 8, "STARRED"), F.when(F.pmod(h, F.lit(13)) == 0, "IMPORTANT")
    )
    size = F.when(roll(7) < 80, 40_000).otherwise(900_000)
    age = F.when(roll(3) < 45, F.pmod(h, F.lit(730))).when(roll(3) < 75, 730 + F.pmod(h, F.lit(1095))).when(roll(3) < 90, 1825 + F.pmod(h, F.lit(1095))).otherwise(2920 + F.pmod(h, F.lit(1095)))
    end = 1_767_225_600_000  # 2026-01-01
    return spark.range(n).select(
        F.col("id").alias("doc_id"), sender.cast("long").alias("sender_rank"), F.filter(marks, lambda x: x.isNotNull()).alias("labels"), _shares(roll(11), MIMES).alias("mime"),
        size.cast("long").alias("size"), (F.lit(end) - age * 86_400_000).cast("long").alias("timestamp_ms"),
    )


def message(corpus: Corpus, doc_id: int) -> dict:
    """One message; equal corpus and id give equal bytes."""
    import hashlib

    rng = Xorshift(corpus.seed * 0x9E3779B1 + doc_id + 1)
    rate, duplicates, largest = PROFILES[corpus.profile]
    address = lambda: f"{rng.choice(_NAMES)}@{rng.choice(('north', 'south'))}.example"
    language, term = rng.choice(sorted(_BODIES)), rng.choice(_TERMS)
    sender, recipients = address(), sorted({address() for _ in range(rng.randint(1, 3))})
    body = f"{_BODIES[language]} {(term + ' ') * body_repeats(corpus.profile, rng)}".strip()
    html = f"<html><body><p>{body[:200]}</p></body></html>" if rng.random() < 0.65 else None
    attachments, payloads = [], []
    if rng.randrange(100) < rate:
        shared = rng.randrange(100) < duplicates
        source = Xorshift(corpus.seed + rng.randrange(64) * 0x85EBCA6B) if shared else rng
        mime = source.choice(sorted(MIMES))
        payload = source.randbytes(attachment_size(corpus.profile, source, largest)).replace(b"\r\n--", b"\r\n-.")
        payloads.append(payload)
        attachments.append({"filename": f"{term}-{doc_id}.dat", "mime": mime, "bytes": len(payload), "content_hash": hashlib.sha256(payload).hexdigest()})
    row = {
        "doc_id": doc_id, "message_id": f"<{doc_id:012x}.{language}@synthetic.example>", "timestamp": 1_577_836_800 + doc_id * 28_800 + rng.randrange(28_800), "sender": sender, "recipients": recipients,
        "subject": f"{term} {language} {doc_id % 1000:03d}", "body": body, "html": html, "account": f"account-{rng.randrange(4)}", "folder": rng.choice(("Inbox", "Sent", "Archive")), "thread": f"thread-{doc_id // 4:06d}",
        "attachments": attachments,
    }
    head = {"Message-ID": row["message_id"], "Date-Unix": row["timestamp"], "From": sender, "To": ", ".join(recipients), "Subject": row["subject"], "X-Account": row["account"], "X-Folder": row["folder"]}
    raw = "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + body.encode()
    for a, payload in zip(attachments, payloads, strict=True):
        raw += f"\r\n--attachment; filename={a['filename']}; hash={a['content_hash']}\r\n".encode() + payload
    return row | {"raw": raw}


def messages(spark: SparkSession, corpus: Corpus) -> DataFrame:
    """The corpus (MESSAGE), generated where its ids are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["id"].tolist()
            for low in range(0, len(ids), 256):
                yield pd.DataFrame([message(corpus, i) for i in ids[low : low + 256]])

    return spark.range(corpus.messages).mapInPandas(run, MESSAGE)
