"""Personal data by a skip-chain conditional random field.

Nodes of a document: the spans that the base patterns find, whose labels are given, and mentions that no pattern covers
(other runs of digits, spelled-out addresses, the local part of a found address). Neighbours in the text form a chain;
equal or similar mentions, however distant, are joined by skip edges that share one potential for equal labels. Loopy
message passing carries the labels along both, so a mention is labelled like the consistent mentions of its document.

Weights are fitted by pseudo-likelihood on a bounded sample of documents: its base spans, its other mentions, and
rewritten copies of its base spans (without ``+``, with other separators, with ``(at)``), once linked to the span they
come from and labelled like it, once alone and labelled as nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import by_batch, small_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Documents of the training sample, at most a quarter of them without a likely base span, and characters of each that are
#: learned from; passes of message passing and its damping; least belief.
SAMPLE, CHARS, ROUNDS, DAMPING, BELIEF = 4000, 20_000, 20, 0.3, 0.9

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NUMBERS = re.compile(r"[0-9][0-9 .\-]*+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_OTHER = re.compile(r"[0-9][0-9 ().\-/]*+")
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{2,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,63}){1,6}")
_DIGIT = re.compile(r"[0-9]")
_RUN = re.compile(r"[A-Za-z0-9._%+@-]{5,}")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _part(digits: str) -> bool:
    left = digits.lstrip("0")
    return len(left) <= 3 and int(left or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """The spans of the four base patterns: leftmost, non-overlapping within a kind; failing matches are dropped."""
    found: list[Span] = []
    if "@" in text:
        end = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                end = m.end()
                found.append(("email", start, end))
    ips, cards = [], []
    for region in _NUMBERS.finditer(text):
        a, b = region.span()
        if b - a >= 7:
            ips += [("ip", *m.span()) for m in _IP.finditer(text, a, b) if all(map(_part, m[0].split(".")))]
            if b - a >= 16:
                for m in _CARD.finditer(text, a, b):
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        cards.append(("card", *m.span()))
    found += ips + cards
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]
    return found


def _locals(text: str, wanted: set[str]) -> list[tuple[int, int]]:
    """Where one of these local parts starts a run of address characters and ends with it or before a dot: one pass."""
    wanted = {x for x in wanted if len(x) >= 5}
    if not wanted:
        return []
    sizes, found = {len(x) for x in wanted}, []
    for m in _RUN.finditer(text):
        run, at = m[0], m.start()
        end = run.find(".")
        while end >= 0:
            if end in sizes and run[:end] in wanted:
                found.append((at, at + end))
            end = run.find(".", end + 1)
        if len(run) in sizes and run in wanted:
            found.append((at, at + len(run)))
    return found


def other_mentions(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Mentions that base spans don't cover, disjoint and in order."""
    found = []
    for m in _OTHER.finditer(text):
        if m.end() - m.start() >= 7:
            mention = m[0].rstrip(" ().-/")
            if len(_DIGIT.findall(mention)) >= 7:
                found.append((m.start(), m.start() + len(mention)))
    if "at)" in text or "at]" in text:
        found += [m.span() for m in _SPELLED.finditer(text)]
    found += _locals(text, {text[a:b].split("@")[0] for kind, a, b in base if kind == "email"})
    out, taken = [], sorted((a, b) for _, a, b in base)
    starts = np.array([a for a, _ in taken], np.int64)
    ends = np.maximum.accumulate(np.array([b for _, b in taken], np.int64)) if taken else starts
    last = 0
    for a, b in sorted(found, key=lambda x: (x[0], -x[1])):
        i = int(np.searchsorted(starts, b))  # base spans that start before b
        if a >= last and (i == 0 or ends[i - 1] <= a):
            out.append((a, b))
            last = b
    return out


def _features(mention: str) -> np.ndarray:
    digits = "".join(_DIGIT.findall(mention))
    n = len(digits)
    flags = (
        True, "@" in mention, "at)" in mention or "at]" in mention, mention.startswith("+"), n < 7, n == 7, 8 <= n <= 15, 16 <= n <= 19, n > 19,
        mention.count(".") == 3 and n >= 4, "(" in mention, n >= 16 and luhn(digits), any(map(str.isalpha, mention)), "/" in mention,
    )
    return np.array(flags, np.float64)


def _keys(mention: str) -> set[tuple[str, str]]:
    """Mentions that share a key are similar."""
    digits = "".join(_DIGIT.findall(mention))
    found = {("text", mention.strip(" .,;:()[]").casefold())}
    letters = any(map(str.isalpha, mention))
    if not letters and len(digits) >= 8:
        found |= {("digits", digits), ("last", digits[-9:])}
    if letters:
        local = re.split(r"@| ?\(at\)| ?\[at\]", mention)[0]
        if len(local) >= 5:
            found.add(("local", local.casefold()))
    return found


@dataclass
class Field:
    """Weights: of features by label, of equal labels over a skip edge, of equal labels next to each other."""

    unary: np.ndarray
    skip: float
    chain: float

    def labels(self, mentions: list[str], given: list[int | None]) -> list[tuple[int, float]]:
        """The most believed label of each mention, by loopy belief propagation, and its belief."""
        n = len(mentions)
        unary = np.array([_features(m) for m in mentions]) @ self.unary
        for i, label in enumerate(given):
            if label is not None:
                unary[i] = -30.0
                unary[i, label] = 0.0
        last: dict[tuple[str, str], int] = {}
        first: dict[tuple[str, str], int] = {}
        edges = {(i, i + 1): self.chain for i in range(n - 1)}
        for i, mention in enumerate(mentions):
            for key in _keys(mention):
                for j in {last.get(key, i), first.get(key, i)} - {i}:  # a tree over the equal ones, whatever their number
                    edges[j, i] = self.skip
                last[key] = i
                first.setdefault(key, i)
        if not edges:
            return [self._best(u) for u in unary]
        a = np.array([e for e in edges], np.int64)
        source, target = np.r_[a[:, 0], a[:, 1]], np.r_[a[:, 1], a[:, 0]]
        gain = np.expm1(np.tile(np.fromiter(edges.values(), float), 2))[:, None]
        back = np.r_[np.arange(len(a)) + len(a), np.arange(len(a))]
        sent = np.zeros((len(source), len(LABELS)))
        belief = unary
        for _ in range(ROUNDS):
            left = belief[source] - sent[back]
            p = np.exp(left - left.max(axis=1, keepdims=True))
            new = np.log(np.maximum(gain * p + p.sum(axis=1, keepdims=True), 1e-300))
            new -= new.max(axis=1, keepdims=True)
            step = np.abs(new - sent).max()
            sent = DAMPING * sent + (1 - DAMPING) * new
            belief = unary.copy()
            np.add.at(belief, target, sent)
            if step < 1e-4:
                break
        return [self._best(b) for b in belief]

    @staticmethod
    def _best(scores: np.ndarray) -> tuple[int, float]:
        p = np.exp(scores - scores.max())
        return int(scores.argmax()), float(p.max() / p.sum())


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and these with the mentions that the field labels."""
    base = base_spans(text)
    others = other_mentions(text, base)
    added: list[Span] = []
    if others:
        nodes = sorted([(a, b, LABELS.index(kind)) for kind, a, b in base] + [(a, b, None) for a, b in others], key=lambda x: x[:2])
        found = field.labels([text[a:b] for a, b, _ in nodes], [label for *_, label in nodes])
        added = [(LABELS[label], a, b) for (a, b, given), (label, belief) in zip(nodes, found, strict=True) if given is None and label and belief >= BELIEF]
    order = lambda s: (KINDS.index(s[0]), s[1])
    return sorted(base, key=order), sorted(base + added, key=order)


def _rewritten(kind: str, mention: str) -> list[str]:
    digits = "".join(_DIGIT.findall(mention))
    if kind == "email":
        local, domain = mention.split("@")
        return [f"{local} (at) {domain}", f"{local}[at]{domain}"] + [local] * (len(local) >= 5)
    if kind == "phone":
        return [digits, f"({digits[:-7]}) {digits[-7:]}", f"{digits[:-4]}-{digits[-4:]}"]
    if kind == "card":
        return [".".join(digits[i : i + 4] for i in range(0, len(digits), 4)), "/".join(digits[i : i + 4] for i in range(0, len(digits), 4))]
    return [mention.replace(".", " . "), mention.replace(".", "-")]


def fit(texts: list[str]) -> Field:
    """Weights from whole texts, by gradient ascent on the penalised pseudo-likelihood."""
    x, y, skips, chains = [], [], [], []
    for text in texts:
        base = base_spans(text)
        nodes = sorted([(a, b, LABELS.index(kind)) for kind, a, b in base] + [(a, b, 0) for a, b in other_mentions(text, base)])
        for i, (a, b, label) in enumerate(nodes):
            mention, near = text[a:b], np.zeros(len(LABELS))
            for j in (i - 1, i + 1):
                if 0 <= j < len(nodes):
                    near[nodes[j][2]] += 1
            for rewritten in [mention] + (_rewritten(LABELS[label], mention) if label else []):
                linked = np.zeros(len(LABELS))
                linked[label] += label > 0
                x += [_features(rewritten)] * 2
                y += [label, 0 if label else label]
                skips += [linked, np.zeros(len(LABELS))]
                chains += [near, near]
    unary, skip, chain = np.zeros((14, len(LABELS))), 0.0, 0.0
    unary[0, 0] = 4.0
    if x:
        f, s, c = np.array(x), np.array(skips), np.array(chains)
        truth = np.eye(len(LABELS))[y]
        for step in range(400):
            scores = f @ unary + skip * s + chain * c
            p = np.exp(scores - scores.max(axis=1, keepdims=True))
            error = truth - p / p.sum(axis=1, keepdims=True)
            rate = 4.0 / (1 + step / 100)
            unary += rate * (f.T @ error / len(f) - 1e-4 * unary)
            skip += rate * ((error * s).sum() / len(f) - 1e-4 * skip)
            chain += rate * ((error * c).sum() / len(f) - 1e-3 * chain)
    return Field(unary, max(0.0, skip), max(0.0, min(chain, 0.5)))


#: Any text with a base span has an @ or matches this.
LIKELY = "[0-9][0-9 ().-]{6}"


def _piece(text: Column, place: Column) -> Column:
    """A text of at most CHARS characters as it is, of a longer one a piece: among those that may hold a base span, if any,
    the one that ``place`` draws. Pieces begin and end at white space, where there is some."""
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s)\S{{{CHARS}}}|.{{1,{CHARS}}}(?!\S)|.{{1,{CHARS}}}"), F.lit(0))
    hopeful = F.filter(pieces, lambda x: F.contains(x, F.lit("@")) | x.rlike(LIKELY))
    drawn = lambda of: F.get(of, F.pmod(F.xxhash64(place), F.size(of)).cast("int"))
    return F.when(F.length(text) <= CHARS, text).when(F.size(hopeful) > 0, drawn(hopeful)).otherwise(drawn(pieces))


def train(docs: DataFrame) -> Field:
    """A field fitted to at most ``SAMPLE`` documents, of any length: those with the smallest hashes of doc_id among the ones
    that may hold a base span, and a quarter of them of the others. Of a document longer than ``CHARS`` a piece is learned
    from, one that may hold a base span, if the document does. An empty table gives a field that adds nothing."""
    spread, most = 1 << 40, {True: SAMPLE - SAMPLE // 4, False: SAMPLE // 4}
    likely = (F.contains("text", F.lit("@")) | F.col("text").rlike(LIKELY)).alias("likely")
    rows = docs.select(F.col("text").cast("string").alias("text"), F.pmod(F.xxhash64("doc_id"), F.lit(spread)).alias("place")).filter("text is not null")
    counts = {r["likely"]: r["n"] for r in rows.groupBy(likely).agg(F.count("*").alias("n")).collect()}
    bound = {kind: min(spread, 2 * most[kind] * spread // n + 1) for kind, n in counts.items()} | {kind: 0 for kind in most if kind not in counts}
    some = rows.filter(F.col("place") < max(bound.values())).select("text", "place", likely)
    some = some.filter(F.col("place") < F.when(F.col("likely"), bound[True]).otherwise(bound[False]))
    some = some.select(_piece(F.col("text"), F.col("place")).alias("text"), "place", "likely").distinct()
    some = some.withColumn("k", F.row_number().over(W.partitionBy("likely").orderBy("place", "text")))
    kept = some.filter(F.col("k") <= F.when(F.col("likely"), most[True]).otherwise(most[False]))
    return fit([r["text"] for r in kept.orderBy("likely", "k").select("text").collect()])


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


_FOUND = "struct<n_email: long, n_ip: long, n_card: long, n_phone: long, base: string, spans: string>"


def _searched(shared, keep_text: bool, into: str):
    def make():
        field: Field = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = []
            for text in batch.column(1).to_pylist():
                base, spans = all_spans(text or "", field)
                found.append((*(sum(s[0] == kind for s in base) for kind in KINDS), _joined(base), _joined(spans)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            names = [*(f"n_{kind}" for kind in KINDS), "base", "spans"]
            pii = pa.StructArray.from_arrays([pa.array([x[i] for x in found], kinds[i]) for i in range(6)], names)
            kept = [(batch.column(1), "text")] * keep_text
            return pa.RecordBatch.from_arrays([batch.column(0), *(c for c, _ in kept), pii], ["row", *(n for _, n in kept), into])

        return step

    return by_batch(make)


def personal_data(docs: DataFrame, field: Field, columns: list[str] | None = None, into: str = "pii") -> DataFrame:
    """Every row of ``docs`` with ``columns`` (all, unless given) and a struct ``into``.

    Its fields: counts of base spans by kind, ``base`` and ``spans`` (base spans, and all spans): ``kind:start:end`` in
    the order of KINDS, then of start, joined by commas; code points, end exclusive. A null text counts as empty and has
    none; an empty table gives no rows; long texts are searched whole, in time linear in their length. Repeated rows get
    equal results. Other columns pass through, whatever their names; one called
    ``into`` is replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    columns = [c for c in (docs.columns if columns is None else columns) if c != into]
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in columns if c != "text"]).alias("row")
    rows = docs.select(row, F.col("text").cast("string").alias("text"))
    keep = "text" in columns
    out = T.StructType([*rows.schema.fields[: 1 + keep], *T.StructType.fromDDL(f"`{into}` {_FOUND}").fields])
    found = rows.mapInArrow(_searched(spark.sparkContext.broadcast(field), keep, into), out)
    return found.select(*[F.col(f"row.`{c}`") if c != "text" else F.col("text") for c in columns], F.col(f"`{into}`"))
