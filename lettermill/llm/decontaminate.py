"""Benchmark decontamination by a prefix-filtered set join on word shingles.

Every window of an item (``WINDOW`` consecutive words, or a shorter item as a whole) is a set of positioned shingles of
``SHINGLE`` words. A document holds the window only if it holds every one of its shingles, so for a containment of one
the necessary prefix of a window is a single shingle: the rarest, by counts over all documents.

1. Windows, their owners and their shingles become tables.
2. A scan of the documents counts those of their shingles that the benchmark may have (a Bloom filter of bounded size says
   so); joined with the shingles, the counts order each window's by rarity, and the rarest becomes its prefix.
3. A second scan emits where a document may hold a prefix shingle, with the words around it. These rows are joined with the
   windows on the shingle. The window must lie inside the document (positional and length bounds), and its words must be
   those around the shingle: the check needs nothing but the joined row.
4. What was hit goes back to the documents by a key of their text. A scan that counts words gives the other columns.

However large the benchmark, documents are scanned three times, and only what may be hit is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import as_bytes, broadcast_if_small, by_batch, measured, small_batches, written

WINDOW = 13
SHINGLE = 3
#: Share of a document's words that makes it contaminated: one in twenty.
SHARE = 20
#: The filter: bits for each shingle of the benchmark, and least and most bits in all (32 MB); more shingles let more words pass, and
#: the join drops them. Shifts of a shingle's hash that give its bits.
BITS, LEAST_BITS, MOST_BITS, SHIFTS = 32, 1 << 15, 1 << 28, (0, 12, 24, 36)
#: Words that a task remembers the hashes of, and words of texts that are looked at together (or one long text's).
REMEMBERED, GROUP = 1 << 17, 1 << 16

_KEPT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BITMAP = 1 << 15  # bits of one of Spark's bitmaps
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes | None) -> list[bytes]:
    """Words of digits, letters a-z and characters beyond ASCII; A-Z in lower case. In UTF-8 those are just bytes."""
    return text.translate(_KEPT).split() if text else []


class Hashes(dict):
    """Hashes of words, and of shingles as made of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, document: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, document), np.uint64, len(document))


def shingles(x: np.ndarray, width: int) -> np.ndarray:
    """A signed hash of each ``width`` consecutive words, from the words' hashes."""
    n = len(x) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    out = np.full(n, width, np.uint64)
    for j in range(width):
        out ^= out >> np.uint64(29)
        out *= _MIX
        out += x[j : j + n]
    out ^= out >> np.uint64(32)
    out *= _MIX
    return (out ^ (out >> np.uint64(29))).view(np.int64)


def width(size: int) -> int:
    """Words in the shingles of a window of so many."""
    return min(SHINGLE, size)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open ranges, as disjoint ranges in order."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _windows():
    """Each item's windows, as words joined by a space, and the hashes of their shingles."""
    hashes = Hashes()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for item, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
            w = words(text)
            codes = shingles(hashes.of(w), width(len(w))) if w else ()
            for i in range(max(1, len(w) - WINDOW + 1) if w else 0):
                window = w[i : i + WINDOW]
                rows.append((item, b" ".join(window), len(window), codes[i : i + len(window) - width(len(window)) + 1]))
        kinds = [pa.string(), pa.binary(), pa.int32(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["item", "window", "size", "shingles"])

    return step


class _Filter:
    """The shingles that may be wanted, by bits of their hashes."""

    def __init__(self, bitmaps: list[tuple[int, bytes]], bits: int, widths: list[int]):
        self.bits, self.widths = bits, widths
        self.map = np.zeros(bits // 8, np.uint8)
        for number, bitmap in bitmaps:
            part = self.map[number * _BITMAP // 8 :][: len(bitmap)]
            part[:] = np.frombuffer(bitmap, np.uint8, len(part))

    def passing(self, codes: np.ndarray) -> np.ndarray:
        """Positions of the hashes that pass."""
        at = None
        for shift in SHIFTS:
            bit = (codes.view(np.uint64) if at is None else codes[at].view(np.uint64)) >> np.uint64(shift)
            bit &= np.uint64(self.bits - 1)
            hit = np.flatnonzero((self.map[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1)
            at = hit if at is None else at[hit]
        return at


class _Words:
    """The words of some texts in one list, with each text's number and the place where its words end."""

    def __init__(self):
        self.words: list[bytes] = []
        self.numbers: list[int] = []
        self.ends: list[int] = []

    def add(self, number: int, found: list[bytes]) -> None:
        self.words += found
        self.numbers.append(number)
        self.ends.append(len(self.words))

    def passing(self, hashes: Hashes, wanted: _Filter) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each width where shingles pass, and their hashes; none goes from one text into the next."""
        x, ends = hashes.of(self.words), np.array(self.ends)
        for k in wanted.widths:
            codes = shingles(x, k)
            at = wanted.passing(codes)
            at = at[at + k <= ends[np.searchsorted(ends, at, "right")]]
            yield k, at, codes[at]


def _grouped(texts: pa.Array) -> Iterator[_Words]:
    """The texts of a batch, some at a time."""
    held = _Words()
    for i, text in enumerate(as_bytes(texts)):
        found = words(text)
        if found:
            held.add(i, found)
        if len(held.words) >= GROUP:
            yield held
            held = _Words()
    if held.words:
        yield held


def _filter_of(codes: DataFrame, n: int, widths: list[int]) -> _Filter:
    """A filter of ``codes(code)``, of which there are n. Its bitmaps are made by tasks; at most MOST_BITS come to the driver."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS * n - 1).bit_length()))
    at = F.explode(F.array(*[F.shiftrightunsigned("code", s).bitwiseAND(F.lit(bits - 1)) for s in SHIFTS])).alias("at")
    maps = codes.select(at).groupBy(F.expr(f"int(at div {_BITMAP})").alias("number")).agg(F.bitmap_construct_agg(F.expr(f"at % {_BITMAP}")).alias("bitmap"))
    return _Filter([(r["number"], bytes(r["bitmap"])) for r in maps.toLocalIterator()], bits, widths)


def _counted(shared):
    """How often the shingles that pass the filter occur, batch by batch."""

    def make():
        wanted: _Filter = shared.value
        hashes = Hashes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [np.empty(0, np.int64)]
            for group in _grouped(batch.column(0)):
                found += [codes for _, _, codes in group.passing(hashes, wanted)]
            code, n = np.unique(np.concatenate(found), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])

        return step

    return by_batch(make)


def _placed(shared):
    """Places of shingles that pass the filter, with the words around them as far as a window reaches."""

    def make():
        wanted: _Filter = shared.value
        hashes = Hashes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, codes = [], [np.empty(0, np.int64)]
            for group in _grouped(batch.column(2)):
                w, starts = group.words, [0, *group.ends]
                for k, at, held in group.passing(hashes, wanted):
                    codes.append(held)
                    for p, text in zip(at.tolist(), np.searchsorted(group.ends, at, "right").tolist(), strict=True):
                        lo, hi = starts[text], starts[text + 1]
                        rows.append((group.numbers[text], p - lo, min(p - lo, WINDOW - k), b" ".join(w[max(lo, p - WINDOW + k) : min(hi, p + WINDOW)])))
            row = pa.array([r[0] for r in rows], pa.int64())
            columns = [batch.column(0).take(row), batch.column(1).take(row), pa.array(np.concatenate(codes))]
            columns += [pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["a", "b", "code", "at", "back", "around"])

        return step

    return by_batch(make)


_SPANS, _ITEMS = "array<struct<lo: long, hi: long>>", "array<string>"
_SPAN = pa.struct([("lo", pa.int64()), ("hi", pa.int64())])


def _summed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A hit text's ranges joined and its items in order, with their numbers and digest."""
    spans = [merged([(x["lo"], x["hi"]) for x in found]) for found in batch.column(2).to_pylist()]
    items = [sorted(found) for found in batch.column(3).to_pylist()]
    columns = {
        "a": batch.column(0), "b": batch.column(1), "n_hit": pa.array([sum(hi - lo for lo, hi in found) for found in spans], pa.int64()), "n_items": pa.array(map(len, items), pa.int64()),
        "items_sha256": pa.array([hashlib.sha256(",".join(found).encode()).hexdigest() for found in items], pa.string()),
        "spans": pa.array([[{"lo": lo, "hi": hi} for lo, hi in found] for found in spans], pa.list_(_SPAN)), "items": pa.array(items, pa.list_(pa.string())),
    }
    return pa.RecordBatch.from_arrays([*columns.values()], [*columns])


def _sized(keep_text: bool):
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes = pa.array([len(words(text)) for text in as_bytes(batch.column(3))], pa.int64())
        kept = [(batch.column(3), "text")] * keep_text
        return pa.RecordBatch.from_arrays([*batch.columns[:3], sizes, *(c for c, _ in kept)], ["row", "a", "b", "n_words", *(n for _, n in kept)])

    return step


def _hits(texts: DataFrame, benchmark: DataFrame) -> DataFrame | None:
    """``a, b, n_hit, n_items, items_sha256, spans, items`` of the texts of ``texts(a, b, text)`` that hold a window."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).filter("item is not null and text is not null")
    held = written(items.mapInArrow(by_batch(_windows), "item string, window binary, size int, shingles array<long>"), "owned")
    owners = written(held.select("window", "item").distinct(), "owners")
    windows = written(held.dropDuplicates(["window"]).select("window", "size", "shingles"), "windows")
    shingles, sums = measured(windows.select(F.explode("shingles").alias("code")).distinct(), "shingles", n=F.count("*"))
    if not sums["n"]:
        return None
    widths = sorted({width(r["size"]) for r in windows.select(F.least("size", F.lit(SHINGLE)).alias("size")).distinct().collect()})
    share = lambda wanted: texts.sparkSession.sparkContext.broadcast(wanted)
    counts = texts.select("text").mapInArrow(_counted(share(_filter_of(shingles, sums["n"], widths))), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    rarity = broadcast_if_small(written(shingles.join(counts, "code", "left").select("code", F.coalesce("n", F.lit(0)).alias("n")), "rarity"))
    each = windows.select("window", "size", F.posexplode("shingles").alias("offset", "code")).join(rarity, "code")
    prefix = each.groupBy("window").agg(F.first("size").alias("size"), F.min(F.struct("n", "code", "offset")).alias("least"))
    prefix, chosen = measured(prefix.select(F.col("least.code").alias("code"), F.col("least.offset").alias("offset"), "window", "size"), "prefix", n=F.count("*"))
    places = texts.mapInArrow(_placed(share(_filter_of(prefix.select("code"), chosen["n"], widths))), "a long, b long, code long, at long, back int, around binary")
    near = places.join(broadcast_if_small(prefix), "code").filter("offset <= back").withColumn("near", F.split(F.col("around").cast("string"), " "))
    start = F.col("back") - F.col("offset") + 1
    near = near.filter(F.size("near") >= start + F.col("size") - 1).filter(F.array_join(F.slice("near", start, F.col("size")), " ") == F.col("window").cast("string"))
    lo = F.col("at") - F.col("offset")
    hits = written(near.select("a", "b", lo.alias("lo"), (lo + F.col("size")).alias("hi"), "window").distinct(), "hits")
    owned = hits.select("a", "b", "window").distinct().join(broadcast_if_small(owners), "window").groupBy("a", "b").agg(F.collect_set("item").alias("items"))
    spans = hits.groupBy("a", "b").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    out = f"a long, b long, n_hit long, n_items long, items_sha256 string, spans {_SPANS}, items {_ITEMS}"
    return written(spans.join(owned, ["a", "b"]).mapInArrow(by_batch(lambda: _summed), out), "verdicts")


def contamination(docs: DataFrame, benchmark: DataFrame, columns: list[str] | None = None, into: str = "contamination") -> DataFrame:
    """Every row of ``docs`` with ``columns`` (all, unless given) and a struct ``into``.

    Its fields: ``n_words``, ``n_hit`` (words inside occurrences of windows), ``n_items``, ``items_sha256`` (of the item
    ids, sorted as strings and joined by commas), ``spans`` (word ranges that are hit), ``items``, ``contaminated``.
    A null or empty text has no words and isn't contaminated. Items with a null id, a null text or no words have no
    windows; rows of one item_id are one item. An empty benchmark hits nothing, an empty table of documents gives no rows.
    Repeated documents are judged alike, long ones whole. Other columns pass through, whatever their names and types; one
    called ``into`` is replaced.
    """
    small_batches(docs.sparkSession)
    columns = [c for c in (docs.columns if columns is None else columns) if c != into]
    text = F.col("text").cast("string").alias("text")
    # two hashes of the text are its key: whatever else a row holds, its text decides
    key = [F.xxhash64(text).alias("a"), F.xxhash64(F.lit("key"), text).alias("b")]
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in columns if c != "text"]).alias("row")
    rows, keep = docs.select(row, *key, text), "text" in columns
    hits = _hits(docs.select(*key, text), benchmark)
    out = T.StructType([*rows.schema.fields[:3], T.StructField("n_words", T.LongType()), *[rows.schema["text"]] * keep])
    sized = rows.mapInArrow(by_batch(lambda: _sized(keep)), out)
    none = {"n_hit": F.lit(0), "n_items": F.lit(0), "items_sha256": F.lit(hashlib.sha256(b"").hexdigest()), "spans": F.array(), "items": F.array()}
    kinds = {"n_hit": "long", "n_items": "long", "items_sha256": "string", "spans": _SPANS, "items": _ITEMS}
    if hits is None:
        sized = sized.select("*", *[value.cast(kinds[name]).alias(name) for name, value in none.items()])
    else:
        sized = sized.join(broadcast_if_small(hits), ["a", "b"], "left")
    found: dict[str, Column] = {name: F.coalesce(name, value.cast(kinds[name])) for name, value in none.items()}
    contaminated = (found["n_hit"] > 0) & (SHARE * found["n_hit"] >= F.col("n_words"))
    verdict = F.struct("n_words", *[value.alias(name) for name, value in found.items()], contaminated.alias("contaminated"))
    return sized.select(*[F.col(f"row.`{c}`") if c != "text" else F.col("text") for c in columns], verdict.alias(into))
