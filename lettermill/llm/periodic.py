"""Runs of periodic words by harmonic grid probing.

A run of period p that is four periods long covers four points of the grid 0, p, 2p, ..., so words at jp and (j + 1)p are equal
three times in a row. All grids of a text have together n log n points. Where the probes hold, word-by-word equality with the
words p further is followed to both sides, by comparing arrays in chunks of growing size. Probes between two points of a run
that is known, of a period that divides p, can only find that run again and are skipped.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import as_bytes, by_batch, small_batches

#: A run has so many words and so many periods at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words compared at first, and at most, when a run is extended.
CHUNK, LONGEST_CHUNK = 32, 1 << 16
#: Grid points probed at once.
PROBES = 1 << 20

#: A word, in a column's pattern.
WORD = r"[^\x20\x09-\x0D]+"

Run = tuple[int, int, int]


def _equal_after(a: np.ndarray, b: np.ndarray) -> int:
    """How many words from the start on are equal, of two arrays of one length."""
    n, at, size = len(a), 0, CHUNK
    while at < n:
        differ = a[at : at + size] != b[at : at + size]
        if differ.any():
            return at + int(differ.argmax())
        at += size
        size = min(2 * size, LONGEST_CHUNK)
    return n


@dataclass
class _Known:
    """Runs found so far, as start, end, period."""

    runs: list[Run] = field(default_factory=list)
    table: np.ndarray = field(default_factory=lambda: np.empty((0, 3), np.int64))

    def add(self, run: Run) -> None:
        self.runs.append(run)

    def outside(self, at: np.ndarray, period: int) -> np.ndarray:
        """The grid points that don't lie, with the next one, in a known run whose period divides this one."""
        if len(self.table) < len(self.runs):
            self.table = np.array(self.runs, np.int64)
        start, end, q = self.table.T
        of = self.table[(end - start > period) & (period % q == 0)]
        if not len(of):
            return at
        of = of[np.argsort(of[:, 0], kind="stable")]
        reach = np.maximum.accumulate(of[:, 1])
        place = np.searchsorted(of[:, 0], at, "right") - 1
        return at[(place < 0) | (reach[place] <= at + period)]


def _probed(words: np.ndarray):
    """Periods, with the grid points whose word is found again at the next three points."""
    n, last = len(words), len(words) // LEAST_PERIODS
    low = 1
    while low <= last and low * low <= n:  # many points in a grid: a grid at a time
        grid = words[::low]
        same = grid[1:] == grid[:-1]
        at = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
        if len(at):
            yield low, at * low
        low += 1
    while low <= last:  # few: the j-th points of many grids at a time
        high = min(last + 1, 2 * low, low + max(1, PROBES * low // n))
        found, same = [], []
        for j in range(-(-n // low)):
            top = min(high, -(-n // (j + 1)))  # grids that have a point j + 1
            if top <= low:
                break
            same = [*same[-2:], words[j * low : j * (top - 1) + 1 : j] == words[(j + 1) * low : (j + 1) * (top - 1) + 1 : j + 1] if j else words[low:top] == words[0]]
            if len(same) == 3:
                hit = np.flatnonzero(same[0][: top - low] & same[1][: top - low] & same[2]) + low
                found.append(np.stack([hit, np.full(len(hit), j - 2)], 1))
        hits = np.concatenate(found) if found else np.empty((0, 2), np.int64)
        if len(hits):
            hits = hits[np.lexsort((hits[:, 1], hits[:, 0]))]
            periods, first = np.unique(hits[:, 0], return_index=True)
            for period, points in zip(periods.tolist(), np.split(hits[:, 1], first[1:]), strict=True):
                yield period, points * period
        low = high


def runs(words: np.ndarray) -> list[Run]:
    """Start, length and period of every run of these numbered words, by start, then period.

    A run is a longest stretch with its smallest period, of LEAST_WORDS words and LEAST_PERIODS periods at least.
    """
    known = _Known()
    for period, points in _probed(words):
        if known.runs:
            points = known.outside(points, period)
        passed = 0
        for at in points.tolist():
            if at < passed:  # in the stretch that was followed last
                continue
            ahead = _equal_after(words[at:-period], words[at + period :])
            behind = _equal_after(words[:at][::-1], words[period : at + period][::-1])
            start, passed = at - behind, at + ahead
            if passed - start + period >= max(LEAST_WORDS, LEAST_PERIODS * period):
                known.add((start, passed + period, period))
    return sorted(((start, end - start, period) for start, end, period in known.runs), key=lambda r: (r[0], r[2]))


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def searched(text: bytes) -> tuple[list[Run], bytes]:
    """The text's runs, and its words without repetitions: what a run holds after its first period goes."""
    words = text.split()
    number = _Numbers()
    found = runs(np.fromiter(map(number.__getitem__, words), np.int32, len(words))) if len(words) >= LEAST_WORDS else []
    if found:
        dropped = np.zeros(len(words) + 1, np.int64)
        for start, length, period in found:
            dropped[start + period] += 1
            dropped[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(dropped[:-1]) == 0).tolist()]
    return found, b" ".join(words)


def strongest(found: list[Run]) -> Run | None:
    """The run with most periods; of equal ones that with the smallest start, then period."""
    best: Run | None = None
    for run in found:  # by start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _searching(keep_text: bool, into: str):
    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [searched(text or b"") for text in as_bytes(batch.column(1))]
            best = [strongest(r) or (None, None, None) for r, _ in found]
            columns = {
                "runs": pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs, _ in found], pa.list_(_RUN)),
                **{name: pa.array([x[i] for x in best], pa.int64()) for i, name in enumerate(("start", "length", "period"))},
                "collapsed": pa.array([x for _, x in found], pa.binary()).cast(pa.string()),
            }
            made = pa.StructArray.from_arrays([*columns.values()], [*columns])
            kept = [(batch.column(1), "text")] * keep_text
            return pa.RecordBatch.from_arrays([batch.column(0), *(c for c, _ in kept), made], ["row", *(x for _, x in kept), into])

        return step

    return by_batch(make)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND = "struct<runs: array<struct<start: long, length: long, period: long>>, start: long, length: long, period: long, collapsed: string>"


def periodic_runs(docs: DataFrame, columns: list[str] | None = None, into: str = "periodic") -> DataFrame:
    """Every row of ``docs(text)`` with ``columns`` (all, unless given) and a struct ``into``.

    Its fields: ``runs`` (start, length and period of each, in words, by start, then period), ``start``, ``length`` and
    ``period`` of the run with most periods (ties: smallest start, then period; null without a run), and ``collapsed``, the
    words that stay when of each run only the first period does, joined by spaces. A null or empty text has no words and no
    runs. Repeated rows get equal results; an empty table gives no rows; long texts are searched whole. Other columns pass
    through, whatever their names; one called ``into`` is replaced.
    """
    small_batches(docs.sparkSession)
    columns = [c for c in (docs.columns if columns is None else columns) if c != into]
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in columns if c != "text"]).alias("row")
    rows = docs.select(row, F.col("text").cast("string").alias("text"))
    keep = "text" in columns
    out = T.StructType([*rows.schema.fields[: 1 + keep], *T.StructType.fromDDL(f"`{into}` {_FOUND}").fields])
    found = rows.mapInArrow(_searching(keep, into), out)
    return found.select(*[F.col(f"row.`{c}`") if c != "text" else F.col("text") for c in columns], F.col(f"`{into}`"))


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, where every tenth document by a checksum of its id repeats some of its words to its end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), words.alias("words"), F.floor(h / 10).alias("g"))
    rows = rows.withColumn("n", F.nullif(F.when(F.col("words").isNotNull(), F.size("words").cast("long")), F.lit(0)))
    rows = rows.withColumn("a", F.col("g") % F.col("n"))
    rows = rows.withColumn("p", 1 + F.expr("(n - a) div (3 + g % 8)"))
    source = lambda i: F.when(i >= F.col("a"), F.col("a") + (i - F.col("a")) % F.col("p")).otherwise(i)
    changed = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("words", source(i).cast("int")))
    return rows.select("doc_id", F.when(F.col("n").isNotNull(), F.array_join(changed, " ")).otherwise(F.col("text")).alias("text"))


def runs_text(found: Column) -> Column:
    """``start,length,period`` and a line feed for each run."""
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    return F.array_join(F.transform(found, lambda r: F.concat(line(r), F.lit("\n"))), "")


#: For a text, words that are found again p further on, in islands of consecutive places.
SQL = r"""
with doc as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    xor(list_reduce([4294967295::bigint] || flatten(list_transform(string_split(doc_id::varchar, ''), lambda ch: [ord(ch)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda c, s: case when s >= 0 then xor(c, s) when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end), 4294967295) as h
  from documents
),
word as (
  select doc_id, n, i, w[1 + case when h % 10 = 0 and i >= a then a + (i - a) % (1 + (n - a) // (3 + g % 8)) else i end] as word
  from (select *, case when n > 0 then g % n end as a, unnest(range(n)) as i from (select *, h // 10 as g, len(w)::bigint as n from doc))
),
pair as (select a.doc_id, a.i, b.i - a.i as p from word a join word b on a.doc_id = b.doc_id and a.word = b.word and b.i > a.i and 4 * (b.i - a.i) <= a.n),
island as (select doc_id, p, min(i) as start, count(*) + p as length from (select *, i - row_number() over (partition by doc_id, p order by i) as island from pair) group by doc_id, p, island),
run as (select doc_id, start, length, min(p) as period from island where length >= greatest(6, 4 * p) group by doc_id, start, length),
best as (
  select doc_id, count(*) as n_runs, arg_min(struct_pack(start, length, period), struct_pack(a := -1000000000 * length // period, b := start, c := period)) as best,
    string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as runs
  from run group by doc_id
),
gone as (select distinct doc_id, unnest(range(start + period, start + length)) as i from run),
kept as (select doc_id, string_agg(word, ' ' order by i) as words from word anti join gone using (doc_id, i) group by doc_id)
select d.doc_id, coalesce(n_runs, 0)::bigint as n_runs, best.start::bigint as start, best.length::bigint as length, best.period::bigint as period,
  (1000 * best.length // best.period)::bigint as exponent_milli, sha256(coalesce(runs, '')) as runs_sha256, sha256(coalesce(words, '')) as collapsed_sha256
from doc d left join best using (doc_id) left join kept using (doc_id)
"""
