"""Fill-in-middle rewriting by a table-driven automaton over UTF-8 bytes.

One scan of a text's bytes takes the automaton through continuation bytes, unit boundaries (a unit is a run of ASCII letters
or any other character) and sentinels. A transition is a state with a byte class; the scan only counts transitions, and units,
characters and sentinels are sums of these counts. Two bytes fix the state, whatever came before them, so all positions of a
piece are stepped at once. A second pass goes back to the pieces that hold the two cuts and locates them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import as_bytes, by_batch, small_batches

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that are rewritten, and of these, percent with the suffix first.
REWRITTEN, SUFFIX_FIRST = 90, 20
#: Bytes scanned at once.
PIECE = 1 << 20

# byte classes
_CONTINUED, _LETTER, _MARK, _OPEN, _CLOSE, _OTHER = range(6)
# states: between units or after a character that is one, inside a word, after "<", after "<" and a mark's letter
_BETWEEN, _WORD, _OPENED, _MARKED = range(4)
_CLASSES, _STATES = 6, 4


def _tables() -> tuple[np.ndarray, ...]:
    """Class of each byte; next state, unit starts, characters by transition (state * classes + class)."""
    kind = np.full(256, _OTHER, np.uint8)
    kind[0x80:0xC0] = _CONTINUED
    kind[[*range(65, 91), *range(97, 123)]] = _LETTER
    kind[[ord(m[1]) for m in (PREFIX, SUFFIX, MIDDLE)]] = _MARK
    kind[ord("<")], kind[ord(">")] = _OPEN, _CLOSE
    after = np.zeros((_STATES, _CLASSES), np.uint8)
    after[:, _LETTER] = after[:, _MARK] = _WORD
    after[:, _OPEN] = _OPENED
    after[_OPENED, _MARK] = _MARKED
    unit, character = np.ones((_STATES, _CLASSES), np.int64), np.ones((_STATES, _CLASSES), np.int64)
    unit[:, _CONTINUED] = character[:, _CONTINUED] = 0
    for state in (_WORD, _MARKED):
        unit[state, [_LETTER, _MARK]] = 0
    return kind, after.ravel(), unit.ravel(), character.ravel()


_KIND, _AFTER, _UNIT, _CHARACTER = _tables()
_SENTINEL = _MARKED * _CLASSES + _CLOSE


def _stepped(text: bytes, low: int, entered: int) -> tuple[np.ndarray, int]:
    """The automaton's transitions over the piece from ``low`` on, entered in a state, and the state that it leaves in."""
    kind = _KIND[np.frombuffer(text, np.uint8, min(PIECE, len(text) - low), low)]
    state = np.empty(len(kind) + 1, np.uint8)
    state[0] = entered
    state[1] = _AFTER[entered * _CLASSES + kind[0]]
    state[2:] = _AFTER[_AFTER[kind[:-1]] * np.uint8(_CLASSES) + kind[1:]]  # from any state, two bytes on
    return state[:-1] * np.uint8(_CLASSES) + kind, int(state[-1])


def counted(text: bytes) -> list[tuple[int, np.ndarray]]:
    """For each piece of the text, the state it is entered in and how often each transition is taken."""
    found, state = [], _BETWEEN
    for low in range(0, len(text), PIECE):
        taken, after = _stepped(text, low, state)
        found.append((state, np.bincount(taken, minlength=_STATES * _CLASSES)))
        state = after
    return found


def located(text: bytes, counts: list[tuple[int, np.ndarray]], cuts: list[int]) -> list[tuple[int, int]]:
    """Bytes and characters before the cuts, which are numbers of units, in order: only their pieces are looked at again."""
    out, units, characters = [], 0, 0
    for low, (state, count) in zip(range(0, len(text), PIECE), counts, strict=True):
        here = int(count @ _UNIT)
        wanted = [c - units for c in cuts[len(out) :] if c < units + here]
        if wanted:
            taken, _ = _stepped(text, low, state)
            starts = np.flatnonzero(_UNIT[taken])[wanted]
            out += [(low + at, characters + int(_CHARACTER[taken[:at]].sum())) for at in starts.tolist()]
        units += here
        characters += int(count @ _CHARACTER)
    return out + [(len(text), characters)] * (len(cuts) - len(out))


def drawn(doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers that a document's id fixes: two cuts, whether it is rewritten, and in which order."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8))


def rewritten(text: bytes, draw: tuple[int, int, int, int]) -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, characters of prefix and middle (none, if plain), and the new text."""
    counts = counted(text)
    total = sum((count for _, count in counts), np.zeros(_STATES * _CLASSES, np.int64))
    n = int(total @ _UNIT)
    if not text or total[_SENTINEL] or draw[2] % 100 >= REWRITTEN:
        return n, "plain", None, None, text
    cuts = sorted(h % (n + 1) for h in draw[:2])
    (a, before), (b, until) = located(text, counts, cuts)
    prefix, middle, suffix = (PREFIX.encode() + text[:a], MIDDLE.encode() + text[a:b], SUFFIX.encode() + text[b:])
    spm = draw[3] % 100 < SUFFIX_FIRST
    return n, "spm" if spm else "psm", before, until - before, (suffix + prefix if spm else prefix + suffix) + middle


def _rewriting(keep_text: bool, into: str):
    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [rewritten(text or b"", drawn(doc_id)) for doc_id, text in zip(batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True)]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
            columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds)]
            columns.append(pa.array([x[4] for x in found], pa.binary()).cast(pa.string()))
            fim = pa.StructArray.from_arrays(columns, ["n", "form", "prefix_chars", "middle_chars", "output"])
            kept = [(batch.column(2), "text")] * keep_text
            return pa.RecordBatch.from_arrays([batch.column(0), *(c for c, _ in kept), fim], ["row", *(x for _, x in kept), into])

        return step

    return by_batch(make)


_FOUND = "struct<n: long, form: string, prefix_chars: long, middle_chars: long, output: string>"


def fill_in_middle(docs: DataFrame, columns: list[str] | None = None, into: str = "fim") -> DataFrame:
    """Every row of ``docs(doc_id, text)`` with ``columns`` (all, unless given) and a struct ``into``.

    Its fields: ``n`` units of the text, ``form`` (``plain``, ``psm``, ``spm``), ``prefix_chars`` and ``middle_chars`` (code
    points; null if plain) and ``output``, the rewritten text. Cuts and form depend on doc_id and the text alone. A null or
    empty text, and one that holds a sentinel, stays as it is (null as empty), ``plain``. A null doc_id draws as if it had
    no digits. Rows of one doc_id draw alike. Long texts are scanned whole, in pieces; an empty table gives no rows. Other columns
    pass through, whatever their names; one called ``into`` is replaced.
    """
    small_batches(docs.sparkSession)
    columns = [c for c in (docs.columns if columns is None else columns) if c != into]
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in columns if c != "text"]).alias("row")
    rows = docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keep = "text" in columns
    out = T.StructType([rows.schema["row"], *([rows.schema["text"]] * keep), *T.StructType.fromDDL(f"`{into}` {_FOUND}").fields])
    found = rows.mapInArrow(_rewriting(keep, into), out)
    return found.select(*[F.col(f"row.`{c}`") if c != "text" else F.col("text") for c in columns], F.col(f"`{into}`"))


def restored(form: Column, output: Column) -> Column:
    """The text that ``output`` was made from: its parts stand between the sentinels, which no part holds."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)  # the first is empty
    first, second, third = (F.element_at(part, i) for i in (2, 3, 4))
    return F.when(form == "psm", F.concat(first, third, second)).when(form == "spm", F.concat(second, third, first)).otherwise(output)


SQL = r"""
with doc as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents
),
draw as (
  select *, len(u)::bigint as n, ('0x' || substr(h, 1, 8))::ubigint as h1, ('0x' || substr(h, 9, 8))::ubigint as h2, ('0x' || substr(h, 17, 8))::ubigint as h3, ('0x' || substr(h, 25, 8))::ubigint as h4 from doc
),
cut as (
  select *, least(h1 % (n + 1), h2 % (n + 1))::bigint as a, greatest(h1 % (n + 1), h2 % (n + 1))::bigint as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from draw
),
part as (
  select *, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:], '') as s from cut
)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(t) as restored_sha256
from part
"""
