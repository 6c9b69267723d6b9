"""Inverted lists in blocks: what tasks make of tokens, and how their parts become blocks ordered by impact.

A task inverts as many messages as it may hold at once into runs: for each term and field one row with ids, counts, lengths
and positions. Only runs are shuffled, a row for each term of a task, never one for each token. Where the runs of a term
meet, in order, their postings are sorted by impact, the part of a score that doesn't depend on the query, and cut into
blocks. So the first blocks of a term hold its best messages, and a block's ``impact`` bounds what it can give.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .ranking import K1, B

#: Postings of a block, tokens that a task inverts at once, tokens of a run (but a posting's at least), and postings of a term
#: that are sorted at once.
BLOCK, TASK_TOKENS, RUN_TOKENS, HELD = 128, 1 << 21, 1 << 12, 1 << 17
#: Rows of an Arrow batch of messages' tokens, and of runs.
MESSAGE_ROWS, RUN_ROWS = 1024, 4096
_LISTS = "ids array<long>, tf array<int>, dl array<int>"
#: Positions of a run follow each other, ``tf`` of each posting: as lists in a list they would be most of what is shuffled.
RUNS = f"term string, field string, first long, postings int, tokens long, {_LISTS}, positions array<int>"
BLOCKS = f"term string, field string, postings int, tokens long, impact double, {_LISTS}, positions array<array<int>>"


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows at most, for what is run inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _nested(values: pa.Array, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), values)


def _inverted(field: str, tokens: pa.Array, ids: np.ndarray, counts: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
    """The runs of one field: ``tokens`` of all messages in a row, of each its id, number of tokens here, and length."""
    coded = tokens.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(ids)), counts)
    place = np.arange(len(code)) - np.repeat(np.cumsum(counts) - counts, counts)
    order = np.argsort(code, kind="stable")  # by term; within it by message and place, as they came
    code, row, place = code[order], row[order], place[order]
    other = code[1:] != code[:-1]
    start = np.flatnonzero(np.concatenate([[True], other | (row[1:] != row[:-1])]))  # of each posting
    tf = np.diff(np.append(start, len(code)))
    of, row = code[start], row[start]
    run = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    before = np.cumsum(tf) - tf
    part = (before - np.repeat(before[run], np.diff(np.append(run, len(of))))) // RUN_TOKENS  # of a frequent term's run
    run = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (part[1:] != part[:-1])]))
    ends = np.append(run[1:], len(of))
    columns = {
        "term": coded.dictionary.take(pa.array(of[run])), "field": pa.array([field] * len(run), pa.string()), "first": pa.array(ids[row[run]]),
        "postings": pa.array((ends - run).astype(np.int32)), "tokens": pa.array(np.add.reduceat(tf, run)),
        "ids": _nested(pa.array(ids[row]), ends), "tf": _nested(pa.array(tf.astype(np.int32)), ends), "dl": _nested(pa.array(lengths[row].astype(np.int32)), ends),
        "positions": _nested(pa.array(place.astype(np.int32)), np.cumsum(tf)[ends - 1]),
    }
    return pa.RecordBatch.from_arrays([*columns.values()], [*columns])


def _runs(fields: list[str], whole: bool):
    """``whole``: a posting's length is that of the message, not of its field."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flushed() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            ids = table["doc_id"].to_numpy()
            counts = {f: pc.fill_null(pc.list_value_length(table[f]), 0).to_numpy().astype(np.int64) for f in fields}
            total = sum(counts.values())
            for f in fields:
                tokens = table[f].combine_chunks().flatten()
                if len(tokens):
                    yield _inverted(f, tokens, ids, counts[f], total if whole else counts[f])

        for batch in batches:
            held.append(batch)
            n += sum(len(batch.column(f).flatten()) for f in fields)
            if n >= TASK_TOKENS:
                yield from flushed()
                held, n = [], 0
        if held:
            yield from flushed()

    return run


def runs(rows: DataFrame, fields: list[str], whole: bool) -> DataFrame:
    """Runs of ``rows(doc_id, *fields)``, whose fields are arrays of tokens."""
    return rows.select("doc_id", *fields).mapInArrow(_runs(fields, whole), RUNS)


def impacts(tf: np.ndarray, dl: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """The part of a BM25 score that term and query don't change, below 1."""
    return tf / (tf + K1 * (1 - B + B * dl / mean))


def _cut(table: pa.Table, means: dict[str, float]) -> pa.RecordBatch:
    """The blocks of these runs, of which those of a term and field follow each other."""
    term, field = table["term"].combine_chunks(), table["field"].combine_chunks()
    changed = pc.or_(pc.not_equal(term[1:], term[:-1]), pc.not_equal(field[1:], field[:-1])).to_numpy(zero_copy_only=False) if len(table) > 1 else np.empty(0, bool)
    group = np.concatenate([[0], np.cumsum(changed)]) if len(table) else np.empty(0, np.int64)
    n = pc.list_value_length(table["ids"]).to_numpy().astype(np.int64)
    flat = lambda c: table[c].combine_chunks().flatten()
    ids, tf, dl = (flat(c).to_numpy() for c in ("ids", "tf", "dl"))
    mean = np.array([means[f] for f in field.to_pylist()])
    row = np.repeat(np.arange(len(table)), n)
    impact = impacts(tf, dl, mean[row])
    of = group[row]
    order = np.lexsort((ids, -impact, of))
    of, row = of[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    rank = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
    block = np.flatnonzero(rank % BLOCK == 0)
    ends = np.append(block[1:], len(of))
    times = tf[order].astype(np.int64)
    spots = flat("positions").to_numpy()
    source = (np.cumsum(tf) - tf)[order]  # where a posting's positions start
    at = np.repeat(source - (np.cumsum(times) - times), times) + np.arange(times.sum())
    columns = {
        "term": term.take(pa.array(row[block])), "field": field.take(pa.array(row[block])), "postings": pa.array((ends - block).astype(np.int32)),
        "tokens": pa.array(np.add.reduceat(times, block)), "impact": pa.array(impact[order][block]), "ids": _nested(pa.array(ids[order]), ends), "tf": _nested(pa.array(tf[order]), ends),
        "dl": _nested(pa.array(dl[order]), ends), "positions": _nested(_nested(pa.array(spots[at]), np.cumsum(times)), ends),
    }
    return pa.RecordBatch.from_arrays([*columns.values()], [*columns])


def _blocks(means: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch.select(_NAMES)])
            table = table if held is None else pa.concat_tables([held, table])
            last = pc.and_(pc.equal(table["term"], table["term"][-1]), pc.equal(table["field"], table["field"][-1])).to_numpy(zero_copy_only=False)
            open_ = int(np.argmax(last))  # the last term may go on
            if pc.sum(table["postings"][open_:]).as_py() >= HELD:
                open_ = len(table)
            if open_:
                yield _cut(table.slice(0, open_), means)
            held = table.slice(open_) if open_ < len(table) else None
        if held is not None:
            yield _cut(held, means)

    return run


def _picked(values: pa.ListArray, keep: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return _nested(values.flatten().filter(pa.array(keep)), ends)


def purged(spark: SparkSession, gone: DataFrame, live: list[int], lists: tuple[str, ...]):
    """For ``mapInArrow``: blocks without the postings of ``gone(doc_id, until)``, which is small and broadcast, and how many these are.

    A block stays whole within its row, so nothing is exploded. ``lists``: those besides the ids.
    """
    table = gone.select("doc_id", "until").toArrow()
    ids = table["doc_id"].to_numpy()
    order = np.argsort(ids)
    sent = spark.sparkContext.broadcast((ids[order], table["until"].to_numpy()[order], {g: i for i, g in enumerate(live)}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, until, places = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            n = pc.list_value_length(batch.column("ids")).to_numpy().astype(np.int64)
            held = batch.column("ids").flatten().to_numpy()
            place = np.repeat([places[g] for g in batch.column("generation").to_pylist()], n)
            at = np.minimum(np.searchsorted(known, held), max(len(known) - 1, 0))
            keep = ~((known[at] == held) & (until[at] > place)) if len(known) else np.ones(len(held), bool)
            row = np.repeat(np.arange(len(n)), n)
            left = np.bincount(row[keep], minlength=len(n))
            ends = np.cumsum(left)
            columns = {"term": batch.column("term"), "field": batch.column("field"), "postings": pa.array(left.astype(np.int32)), "ids": _picked(batch.column("ids"), keep, ends)}
            columns |= {c: _picked(batch.column(c), keep, ends) for c in lists}
            columns["dead"] = pa.array((n - left).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    return run


_NAMES = ["term", "field", "postings", "ids", "tf", "dl", "positions"]


def blocks(parts: DataFrame, means: dict[str, float]) -> DataFrame:
    """Blocks of ``parts`` (runs, or blocks with their positions in a row), which are in order of term and field within their partitions."""
    return parts.select(*_NAMES).mapInArrow(_blocks({f: m or 1.0 for f, m in means.items()}), BLOCKS)
