"""Byte-level BPE by a global shuffle of distinct words: each distinct pre-token of the corpus is encoded once.

Documents are dealt into blocks by a hash; rows that are repeated very often travel once, with their number. A block's pre-tokens are exploded to its distinct ones, which are dealt into
buckets by a hash of the word; where the rows of a bucket meet, each distinct word is encoded once, whatever the number
of blocks that ask for it, and the ids go back to those blocks. A block then reassembles each document by the positions
of its pre-tokens. Words travel many to a row, in an order that block and bucket agree on (sorted), so neither words nor
numbers travel back.

Decoding joins each id with the table of token bytes, which has one row for each rank of the vocabulary file.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pretokens import Splitter, ranked
from .shared import as_bytes, by_batch, release, small_batches, written

#: Bytes of text in a block; one task holds a block's distinct words and their ids. Bytes of text for each bucket: the
#: buckets grow with the corpus, so a bucket's share of the vocabulary doesn't; words that a bucket remembers at most.
BLOCK_BYTES, BUCKET_BYTES, REMEMBERED = 12_000_000, 64_000_000, 2_000_000
#: Equal rows from which on they travel once.
REPEATED, TIMES = 1000, "_lm_times"
#: Documents of a block that are put together at once.
ROWS = 256


def _bucket(word: str, buckets: int) -> int:
    return xxhash.xxh3_64_intdigest(word.encode()) % buckets


def _by_bucket(words: Iterable[str], buckets: int) -> dict[int, list[str]]:
    """The words of each bucket, sorted."""
    out: dict[int, list[str]] = {}
    for word in words:
        out.setdefault(_bucket(word, buckets), []).append(word)
    for found in out.values():
        found.sort()
    return out


def _packed(parts: list[bytes]) -> tuple[bytes, bytes]:
    """Lengths, as little-endian 32-bit numbers, and the parts' bytes."""
    return np.fromiter(map(len, parts), "<u4", len(parts)).tobytes(), b"".join(parts)


def _unpacked(lengths: bytes, body: bytes) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(lengths, "<u4"), dtype=np.int64).tolist()
    return [body[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _squeezed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Texts as compressed bytes: they cross the network once, and most of what crosses is text."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    packed = [None if x is None else squeeze(x) for x in as_bytes(batch.column("text"))]
    return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(packed, pa.binary()), batch.column("block")], ["row", "packed", "block"])


def _texts(column: pa.Array) -> list[str | None]:
    expand = zstandard.ZstdDecompressor().decompress
    return [None if x is None else expand(x).decode() for x in column.to_pylist()]


def _distinct(pattern: str, buckets: int):
    """The distinct words of each block, by bucket; the rows of a block are together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, block, words = Splitter(pattern), None, set()

        def rows() -> pa.RecordBatch:
            found = sorted(_by_bucket(words, buckets).items())
            packed = [_packed([w.encode() for w in part]) for _, part in found]
            columns = [[block] * len(found), [b for b, _ in found], [p for p, _ in packed], [p for _, p in packed]]
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["block", "bucket", "lengths", "body"])

        for batch in batches:
            for at, text in zip(batch.column("block").to_pylist(), _texts(batch.column("packed")), strict=True):
                if at != block:
                    if words:
                        yield rows()
                    block, words = at, set()
                if text:
                    words.update(split(text))
        if words:
            yield rows()

    return run


def _encoded(path: str, pattern: str, wide: bool):
    """Ids of each bucket's words; a word that several blocks ask for is encoded once. The rows of a bucket are together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, kind = ranked(path, pattern)._encode_single_piece, "<u4" if wide else "<u2"

        class Known(dict):
            def __missing__(self, word: bytes) -> bytes:
                if len(self) >= REMEMBERED:  # a bucket of very many rare words; some are encoded again
                    self.clear()
                value = self[word] = np.array(piece(word), kind).tobytes()
                return value

        known, bucket = Known(), None
        for batch in batches:
            packed = []
            for now, lengths, body in zip(batch.column("bucket").to_pylist(), batch.column("lengths").to_pylist(), batch.column("body").to_pylist(), strict=True):
                if now != bucket:
                    known, bucket = Known(), now
                packed.append(_packed([known[w] for w in _unpacked(lengths, body)]))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("bucket"), pa.array([p for p, _ in packed], pa.binary()), pa.array([p for _, p in packed], pa.binary())], ["block", "bucket", "lengths", "ids"])

    return run


def _assembled(path: str, pattern: str, buckets: int, wide: bool, keep_text: bool, keep_bytes: bool):
    """For cogrouped blocks: the ids of each document, put together by the positions of its pre-tokens."""

    class Numbers(dict):
        def __missing__(self, word: str) -> int:
            value = self[word] = len(self)
            return value

    def numbered(texts: pa.Table) -> tuple[list[np.ndarray], Numbers]:
        split, number, positions = Splitter(pattern), Numbers(), []
        for batch in texts.select(["packed"]).to_batches(max_chunksize=ROWS):
            for text in _texts(batch.column(0)):
                found = split(text) if text else []
                positions.append(np.fromiter(map(number.__getitem__, found), np.int32, len(found)))
        return positions, number

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        positions, number = numbered(texts)
        of_bucket = _by_bucket(number, buckets)
        ids = [b""] * len(number)
        for bucket, lengths, body in zip(*(words[c].to_pylist() for c in ("bucket", "lengths", "ids")), strict=True):
            for word, found in zip(of_bucket[bucket], _unpacked(lengths, body), strict=True):
                ids[number[word]] = found
        del of_bucket, number
        table = token_table(path, pattern) if keep_bytes else []
        batches = []
        for low in range(0, len(positions), ROWS):
            part = texts.slice(low, ROWS)
            found = [np.frombuffer(b"".join(map(ids.__getitem__, p.tolist())), "<u4" if wide else "<u2") for p in positions[low : low + ROWS]]
            columns = [(part["row"].combine_chunks(), "row")]
            if keep_text:
                columns.append((pa.array(_texts(part["packed"]), pa.string()), "text"))
            columns.append((pa.array([x.astype("<u4").tobytes() for x in found], pa.binary()), "token_ids"))
            if keep_bytes:
                columns.append((pa.array([b"".join(map(table.__getitem__, x.tolist())) for x in found], pa.binary()), "token_bytes"))
            batches.append(pa.RecordBatch.from_arrays([c for c, _ in columns], [n for _, n in columns]))
        del positions, ids
        release()
        return pa.Table.from_batches(batches)

    return run


def _hashable(kind: T.DataType) -> bool:
    """Whether Spark hashes and groups values of the type: not with a map or a variant in it."""
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return _hashable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))


def _once(rows: DataFrame) -> DataFrame:
    """``rows(row, text)``, where very many equal ones come as one, with their number in ``row``: they'd fill one block."""
    rows = rows.withColumn("key", F.xxhash64("row", "text"))
    hot = written(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= REPEATED).select("key"), "repeated")
    if hot.isEmpty():
        return rows.drop("key")
    numbered = lambda df, n: df.select(F.col("row").withField(TIMES, n).alias("row"), "text")
    many = rows.join(hot, "key", "left_semi").groupBy("row", "text").agg(F.count("*").alias("n"))
    return numbered(rows.join(hot, "key", "left_anti"), F.lit(1).cast("long")).union(numbered(many, F.col("n")))


def encode(docs: DataFrame, ranks: str, pattern: str, columns: list[str] | None = None, decoded: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every row of ``docs``, with ``columns`` (all, unless given) and ``token_ids``: little-endian unsigned 32-bit ids.

    The ids are those of the tiktoken library for the whole text, without special tokens. A null or empty text has no
    ids. Repeated rows stay. Long texts are encoded whole; an empty table gives no rows. Other columns pass through,
    whatever their names and types (maps cost one more write of the table); one called ``token_ids`` is replaced.
    With ``decoded``, ids are also joined with the token table where they are made, which gives ``token_bytes``. Blocks of
    fewer ``block_bytes`` of text take less of a task's memory and shuffle more words.
    """
    spark = docs.sparkSession
    small_batches(spark)
    made = ["token_ids", "token_bytes"] if decoded else ["token_ids"]
    columns = [c for c in (docs.columns if columns is None else columns) if c not in made]
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets, blocks = max(least, -(-size // BUCKET_BYTES)), max(least, -(-size // block_bytes))
    wide = ranked(ranks, pattern).n_vocab > 1 << 16
    text = F.col("text").cast("string").alias("text")
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in columns if c != "text"]).alias("row")
    rows = docs.select(row, text)
    if _hashable(rows.schema["row"].dataType):
        rows, key = _once(rows), ["row", "text"]
    else:  # such rows are dealt by a number that they get by being written
        rows, key = written(rows.withColumn("number", F.monotonically_increasing_id()), "numbered"), ["number"]
    rows = rows.select("row", "text", F.pmod(F.xxhash64(*key), F.lit(blocks)).cast("int").alias("block"))
    squeezed = T.StructType([rows.schema["row"], T.StructField("packed", T.BinaryType()), rows.schema["block"]])
    dealt = rows.mapInArrow(by_batch(lambda: _squeezed), squeezed).repartition("block")
    asked = dealt.sortWithinPartitions("block").mapInArrow(_distinct(pattern, buckets), "block int, bucket int, lengths binary, body binary")
    asked = asked.repartition("bucket").sortWithinPartitions("bucket")
    answered = asked.mapInArrow(_encoded(ranks, pattern, wide), "block int, bucket int, lengths binary, ids binary")
    out = T.StructType([dealt.schema["row"], *([rows.schema["text"]] if "text" in columns else []), *[T.StructField(c, T.BinaryType()) for c in made]])
    joined = dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(_assembled(ranks, pattern, buckets, wide, "text" in columns, decoded), out)
    if TIMES in rows.schema["row"].dataType.names:
        joined = joined.select("*", F.explode(F.sequence(F.lit(1).cast("long"), f"row.{TIMES}")))
    return joined.select(*[F.col(f"row.`{c}`") if c != "text" else F.col("text") for c in columns], *made)


def _decoded(path: str, pattern: str):
    def make():
        table = token_table(path, pattern)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [None if x is None else b"".join(map(table.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["row", "token_ids", "token_bytes"])

        return step

    return by_batch(make)


def token_table(path: str, pattern: str) -> list[bytes | None]:
    """The bytes of each id."""
    encoding = ranked(path, pattern)
    table: list[bytes | None] = [None] * encoding.n_vocab
    for token, rank in encoding._mergeable_ranks.items():
        table[rank] = token
    return table


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Every row of ``encoded``, with ``token_bytes``: the bytes of its ``token_ids``, joined with the token table.

    The table has a row for each rank of the file, so its size doesn't depend on the data; each task reads it once. Null
    ids give null. An id outside the vocabulary is an error.
    """
    columns = [c for c in encoded.columns if c not in ("token_ids", "token_bytes")]
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in columns]).alias("row")
    rows = encoded.select(row, "token_ids")
    out = T.StructType([*rows.schema.fields, T.StructField("token_bytes", T.BinaryType())])
    return rows.mapInArrow(_decoded(ranks, pattern), out).select(*[F.col(f"row.`{c}`") for c in columns], "token_ids", "token_bytes")
