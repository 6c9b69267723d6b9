"""Document quality by random-indexing word vectors, pooled per document, and a two-layer network.

1. Tokens (runs of letters, of digits, of other characters, as they are written) fall into ``BUCKETS`` by a hash. Every
   bucket has a fixed sparse random index vector; a bucket's context vector is the sum of the index vectors of its
   neighbours in all documents. Tasks sum theirs and Spark adds the sums, so all that grows with the corpus is counts.
2. A document is the weighted mean of its tokens' context vectors (frequent tokens weigh less) beside the mean of their
   index vectors, how long the two are (long, where few tokens make up the text), and how many tokens equal a near one: one
   row of numbers for a text of any length.
3. A network of one hidden layer learns from a bounded sample of labelled rows, weighed so that both labels count as
   often as they occur. One temperature, fitted on rows that training didn't see, calibrates its probabilities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import as_bytes, by_batch, release, small_batches, written

#: Buckets of tokens, numbers in a vector, those of them that an index vector sets, neighbours to each side that count.
BUCKETS, SIZE, SET, NEAR = 8192, 32, 4, 2
#: Weight of a token of relative frequency f: RARE / (RARE + f).
RARE = 1e-3
#: Labelled rows of each label that are learned from at most; one in so many calibrates.
ROWS, CALIBRATION = 6000, 5
#: Hidden units, passes, rows in a step, step size, penalty on weights.
HIDDEN, PASSES, BATCH, RATE, PENALTY = 32, 60, 64, 3e-3, 1e-3
#: Bytes of a text that are split at once; tokens that are counted at once, and that a task remembers.
PIECE, TOKENS, REMEMBERED = 1 << 20, 1 << 19, 1 << 20

_TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff\s]+")
_SPACE = re.compile(rb"\s")


class Tokens(dict):
    """The buckets of a text's tokens."""

    def __missing__(self, token: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[token] = xxhash.xxh3_64_intdigest(token) % BUCKETS
        return value

    def of(self, text: bytes | None) -> Iterator[np.ndarray]:
        """Buckets, a piece of the text at a time; pieces end before white space, so no token is cut."""
        low, size = 0, len(text or b"")
        while low < size:
            space = _SPACE.search(text, low + PIECE)
            high = space.start() if space else size
            found = _TOKEN.findall(text, low, high)
            yield np.fromiter(map(self.__getitem__, found), np.int32, len(found))
            low = high


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each bucket, the places of its index vector that are set, and to what; one more bucket stands for nothing."""
    draw = np.random.default_rng(11)
    places = np.argsort(draw.random((BUCKETS + 1, SIZE)), axis=1)[:, :SET].astype(np.int64)
    signs = draw.choice([-1.0, 1.0], (BUCKETS + 1, SET))
    signs[BUCKETS] = 0
    return places, signs


class _Contexts:
    """Sums of neighbours' index vectors, and tokens, by bucket."""

    def __init__(self):
        self.places, self.signs = index_vectors()
        self.sums = np.zeros((BUCKETS + 1) * SIZE)
        self.count = np.zeros(BUCKETS + 1, np.int64)
        self.held: list[np.ndarray] = []
        self.n = 0

    def add(self, pieces: Iterator[np.ndarray]) -> None:
        """The pieces of one text, with nothing as the neighbours of its ends."""
        for piece in pieces:
            self._hold(piece)
        self._hold(np.full(NEAR, BUCKETS, np.int32))

    def _hold(self, piece: np.ndarray) -> None:
        self.held.append(piece)
        self.n += len(piece)
        if self.n >= TOKENS:
            self.flush()

    def flush(self) -> None:
        """Count what is held, but keep the last tokens, which may have neighbours still to come."""
        token = np.concatenate(self.held) if self.held else np.empty(0, np.int32)
        kept = token[len(token) - NEAR :] if self.n > NEAR else token
        fresh = min(getattr(self, "seen", 0), len(token))  # these were counted with the last ones
        self.count += np.bincount(token[fresh:], minlength=BUCKETS + 1)
        for distance in range(1, NEAR + 1):
            left, right = token[max(0, fresh - distance) : -distance].astype(np.int64), token[max(fresh, distance) :]
            for at, neighbour in ((left, right), (right.astype(np.int64), left)):
                for k in range(SET):
                    self.sums += np.bincount(at * SIZE + self.places[neighbour, k], self.signs[neighbour, k], (BUCKETS + 1) * SIZE)
        self.held, self.n, self.seen = [kept], len(kept), len(kept)

    def rows(self) -> pa.RecordBatch:
        self.flush()
        at = np.flatnonzero(self.count[:BUCKETS])
        sums = self.sums.reshape(-1, SIZE)[at].astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(self.count[at]), *(pa.array(np.ascontiguousarray(sums[:, i])) for i in range(SIZE))], ["bucket", "n", *_NUMBERS])


#: Numbers of a pooled document.
WIDTH = 2 * SIZE + 2 + NEAR
_NUMBERS = [f"v{i}" for i in range(SIZE)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens, contexts = Tokens(), _Contexts()
    for batch in batches:
        for text in as_bytes(batch.column(0)):
            contexts.add(tokens.of(text))
    yield contexts.rows()


@dataclass
class Vectors:
    """For each bucket its weight, its context vector and its index vector."""

    weight: np.ndarray
    context: np.ndarray
    index: np.ndarray

    def pooled(self, pieces: Iterator[np.ndarray]) -> np.ndarray:
        """A document of these tokens as WIDTH numbers, zeros without tokens."""
        count, same, tail = np.zeros(BUCKETS, np.int64), np.zeros(NEAR), np.empty(0, np.int32)
        for piece in pieces:
            count += np.bincount(piece, minlength=BUCKETS)
            near = np.concatenate([tail, piece])
            for distance in range(1, NEAR + 1):
                fresh = near[max(len(tail), distance) :]
                same[distance - 1] += (fresh == near[len(near) - len(fresh) - distance : len(near) - distance]).sum()
            tail = near[max(0, len(near) - NEAR) :]
        at = np.flatnonzero(count)
        if not len(at):
            return np.zeros(WIDTH, np.float32)
        n = count[at].astype(float)
        w = n * self.weight[at]
        means = w @ self.context[at] / w.sum(), n @ self.index[at] / n.sum()
        return np.concatenate([*means, [np.log(m @ m + 1e-6) for m in means], same / n.sum()]).astype(np.float32)


def word_vectors(docs: DataFrame) -> Vectors:
    """Vectors from all texts of ``docs(text)``. What comes to the driver is a row for each bucket, whatever the corpus."""
    small_batches(docs.sparkSession)
    schema = "bucket long, n long, " + ", ".join(f"{c} long" for c in _NUMBERS)
    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_counted, schema)
    rows = found.groupBy("bucket").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in _NUMBERS]).toArrow()
    at = rows["bucket"].to_numpy()
    count, context = np.zeros(BUCKETS), np.zeros((BUCKETS, SIZE))
    count[at] = rows["n"].to_numpy()
    context[at] = np.stack([rows[c].to_numpy() for c in _NUMBERS], 1)
    if count.sum():
        context -= np.outer(count, context.sum(axis=0) / count.sum())  # what all tokens share says nothing
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-12)
    places, signs = index_vectors()
    index = np.zeros((BUCKETS, SIZE))
    np.put_along_axis(index, places[:BUCKETS], signs[:BUCKETS], axis=1)
    return Vectors(RARE / (RARE + count / max(count.sum(), 1)), context, index)


def _pooled(shared, keep_text: bool, into: str):
    def make():
        vectors: Vectors = shared.value
        tokens = Tokens()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = pa.array([vectors.pooled(tokens.of(text)).tobytes() for text in as_bytes(batch.column(1))], pa.binary())
            kept = [(batch.column(1), "text")] * keep_text
            return pa.RecordBatch.from_arrays([batch.column(0), *(c for c, _ in kept), made], ["row", *(x for _, x in kept), into])

        return step

    return by_batch(make)


def pooled(docs: DataFrame, vectors: Vectors, columns: list[str] | None = None, into: str = "pooled") -> DataFrame:
    """Every row of ``docs`` with ``columns`` (all, unless given) and ``into``: WIDTH little-endian 32-bit floats."""
    small_batches(docs.sparkSession)
    columns = [c for c in (docs.columns if columns is None else columns) if c != into]
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in columns if c != "text"]).alias("row")
    rows = docs.select(row, F.col("text").cast("string").alias("text"))
    keep = "text" in columns
    out = T.StructType([*rows.schema.fields[: 1 + keep], T.StructField(into, T.BinaryType())])
    found = rows.mapInArrow(_pooled(docs.sparkSession.sparkContext.broadcast(vectors), keep, into), out)
    return found.select(*[F.col(f"row.`{c}`") if c != "text" else F.col("text") for c in columns], F.col(f"`{into}`"))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(x / 2)


@dataclass
class Network:
    """Means and deviations of the inputs, the two layers, and the temperature. Without layers, ``share`` for every row."""

    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float
    share: float

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale

    def logits(self, z: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh(z @ w1 + b1) @ w2 + b2[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for rows of pooled numbers."""
        if not self.layers:
            return np.full(len(x), self.share)
        return _sigmoid(self.logits(self.inputs(x)) / self.temperature)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Network:
    """A network from rows of pooled numbers, labels 0 and 1, and weights, in their order. One label only: its share."""
    share = float((weight * y).sum() / weight.sum()) if len(y) else 0.5
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (0.0, 1.0)
    network = Network(mean, scale, [], 1.0, share)
    if len(np.unique(y)) < 2:
        return network
    z = network.inputs(x)
    place = np.zeros(len(y), np.int64)
    for label in (0, 1):  # of each label one row in CALIBRATION is set aside, but never the only one
        place[y == label] = np.arange((y == label).sum()) + 1
    aside = place % CALIBRATION == 0
    draw = np.random.default_rng(11)
    w1 = draw.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN))
    network.layers = layers = [w1, np.zeros(HIDDEN), draw.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    zt, yt, wt = z[~aside], y[~aside], weight[~aside] / weight[~aside].mean()
    first, second, step = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    for turn in range(PASSES):
        order = draw.permutation(len(zt))
        for low in range(0, len(order), BATCH):
            rows = order[low : low + BATCH]
            hidden = np.tanh(zt[rows] @ layers[0] + layers[1])
            error = wt[rows] * (_sigmoid(hidden @ layers[2] + layers[3][0]) - yt[rows]) / len(rows)
            back = np.outer(error, layers[2]) * (1 - hidden**2)
            slopes = [zt[rows].T @ back + PENALTY * layers[0], back.sum(axis=0), hidden.T @ error + PENALTY * layers[2], np.array([error.sum()])]
            step += 1
            rate = RATE * (1 - turn / PASSES)
            for p, g, m, v in zip(layers, slopes, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    if aside.any():
        logits, sign, w = network.logits(z[aside]), np.where(y[aside] == 1, 1.0, -1.0), weight[aside]
        network.temperature = float(min(np.geomspace(0.1, 10, 121), key=lambda t: (w * np.logaddexp(0, -sign * logits / t)).sum()))
    return network


def train(found: DataFrame, labels: DataFrame, may_learn: Column) -> Network:
    """A network from rows of ``found(doc_id, pooled)`` that ``may_learn`` allows, with ``labels(doc_id, quality)`` of 0 or 1.

    At most ROWS rows of each label, those with the smallest hashes of doc_id, come to the driver. Labels that repeat count
    once; a document with both labels is a row of each. Without rows, every document gets 0.5; with one label only, its share.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter("label in (0, 1)").distinct()
    rows = found.filter(may_learn & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "pooled").join(marks, "doc_id")
    spread = 1 << 40
    rows = rows.select("label", "pooled", F.pmod(F.xxhash64("doc_id"), F.lit(spread)).alias("place"))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit(np.empty((0, WIDTH)), np.empty(0), np.empty(0))
    bound = F.create_map(*[F.lit(v) for label, n in counts.items() for v in (label, min(spread, 2 * ROWS * spread // n + 1))])
    some = rows.filter(F.col("place") < bound[F.col("label")])
    some = some.withColumn("k", F.row_number().over(W.partitionBy("label").orderBy("place", "pooled"))).filter(F.col("k") <= ROWS)
    sample = some.orderBy("label", "k").select("label", "pooled").toArrow()
    y = sample["label"].to_numpy().astype(float)
    x = np.frombuffer(b"".join(sample["pooled"].to_pylist()), "<f4").reshape(-1, WIDTH).astype(float)
    weight = np.array([counts[int(v)] / (y == v).sum() for v in y])
    network = fit(x, y, weight)
    release()
    return network


def _scored(shared):
    def make():
        network: Network = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<f4").reshape(-1, WIDTH).astype(float)
            score = np.concatenate([network.score(row[None]) for row in x])  # a row's score doesn't depend on its batch
            made = pa.StructArray.from_arrays([pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["score", "predicted"])
            return pa.RecordBatch.from_arrays([batch.column(0), made], ["row", "made"])

        return step

    return by_batch(make)


def quality(docs: DataFrame, labels: DataFrame, may_learn: Column, columns: list[str] | None = None, into: str = "quality") -> DataFrame:
    """Every row of ``docs(doc_id, text)`` with ``columns`` (all, unless given) and a struct ``into``: ``score``, ``predicted``.

    ``score`` (0 to 1) is the calibrated probability of label 1, ``predicted`` 1 from 0.5 on. Only the whole text decides,
    however long; vectors are counted over all texts, and labels are learned from the rows that ``may_learn`` allows. A null
    or empty text scores like a document without tokens. Without labels every score is 0.5. Repeated rows get equal scores;
    an empty table gives no rows. Other columns pass through, whatever their names; one called ``into`` is replaced.
    """
    spark = docs.sparkSession
    columns = [c for c in (docs.columns if columns is None else columns) if c != into]
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in columns]).alias("row")
    rows = docs.select(row, "doc_id", may_learn.alias("learn"), F.col("text").cast("string").alias("text"))
    found = written(pooled(rows, word_vectors(docs), ["row", "doc_id", "learn"]), "pooled")
    network = train(found, labels, F.coalesce("learn", F.lit(False)))
    kept = found.select("row", "pooled")
    out = T.StructType([kept.schema["row"], *T.StructType.fromDDL("made struct<score: double, predicted: int>").fields])
    scored = kept.mapInArrow(_scored(spark.sparkContext.broadcast(network)), out)
    return scored.select(*[F.col(f"row.`{c}`") for c in columns], F.col("made").alias(into))


def held_out() -> Column:
    """Rows whose labels aren't learned: every third by a checksum of doc_id."""
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1
