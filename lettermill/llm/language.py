"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader (per-coordinate FTRL-proximal, elastic net: L1 makes the weights sparse, L2
shrinks them) on a bounded sample of labelled rows, then calibrated: one temperature, fitted on rows of the sample that
training didn't see, divides the scores.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import by_batch, release, small_batches

#: The sample: at most so many rows of a language and in all (but one of every language), of each a piece of at most so many characters.
PER_LANGUAGE, ROWS, CHARS = 1500, 12_000, 4000
#: One row in so many of each language's sample calibrates; the others train.
CALIBRATION = 5
#: n-gram sizes, bits of an n-gram's hash, and features kept (those in most documents of the sample).
SIZES, BITS, FEATURES = (1, 2, 3), 18, 16_384
#: FTRL: learning rate, its smoothing, L1 and L2 penalties, passes.
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 1.0, 0.5, 3
#: Characters whose n-grams are counted at once.
PIECE = 1 << 20
UNKNOWN = "und"
#: Any letter, in a column's pattern.
LETTER = r"\p{L}"

_MULTIPLIERS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)


@lru_cache
def _letters() -> np.ndarray:
    """Whether a character is a letter or a mark on one."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)), bool, 0x110000)


def hashed(text: str):
    """Hashes of the n-grams of the text, all of them, some at a time: lower case, all but letters as single spaces."""
    marks, space, tail = f" {text.lower()} ", np.uint32(32), np.empty(0, np.uint32)
    for low in range(0, len(marks), PIECE):
        a = np.frombuffer(marks[low : low + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        a = np.concatenate([tail, np.where(_letters()[a], a, space)])
        kept = np.ones(len(a), bool)
        kept[1:] = (a[1:] != space) | (a[:-1] != space)
        a = a[kept]
        for size in SIZES:
            first = max(0, len(tail) - size + 1)  # n-grams before it were in the last piece
            n = len(a) - size + 1 - first
            if n > 0:
                x = a[first : first + n] * np.uint32(_MULTIPLIERS[size - 1])
                for j in range(1, size):
                    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + a[first + j : first + j + n]
                x = (x ^ (x >> np.uint32(16))) * np.uint32(0x297A2D39)
                yield x >> np.uint32(32 - BITS)
        tail = a[len(a) - max(SIZES) + 1 :] if len(a) >= max(SIZES) else a


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Model:
    """Feature numbers by n-gram hash (the last number: none), inverse document frequencies, weights, temperature."""

    languages: list[str]
    number: np.ndarray
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def counted(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The features that a text has, and how often, in few bytes: the sample's are held while it is learned."""
        size = len(self.idf)
        counts = np.zeros(size + 1, np.int64)
        for h in hashed(text):
            counts += np.bincount(self.number[h], minlength=size + 1)
        at = np.flatnonzero(counts[:size])
        return at.astype(np.uint16 if size <= 1 << 16 else np.uint32), counts[at].astype(np.uint32)

    def weighed(self, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features and their TF-IDF values, of length one."""
        at = at.astype(np.int64)
        x = (1 + np.log(counts)) * self.idf[at]
        return at, x / (np.sqrt((x * x).sum()) or 1.0)

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return self.weighed(*self.counted(text))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        at, x = self.features(text)
        p = softmax((x @ self.weights[at] + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, str]]) -> Model:
    """A model from (text, language) rows, in their order."""
    rows = list(dict.fromkeys((t, lang) for t, lang in rows if has_letter(t)))
    languages = sorted({lang for _, lang in rows})
    seen = np.zeros(1 << BITS, np.int64)
    for text, _ in rows:
        seen[np.unique(np.concatenate([*hashed(text)]))] += 1
    kept = np.sort(np.argsort(-seen, kind="stable")[:FEATURES])
    kept = kept[seen[kept] > 1]
    number = np.full(1 << BITS, len(kept), np.int32)
    number[kept] = np.arange(len(kept))
    idf = np.log((1 + len(rows)) / (1 + seen[kept])) + 1
    model = Model(languages, number, idf, np.zeros((len(kept), len(languages))), np.zeros(len(languages)), 1.0)
    if not languages:
        return model
    told = {lang: k for k, lang in enumerate(languages)}
    examples = [(*model.counted(text), told[lang]) for text, lang in rows]
    place, aside, training = [0] * len(languages), [], []
    for example in examples:  # of each language in turn: one row in CALIBRATION is kept from training
        k = example[2]
        place[k] += 1
        (training if place[k] % CALIBRATION else aside).append(example)
    _ftrl(model, training)
    if not aside:  # too few rows of each language
        return model
    scores = np.array([x @ model.weights[at] + model.bias for at, x in (model.weighed(a, c) for a, c, _ in aside)])
    truth = np.array([k for *_, k in aside])
    loss = lambda t: -np.log(softmax(scores / t)[np.arange(len(truth)), truth] + 1e-300).mean()
    model.temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
    return model


def _ftrl(model: Model, examples: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
    z, n = np.zeros_like(model.weights), np.zeros_like(model.weights)
    zb, nb = np.zeros_like(model.bias), np.zeros_like(model.bias)

    def weights(z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    order = np.random.default_rng(0)
    for _ in range(PASSES):
        for i in order.permutation(len(examples)):
            (at, x), k = model.weighed(*examples[i][:2]), examples[i][2]
            za, na = z[at], n[at]
            w, b = weights(za, na, L1), weights(zb, nb, 0.0)
            error = softmax(x @ w + b)
            error[k] -= 1
            g = x[:, None] * error
            more = na + g * g
            z[at] = za + g - (np.sqrt(more) - np.sqrt(na)) / ALPHA * w
            n[at] = more
            moreb = nb + error * error
            zb, nb = zb + error - (np.sqrt(moreb) - np.sqrt(nb)) / ALPHA * b, moreb
    model.weights[:] = weights(z, n, L1)
    model.bias[:] = weights(zb, nb, 0.0)


def _piece(text: Column, place: Column) -> Column:
    """One of the text's pieces of at most CHARS characters: among those with a letter, the one that ``place`` draws."""
    pieces = F.filter(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHARS}}}"), F.lit(0)), lambda x: x.rlike(LETTER))
    return F.element_at(pieces, (F.pmod(F.xxhash64(place), F.size(pieces)) + 1).cast("int"))


def train(docs: DataFrame, may_learn: Column) -> Model:
    """A model from the rows of ``docs(doc_id, text, lang)`` that ``may_learn`` allows and whose lang isn't null.

    The rows are those with the smallest hashes of doc_id in each language, among all that have a letter, however long;
    only a piece of each, drawn by its hash from the pieces with a letter, comes to the driver. Every language has a row,
    however many there are. No rows: a model that knows no language.
    """
    rows = docs.filter(may_learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    spread = 1 << 40
    rows = rows.filter(F.col("text").rlike(LETTER)).select("lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(spread)).alias("place"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("place").alias("first")).orderBy("lang").collect()
    if not counts:
        return fit([])
    each = max(1, min(PER_LANGUAGE, ROWS // len(counts)))
    bound = docs.sparkSession.createDataFrame([(r["lang"], max(r["first"] + 1, min(spread, 2 * each * spread // r["n"] + 1))) for r in counts], "lang string, bound long")
    found = rows.join(F.broadcast(bound), "lang").filter(F.col("place") < F.col("bound"))
    found = found.select("lang", "place", _piece(F.col("text"), F.col("place")).alias("text")).distinct()
    found = found.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("place", "text"))).filter(F.col("k") <= each)
    model = fit([(r["text"], r["lang"]) for r in found.orderBy("k", "lang").select("text", "lang").collect()])
    release()  # of the sample's features
    return model


def _predicted(shared, keep_text: bool, into: str):
    def make():
        model: Model = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [model.predict(text) for text in batch.column(1).to_pylist()]
            language = pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["lang_pred", "score"])
            kept = [(batch.column(1), "text")] * keep_text
            return pa.RecordBatch.from_arrays([batch.column(0), *(c for c, _ in kept), language], ["row", *(n for _, n in kept), into])

        return step

    return by_batch(make)


def identify(docs: DataFrame, model: Model, columns: list[str] | None = None, into: str = "language") -> DataFrame:
    """Every row of ``docs`` with ``columns`` (all, unless given) and a struct ``into``: ``lang_pred``, ``score``.

    Only the whole text decides, however long. A null text, or one without a letter, gets ``und`` and 0, as every text
    does from a model without languages. Of equally likely languages the first by name is taken. Repeated rows get equal
    predictions; an empty table gives no rows. Other columns pass through, whatever their names; one called ``into`` is replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    columns = [c for c in (docs.columns if columns is None else columns) if c != into]
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in columns if c != "text"]).alias("row")
    rows = docs.select(row, F.col("text").cast("string").alias("text"))
    keep = "text" in columns
    out = T.StructType([*rows.schema.fields[: 1 + keep], T.StructField(into, T.StructType.fromDDL("lang_pred string, score double"))])
    found = rows.mapInArrow(_predicted(spark.sparkContext.broadcast(model), keep, into), out)
    return found.select(*[F.col(f"row.`{c}`") if c != "text" else F.col("text") for c in columns], F.col(f"`{into}`"))


def held_out() -> Column:
    """Rows kept from training: every fourth by a checksum of doc_id."""
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2
