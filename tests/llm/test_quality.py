"""The quality classifier: vectors and pooling against plain versions, accuracy on held-out rows, odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lettermill.llm import quality, queries

WORDS = "and of the to in was it is a for with on at".split()


def corpus(rows, seed=1):
    """Texts that are prose or junk, and which they are."""
    rng, out = random.Random(seed), []
    for i in range(rows):
        prose = [rng.choice(WORDS) if rng.random() < 0.6 else f"w{rng.randrange(500)}" for _ in range(rng.randrange(5, 60))]
        good = rng.random() < 0.7
        text = " ".join(prose) + "." if good else " ".join(w + rng.choice(["!!", "%%%", " |", " |"]) for w in prose)
        out.append((i, text, int(good)))
    return out


@pytest.fixture
def tables(spark, tmp_path):
    rows = corpus(600)
    docs = [(i, t) for i, t, _ in rows] + [(600, None), (601, ""), (602, " \n "), (603, "the of " * 60_000), (None, "and so"), (5, rows[5][1])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, g, 0) for i, _, g in rows if i % 4] + [(1, rows[1][2], 1), (None, 1, 0), (2, None, 0), (600, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return spark, str(tmp_path), rows


def test_quality_of_held_out_rows(tables):
    spark, folder, rows = tables
    found = queries.op11_quality(spark, folder).collect()
    assert len(found) == 606
    assert sum(r["doc_id"] == 5 for r in found) == 2 and len({r["score"] for r in found if r["doc_id"] == 5}) == 1
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found if r["doc_id"] is not None)
    assert len({r["score"] for r in found if r["doc_id"] in (600, 601, 602)}) == 1
    truth = {i: g for i, _, g in rows}
    held = [r for r in found if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 150 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_labels_outside_the_allowed_rows_change_nothing(spark):
    docs = spark.createDataFrame([(i, t) for i, t, _ in corpus(200)], "doc_id long, text string")
    truth = {i: g for i, _, g in corpus(200)}
    seen = []
    for flip in (0, 1):
        labels = spark.createDataFrame([(i, g ^ (flip if zlib.crc32(str(i).encode()) % 3 == 1 else 0)) for i, g in truth.items()], "doc_id long, quality int")
        seen.append(sorted((r["doc_id"], r["quality"]["score"]) for r in quality.quality(docs, labels, ~quality.held_out(), ["doc_id"]).collect()))
    assert seen[0] == seen[1]


def test_word_vectors_equal_plain_sums(spark, monkeypatch):
    monkeypatch.setattr(quality, "TOKENS", 7)
    texts = ["a b c a", None, "", "b b", "c, a!! 12 a", "x " * 30, "a b c a"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    found = quality.word_vectors(docs)
    places, signs = quality.index_vectors()
    index = np.zeros((quality.BUCKETS, quality.SIZE))
    for b in range(quality.BUCKETS):
        index[b, places[b]] = signs[b]
    assert (index == found.index).all() and (np.abs(index).sum(axis=1) == quality.SET).all()
    count, sums = np.zeros(quality.BUCKETS), np.zeros((quality.BUCKETS, quality.SIZE))
    for text in texts:
        token = [x for piece in quality.Tokens().of((text or "").encode()) for x in piece.tolist()]
        for i, t in enumerate(token):
            count[t] += 1
            for j in range(max(0, i - quality.NEAR), min(len(token), i + quality.NEAR + 1)):
                if j != i:
                    sums[t] += index[token[j]]
    sums -= np.outer(count, sums.sum(axis=0) / count.sum())
    sums /= np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    assert np.allclose(sums, found.context)
    assert np.allclose(found.weight, quality.RARE / (quality.RARE + count / count.sum()))


@pytest.mark.parametrize("piece", [1, 5, 17])
def test_pieces_pool_like_the_whole(monkeypatch, piece):
    draw = np.random.default_rng(0)
    vectors = quality.Vectors(draw.random(quality.BUCKETS), draw.normal(size=(quality.BUCKETS, quality.SIZE)), draw.normal(size=(quality.BUCKETS, quality.SIZE)))
    for text in ("", " ", "aa bb aa", "é è é, 12  12 x" * 9, "longwithoutspace" * 10, " lead and trail "):
        whole = vectors.pooled(quality.Tokens().of(text.encode()))
        with monkeypatch.context() as m:
            m.setattr(quality, "PIECE", piece)
            assert (vectors.pooled(quality.Tokens().of(text.encode())) == whole).all()
    plain = quality.Tokens().of(b"aa bb aa aa !!")
    ids = [x for p in plain for x in p.tolist()]
    pooled = vectors.pooled(quality.Tokens().of(b"aa bb aa aa !!"))
    w = vectors.weight[ids]
    assert np.allclose(pooled[: quality.SIZE], (w[:, None] * vectors.context[ids]).sum(axis=0) / w.sum(), rtol=1e-5)
    assert np.allclose(pooled[-2:], [1 / 5, 1 / 5])  # the third and fourth; the first and third


def test_without_labels_or_with_one(spark):
    docs = spark.createDataFrame([(i, t, "x", 1.5) for i, t, _ in corpus(30)], "doc_id long, text string, quality string, learn double")
    nothing = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality.quality(docs, nothing, F.lit(True)).collect()
    assert len(rows) == 30 and {(r["quality"]["score"], r["quality"]["predicted"], r["learn"]) for r in rows} == {(0.5, 1, 1.5)}
    ones = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, quality int")
    assert {r["quality"]["score"] for r in quality.quality(docs, ones, F.lit(True)).collect()} == {1.0}
    assert quality.quality(docs.limit(0), ones, F.lit(True)).collect() == []


def test_temperature_is_fitted_on_rows_aside():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(600, quality.WIDTH))
    chance = 1 / (1 + np.exp(-2 * x[:, 0]))
    y = (draw.random(600) < chance).astype(float)
    network = quality.fit(x, y, np.ones(600))
    assert network.temperature > 1.2  # a network that has learned noise by heart is too sure
    fresh = draw.normal(size=(4000, quality.WIDTH))
    truth = (draw.random(4000) < 1 / (1 + np.exp(-2 * fresh[:, 0]))).astype(float)
    loss = lambda t: np.logaddexp(0, -np.where(truth == 1, 1, -1) * network.logits(network.inputs(fresh)) / t).mean()
    assert loss(network.temperature) < loss(1.0)
    assert len(quality.fit(x[:2], np.array([0.0, 1.0]), np.ones(2)).layers) == 4
