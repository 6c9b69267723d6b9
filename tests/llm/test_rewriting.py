"""Fill-in-middle rewriting and periodic runs against brute-force versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lettermill.llm import fim, periodic, queries

TEXTS = [None, "", " ", "a", "ab cd", "  ab\n\ncd  ", "naïve café – ok", "x<P>y", "a <S> b", "<", "<P", "<M>", "<PP>", "< P>", "<p>", "<S<M>", "日本語 text 日本", "a" * 5000 + " " + "é" * 3000]


def brute_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.DOTALL)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def fields(row):
    return row["n"], row["form"], row["prefix_chars"], row["middle_chars"], row["output"]


def test_fill_in_middle_equals_brute_force(spark):
    rng = random.Random(1)
    made = ["".join(rng.choice("abXY<PSM> \né日") for _ in range(rng.randrange(40))) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(TEXTS * 8 + made)] + [(None, "no id"), (7, "twice"), (7, "twice")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fim string, row int")
    found = fim.fill_in_middle(docs)
    got = found.withColumn("back", fim.restored(found["fim.form"], found["fim.output"])).collect()
    assert sorted(map(repr, ((r["doc_id"], fields(r["fim"])) for r in got))) == sorted(map(repr, ((i, brute_fim(i, t)) for i, t in rows)))
    assert all(r["back"] == (r["text"] or "") and r["row"] == 1 for r in got)
    assert {r["fim"]["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).collect() == []


@pytest.mark.parametrize("piece", [1, 2, 3, 7])
def test_pieces_of_a_text_join(monkeypatch, piece):
    monkeypatch.setattr(fim, "PIECE", piece)
    rng = random.Random(piece)
    for i in range(300):
        text = "".join(rng.choice("ab<PSM> é日😀") for _ in range(rng.randrange(30)))
        n, form, prefix, middle, output = fim.rewritten(text.encode(), fim.drawn(i))
        assert (n, form, prefix, middle, output.decode()) == brute_fim(i, text)


def brute_runs(words):
    """Every period's longest stretches, and of equal stretches that with the smallest period."""
    best = {}
    for p in range(1, len(words) // 4 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(6, 4 * p):
                best.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted(((s, n, p) for (s, n), p in best.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90))
def test_runs_equal_brute_force(words):
    assert periodic.runs(np.array(words, np.int32)) == brute_runs(words)


@pytest.mark.parametrize("probes", [8, 1 << 20])
def test_nested_and_adjacent_runs(monkeypatch, probes):
    monkeypatch.setattr(periodic, "PROBES", probes)
    rng = random.Random(5)
    for _ in range(150):
        words = []
        while len(words) < rng.randrange(1, 400):
            unit = [rng.randrange(4) for _ in range(rng.randrange(1, 30))]
            if rng.random() < 0.4:  # a unit that holds a run of its own
                unit = unit[:3] * 5 + unit
            words += unit * rng.randrange(1, 8) + [rng.randrange(40) for _ in range(rng.randrange(6))]
        assert periodic.runs(np.array(words, np.int32)) == brute_runs(words)


def test_long_texts_of_one_word_and_of_long_periods():
    assert periodic.runs(np.zeros(30_000, np.int32)) == [(0, 30_000, 1)]
    unit = np.random.default_rng(0).integers(0, 50, 5000).astype(np.int32)
    assert (0, 25_000, 5000) in periodic.runs(np.tile(unit, 5))


def brute_periodic(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    found = brute_runs(words)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    return [list(r) for r in found], *best, " ".join(w for i, w in enumerate(words) if i not in gone)


def test_periodic_texts_equal_brute_force(spark):
    texts = [*TEXTS, "a b " * 9, "x y " * 8, "a a a a a a", "a a a a a", "q " + "la " * 7 + "so " * 7, ("a b a b a b a b c " * 5).strip(), "same", "same"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, periodic string")
    found = {r["doc_id"]: (*r["periodic"], r["text"]) for r in periodic.periodic_runs(docs).collect()}
    for i, text in enumerate(texts):
        runs, start, length, period, collapsed, kept = found[i]
        assert ([list(r) for r in runs], start, length, period, collapsed, kept) == (*brute_periodic(text), text)
    assert periodic.periodic_runs(docs.limit(0)).collect() == []


def test_every_tenth_document_is_planted(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(80)))) for i in range(400)] + [(None, "a b"), (1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    planted = {r["doc_id"]: r["text"] for r in periodic.planted(docs).collect()}
    changed = 0
    for i, text in rows:
        h = zlib.crc32(str(i).encode())
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        if i is not None and h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            assert planted[i] == " ".join(words[a + (j - a) % p if j >= a else j] for j in range(n))
            changed += 1
        else:
            assert planted[i] == text
    assert changed > 20
    for row in queries.op13_periodic_runs(spark, str(tmp_path)).collect():
        runs, start, length, period, collapsed = brute_periodic(planted[row["doc_id"]])
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        assert (row["n_runs"], row["start"], row["length"], row["period"]) == (len(runs), start, length, period)
        assert row["exponent_milli"] == (None if length is None else 1000 * length // period)
        assert (row["runs_sha256"], row["collapsed_sha256"]) == tuple(hashlib.sha256(x.encode()).hexdigest() for x in (lines, collapsed))
