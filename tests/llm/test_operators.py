"""Every training-data operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows,
empty tables and columns of clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lettermill.llm import bpe, decontaminate, language, pii, queries, site_lines, token_files, url_rules
from lettermill.llm import top_k as top_k_module
from lettermill.llm.components import components
from lettermill.llm.cover_tree import Search, build
from lettermill.llm.decontaminate import contamination
from lettermill.llm.near_dup import near_duplicates
from lettermill.llm.pretokens import PieceLengths, Splitter, ranked
from lettermill.llm.registers import MANTISSA, REGISTERS, WordHashes, band_keys, densified, estimated, raw_registers, shingle_set
from lettermill.llm.token_counts import length_histogram, quantile, truncated_total
from lettermill.llm.top_k import top_k

RANKS, JSON, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, pool=400):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def frame(spark, texts, schema="doc_id long, text string"):
    return spark.createDataFrame(list(enumerate(texts)), schema)


# 1: benchmark decontamination


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def split_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def brute_contamination(texts, items):
    windows = {}
    for item, text in items:
        w = split_words(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(str(item))
    out = []
    for text in texts:
        w, found = split_words(text), set()
        hit = [False] * len(w)
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if owners := windows.get(tuple(w[i : i + size])):
                    found |= owners
                    hit[i : i + size] = [True] * size
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((len(w), sum(hit), len(found), digest, sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return out


@pytest.mark.parametrize(("bits", "most"), [(32, 1 << 24), (1, 0)])  # few words pass the filter, and tables are broadcast; or neither
def test_contamination_equals_brute_force(spark, monkeypatch, bits, most):
    monkeypatch.setattr("lettermill.llm.decontaminate.BITS", bits)
    monkeypatch.setattr("lettermill.llm.decontaminate.LEAST_BITS", 1 << (15 if bits > 1 else 3))
    monkeypatch.setattr("lettermill.llm.shared.BROADCAST_BYTES", most)
    rng = random.Random(1)
    items = [(2, " ".join(words(rng, 30))), (10, "Éa b"), (11, "solo"), (12, None), (13, "..."), (14, " ".join(words(rng, 13))), (10, "second text of ten"), (None, "w1 w2")]
    long = " ".join(words(rng, 20_000))
    texts = [None, "", "...", "Solo!", "nothing here", items[0][1].upper(), items[0][1] + " x " * 700 + items[5][1], "éa B", "Éa, b. solo", long + " " + items[5][1], " ".join(split_words(items[0][1])[3:16]), "solo " * 50]
    texts.append(texts[5])
    docs = frame(spark, texts).withColumn("n_words", F.lit("mine")).withColumn("row", F.lit(1)).withColumn("tags", F.create_map(F.lit("k"), F.col("doc_id")))
    found = contamination(docs, spark.createDataFrame(items, "item_id long, text string")).orderBy("doc_id").collect()
    assert [(r["n_words"], r["row"], r["text"], r["tags"]) for r in found] == [("mine", 1, t, {"k": i}) for i, t in enumerate(texts)]
    assert [tuple(r["contamination"][c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in found] == brute_contamination(texts, [i for i in items if i[0] is not None])


def test_large_benchmarks_take_no_more_scans(spark, monkeypatch):
    """Each document holds windows of two of many items; a passage of all of them is a window of a thousand items."""
    rng = random.Random(24)
    shared = " ".join(words(rng, 20, 10**6))
    items = [(i, " ".join(words(rng, 40, 10**6)) + (" " + shared if i % 2 else "")) for i in range(2000)]
    texts = [" ".join(words(rng, 100)) + " " + " ".join(items[i][1].split()[5:20]) + " zz " + " ".join(items[i + 1][1].split()[:14]) for i in range(0, 300, 2)] + [shared, "clean " * 50]
    scans, counted = [], decontaminate._counted
    monkeypatch.setattr(decontaminate, "_counted", lambda shared: (scans.append(1), counted(shared))[1])
    found = contamination(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).orderBy("doc_id").collect()
    assert len(scans) == 1
    assert [tuple(r["contamination"][c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in found] == brute_contamination(texts, items)
    assert found[150]["contamination"]["n_items"] == 1000


def test_contamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = frame(spark, ["a b", None])
    assert [r["contamination"]["contaminated"] for r in contamination(docs, none).collect()] == [False, False]
    assert contamination(docs.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


# 2: language ID


def languages(rng, n):
    pools = {"aa": "kal mor tif sun".split(), "bb": "ßeh zün örk lüm".split(), "cc": "quo vie çon eau".split()}
    rows = []
    for i in range(n):
        lang = sorted(pools)[i % 3]
        rows.append((i, " ".join(rng.choice(pools[lang]) + rng.choice(pools[lang]) for _ in range(rng.randint(1, 60))), lang))
    return rows


def test_language_of_held_out_rows(spark):
    rows = languages(random.Random(3), 300) + [(900, None, "aa"), (901, "", "bb"), (902, "123 !!", "aa"), (903, "kal mor", None), (0, "kal mor", "aa"), (904, "kalmor " * 30_000, "aa"), (905, "🙂 zünörk", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("language", F.lit(1)).withColumn("score", F.lit("mine"))
    model = language.train(docs, ~language.held_out())
    assert model.languages == ["aa", "bb", "cc"]
    assert (model.weights == 0).mean() > 0.1, model.weights  # L1
    found = {r["doc_id"]: r for r in language.identify(docs, model).filter("doc_id > 0").collect()}
    assert all(0 <= r["language"]["score"] <= 1 and r["score"] == "mine" for r in found.values())
    held = [r for r in rows if r[0] and zlib.crc32(str(r[0]).encode()) % 4 == 2 and r[0] < 900]
    assert len(held) > 50 and np.mean([found[i]["language"]["lang_pred"] == lang for i, _, lang in held]) > 0.97
    assert {i: found[i]["language"]["lang_pred"] for i in (900, 901, 902, 904, 905)} == {900: "und", 901: "und", 902: "und", 904: "aa", 905: "bb"}
    assert language.held_out().__class__ and docs.filter(language.held_out()).filter("doc_id < 300 and doc_id > 0").count() == len(held)


def test_language_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = language.train(docs, F.lit(True))
    assert [tuple(r["language"]) for r in language.identify(docs, model).collect()] == [("und", 0.0)]
    assert language.identify(docs.limit(0), model).count() == 0


def test_every_labelled_language_is_learned(spark):
    rng = random.Random(4)
    rows = [(i, text, lang) for i, text, lang in languages(rng, 90) if lang != "cc"]
    rows += [(1000 + i, " ".join(rng.choices("quo vie çon eau".split(), k=3000)) + " 123" * 3000, "cc") for i in range(30)]  # only long ones
    rows += [(2000 + i, "12 34", "dd") for i in range(20_000)] + [(50_000 + i, " ".join(rng.choices("şiğ böy gür ıpt".split(), k=20)), "dd") for i in range(30)]  # few with letters
    rows += [(60_000, "wjk xwq " * 5, "ee")] * 20_000  # copies of one row
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language.train(docs, F.lit(True))
    assert model.languages == ["aa", "bb", "cc", "dd", "ee"] and (model.bias != 0).all()
    told = {"kalmor tif": "aa", "zünörk ßeh": "bb", "çon vie quo eau": "cc", "şiğ böy gür": "dd"}
    assert {text: model.predict(text)[0] for text in told} == told


def test_very_many_languages_are_learned(spark):
    rng = random.Random(15)
    rows = [(i, "".join(rng.choices("abcdefghijklmnop", k=30)), f"l{i:03d}") for i in range(600)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert len(model.languages) == 600


def test_language_with_one_row_is_trained(monkeypatch):
    trained, ftrl = [], language._ftrl
    monkeypatch.setattr(language, "_ftrl", lambda model, examples: (trained.extend(k for *_, k in examples), ftrl(model, examples)))
    model = language.fit([("çon quo", "cc"), *((f"kal mor {'tif ' * i}", "aa") for i in range(30))])  # the first row is set aside
    assert {model.languages[k] for k in trained} == {"aa", "cc"}


@pytest.mark.parametrize("known", [4, 5, 10])
def test_calibration_sees_every_language_and_none_that_trains(monkeypatch, known):
    rng = random.Random(known)
    rows = [("".join(rng.choices("abcdefghijklmnop", k=30)), f"l{k}") for _ in range(60) for k in range(known)]  # by turns, as train() orders them
    trained, ftrl = [], language._ftrl
    monkeypatch.setattr(language, "_ftrl", lambda model, examples: (trained.extend((at.tobytes(), k) for at, _, k in examples), ftrl(model, examples)))
    model = language.fit(rows)
    found = [(at.tobytes(), k) for (at, _), k in ((model.counted(t), model.languages.index(lang)) for t, lang in rows)]
    aside = [x for x in found if x not in set(trained)]
    assert [sum(k == j for _, k in trained) for j in range(known)] == [48] * known
    assert [sum(k == j for _, k in aside) for j in range(known)] == [12] * known


def test_weights_equal_a_plain_ftrl():
    """The published per-coordinate update, one number at a time."""
    import math

    rows = [(t, lang) for _, t, lang in languages(random.Random(19), 30)]
    model = language.fit(rows)
    texts = list(dict.fromkeys(rows))
    told = {lang: k for k, lang in enumerate(model.languages)}
    examples = [(*model.features(t), told[lang]) for t, lang in texts]
    place = [sum(lang == other for _, other in texts[: i + 1]) for i, (_, lang) in enumerate(texts)]  # within the language
    aside = [x for x, at in zip(examples, place, strict=True) if at % language.CALIBRATION == 0]
    examples = [x for x, at in zip(examples, place, strict=True) if at % language.CALIBRATION]
    z, n = {}, {}

    def weight(key, l1):
        if abs(z.get(key, 0.0)) <= l1:
            return 0.0
        sign = math.copysign(1.0, z[key])
        return (sign * l1 - z[key]) / ((language.BETA + math.sqrt(n[key])) / language.ALPHA + language.L2)

    order = np.random.default_rng(0)
    for _ in range(language.PASSES):
        for i in order.permutation(len(examples)):
            at, x, truth = examples[i]
            keys = [*zip(at.tolist(), x.tolist(), strict=True), (None, 1.0)]  # the bias has no L1
            held = [{f: weight((f, k), 0.0 if f is None else language.L1) for f, _ in keys} for k in range(len(told))]
            scores = [sum(v * held[k][f] for f, v in keys) for k in range(len(told))]
            total = sum(math.exp(s - max(scores)) for s in scores)
            for k, score in enumerate(scores):
                error = math.exp(score - max(scores)) / total - (k == truth)
                for f, v in keys:
                    g, before = v * error, n.get((f, k), 0.0)
                    z[f, k] = z.get((f, k), 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / language.ALPHA * held[k][f]
                    n[f, k] = before + g * g
    plain = np.array([[weight((f, k), language.L1) for k in range(len(told))] for f in range(len(model.idf))])
    assert np.allclose(model.weights, plain) and np.allclose(model.bias, [weight((None, k), 0.0) for k in range(len(told))])
    def loss(temperature):
        out = 0.0
        for at, x, truth in aside:
            scores = (x @ model.weights[at] + model.bias) / temperature
            out -= scores[truth] - scores.max() - math.log(sum(math.exp(s - scores.max()) for s in scores))
        return out

    assert loss(model.temperature) <= min(map(loss, np.geomspace(0.05, 20, 121))) + 1e-9


def test_pieces_of_long_texts(spark):
    texts = ["a🙂\n" * 5000, "1 " * 10_000 + "b", "c"]
    rows = spark.createDataFrame(list(enumerate(texts)), "place long, text string")
    found = [r[0] for r in rows.select(language._piece(F.col("text"), F.col("place"))).collect()]
    assert found[0] in texts[0] and len(found[0]) in (3000, language.CHARS) and found[1:] == ["b", "c"]


def test_temperature_and_pieces(monkeypatch):
    model = language.fit([(t, lang) for _, t, lang in languages(random.Random(5), 120)])
    assert 0.05 <= model.temperature <= 20
    text = "kalmor zünörk çoneau " * 40
    whole = model.features(text)
    monkeypatch.setattr(language, "PIECE", 17)
    parts = model.features(text)
    assert all(np.allclose(a, b) for a, b in zip(whole, parts, strict=True))


# 3: personal data

E_MAIL, I_P, C_ARD, P_HONE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"


def brute_pii(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(E_MAIL, text)]
    out += [("ip", *m.span()) for m in re.finditer(I_P, text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(C_ARD, text) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(P_HONE, text) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    pool = ["a", "B", "1", "2", "55", "192.168.1.1", "@", "@x.com", ".", "-", " ", "+", "+1 (", "4111111111111111", "4111 1111-1111 1111", "(", ")", "é", "%", "0049", "256.1.1.1"]
    for _ in range(4000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 25)))
        assert sorted(pii.base_spans(text)) == sorted(brute_pii(text)), text
    assert pii.base_spans("9" * 50_000) == [] and pii.base_spans("1." * 20_000 + "+1" * 20_000 + "a@" * 20_000) == brute_pii("1." * 20_000)


def test_skip_chain_adds_similar_mentions(spark):
    sample = [f"call +49 30 12345{i:04d} or mail jo.doe{i}@x.org from 10.0.0.{i % 200} order {i * 7919 + 10_000_000}" for i in range(200)]
    field = pii.fit(sample)
    text = "call +49 30 123456789 then 004930123456789, mail jane.doe@x.org or jane.doe (at) x.org; jane.doe knows. order 99887766"
    base, spans = pii.all_spans(text, field)
    assert {text[a:b] for _, a, b in set(spans) - set(base)} == {"004930123456789", "jane.doe (at) x.org", "jane.doe"}
    assert set(base) <= set(spans) and pii.all_spans("order 99887766 and 99887766", field) == ([], [])
    rows = [(1, text), (2, None), (3, ""), (4, "x" * 200_000 + " a@b.cd"), (1, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_email", F.lit("mine")).withColumn("pii", F.lit(0))
    found = pii.personal_data(docs, pii.train(docs)).orderBy("doc_id").collect()
    assert [(r["pii"]["n_email"], r["pii"]["base"], r["n_email"]) for r in found[2:]] == [(0, "", "mine"), (0, "", "mine"), (1, "email:200001:200007", "mine")]
    assert found[0] == found[1] and found[0]["pii"]["n_phone"] == 1
    assert pii.personal_data(docs.limit(0), field).count() == 0


def test_beliefs_equal_enumeration_on_trees():
    """Message passing is exact where the mentions form a tree: each belief against the sum over all labellings."""
    import itertools

    rng = np.random.default_rng(20)
    cases = [["+49 30 1234567", "10.0.0.1", "order 1234567"], ["jane.doe@x.org", "5551234567", "4111 1111 1111 1111", "12.34.5678"], ["0049301234567", "+49301234567"], ["7654321"]]
    for mentions in cases:
        for given in ([None] * len(mentions), [4] + [None] * (len(mentions) - 1)):
            field = pii.Field(rng.normal(size=(14, 5)), 1.5, 0.4)
            unary = np.array([pii._features(m) for m in mentions]) @ field.unary
            edges = {(i, i + 1): field.skip if pii._keys(mentions[i]) & pii._keys(mentions[i + 1]) else field.chain for i in range(len(mentions) - 1)}
            mass = np.zeros((len(mentions), 5))
            for labels in itertools.product(range(5), repeat=len(mentions)):
                if any(g is not None and g != x for g, x in zip(given, labels, strict=True)):
                    continue
                score = sum(0.0 if g is not None else unary[i, x] for i, (g, x) in enumerate(zip(given, labels, strict=True)))
                score += sum(w for (i, j), w in edges.items() if labels[i] == labels[j])
                for i, x in enumerate(labels):
                    mass[i, x] += np.exp(score)
            mass /= mass.sum(axis=1, keepdims=True)
            for (label, belief), truth in zip(field.labels(mentions, given), mass, strict=True):
                assert label == truth.argmax() and abs(belief - truth.max()) < 1e-3


def slow_locals(text, wanted):
    out = []
    for local in wanted:
        if len(local) >= 5:
            out += [m.span() for m in re.finditer(rf"(?<![A-Za-z0-9._%+@-]){re.escape(local)}(?![A-Za-z0-9_%+@-])", text)]
    return sorted(out)


def test_local_parts_equal_a_search_for_each():
    rng = random.Random(14)
    pool = ["jane.doe", "jane", ".", "..", "doe12", "@", "-", " ", "x", "é", "jane.", "%", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 20)))
        wanted = {"".join(rng.choice(pool[:5] + pool[6:7] + pool[10:12]) for _ in range(rng.randint(1, 3))) for _ in range(4)}
        assert sorted(pii._locals(text, wanted)) == slow_locals(text, wanted), (text, wanted)


def test_many_addresses_stay_linear():
    import time

    text = " and ".join(f"user{i:05d}.x@example{i % 7}.org, or user{i:05d}.x (at) example.org, user{i:05d}.x" for i in range(20_000))
    began = time.perf_counter()
    base, spans = pii.all_spans(text, pii.fit([text[:20_000]]))
    assert len(base) == 20_000 and time.perf_counter() - began < 60
    text = "a." * 100_000 + " ".join("b." * n + "c@x.org" for n in range(1, 600))
    began = time.perf_counter()
    assert len(pii.base_spans(text)) == 599 and pii.other_mentions(text, pii.base_spans(text)) == [] and time.perf_counter() - began < 20


def test_field_learns_from_rare_personal_data(spark, monkeypatch):
    monkeypatch.setattr(pii, "SAMPLE", 40)
    rows = [(i, "plain words only") for i in range(3000)] + [(5000 + i, f"mail jo.doe{i}@x.org or call +49 30 12345{i:04d}") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert pii.train(docs).skip > 0
    assert pii.train(docs.limit(0)).skip == 0 and pii.personal_data(docs.limit(0), pii.train(docs.limit(0))).count() == 0
    like = re.compile(pii.LIKELY)
    assert all(like.search(t) for t in ("1.2.3.4", "4111 1111 1111 1111", "+1234567 8", "+1 (2) 345678"))


def test_field_learns_from_long_documents_only(spark):
    def text(i, filler):
        phone = f"+49 30 12345{i:04d}"
        return f"call {phone} or {phone[1:].replace(' ', '')} or {phone.replace(' ', '-')[1:]} soon{filler}"

    texts = {n: [text(i, " plain words only" * n) for i in range(60)] for n in (0, 1300)}
    for n in texts:
        docs = frame(spark, texts[n])
        field = pii.train(docs)
        assert field.skip > 5, (n, field.skip)
        added = [r["pii"]["spans"].count("phone") - r["pii"]["n_phone"] for r in pii.personal_data(docs, field).collect()]
        assert set(added) == {2}, n
    long = spark.createDataFrame([("x" * 50_000 + " a@b.org " + "y" * 50_000, 1), ("z" * 30_000, 2), ("w " * 15_000, 3), ("s", 4)], "text string, place long")
    pieces = [r[0] for r in long.select(pii._piece(F.col("text"), F.col("place"))).collect()]
    assert "a@b.org" in pieces[0] and all(0 < len(p) <= pii.CHARS for p in pieces) and pieces[3] == "s"


def test_many_equal_mentions_stay_linear():
    field = pii.Field(np.zeros((14, 5)), 2.0, 0.1)
    assert len(field.labels(["+49 30 1234567"] * 5000, [4] + [None] * 4999)) == 5000


# 4: token counts


def test_histogram_answers_every_limit(spark):
    texts = [None, "", "a", "b", "hello world", "hello world " * 900, "  \n", "é" * 50, "a"]
    sizes = [len(ranked(RANKS, PATTERN).encode_ordinary(t or "")) for t in texts]
    assert sizes == [PieceLengths(RANKS, PATTERN).of(t) for t in texts]
    histogram = length_histogram(frame(spark, texts).withColumn("n_docs", F.lit(7)), RANKS, PATTERN).cache()
    for row in histogram.collect():
        n = row["n_tokens"]
        assert (row["n_docs"], row["docs_at_least"], row["tokens_at_least"]) == (sizes.count(n), sum(s >= n for s in sizes), sum(s for s in sizes if s >= n))
        assert row["truncated_tokens"] == sum(min(s, n) for s in sizes) and row["tokens_total"] == sum(sizes) and row["docs_total"] == len(sizes)
    for limit in (0, 1, 5, 100, 10**6):
        assert truncated_total(histogram, limit).first()[0] == sum(min(s, limit) for s in sizes)
    for share in (0.1, 0.5, 0.9, 1.0):
        assert quantile(histogram, share).first()[0] == min(s for s in sizes if sum(x <= s for x in sizes) >= share * len(sizes))
    empty = length_histogram(frame(spark, texts).limit(0), RANKS, PATTERN)
    assert empty.count() == 0 and truncated_total(empty, 5).first()[0] == 0 and quantile(empty, 0.5).first()[0] is None


def test_lengths_of_long_runs(spark):
    texts = [" " * 2_000_000, "\n" * 1_200_000, " " * 1_000_000 + "end", "a" * 500_000 + " b" * 100]
    found = length_histogram(frame(spark, texts), RANKS, PATTERN).collect()
    piece = ranked(RANKS, PATTERN)._encode_single_piece
    sizes = [len(piece(texts[0].encode())), len(piece(texts[1].encode())), len(piece(b" " * 999_999)) + len(piece(b" end")), len(piece(b"a" * 500_000)) + 100 * len(piece(b" b"))]
    assert {r["n_tokens"]: r["n_docs"] for r in found} == {n: sizes.count(n) for n in sizes}


def test_lengths_equal_the_library():
    rng, length = random.Random(13), PieceLengths(RANKS, PATTERN).of
    pool = [" ", "   ", "\n", "the", "Zé", "東京", "'re", "12345", "!?", "🙂", "qzx", "\u00a0", "<|endoftext|>"]
    for _ in range(500):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))
        assert length(text) == len(ranked(RANKS, PATTERN).encode_ordinary(text)), text


# 5: line dedup


def test_boilerplate_lines_go(spark):
    rows = [(i, f"line {i}\n  Menu \n\nend {i}", "h1") for i in range(40)] + [(100 + i, f"Menu\nother {i}", "h2") for i in range(9)]
    rows += [(200, None, "h1"), (201, "", "h1"), (202, "Menu", None), (203, "Menu\nMenu\nrest", "h1"), (203, "Menu\nMenu\nrest", "h1"), (204, "y" * 300_000 + "\nMenu", "h1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string").withColumn("n_lines", F.lit(1)).withColumn("marks", F.lit(2)).withColumn("mark", F.lit(3))
    found = {r["doc_id"]: r for r in site_lines.drop_boilerplate(docs, F.col("host")).collect()}
    assert found[3]["text"] == "line 3\n\nend 3" and (found[3]["n_lines"], found[3]["n_dropped"]) == (4, 1)
    assert found[100]["text"] == "other 0"  # on all nine pages of its host
    assert (found[200]["text"], found[200]["n_lines"]) == (None, 0) and found[201]["text"] == "" and found[202]["text"] == "Menu"
    assert found[203]["text"] == "rest" and found[204]["n_dropped"] == 1 and found[3]["marks"] == 2 and found[3]["mark"] == 3
    assert site_lines.drop_boilerplate(docs, F.col("host")).count() == len(rows)
    assert site_lines.drop_boilerplate(docs.limit(0), F.col("host")).count() == 0


def test_small_hosts_lose_lines_by_ratio(spark, tmp_path):
    import duckdb

    rows = [(i, f"Menu\nother {i}", "nine") for i in range(9)] + [(100 + i, f"Foot\nother {i}", "three") for i in range(3)] + [(200 + i, f"Top\nother {i}", "two") for i in range(2)]
    rows += [(400, "Alone\nonly", "one")]
    rows += [(300 + i, ("Rare\n" if i < 3 else "Often\n" if i < 7 else "") + f"other {i}", "thirty") for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: tuple(r) for r in queries.op5_site_lines(spark, str(tmp_path)).select("doc_id", "n_lines", "n_dropped", "text_md5").collect()}
    assert {i for i, r in found.items() if r[2]} == {*range(9), *range(100, 103), *range(303, 307)}
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert set(duck.execute(queries.oracle_sql()["op5_site_lines"]).fetchall()) == set(found.values())
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("lang", F.lit("aa"))
    assert corpus_pipeline.line_dedup(spark, docs, str(tmp_path)).filter("text like '%Menu%' or text like '%Foot%' or text like '%Often%'").count() == 0


# 6: exact top-k


def brute_top(rows, queries, k):
    whole = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole[i] = [int(np.floor(256 * float(np.float32(x)))) for x in v]
    out = set()
    for q in queries:
        if q in whole:
            scores = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
            out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)}
    return out


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr("lettermill.llm.top_k.BLOCK", 100)
    monkeypatch.setattr("lettermill.llm.top_k.TREE", 40)
    monkeypatch.setattr("lettermill.llm.top_k.CELL", 60)
    monkeypatch.setattr("lettermill.llm.top_k.QUERIES", 3)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 8))
    rows = [(i, [float(x) for x in (centres[i % 5] + rng.normal(size=8) * (0.01 if i % 3 else 0.5))]) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(60)]  # ties
    rows += [(500, None), (501, [1.0, None] + [0.0] * 6), (502, [float("nan")] * 8), (503, [float("inf")] * 8), (505, [0.0] * 8), (504, [1.0, 2.0]), (550, [3.0, 1.0]), (None, rows[1][1]), rows[50], (0, rows[0][1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("mine")).withColumn("v", F.lit(1))
    found = top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5).collect()
    assert {tuple(r) for r in found} == brute_top(rows, range(0, 600, 50), 5) and len(found) == len(set(found))
    assert top_k(vectors.limit(0), vectors, 5).count() == 0 and top_k(vectors, vectors.limit(0), 5).count() == 0
    few = vectors.filter("vec_id in (1, 2)")
    assert {r["vec_id"] for r in top_k(few, few, 5).collect()} == {1, 2}


def test_top_k_prunes_whole_cells(spark, monkeypatch):
    monkeypatch.setattr("lettermill.llm.top_k.CELL", 20)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 8)) * 10
    rows = [(i, [float(x) for x in centres[i % 30] + rng.normal(size=8) * 0.01]) for i in range(900)] + [(1000 + i, [float(x) for x in centres[0]]) for i in range(500)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    sent, asked = [], top_k_module._searched_in
    monkeypatch.setattr(top_k_module, "_searched_in", lambda asked_, *rest: (sent.append(asked_.count()), asked(asked_, *rest))[1])
    queries = vectors.filter("vec_id % 50 = 0")
    found = top_k(vectors, queries, 5).collect()
    assert {tuple(r) for r in found} == brute_top(rows, [i for i, _ in rows if i % 50 == 0], 5)
    assert sent[1] < 10 * sent[0], sent  # of 70 cells


def test_top_k_of_huge_components(spark):
    rows = [(1, [1e300, 1.0]), (2, [1e300, -1.0]), (3, [3e16, 2.0]), (4, [2e7, 5.0]), (5, [-1e300, 0.0]), (6, [3e16, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    top, low = 2**63 - 1, -(2**63)
    whole = {i: [max(low, min(top, int(np.floor(256 * x)) if abs(x) < 1e290 else (top if x > 0 else low))) for x in v] for i, v in rows}
    want = set()
    for q in whole:
        scores = sorted((-max(low, min(top, sum(a * b for a, b in zip(whole[q], v, strict=True)))), i) for i, v in whole.items() if i != q)
        want |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:3], 1)}
    assert {tuple(r) for r in top_k(vectors, vectors, 3).collect()} == want


def test_cover_tree_prunes_and_covers():
    rng = np.random.default_rng(5)
    vectors = np.concatenate([rng.normal(size=6) * 100 + rng.normal(size=(60, 6)) for _ in range(20)])
    root, seen = build(vectors), []

    def walk(node):
        assert np.sqrt(((vectors[node.points] - node.centre) ** 2).sum(axis=1)).max() <= node.radius + 1e-9
        seen.extend(node.held.tolist())
        for child in node.children:
            assert child.radius <= node.radius
            walk(child)

    walk(root)
    assert sorted(seen) == list(range(len(vectors)))
    search = Search(vectors[:10].astype(np.int64), np.arange(10), 3)
    compared = []
    compare = search._compare
    search._compare = lambda rows, columns: (compared.append(len(rows) * len(columns)), compare(rows, columns))
    search.add(vectors.astype(np.int64), np.arange(len(vectors)))
    assert sum(compared) < 10 * len(vectors)


# 7: URL rules


def brute_url(url, rules):
    rest = (url or "").partition("://")[2]
    host = lower(re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(host) :], re.S)[0]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"), key=lambda x: x[:2])
    return host, path, best[2], best[3]


def test_url_rules_equal_brute_force(spark):
    rng = random.Random(6)
    rules = url_rules.RULES + [("a.com", "/", "block"), ("b.a.com", "/x/", "allow"), ("b.a.com", "/x/y", "block"), ("a-b.com", "/", "block"), ("org", "", "block"), ("", "/", "block"), (None, "/", "block")]
    hosts = ["a.com", "b.a.com", "B.A.com", "xa.com", "a-b.com", "www.example.com", "example.com", "q.example.net", "net", "x.org", "c.b.a.com", "a.com:80", ".com", "a.com.", ""]
    paths = ["", "/", "/x/", "/x/yz", "/en/1", "/es/", "/fr/2?u=1", "?q=/en/", "#/en/", "/en", "/é/", "/x/y/../z"]
    urls = [f"{s}{rng.choice(hosts)}{rng.choice(paths)}" for s in ("http://", "HTTPS://", "", "x://y://") for _ in range(150)] + [None, "", "://", "no scheme", "http://a.com/" + "p" * 50_000] + ["http://hot.example.com/en/"] * 300
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, "http://a.com/")], "page_id long, url string").withColumn("host", F.lit(1)).withColumn("key", F.lit(2)).withColumn("html", F.lit("h"))
    found = {r["page_id"]: tuple(r)[1:] for r in url_rules.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    sound = [r for r in rules if r[0]]
    assert found == {i: brute_url(u, sound) for i, u in [*enumerate(urls), (None, "http://a.com/")]}
    assert url_rules.judge(pages.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0
    assert url_rules.judge(pages, spark.createDataFrame([], "host string, path string, verdict string")).filter("rule is null and verdict = 'allow'").count() == len(urls) + 1


# 8: token files

ODD = [None, "", "hello world", "  two  spaces \n\n\t tab", "naïve café 東京 🙂🙂", "<|endoftext|> x", "a<|endoftext|>b<|endoftext|><|endoftext|> <|endoftext", "!" * 300, "don't I'll we've", "\x1c\x1d a\u00a0b\u2003c", "z" * 3000, "𝒜𝓑 x", "hello world"]


def test_token_files_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_IDS", 500)
    rng = random.Random(7)
    rows = [(i * 3 % 101, t) for i, t in enumerate(ODD + [" ".join(words(rng, rng.randint(0, 400))) for _ in range(60)])] + [(None, "null id"), (7, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("mine")).repartition(3)
    library = Tokenizer.from_file(JSON)  # as it comes
    assert library.encode("a<|endoftext|>b", add_special_tokens=False).ids == [64, 50256, 65]
    folder = str(tmp_path / "tokens")
    token_files.write_token_files(docs, JSON, PATTERN, folder)
    found = [tuple(r) for r in token_files.read_token_files(spark, folder).orderBy("start").collect()]
    want, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert found == want
    files = [token_files.SequenceFile(str(p)) for p in sorted((tmp_path / "tokens").glob("part-*"))]
    assert len(files) > 5
    stream = np.concatenate([ids[mask.to_numpy(zero_copy_only=False)] for f in files for n in range(sum(f.batch(b).num_rows for b in range(f.file.num_record_batches))) for ids, mask in [f[n]]])
    assert len(stream) == start and all(len(f[0][0]) == token_files.LENGTH and not f[0][0].flags.owndata for f in files)
    assert token_files.token_files(docs.limit(0), JSON, PATTERN).count() == 0


# 9: near duplicates


def brute_groups(texts, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("percent", "chunk"), [(85, 256), (80, 4)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, percent, chunk):
    monkeypatch.setattr("lettermill.llm.near_dup.CHUNK", chunk)
    monkeypatch.setattr("lettermill.llm.near_dup.PAIRED", 12 if chunk > 100 else 1)
    monkeypatch.setattr("lettermill.llm.shared.BROADCAST_BYTES", 1 << 24 if chunk > 100 else 0)
    rng = random.Random(8)
    texts = [None, "", "  \t", "one", "One", "one two", "a b c d e f", "a b c d e f"]
    for size in (7, 10, 11, 12, 60, 300):
        base = words(rng, size, 10**6)
        for edits in (0, 0, 1, 1, 1, 2, 3, 5, 8, 13):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(copy).upper() if edits == 1 else "\n".join(copy))
        texts.append(" ".join(base[1:]))
        texts.append(" ".join([*base, "tail"]))
    base = words(rng, 80, 10**6)
    for _ in range(120):  # a chain of edits: only some pairs are near enough
        base[rng.randrange(80)] = f"c{rng.randrange(10**6)}"
        texts.append(" ".join(base))
    texts += [" ".join(words(rng, 20_000)), "same thing said here by many people today"] + ["same thing said here by many people today"] * 40
    docs = frame(spark, texts).withColumn("rep", F.lit(0)).withColumn("fp", F.lit("x")).withColumn("n_shingles", F.lit(None).cast("string"))
    found = {r["doc_id"]: r for r in near_duplicates(docs, percent).collect()}
    assert [(found[i]["n_shingles"], found[i]["component_id"], found[i]["kept"]) for i in range(len(texts))] == [(n, c, c == i) for i, (n, c) in enumerate(brute_groups(texts, percent))]


def shuffled(spark):
    """Bytes that the session's executors have written to shuffles so far."""
    listed = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(listed.apply(i).totalShuffleWrite() for i in range(listed.size()))


@pytest.mark.parametrize("repeated", [False, True])
def test_near_copies_cost_in_proportion(spark, repeated):
    base = words(random.Random(16), 120, 10**6)
    cost = []
    for n in (5_000, 20_000):
        rng = random.Random(17)
        texts = []
        for _ in range(n):
            copy = list(base)
            copy[rng.randrange(120)] = f"e{rng.randrange(10**9)}"
            texts.append(" ".join(copy))
        rows = [*enumerate(texts), *[(0, "another text under an id that is taken")] * repeated]
        docs, before = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), shuffled(spark)
        found = near_duplicates(docs, 80).filter("component_id = 0 or doc_id > 0").agg(F.count_distinct("component_id"), F.count_if("kept")).first()
        cost.append(shuffled(spark) - before)
        assert tuple(found) == (1, 1 + repeated)  # both rows of the repeated id
    assert cost[1] < 6 * cost[0], cost  # chunks held against each other would make it 16 times


def test_near_duplicates_beside_a_large_component(spark, monkeypatch):
    monkeypatch.setattr("lettermill.llm.near_dup.CHUNK", 16)
    rng = random.Random(18)
    base, texts = words(rng, 60, 10**6), []
    for i in range(150):  # copies of one text, and some of them drift away from it
        copy = list(base)
        for _ in range(1 if i < 100 else rng.randint(2, 9)):
            copy[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    found = {r["doc_id"]: r["component_id"] for r in near_duplicates(frame(spark, texts), 80).collect()}
    assert [found[i] for i in range(len(texts))] == [c for _, c in brute_groups(texts, 80)]


def test_texts_of_one_id_are_one_document(spark):
    rng = random.Random(22)
    a, b, c = (words(rng, 60, 10**6) for _ in range(3))
    near = lambda base, i: " ".join([*base[:i], f"x{i}", *base[i + 1 :]])
    a, b, c = (" ".join(x) for x in (a, b, c))
    rows = [(5, a), (5, b), (5, b), (9, near(a.split(), 7)), (8, near(b.split(), 9)), (3, b), (20, a), (30, c), (31, near(c.split(), 3)), (31, near(a.split(), 30)), (40, "alone here"), (5, ""), (50, c)]
    found = {(r["doc_id"], r["n_shingles"] > 0): (r["component_id"], r["kept"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect()}
    assert found == {(i, True): (3, i == 3) for i in (3, 5, 8, 9, 20, 30, 31, 50)} | {(40, True): (40, True), (5, False): (5, True)}


def test_very_many_texts_of_one_id(spark):
    rng = random.Random(23)
    texts = [" ".join(words(rng, 30, 10**6)) for _ in range(3000)]
    rows = [(7, t) for t in texts] + [(i + 100, t + " tail") for i, t in enumerate(texts[:50])] + [(3, "some text of its own that nothing else has")]
    before = shuffled(spark)
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 80).collect()
    assert {(r["doc_id"], r["component_id"]) for r in found} == {(7, 7), (3, 3), *((i + 100, 7) for i in range(50))} and len(found) == len(rows)
    assert shuffled(spark) - before < 40 * sum(len(t) for _, t in rows)  # not a row for each pair of its texts


def test_near_duplicates_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (9, "a b c")], "doc_id long, text string")
    found = sorted(map(tuple, near_duplicates(docs).collect()), key=str)
    assert found == sorted([(None, 1, None, True), (5, 1, 5, True), (5, 1, 5, True), (9, 1, 5, False)], key=str)
    assert near_duplicates(docs.limit(0)).count() == 0


def test_registers():
    hashes = WordHashes()
    rng = random.Random(9)
    base = words(rng, 4000, 10**7)
    a, b = (shingle_set(" ".join(x).encode(), hashes) for x in (base, base[400:] + words(rng, 400, 10**7)))
    filled = densified(np.stack([raw_registers(a), raw_registers(b)]))
    truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(estimated(*filled) - truth) < 0.2 and (filled > 0).all() and raw_registers(a).max() < (54 << MANTISSA) + 2
    small = densified(raw_registers(a[:3])[None])
    assert small.shape == (1, REGISTERS) and (small > 0).all() and len(set(band_keys(small)[0].tolist())) == 24
    assert not densified(raw_registers(a[:0])[None]).any()


def test_components(spark):
    rng = random.Random(10)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(80)]
    parent = list(range(500))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 10: byte-level BPE


def test_bpe_equals_the_library_and_decodes(spark):
    rng = random.Random(11)
    texts = ODD + [" ".join(words(rng, 300)) for _ in range(30)] + ["the very same"] * 50 + ["q" * 20_000 + " end"]
    docs = frame(spark, texts).withColumn("block", F.lit("mine")).withColumn("row", F.lit(2)).withColumn("token_ids", F.lit(0))
    encoding = ranked(RANKS, PATTERN)
    found = {r["doc_id"]: r for r in bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        assert np.frombuffer(found[i]["token_ids"], "<u4").tolist() == encoding.encode_ordinary(text or "")
        assert bytes(found[i]["token_bytes"]) == (text or "").encode() and found[i]["text"] == text and (found[i]["block"], found[i]["row"]) == ("mine", 2)
    both = {r["doc_id"]: r for r in bpe.encode(docs, RANKS, PATTERN, columns=["doc_id"], decoded=True).collect()}
    assert all(both[i]["token_ids"] == found[i]["token_ids"] and both[i]["token_bytes"] == found[i]["token_bytes"] for i in range(len(texts)))
    assert bpe.encode(docs.limit(0), RANKS, PATTERN).count() == 0


def test_bpe_of_rows_repeated_very_often(spark, monkeypatch):
    monkeypatch.setattr(bpe, "REPEATED", 20)
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    docs = frame(spark, ["the very same text"]).select("doc_id", "text", F.explode(F.sequence(F.lit(1), F.lit(90)))).drop("col").union(frame(spark, [None, "other", "text"]))
    docs = docs.union(spark.createDataFrame([(7, None)] * 30, "doc_id long, text string")).withColumn("_lm", F.lit("mine"))
    encoding = ranked(RANKS, PATTERN)
    found = bpe.encode(docs, RANKS, PATTERN, decoded=True).collect()
    want = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    assert sorted((r["doc_id"], r["text"] or "") for r in found) == want and found[0].asDict().keys() == {"doc_id", "text", "_lm", "token_ids", "token_bytes"}
    assert all(np.frombuffer(r["token_ids"], "<u4").tolist() == encoding.encode_ordinary(r["text"] or "") for r in found)


def test_bpe_of_rows_with_maps(spark, monkeypatch):
    monkeypatch.setattr(bpe, "REPEATED", 3)
    docs = frame(spark, ["same text"] * 8 + [None, "other"]).select("text", F.create_map(F.lit("a"), F.lit(1)).alias("tags"), F.array(F.create_map(F.lit(1), F.lit("x"))).alias("nested"))
    found = bpe.encode(docs, RANKS, PATTERN, decoded=True).collect()
    assert sorted(((r["text"], bytes(r["token_bytes"]).decode()) for r in found), key=str) == sorted([("same text", "same text")] * 8 + [(None, ""), ("other", "other")], key=str)
    assert all(r["tags"] == {"a": 1} and r["nested"] == [{1: "x"}] for r in found)


def test_splitter_equals_the_pattern():
    import regex

    split, pattern = Splitter(PATTERN), regex.compile(PATTERN)
    rng = random.Random(12)
    pool = [" ", "  ", "\n", "'s", "'", "a", "Zé", "9", "½", "東", "_", "\u3000", "\x1c", "\x85", "🙂", "́", "ǅ", "Ⅷ", "!"]
    for _ in range(3000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 20)))
        assert split(text) == pattern.findall(text) and "".join(split(text)) == text
