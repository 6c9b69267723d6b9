"""The pipeline stage by stage: each stage's decisions take effect, clean documents and columns stay."""

import random

import numpy as np
import pytest

import corpus_pipeline
from lettermill.llm import language, queries
from lettermill.llm.pretokens import ranked

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    pools = {"aa": "kal mor tif sun", "bb": "ßeh zün örk lüm"}
    prose = lambda lang, n: " ".join("".join(rng.choice(pools[lang].split()) for _ in range(3)) for _ in range(n))
    rows = [(i, prose(lang := ("aa", "bb")[i % 2], 60) + f"\nMenu\nend {i}", lang, f"src{i % 3}", 0) for i in range(120)]
    item = prose("aa", 40)
    rows += [(200, rows[4][1], "aa", "src1", 0), (201, rows[5][1] + " more", "bb", "src1", 0), (202, item, "aa", "src2", 0), (203, "12 34", "aa", "src2", 0), (204, None, None, None, None), (205, "kalmor", "aa", "src0", 6)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    gone = [{203, 204}, set(), {200, 201}, {202}]
    for (name, stage), lost in zip(corpus_pipeline.STAGES, gone, strict=False):
        after = stage(spark, docs, folder)
        assert after.columns == COLUMNS, name
        ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
        assert ids(docs) - ids(after) == lost, name
        docs = spark.createDataFrame(after.collect(), docs.schema)
        if name == "line_dedup":
            assert docs.filter("text like '%Menu%'").count() == 0 and docs.filter("doc_id = 205").first()["n_chars"] == 6
            assert docs.filter("doc_id = 3 and n_chars = length(text)").count() == 1
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert len(out) == docs.count()
    encoding = ranked(queries.public_tokenizers.path("byte_bpe_50k.tiktoken"), queries.public_tokenizers.PATTERN)
    assert all(out[r["doc_id"]]["n_tokens"] == len(encoding.encode_ordinary(r["text"])) for r in docs.collect())


def test_run_equals_brute_force(spark, folder):
    """Every stage by plain Python over all it is given, in a row; only the language model is the pipeline's own."""
    import hashlib
    from collections import Counter, defaultdict

    from .test_operators import brute_contamination, brute_groups

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = language.train(docs, ~language.held_out())
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    least = corpus_pipeline.LEAST_SCORE * min(1, corpus_pipeline.CHANCES / len(model.languages))
    rows = [r for r in rows if (found := model.predict(r[1]))[0] != "und" and found[1] >= least]
    pages, on = Counter(r[2] for r in rows), defaultdict(Counter)
    for _, text, host in rows:
        on[host].update({x.strip(" ") for x in text.split("\n")} - {""})
    keeps = lambda line, host: not line.strip(" ") or host is None or on[host][line.strip(" ")] < 3 or on[host][line.strip(" ")] <= 0.1 * pages[host]
    rows = sorted((i, "\n".join(x for x in text.split("\n") if keeps(x, host))) for i, text, host in rows)
    groups = brute_groups([t for _, t in rows], corpus_pipeline.SIMILAR)
    rows = [r for n, (r, (_, group)) in enumerate(zip(rows, groups, strict=True)) if group == n]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    rows = [r for r, verdict in zip(rows, brute_contamination([t for _, t in rows], items), strict=True) if not verdict[-1]]
    encode = ranked(queries.public_tokenizers.path("byte_bpe_50k.tiktoken"), queries.public_tokenizers.PATTERN).encode_ordinary
    want = {i: (len(ids := encode(t)), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows}
    found = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, folder).collect()}
    assert found == want and 100 < len(want) < docs.count()


def test_stages_keep_columns_of_any_name(spark, folder):
    from pyspark.sql import functions as F

    names = ["language", "contamination", "n_lines", "n_dropped", "row", "rep", "fp", "spans", "a b", "component_id", "kept", "pii"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 20")
    docs = docs.union(docs.filter("doc_id = 3")).select("*", *[F.lit(f"mine {n}").alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.schema.simpleString() == docs.schema.simpleString(), name
        rows = after.collect()
        assert len(rows) == 21 and all(r[n] == f"mine {n}" for r in rows for n in names), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == 21


def test_stages_on_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    assert [stage(spark, docs, folder).count() for _, stage in corpus_pipeline.STAGES] == [0] * 5


def test_unlabelled_documents_stay(spark, folder):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    after = corpus_pipeline.language_id(spark, docs, folder)
    assert after.columns == COLUMNS and after.count() == docs.count() - 2
    assert after.filter("doc_id in (203, 204)").count() == 0


def test_least_score_follows_the_number_of_languages(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 20")
    for n, kept in ((4, 0), (20, 20)):  # models that give their first language 0.28 for any text
        bias = np.log([0.28] + [0.72 / (n - 1)] * (n - 1))
        model = language.Model([f"l{i}" for i in range(n)], np.zeros(1 << language.BITS, np.int32), np.zeros(0), np.zeros((0, n)), bias, 1.0)
        monkeypatch.setattr(language, "train", lambda *_, model=model: model)
        assert corpus_pipeline.language_id(spark, docs, folder).count() == kept


def test_registered_queries():
    names = queries.queries()
    assert sorted({int(n[2:].split("_")[0]) for n in names}) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)
