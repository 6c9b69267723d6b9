"""The FTS5 dialect against SQLite's own engine, where it is compiled in."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from lettermill.operators import fulltext
from lettermill.operators.block_index import _after
from lettermill.operators.fulltext_index import FulltextIndex
from lettermill.operators.ranking import QueryError

SCHEMA = "doc_id long, timestamp_ms long, " + ", ".join(f"{c} string" for c in fulltext.COLUMNS)


def engine(rows):
    held = sqlite3.connect(":memory:")
    try:
        held.execute(f"create virtual table docs using fts5(doc_id unindexed, {', '.join(fulltext.COLUMNS)}, tokenize='unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("SQLite without FTS5")
    held.executemany(f"insert into docs(rowid, doc_id, {', '.join(fulltext.COLUMNS)}) values (?, ?, ?, ?, ?, ?, ?, ?)", [(r[0], r[0], *r[2:]) for r in rows])
    return held


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    pool = "alpha beta gamma delta epsilon Ééa naïve the plan-review x1 x12 été".split()
    text = lambda n: " ".join(rng.choice(pool) for _ in range(rng.randint(0, n)))
    return [(i + 1, i * 10, text(3), text(2), text(5), text(40), rng.choice(["Inbox", "Sent"]), f"account-{i % 4}") for i in range(150)]


QUERIES = [
    "alpha", "ALPHA", "eea", "ete", "alpha beta", "alpha AND beta", "alpha OR beta", "alpha NOT beta", "alpha beta NOT gamma", "alpha OR beta NOT gamma", "alpha AND beta OR gamma delta", '"alpha beta"', "alpha + beta", "x1*", '"alpha x"*',
    "alpha + x1 *", "subject:alpha", "subject : alpha beta", "{subject body}: alpha", "-body: alpha", "-{body subject} : alpha", "subject:(alpha OR beta)", "body: (alpha AND subject: beta)", "^alpha", "body: ^alpha", "^alpha + beta", "NEAR(alpha beta, 2)",
    "NEAR(alpha beta)", "NEAR(alpha beta gamma, 4)", 'NEAR("alpha beta" gamma, 1)', "(alpha OR beta) AND gamma", "(alpha)", '"account-1"', '"plan-review"', "nothing", "alpha NOT (beta OR gamma)", "folder:sent alpha", "the the", 'alpha "" beta', "NEAR(alpha, 3)",
]


@pytest.mark.parametrize("query", QUERIES)
def test_equals_the_engine(spark, rows, query):
    found = fulltext.search(spark.createDataFrame(rows, SCHEMA), query, limit=1000).collect()
    want = engine(rows).execute("select rowid, bm25(docs) from docs where docs match ?", (query,)).fetchall()
    assert {r["doc_id"] for r in found} == {i for i, _ in want}
    scores = dict(want)
    assert all(abs(r["score"] - scores[r["doc_id"]]) < 2e-6 for r in found)
    assert [r["score"] for r in found] == sorted(r["score"] for r in found)


@pytest.fixture(scope="module")
def indexes(spark, rows, tmp_path_factory):
    """All rows, as built at once, and after updates that changed and removed some."""
    docs = spark.createDataFrame(rows, SCHEMA)
    whole = FulltextIndex.write(docs, str(tmp_path_factory.mktemp("whole")))
    other = docs.withColumn("body", F.lit("alpha other text beta"))
    updated = FulltextIndex.write(other.filter("doc_id < 140").unionByName(docs.filter("doc_id >= 140").withColumn("doc_id", F.col("doc_id") + 1000)), str(tmp_path_factory.mktemp("updated")))
    updated = updated.update(docs.filter("doc_id < 70"), docs.select((F.col("doc_id") + 1000).alias("doc_id"))).update(docs.filter("doc_id >= 70"), docs.limit(0).select("doc_id"))
    return whole, updated


@pytest.mark.parametrize("query", [*QUERIES, "^x*", "e*", '"gamma del"*', "NEAR(al* beta, 3)", "-subject: x1 *"])
def test_index_gives_the_same(spark, rows, indexes, query):
    want = [tuple(r) for r in fulltext.search(spark.createDataFrame(rows, SCHEMA), query, limit=1000).collect()]
    for index in indexes:
        assert [tuple(r) for r in index.search(query, limit=1000).collect()] == want
    some = [tuple(r) for r in fulltext.search(spark.createDataFrame(rows, SCHEMA), query, 200, 900, limit=5).collect()]
    assert [tuple(r) for r in indexes[0].search(query, 200, 900, limit=5).collect()] == some


def test_index_reads_no_texts(spark, indexes):
    index = indexes[0]
    plan = index.blocks_of(["beta"], ["body"], ["alp"])._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "GreaterThanOrEqual(term,alp)" in plan
    assert {r["term"] for r in index.blocks_of([], ["body"], ["alp"]).collect()} == {"alpha"}
    assert index.search(" ").collect() == [] and index.search("nothing").collect() == [] and index.search('""').collect() == []
    with pytest.raises(QueryError):
        index.search("(alpha")


def test_ends_of_prefixes():
    assert _after("ab") == "ac" and _after("a\ud7ff") == "a\ue000" and _after("a\U0010ffff") == "b" and _after("\U0010ffff") is None


@pytest.mark.parametrize("query", ["zzzz-never-generated", "account:account-1", "nocolumn:x", "(alpha", "alpha)", '"open', "alpha AND", "OR alpha", "NOT alpha", "*", "alpha @ beta", "NEAR(alpha beta, x)", "{subject alpha", "subject:", "- alpha"])
def test_errors_are_the_engine_s(rows, query):
    with pytest.raises(QueryError):
        fulltext.parse(query)
    with pytest.raises(sqlite3.OperationalError):
        engine(rows).execute("select rowid from docs where docs match ?", (query,)).fetchall()


def test_dates_and_limits(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    every = {r["doc_id"]: r["score"] for r in fulltext.search(docs, "alpha", limit=1000).collect()}
    some = fulltext.search(docs, "alpha", start=100, end=600, limit=1000).collect()
    assert {r["doc_id"]: r["score"] for r in some} == {i: s for i, s in every.items() if 100 <= (i - 1) * 10 <= 600}
    assert fulltext.search(docs, "alpha").count() == 20 and fulltext.search(docs, " ").count() == 0 and fulltext.search(docs.limit(0), "alpha").count() == 0
