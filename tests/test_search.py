"""Search requests over three messages, the query language, dates and text functions."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lettermill.functions import dates, formatting, text
from lettermill.functions.ranks import nearest_rank, plain_nearest_rank
from lettermill.functions.types import ddl
from lettermill.operators import ranking, search
from lettermill.operators.search import SearchRequest
from lettermill.operators.stored_index import NothingIndexed, StoredIndex
from lettermill.schemas import SEARCH_DOCS, SchemaError, validate


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (0, "Alice Example <alice@example.test>", "reader@example.test", "Invoice alpha", ["INBOX", "STARRED"], 1000, None),
        (1, "Bob Example <bob@example.test>", "reader@example.test", "Invoice beta", ["INBOX", "WORK"], 2000, "application/pdf"),
        (2, "Alice Example <alice@example.test>", "other@example.test", "Invoice gamma", ["SENT"], 3000, None),
    ]
    base = spark.createDataFrame(rows, "doc_id long, sender string, recipients string, subject string, labels array<string>, timestamp_ms long, mime string")
    types = F.when(F.col("mime").isNotNull(), F.array("mime")).otherwise(F.array().cast("array<string>"))
    values = {
        "message_id": F.col("doc_id").cast("string"), "body": F.concat(F.col("subject"), F.lit(" body words")), "attachment_types": types, "attachment_mime": types,
        "attachment_family": F.transform(types, lambda x: F.split_part(x, F.lit("/"), F.lit(1))), "attachment_count": F.size(types), "has_attachment": F.size(types),
        "sender_filter": text.address_values("sender"), "recipient_filter": text.address_values("recipients"),
    }
    columns = [values.get(f.name, F.col(f.name) if f.name in base.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SEARCH_DOCS]
    return base.select(*columns).cache()


@pytest.mark.parametrize(
    ("request_", "ids"),
    [
        (SearchRequest(text="invoice", sender="alice", date_to=2500), [0]),
        (SearchRequest(sender="alice@example.test"), [2, 0]),
        (SearchRequest(sender="<ALICE@example.test>", limit=1), [2]),
        (SearchRequest(attachment="with", mime="application/pdf"), [1]),
        (SearchRequest(attachment="with", mime="application/*"), [1]),
        (SearchRequest(attachment="without"), [2, 0]),
        (SearchRequest(labels=("WORK",)), [1]),
        (SearchRequest(labels=("work",)), []),
        (SearchRequest(labels=("INBOX", " STARRED ")), [0]),
        (SearchRequest(labels=(" ",)), [2, 1, 0]),
        (SearchRequest(recipients="reader", date_from=1000, date_to=2000), [0]),
        (SearchRequest(sender="ali"), []),
        (SearchRequest(sender="!!"), [2, 1, 0]),
        (SearchRequest(sender="!!", limit=1), [2]),
        (SearchRequest(text="alpha", recipients="--"), [0]),
        (SearchRequest(text="alpha"), [0]),
        (SearchRequest(), []),
        (SearchRequest(text="invoice", limit=0), []),
        (SearchRequest(text="-"), []),
        (SearchRequest(text="(alpha"), None),
        (SearchRequest(text="gamma OR beta", date_to=2500), [1]),
        (SearchRequest(text='"invoice alpha"'), [0]),
        (SearchRequest(text="alpha invoice", labels=("SENT",)), [2]),
        (SearchRequest(text="subject:alpha"), [0]),
        (SearchRequest(text="+invoice -alpha -beta"), [2]),
        (SearchRequest(text="invoice AND NOT alpha AND NOT sender:bob"), [2]),
        (SearchRequest(text="(alpha OR gamma) AND label:sent"), [2]),
        (SearchRequest(text="nothing"), []),
    ],
)
def test_requests(docs, request_, ids):
    if ids is None:
        with pytest.raises(ranking.QueryError):
            search.search(docs, request_)
    else:
        assert [r["doc_id"] for r in search.search(docs, request_).collect()] == ids


TEXTS = ["invoice", "gamma OR beta", '"invoice alpha"', "alpha invoice", "subject:alpha", "+invoice -alpha -beta", "(alpha OR gamma) AND label:sent", "nothing", '"body words" -gamma', "sender:alice subject:gamma", "-"]


def found(index, request):
    return [(r["doc_id"], r["score"]) for r in index.search(request).collect()]


def wanted(docs, request):
    return [(r["doc_id"], r["score"]) for r in search.search(docs, request).collect()]


def test_stored_index_gives_the_same(spark, docs, tmp_path):
    index = StoredIndex.write(docs, str(tmp_path / "index"))
    again = StoredIndex(spark, str(tmp_path / "index"))
    for text_ in TEXTS:
        request = SearchRequest(text=text_, date_from=0)
        assert found(index, request) == wanted(docs, request), text_
    assert [r["doc_id"] for r in again.search(SearchRequest(sender="alice")).collect()] == [2, 0] and again.search(SearchRequest()).count() == 0
    plan = again.scored("alpha")._jdf.queryExecution().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "body:string" not in plan
    rows = [r.asDict() for r in index.search(SearchRequest(text="alpha invoice")).collect()]
    assert rows == [r.asDict() for r in search.search(docs, SearchRequest(text="alpha invoice")).collect()]


def test_updated_index_equals_a_rebuild(spark, docs, tmp_path):
    new = docs.filter("doc_id = 0").withColumn("doc_id", F.lit(77).cast("long")).withColumn("body", F.lit("beta words of a new message"))
    changed = docs.filter("doc_id = 1").withColumn("body", F.lit("alpha alpha changed body words")).unionByName(new)
    removed = docs.filter("doc_id = 2").select("doc_id")
    index = StoredIndex.write(docs, str(tmp_path / "index")).update(changed, removed)
    want = docs.filter("doc_id not in (1, 2)").unionByName(changed)
    again = index.update(docs.filter("doc_id = 1"), docs.filter("doc_id in (77, 3)").select("doc_id").union(spark.createDataFrame([(12345,)], "doc_id long")))
    then = want.filter("doc_id not in (1, 3)").unionByName(docs.filter("doc_id = 1"))
    for held, projection in ((index, want), (again, then)):
        for one in (held, held.compacted(str(tmp_path / f"compact{held.last}"))):
            assert one.messages.count() == projection.count()
            for text_ in TEXTS + ["changed", "words", "new"]:
                assert found(one, SearchRequest(text=text_)) == wanted(projection, SearchRequest(text=text_)), text_
    last = again.last
    os.rename(tmp_path / f"index/state/generation={last}", tmp_path / "index/unfinished")  # an update that didn't end
    before = StoredIndex(spark, str(tmp_path / "index"))
    assert before.last < last and before.search(SearchRequest(text="alpha")).count() > 0
    both = before.search_all({"a": SearchRequest(text="alpha"), "b": SearchRequest(sender="alice")}).collect()
    assert {r["request"] for r in both} == {"a", "b"}


def made(spark, docs, rows):
    """Messages with these bodies, else like the first of ``docs``."""
    first = docs.filter("doc_id = 0").drop("doc_id", "body")
    return spark.createDataFrame(rows, "doc_id long, body string").crossJoin(first).select(docs.columns)


@pytest.fixture
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_generations_stay_few_and_frequencies_exact(spark, docs, tmp_path, one_partition):
    rng = random.Random(41)
    text = lambda: " ".join(rng.choices("alpha beta gamma delta the of and".split(), k=rng.randint(1, 30)))
    held = {i: text() for i in range(400)}
    index, most = StoredIndex.write(made(spark, docs, [*held.items()]), str(tmp_path / "index")), 0
    for step in range(10):
        changed = {rng.randrange(450): text() for _ in range(12)}
        removed = [i for i in rng.sample(range(450), 5) if i not in changed]
        index = index.update(made(spark, docs, [*changed.items()]), spark.createDataFrame([(i,) for i in removed], "doc_id long"))
        held = {i: t for i, t in held.items() if i not in removed} | changed
        most = max(most, len(index.live))
        if step == 9:
            count = lambda w: sum(w in t.split() for t in held.values())
            df = {r["term"]: r["df"] for r in index.frequencies(["alpha", "the"], ["body"]).collect()}
            assert df == {w: count(w) for w in ("alpha", "the")} and index.n == len(held)
            request = SearchRequest(text="body:alpha body:delta", limit=1000)
            assert found(index, request) == wanted(made(spark, docs, [*held.items()]), request)
    assert 2 <= most <= 6, most
    assert index._gone is not None
    plan = index.postings(index.blocks_of(["alpha"], ["body"]))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    live = index.live
    index.vacuum()
    assert sorted(os.listdir(tmp_path / "index/blocks")) == [f"generation={g}" for g in sorted(live)]
    assert StoredIndex(spark, str(tmp_path / "index")).frequencies(["the"], ["body"]).first()["df"] == sum("the" in t.split() for t in held.values())


def test_the_first_update_of_an_empty_index_is_a_build(spark, docs, tmp_path, monkeypatch):
    import tempfile

    (tmp_path / "scratch").mkdir()
    monkeypatch.setattr(tempfile, "tempdir", str(tmp_path / "scratch"))
    none = spark.createDataFrame([], "doc_id long")
    index = StoredIndex.write(made(spark, docs, []), str(tmp_path / "index"))
    index = index.update(made(spark, docs, [(i, "alpha beta") for i in range(50)]), none)
    assert index.live == [1] and index._gone is None and index.n == 50  # written once, not merged with what was empty
    index = index.update(made(spark, docs, []), made(spark, docs, [(i, "") for i in range(50)]).select("doc_id"))
    assert index.n == 0 and found(index, SearchRequest(text="alpha")) == []
    index = index.update(made(spark, docs, [(3, "alpha")]), none)
    assert index.live == [index.last] and [r[0] for r in found(index, SearchRequest(text="alpha"))] == [3]
    assert index.frequencies(["alpha", "beta"], ["body"]).collect()[0]["df"] == 1
    assert not list((tmp_path / "scratch").rglob("runs"))  # runs go once they are blocks


@pytest.mark.parametrize("small", [True, False])
def test_merges_drop_dead_postings_inside_blocks(spark, docs, tmp_path, monkeypatch, small):
    from lettermill.operators import block_index, blocks

    sent = []
    monkeypatch.setattr(block_index, "is_small", lambda _: small)
    monkeypatch.setattr(block_index, "purged", lambda *a: sent.append(a) or blocks.purged(*a))
    index = StoredIndex.write(made(spark, docs, [(i, f"alpha w{i % 7} alpha" if i % 2 else "the") for i in range(600)]), str(tmp_path / "index"))
    held = {i: f"alpha w{i % 7} alpha" if i % 2 else "the" for i in range(600)}
    for low, high, text in ((0, 40, "beta beta"), (20, 60, "alpha"), (50, 90, "the beta")):  # the younger ones are merged, with an older one left
        index = index.update(made(spark, docs, [(i, text) for i in range(low, high)]), spark.createDataFrame([(high + 5,)], "doc_id long"))
        held = {i: t for i, t in held.items() if i != high + 5} | {i: text for i in range(low, high)}
    assert len(index.live) == 2 and bool(sent) == small
    for one in (index, index.compacted(str(tmp_path / "compact"))):
        rows = {(r["term"], r["doc_id"], r["tf"], r["dl"], tuple(r["positions"])) for r in one.postings(one._held.filter("field = 'body'"), positions=True).collect()}
        assert rows == {(w, i, t.split().count(w), len(t.split()), tuple(k for k, x in enumerate(t.split()) if x == w)) for i, t in held.items() for w in set(t.split())}
        df = {r["term"]: r["df"] for r in one.frequencies(["alpha", "the", "beta", "w3"], ["body"]).collect()}
        assert df == {w: sum(w in t.split() for t in held.values()) for w in ("alpha", "the", "beta", "w3")}


@pytest.mark.parametrize("request_", [SearchRequest(text="body:the", limit=20), SearchRequest(text="body:the body:alpha", limit=7), SearchRequest(text="body:the", limit=9, date_from=2000), SearchRequest(text="beta", limit=3), SearchRequest(text="body:the body:the", limit=20), SearchRequest(text="body:the", limit=10**6), SearchRequest(text="+body:the", limit=5), SearchRequest(text='body:"the the"', limit=5)])
def test_best_blocks_are_enough(spark, docs, tmp_path, monkeypatch, request_):
    rng = random.Random(42)
    text = lambda n: " ".join(rng.choices("the of and alpha beta".split(), [30, 20, 10, 2, 1], k=n))
    rows = [(i, text(rng.randint(1, 60))) for i in range(3000)] + [(i, "the the the") for i in range(5000, 5040)]  # forty that tie
    projection = made(spark, docs, rows).withColumn("timestamp_ms", F.col("doc_id"))
    monkeypatch.setattr("lettermill.operators.stored_index.SKIP_FROM", 0)
    index = StoredIndex.write(projection.filter("doc_id % 9 > 0"), str(tmp_path / "index"))
    index = index.update(projection.filter("doc_id % 9 = 0"), spark.createDataFrame([(7,), (8,)], "doc_id long"))
    assert len(index.live) == 2
    assert found(index, request_) == wanted(projection.filter("doc_id not in (7, 8)"), request_)
    if request_.text == "body:the" and request_.limit == 20:
        used, held = index.best_blocks(request_).count(), index.blocks_of(["the"], ["body"]).count()
        assert 0 < used * 4 < held, (used, held)


def test_open_builds_what_is_missing(spark, docs, tmp_path):
    built = []
    parsed = lambda rows, failed: lambda: (built.append(1), (rows, failed))[1]
    folder = str(tmp_path / "index")
    with pytest.raises(NothingIndexed):
        StoredIndex.open(spark, folder, parsed(docs.limit(0), 3))
    assert StoredIndex.open(spark, folder, parsed(docs.limit(0), 0)).n == 0 and len(built) == 2  # an empty archive has an empty index
    assert StoredIndex.open(spark, folder, parsed(docs, 1)).n == docs.count() and len(built) == 3
    assert StoredIndex.open(spark, folder, parsed(docs.limit(0), 5)).n == docs.count() and len(built) == 3


def test_postings_in_a_row(spark):
    made = spark.createDataFrame([(1, "b a b, c B"), (2, ""), (3, None), (4, "z")], "doc_id long, body string")
    found = {(r["doc_id"], r["term"]): (r["tf"], r["positions"], r["dl"]) for r in ranking.postings(made, ["body"]).collect()}
    assert found == {(1, "a"): (1, [1], 5), (1, "b"): (3, [0, 2, 4], 5), (1, "c"): (1, [3], 5), (4, "z"): (1, [0], 1)}


@pytest.mark.parametrize("bad", ["nofield:x", "(a", "a)", '"open', "subject:"])
def test_bad_queries(docs, bad):
    with pytest.raises(ranking.QueryError):
        ranking.parse(bad) if bad != "subject:" else ranking.parse("subject:(a)")


def test_scores(docs):
    rows = search.search(docs, SearchRequest(text="alpha invoice")).collect()
    assert rows[0]["doc_id"] == 0 and rows[0]["score"] > rows[1]["score"] == rows[2]["score"] and [r["doc_id"] for r in rows[1:]] == [1, 2]
    assert rows[0]["snippet"] == "Invoice alpha body words"


def test_filters_in_the_score(spark, docs, tmp_path):
    import math

    request = SearchRequest(text="invoice", sender="alice", labels=("INBOX",), attachment="without", date_from=0)
    plain = {r["doc_id"]: r["score"] for r in search.search(docs, request).collect()}
    strict = search.search(docs, request, strict_scoring=True).collect()
    rows = {r["doc_id"]: r for r in docs.collect()}
    n = len(rows)

    def term(column, value, i):
        df, mean = sum(value in r[column] for r in rows.values()), sum(len(r[column]) for r in rows.values()) / n
        return math.log(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(rows[i][column]) / mean))

    without = sum(not r["has_attachment"] for r in rows.values())
    want = {i: s + term("sender_filter", "alice", i) + term("labels", "INBOX", i) + math.log(1 + (n - without + 0.5) / (without + 0.5)) + 1 for i, s in plain.items()}
    assert want and {r["doc_id"]: r["score"] for r in strict} == pytest.approx(want, abs=2e-6)
    index = StoredIndex.write(docs, str(tmp_path / "index"))
    assert [tuple(r) for r in index.search(request, strict_scoring=True).collect()] == [tuple(r) for r in strict]
    assert [r["score"] for r in search.search(docs, SearchRequest(text="invoice"), strict_scoring=True).collect()] == [r["score"] for r in search.search(docs, SearchRequest(text="invoice")).collect()]


def test_legacy_line():
    request = search.legacy_request("after:2024-01-01 foo from:a from:b to:c before:nonsense bar:x bar")
    assert request == SearchRequest("foo bar:x bar", "b", "c", dates.parse_date_ms("2024-01-01"), None, limit=20)
    assert SearchRequest(labels=("",)).has_filters() and not SearchRequest(text="x").has_filters()


def test_dates(spark):
    assert dates.parse_date_ms(" 1970-01-02 ") == dates.DAY_MS and dates.parse_date_ms("2024-02-31") == dates.parse_date_ms("2024-03-02")
    assert dates.parse_date_ms("2024-02-31", strict=True) is None and all(dates.parse_date_ms(x) is None for x in ("2024-13-01", "2024-01-32", "2024-01", "2024-1-1-1", "x"))
    assert dates.inclusive_day_end("1970-01-01") == dates.DAY_MS
    rows = spark.createDataFrame([("2024-02-31",), ("2024-13-01",), ("x",), (None,), (" 1970-1-2 ",)], "d string")
    assert [r[0] for r in rows.select(dates.date_ms(F.col("d"))).collect()] == [dates.parse_date_ms("2024-03-02"), None, None, None, dates.DAY_MS]
    shown = spark.createDataFrame([(0,), (None,), (dates.DAY_MS + 61_000,)], "ms long").select(dates.format_ms(F.col("ms")))
    assert [r[0] for r in shown.collect()] == ["unknown", "unknown", "1970-01-02 00:01"]


def test_text_functions(spark):
    from lettermill.operators.mime import html_to_text

    rows = ["<p>a&nbsp;b</p><script>var x='<p>';</script>c <br>www.x.example http://y &amp;lt; <style>p{}</style>d", "plain", "", None, "a < b > c", "<script>never closed", "x<div>y</div>z"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    assert [r[0] for r in df.select(text.html_text("t")).collect()] == [html_to_text(r or "") for r in rows]
    assert df.select(text.html_text("t")).first()[0] == "a b c [lien externe] [lien externe] < d"
    addresses = spark.createDataFrame([("A B <A@x.y>, c@d.e, <f@g.h>",), (None,)], "t string").select(text.address_values("t"))
    assert [r[0] for r in addresses.collect()] == [["a", "a@x.y", "b", "c", "c@d.e", "d", "e", "f", "f@g.h", "g", "h", "x", "y"], []]
    encoded = spark.createDataFrame([("-_8",), ("YQ==",), ("YQ",), ("Y Q",), ("$",), (None,), ("",)], "t string").select(text.decode_base64url("t"))
    assert [None if r[0] is None else bytes(r[0]) for r in encoded.collect()] == [b"\xfb\xff", b"a", b"a", None, None, None, b""]
    assert [r[0] for r in spark.createDataFrame([('["a","b"]',), ("{",), (None,)], "t string").select(text.labels("t")).collect()] == [["a", "b"], [], []]


def test_formatting(spark):
    one = spark.range(1)
    show = lambda c: one.select(c).first()[0]
    assert show(formatting.eml_filename(F.lit("2024-01-01"), F.lit(' a/b:"c"  d. '), F.lit(7))) == "2024-01-01 a_b__c_ d.eml"
    assert show(formatting.eml_filename(F.lit(None).cast("string"), F.lit("con"), F.lit(7))) == "message-7.eml"
    assert len(show(formatting.eml_filename(F.lit("d"), F.lit("x" * 500), F.lit(7)))) == 100
    assert show(formatting.attachment_filename(F.lit(None).cast("string"), F.lit("IMAGE/PNG"), F.lit(3))) == "attachment-3.png"
    assert [show(formatting.human_bytes(F.lit(n))) for n in (0, 1023, 1024, 1536, 1 << 30)] == ["0 B", "1023 B", "1.0 KiB", "1.5 KiB", "1.0 GiB"]
    assert [show(formatting.message_count(F.lit(n), "fr")) for n in (0, 2)] == ["0 message", "2 messages"] and show(formatting.message_count(F.lit(0))) == "0 messages"
    assert show(formatting.key_lines(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")))) == "a=1\nb=2"


def test_nearest_rank(spark):
    values = [3, 1, 2, 9, 9, 4, 4, 4, 0, 7]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    fractions = {f"p{i}": i / 100 for i in (0, 10, 25, 50, 75, 90, 95, 99, 100)}
    assert nearest_rank(df, "v", fractions).first().asDict() == {k: plain_nearest_rank(values, f) for k, f in fractions.items()}
    assert nearest_rank(df.limit(0), "v", {"p50": 0.5}).first()[0] == 0 and plain_nearest_rank([], 0.5) == 0


def test_schemas(spark):
    from pyspark.sql import types as T

    text_ = "a long not null, b array<struct<c: string, d: map<string, double>>>, e decimal(20,0), f binary"
    assert ddl(text_) == T.StructType.fromDDL(text_)
    state = spark.createDataFrame([("a", "1", 1)], ddl("source_account string not null, history_id string not null, complete int not null"))
    validate("gmail_state", state)
    for bad in (state.withColumnRenamed("complete", "done"), state.withColumn("complete", F.lit(1).cast("long")), state.union(state), state.withColumn("history_id", F.lit(None).cast("string"))):
        with pytest.raises(SchemaError):
            validate("gmail_state", bad)
