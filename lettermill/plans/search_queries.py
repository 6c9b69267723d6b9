"""Search over ``documents`` as messages, and filters over the other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import fulltext, ranking, search
from ..operators.search import SearchRequest
from ..operators.fulltext_index import FulltextIndex
from ..operators.stored_index import StoredIndex
from ..session import scratch_folder, table
from .registry import query
from .views import MESSAGES, START_MS, STEP_MS, bm25_sql, messages, tokens_sql

_DAY = dates.DAY_MS
_FIELDS = {"body": ("body", 1.0)}


def _ids(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "score")


def _filtered(where: str, limit: int = 50) -> str:
    return f"with {MESSAGES.strip()} select doc_id, 0.0::double as score from messages where {where} order by timestamp_ms desc, doc_id limit {limit}"


@query(_filtered(f"list_contains(labels, 'en') and timestamp_ms >= {START_MS + 10 * _DAY} and timestamp_ms < {START_MS + 60 * _DAY}"))
def search_filter_newest(spark: SparkSession, folder: str) -> DataFrame:
    request = SearchRequest(labels=("en",), date_from=START_MS + 10 * _DAY, date_to=START_MS + 60 * _DAY)
    return _ids(search.search(messages(spark, folder), request))


@query(bm25_sql(["erth"], _FIELDS))
def search_text_bm25(spark: SparkSession, folder: str) -> DataFrame:
    return _ids(search.search(messages(spark, folder, all_cores=True), SearchRequest(text="body:erth")))


@query(bm25_sql(["erth", "thion", "apache"], _FIELDS))
def search_text_multi(spark: SparkSession, folder: str) -> DataFrame:
    return _ids(search.search(messages(spark, folder, all_cores=True), SearchRequest(text="body:erth body:thion body:Apache")))


@query(bm25_sql(["src3", "license"], {"sender": ("sender", 1.0), "recipients": ("recipients", 1.0), "subject": ("subject", 1.0), "body": ("body", 1.0), "account": ("account", 1.0), "label": ("array_to_string(labels, ' ')", 1.0), "attachment_type": ("coalesce(mime, '')", 1.0), "attachment_text": ("''", 0.7)}))
def search_text_default_fields(spark: SparkSession, folder: str) -> DataFrame:
    return _ids(search.search(messages(spark, folder, all_cores=True), SearchRequest(text="src3 license")))


@query(bm25_sql(["erth"], _FIELDS, f"timestamp_ms >= {START_MS + 30 * _DAY} and timestamp_ms < {START_MS + 200 * _DAY}"))
def search_text_date(spark: SparkSession, folder: str) -> DataFrame:
    return _ids(search.search(messages(spark, folder, all_cores=True), SearchRequest(text="body:erth", date_from=START_MS + 30 * _DAY, date_to=START_MS + 200 * _DAY)))


@query(bm25_sql(["license"], _FIELDS, "list_contains(labels, 'STARRED')"))
def search_text_label(spark: SparkSession, folder: str) -> DataFrame:
    return _ids(search.search(messages(spark, folder, all_cores=True), SearchRequest(text="body:license", labels=("STARRED",))))


@query(bm25_sql(["license"], _FIELDS, "starts_with(mime, 'image/')"))
def search_text_mime_family(spark: SparkSession, folder: str) -> DataFrame:
    return _ids(search.search(messages(spark, folder, all_cores=True), SearchRequest(text="body:license", mime="IMAGE/*")))


_PHRASE = f"""
with {MESSAGES.strip()},
tok as (select doc_id, {tokens_sql("body")} as toks from messages),
stats as (select count(*) as n, sum(len(toks)) / count(*) as avgdl, count(*) filter (list_contains(toks, 'apache')) as d0, count(*) filter (list_contains(toks, 'license')) as d1 from tok),
hit as (
  select doc_id, len(toks) as dl, len(list_filter(generate_series(1, len(toks) - 1), lambda i: toks[i] = 'apache' and toks[i + 1] = 'license')) as tf from tok
)
select doc_id, round((ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) + ln(1 + (n - d1 + 0.5) / (d1 + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) as score
from hit, stats where tf > 0 order by score desc, doc_id limit 50
"""


@query(_PHRASE)
def search_phrase(spark: SparkSession, folder: str) -> DataFrame:
    return _ids(search.search(messages(spark, folder, all_cores=True), SearchRequest(text='body:"Apache License"')))


@query(f"""
with {MESSAGES.strip()}, tok as (select doc_id, {tokens_sql("body")} as toks from messages)
select doc_id from tok where list_contains(toks, 'license') and not list_contains(toks, 'apache') and (list_contains(toks, 'erth') or list_contains(toks, 'the'))
""")
def search_boolean(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.scored(messages(spark, folder, all_cores=True), "+body:license -body:apache +(body:erth OR body:the)").select("doc_id")


@query(_filtered("account = 'src7'"))
def search_address_exact(spark: SparkSession, folder: str) -> DataFrame:
    return _ids(search.search(messages(spark, folder), SearchRequest(sender="<SRC7@mail.example>")))


@query(_filtered("account = 'src3' and lang = 'fr'"))
def search_address_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return _ids(search.search(messages(spark, folder), SearchRequest(sender="Src3 sender", recipients="fr")))


@query(_filtered("mime is not null"))
def search_attachment_with(spark: SparkSession, folder: str) -> DataFrame:
    return _ids(search.search(messages(spark, folder), SearchRequest(attachment="with")))


@query(_filtered("mime is null"))
def search_attachment_without(spark: SparkSession, folder: str) -> DataFrame:
    return _ids(search.search(messages(spark, folder), SearchRequest(attachment="without")))


@query(_filtered("mime = 'application/pdf'"))
def search_mime_exact(spark: SparkSession, folder: str) -> DataFrame:
    return _ids(search.search(messages(spark, folder), SearchRequest(mime=" Application/PDF ")))


@query(_filtered("list_contains(labels, 'de') and list_contains(labels, 'STARRED')"))
def search_labels_all_of(spark: SparkSession, folder: str) -> DataFrame:
    return _ids(search.search(messages(spark, folder), SearchRequest(labels=("de", " STARRED ", " "))))


@query(_filtered(f"account = 'src2' and timestamp_ms >= {START_MS} and timestamp_ms < {START_MS + 91 * _DAY}", 20))
def search_legacy_line(spark: SparkSession, folder: str) -> DataFrame:
    return _ids(search.search_line(messages(spark, folder), "after:2020-01-01 from:nobody from:src2 before:2020-04-01"))


@query("select 0::bigint as doc_id, 0.0::double as score where false")
def search_empty_request(spark: SparkSession, folder: str) -> DataFrame:
    return _ids(search.search(messages(spark, folder), SearchRequest()))


@query(f"with {MESSAGES.strip()} select doc_id, substr(body, 1, 180) as snippet from messages")
def search_snippet(spark: SparkSession, folder: str) -> DataFrame:
    return messages(spark, folder).select("doc_id", text.snippet("body").alias("snippet"))


@query(f"with {MESSAGES.strip()} select count(*) as n from messages where timestamp_ms between {START_MS} and {START_MS + 90 * STEP_MS}")
def date_count(spark: SparkSession, folder: str) -> DataFrame:
    return search.date_count(messages(spark, folder), START_MS, START_MS + 90 * STEP_MS)


@query(f"with {MESSAGES.strip()} select doc_id, 1.0::double as score from messages where timestamp_ms between {START_MS} and {START_MS + 90 * STEP_MS} order by doc_id limit 20")
def date_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.date_search(messages(spark, folder), START_MS, START_MS + 90 * STEP_MS)


@query("select o_orderkey, epoch_ms(o_orderdate) as order_ms from orders where o_orderdate >= timestamp '1995-03-01' and o_orderdate < timestamp '1995-04-02'")
def date_range_half_open(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").withColumn("order_ms", F.unix_millis(F.col("o_orderdate").cast("timestamp")))
    start, end = dates.parse_date_ms("1995-03-01"), dates.inclusive_day_end("1995-04-01")
    return orders.filter(search.date_clause("order_ms", start, end)).select("o_orderkey", "order_ms")


@query("""
select o_orderkey, day, case when day between 1 and 31 then epoch_ms((make_date(year(o_orderdate), month(o_orderdate), 1) + (day - 1)::integer)::timestamp) else -1 end as ms
from (select o_orderkey, o_orderdate, o_orderkey % 33 as day from orders)
""")
def date_overflow_parse(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").withColumn("day", F.col("o_orderkey") % 33)
    written = F.concat_ws("-", F.year("o_orderdate").cast("string"), F.month("o_orderdate").cast("string"), F.col("day").cast("string"))
    return orders.select("o_orderkey", "day", F.coalesce(dates.date_ms(written), F.lit(-1)).alias("ms"))


@query("select distinct lang as label from documents union select 'STARRED' from documents where doc_id % 5 = 0")
def label_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return search.distinct_labels(messages(spark, folder))


@query(f"""
with {MESSAGES.strip()}, t as (select doc_id, 'subject' as field, {tokens_sql("subject")} as toks from messages union all select doc_id, 'body', {tokens_sql("body")} from messages)
select doc_id, field, term, count(*)::integer as tf, md5(string_agg(pos::varchar, ',' order by pos)) as positions, any_value(dl)::integer as dl
from (select doc_id, field, unnest(toks) as term, unnest(generate_series(0, len(toks) - 1))::integer as pos, len(toks) as dl from t) group by doc_id, field, term
""")
def index_postings(spark: SparkSession, folder: str) -> DataFrame:
    rows = ranking.postings(messages(spark, folder, all_cores=True), ["subject", "body"])
    return rows.select("doc_id", "field", "term", "tf", F.md5(F.array_join(F.col("positions").cast("array<string>"), ",")).alias("positions"), "dl")


_FIELD_TEXTS = {"sender": "sender", "recipients": "recipients", "subject": "subject", "body": "body", "account": "account", "label": "array_to_string(labels, ' ')", "attachment_type": "coalesce(mime, '')", "attachment_text": "''", "folder": "''"}


@query(f"with {MESSAGES.strip()} " + " union all ".join(f"select '{f}' as field, count(*) as n, round(sum(len(toks)) / count(*), 6) as avgdl from (select {tokens_sql(x)} as toks from messages)" for f, x in _FIELD_TEXTS.items()))
def index_field_stats(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.field_stats(messages(spark, folder, all_cores=True), list(_FIELD_TEXTS)).select("field", "n", F.round("avgdl", 6).alias("avgdl"))


@query("select c_custkey, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(translate(c_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))), ' ') as values_ from customer")
def address_values(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select("c_custkey", F.array_join(text.address_values("c_name"), " ").alias("values_"))


def _stored(spark: SparkSession, folder: str) -> StoredIndex:
    return StoredIndex.write(messages(spark, folder, all_cores=True), scratch_folder(spark))


@query(bm25_sql(["erth", "thion", "apache"], _FIELDS, f"timestamp_ms >= {START_MS + 30 * _DAY} and timestamp_ms < {START_MS + 200 * _DAY}"))
def stored_search_bm25(spark: SparkSession, folder: str) -> DataFrame:
    request = SearchRequest(text="body:erth body:thion body:Apache", date_from=START_MS + 30 * _DAY, date_to=START_MS + 200 * _DAY)
    return _ids(_stored(spark, folder).search(request))


@query(_PHRASE)
def stored_search_phrase(spark: SparkSession, folder: str) -> DataFrame:
    return _ids(_stored(spark, folder).search(SearchRequest(text='body:"Apache License"')))


@query(f"""
with {MESSAGES.strip()}, tok as (select *, {tokens_sql("body")} as toks from messages),
t as (select *, len(toks) as dl, len(list_filter(toks, lambda x: x = 'license')) as tf, case when mime is null then 0 else 1 end as n_mime from tok),
stats as (select count(*) as n, sum(dl) / count(*) as avgdl, count(*) filter (tf > 0) as df, count(*) filter (list_contains(labels, 'STARRED')) as d_label, avg(len(labels)) as m_label, count(*) filter (mime = 'image/png') as d_mime, avg(n_mime) as m_mime from t)
select doc_id, round(round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) + ln(1 + (n - d_label + 0.5) / (d_label + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(labels) / m_label))
  + ln(1 + (n - d_mime + 0.5) / (d_mime + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * n_mime / m_mime)) + 1, 6) as score
from t, stats where tf > 0 and list_contains(labels, 'STARRED') and mime = 'image/png' and timestamp_ms >= {START_MS} order by score desc, doc_id limit 50
""")
def search_strict_scoring(spark: SparkSession, folder: str) -> DataFrame:
    request = SearchRequest(text="body:license", labels=("STARRED",), mime="image/png", date_from=START_MS)
    return _ids(search.search(messages(spark, folder, all_cores=True), request, strict_scoring=True))


_PLAIN = "strip_accents(lower({x}))"


def _fulltext_sql(holds: str, counts: dict[str, str], dates: str = "true") -> str:
    """Rows of the full-text dialect's search: ``counts`` are its phrases' numbers in a row, by name."""
    columns = ("sender", "recipients", "subject", "body", "account")
    cut = lambda c: f"list_filter(regexp_split_to_array({_PLAIN.format(x=c)}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    sums = " + ".join(f"ln((n - d_{k} + 0.5) / (d_{k} + 0.5)) * f_{k} * 2.2 / (f_{k} + 1.2 * (0.25 + 0.75 * length / mean))" for k in counts)
    return f"""
with {MESSAGES.strip()},
cut as (select doc_id, timestamp_ms, {", ".join(f"{cut(c)} as t_{c}" for c in columns)} from messages),
tok as (select *, {" + ".join(f"len(t_{c})" for c in columns)} as length from cut),
found as (select doc_id, timestamp_ms, length, {", ".join(f"{x} as f_{k}" for k, x in counts.items())} from tok),
stats as (select count(*) as n, sum(length) / count(*) as mean, {", ".join(f"count(*) filter (f_{k} > 0) as d_{k}" for k in counts)} from found)
select doc_id, round(-({sums}), 6) as score from found, stats where {holds} and {dates} order by score, doc_id limit 20
"""


def _word_sql(word: str, columns: tuple[str, ...] = ("sender", "recipients", "subject", "body", "account")) -> str:
    return " + ".join(f"len(list_filter(t_{c}, lambda x: x = '{word}'))" for c in columns)


def _pair_sql(first: str, second: str) -> str:
    return f"len(list_filter(generate_series(1, len(t_body) - 1), lambda i: t_body[i] = '{first}' and t_body[i + 1] = '{second}'))"


def _fulltext(spark: SparkSession, folder: str) -> FulltextIndex:
    return FulltextIndex.write(messages(spark, folder, all_cores=True), scratch_folder(spark))


@query(_fulltext_sql("f_a > 0 and f_b > 0", {"a": _word_sql("license"), "b": _word_sql("apache")}))
def fulltext_and(spark: SparkSession, folder: str) -> DataFrame:
    return _fulltext(spark, folder).search("License AND apache")


@query(_fulltext_sql("f_a > 0", {"a": _pair_sql("apache", "license")}))
def fulltext_phrase(spark: SparkSession, folder: str) -> DataFrame:
    return _fulltext(spark, folder).search('body : "apache license"')


@query(_fulltext_sql("(f_a > 0 or f_b > 0)", {"a": "len(list_filter(t_body, lambda x: starts_with(x, 'apach')))", "b": _pair_sql("apache", "license")}, f"timestamp_ms between {START_MS} and {START_MS + 200 * _DAY}"))
def fulltext_prefix_date(spark: SparkSession, folder: str) -> DataFrame:
    return _fulltext(spark, folder).search("body: (apach* OR apache + license)", START_MS, START_MS + 200 * _DAY)


@query(f"""
with {MESSAGES.strip()}, tok as (select doc_id, list_filter(regexp_split_to_array(strip_accents(lower(body)), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') as t from messages),
place as (select doc_id, unnest(range(len(t))) as i, unnest(t) as word from tok)
select distinct a.doc_id from place a join place b using (doc_id) where a.word = 'apache' and b.word = 'version' and abs(a.i - b.i) <= 4
""")
def fulltext_near(spark: SparkSession, folder: str) -> DataFrame:
    """Words with at most three others between them."""
    return _fulltext(spark, folder).search("body: NEAR(apache version, 3)", limit=10**6).select("doc_id")


@query(_fulltext_sql("f_a > 0 and f_b > 0", {"a": _word_sql("license"), "b": _word_sql("apache")}))
def fulltext_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The same without an index, in two passes over the texts."""
    return fulltext.search(messages(spark, folder, all_cores=True), "License AND apache")


@query(_fulltext_sql("f_a > 0 and f_b = 0", {"a": _word_sql("license"), "b": _word_sql("src3", ("account",))}).replace("ln((n - d_b + 0.5) / (d_b + 0.5)) * f_b", "0 * f_b"))
def fulltext_not(spark: SparkSession, folder: str) -> DataFrame:
    return _fulltext(spark, folder).search("license NOT account: src3")
