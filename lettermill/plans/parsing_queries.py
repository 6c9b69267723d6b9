"""MIME, delivery-report, HTML and attachment parsing over messages put together from the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import delivery_report, html_evidence, index, mime, statistics
from ..session import spread, table
from ..sources import synthetic
from .registry import query

_LINE = "\r\n"


def _lines(*lines: str | Column) -> Column:
    return F.encode(F.concat_ws(_LINE, *[F.lit(x) if isinstance(x, str) else x for x in lines]), "UTF-8")


def multipart(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, raw``: a document as plain text, its source as HTML, a base64 attachment and an inline image of each document.

    The plain part and the attachment hold the whole text; base64 goes in lines of 76.
    """
    docs = spread(table(spark, folder, "documents"))
    coded = F.regexp_replace(F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"\s", ""), "(.{76})(?=.)", f"$1{_LINE}")
    raw = _lines(
        F.concat(F.lit("Subject: note "), F.col("doc_id").cast("string")), F.concat(F.lit("From: "), F.col("source"), F.lit(" <"), F.col("source"), F.lit("@mail.example>")), "To: a@list.example", "Cc: b@list.example",
        "MIME-Version: 1.0", 'Content-Type: multipart/mixed; boundary="b0"', "", "--b0", "Content-Type: text/plain; charset=utf-8", "Content-Transfer-Encoding: 8bit", "", F.col("text"),
        "--b0", "Content-Type: text/html; charset=utf-8", "Content-Transfer-Encoding: 8bit", "", F.concat(F.lit("<p>see http://x.example/ "), F.col("source"), F.lit("</p><script>no</script>")),
        "--b0", F.concat(F.lit('Content-Type: text/csv; charset=utf-8; name="d'), F.col("doc_id").cast("string"), F.lit('.csv"')), "Content-Disposition: attachment", "Content-Transfer-Encoding: base64", "", coded,
        "--b0", "Content-Type: image/png", "Content-Disposition: inline; filename=logo.png", "Content-ID: <logo>", "Content-Transfer-Encoding: base64", "", "iVBORw0KGgo=", "--b0--", "",
    )
    return docs.select("doc_id", raw.alias("raw"))


@query("""
select doc_id, 'note ' || doc_id as subject, source || ' <' || source || '@mail.example>' as sender, 'a@list.example b@list.example' as recipients,
  text || chr(10) || 'see [lien externe] ' || source || chr(10) as body, 'text/csv' as attachment_types, 1::bigint as attachment_count, text as attachment_text from documents
""")
def mime_messages(spark: SparkSession, folder: str) -> DataFrame:
    return _fields(multipart(spark, folder))


def _fields(messages: DataFrame) -> DataFrame:
    found = mime.with_parsed(messages, fields=mime.SEARCHED).select("doc_id", "parsed.*")
    body = F.regexp_replace("body", "\r?\n", "\n")
    return found.select("doc_id", "subject", "sender", "recipients", body.alias("body"), F.array_join("attachment_types", " ").alias("attachment_types"), "attachment_count", "attachment_text")


@query("""
select doc_id, i as part_id, ['text/plain', 'text/html', 'text/csv', 'image/png'][i + 1] as mime, case when i = 2 then 'attachment' else 'inline' end as disposition,
  case i when 2 then 'd' || doc_id || '.csv' when 3 then 'logo.png' else '' end as filename, case when i = 3 then 'logo' else '' end as content_id, i = 2 as downloadable,
  case i when 1 then strlen('<p>see http://x.example/ ' || source || '</p><script>no</script>') when 3 then 8 else strlen(text) end::bigint as decoded_bytes
from documents cross join (select unnest([0, 1, 2, 3])::integer as i)
""")
def mime_parts(spark: SparkSession, folder: str) -> DataFrame:
    return _parts(multipart(spark, folder))


def _parts(messages: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    parts = mime.parts(mime.with_parsed(messages))
    return parts.select("doc_id", "part_id", "mime", "disposition", blank("filename"), blank("content_id"), "downloadable", "decoded_bytes")


@query("select count(*) as encountered, count(*) as supported, count(*) as extracted, 0::bigint as unsupported, 0::bigint as failures, sum(strlen(text))::bigint as bytes, sum(length(text))::bigint as chars from documents")
def attachment_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return statistics.extraction_stats(mime.extractions(mime.parts(mime.with_parsed(multipart(spark, folder), fields=("parts",)))))


@query("select doc_id, '<p>see http://x.example/ ' || source || '</p><script>no</script>' as html, 'logo' as content_ids from documents")
def html_documents(spark: SparkSession, folder: str) -> DataFrame:
    found = mime.html_documents(mime.with_parsed(multipart(spark, folder)))
    return found.select("doc_id", F.regexp_replace("html", "[\r\n]+$", "").alias("html"), F.array_join(F.transform("resources", lambda r: r["content_id"]), ",").alias("content_ids"))


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, raw``: delivery reports of every kind and fault, by order key."""
    k = F.col("o_orderkey")
    kind = F.when(k % 10 == 0, "disposition-notification").otherwise("delivery-status")
    second = F.when(k % 10 == 0, "message/disposition-notification").when(k % 10 == 1, "message/global-delivery-status").otherwise("message/delivery-status")
    status = F.when(k % 10 == 2, "5.01.1").otherwise("5.1.1")
    action = F.when(k % 10 == 3, "bounced").when(k % 10 == 4, "delayed").otherwise("failed")
    group = F.concat_ws(_LINE, F.lit("Reporting-MTA: dns; mx.example"), F.lit(""), F.concat(F.lit("Final-Recipient: rfc822; c"), F.col("o_custkey").cast("string"), F.lit("@x.example")), F.concat(F.lit("Action: "), action), F.concat(F.lit("Status: "), status), F.lit("Diagnostic-Code: smtp; 550 no"), F.when(k % 10 == 5, F.lit("Will-Retry-Until: tomorrow")))
    mdn = F.concat_ws(_LINE, F.lit("Final-Recipient: rfc822; me@x.example"), F.lit("Disposition: manual-action/mdn-sent-manually; displayed"))
    raw = _lines(
        "MIME-Version: 1.0", F.concat(F.lit("Content-Type: "), F.when(k % 10 == 6, "multipart/mixed").otherwise("multipart/report"), F.lit("; report-type="), kind, F.lit('; boundary="r"')), "", "--r", "Content-Type: text/plain", "", "About your message.",
        "--r", F.concat(F.lit("Content-Type: "), second), "", F.when(k % 10 == 0, mdn).otherwise(group), "--r--", "",
    )
    return spread(table(spark, folder, "orders")).select(k.alias("doc_id"), F.when(k % 10 == 7, _lines("Subject: hello", "", "ordinary")).otherwise(raw).alias("raw"))


@query("""
select o_orderkey as doc_id, case o_orderkey % 10 when 0 then 'mdn' when 7 then 'ordinary' else 'dsn' end as kind,
  case when o_orderkey % 10 = 1 then 'unsupported' when o_orderkey % 10 in (2, 3, 5, 6) then 'malformed' else 'valid' end as validity,
  case o_orderkey % 10 when 1 then 'RFC 6533 global report types are not implemented' when 2 then 'invalid Status syntax' when 3 then 'unsupported Action value'
    when 5 then 'Will-Retry-Until is only valid for delayed delivery' when 6 then 'DSN is not multipart/report' else '' end as reason from orders
""")
def dsn_classify(spark: SparkSession, folder: str) -> DataFrame:
    found = delivery_report.with_report(reports(spark, folder))
    return found.select("doc_id", "report.kind", "report.validity", F.coalesce("report.reason", F.lit("")).alias("reason"))


@query("""
select o_orderkey as doc_id, case when o_orderkey % 10 = 0 then 'me@x.example' else 'c' || o_custkey || '@x.example' end as final_recipient, case o_orderkey % 10 when 0 then '' when 4 then 'delayed' else 'failed' end as action,
  case when o_orderkey % 10 = 0 then '' else '550 no' end as diagnostic_code from orders where o_orderkey % 10 in (0, 4, 8, 9)
""")
def dsn_recipients(spark: SparkSession, folder: str) -> DataFrame:
    rows = delivery_report.recipients(delivery_report.with_report(reports(spark, folder)))
    return rows.select("doc_id", "final_recipient", F.coalesce("action", F.lit("")).alias("action"), F.coalesce("diagnostic_code", F.lit("")).alias("diagnostic_code"))


#: A page with every place where a remote resource can be named, made from its address.
_PAGE = (
    '<style>p { background: url("//s.example/', ["page_id"], '?x"); color: red }</style><p style="WIDTH: 1px; display: none; background:url(\'http://t.example/', ["page_id"], '\')">x</p><img height="1px" width="40" srcset="', ["url"],
    ' 2x, cid:i 1x" src="', ["url"], '"><img src="data:image/png;base64,AA=="><img src="logo.png" style="opacity:0"><a href="https:/l.example/', ["page_id"], '">l</a><a href="mailto:a@b">m</a><object>kept <b>b',
)


def _page(spark: SparkSession, folder: str) -> DataFrame:
    html = F.concat(*[F.lit(x) if isinstance(x, str) else F.col(x[0]).cast("string") for x in _PAGE])
    return spread(table(spark, folder, "pages")).select("page_id", html.alias("html"))


_PAGE_SQL = " || ".join("'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"{x[0]}::varchar" for x in _PAGE)
#: Of a page's address: its scheme, host and whether it has a query.
_URL_SQL = "lower(split_part(url, ':', 1)) as scheme, lower(regexp_extract(url, '://([^/?#]*)', 1)) as host, position('?' in split_part(url, '#', 1)) > 0 as query"


@query(f"""
with p as (select page_id, url, {_URL_SQL} from pages), q as (select * from p where scheme in ('http', 'https') and host <> ''),
r as (
  select page_id, 0 as position, 'css-background' as kind, 'style-block' as source, '//s.example/' || page_id || '?x' as url, 'protocol-relative' as scheme, 's.example' as host, null::bigint as width, null::bigint as height, false as hidden, 'query-parameters' as signals from pages
  union all select page_id, 1, 'css-background', 'style-attribute', 'http://t.example/' || page_id, 'http', 't.example', 1, null, true, 'tiny-dimensions,hidden' from pages
  union all select page_id, 2, 'image', 'img-src', url, scheme, host, 40, 1, false, 'tiny-dimensions' || case when query then ',query-parameters' else '' end from q
  union all select page_id, 3, 'image', 'img-srcset', url, scheme, host, 40, 1, false, 'tiny-dimensions' || case when query then ',query-parameters' else '' end from q
)
select page_id, position, kind, source, url, scheme, host, coalesce(width, -1) as declared_width, coalesce(height, -1) as declared_height, hidden, signals from r
""")
def html_remote_evidence(spark: SparkSession, folder: str) -> DataFrame:
    rows = html_evidence.remote_resources(html_evidence.with_evidence(_page(spark, folder)), "page_id")
    sizes = [F.coalesce(c, F.lit(-1).cast("long")).alias(c) for c in ("declared_width", "declared_height")]
    return rows.select("page_id", "position", "kind", "source", "url", "scheme", "host", *sizes, "hidden", F.array_join("signals", ",").alias("signals"))


@query("select page_id, 'cid:i,data:image/png;base64,AA==,logo.png' as references_, 'https:/l.example/' || page_id as links from pages")
def html_references(spark: SparkSession, folder: str) -> DataFrame:
    found = html_evidence.with_evidence(_page(spark, folder))
    return found.select("page_id", F.array_join("evidence.local_references", ",").alias("references_"), F.array_join("evidence.links", ",").alias("links"))


@query(r"""
with t as (select page_id, regexp_extract_all('<p><a class=x href="' || url || '">this page</a></p>' || html, '<a\s[^>]*href="([^"]*)"', 1) as urls from pages)
select page_id, replace(url, '&amp;', '&') as url, count(*) as n from (select page_id, unnest(urls) as url from t) where regexp_matches(url, '^(https?:)?//') group by all
""")
def html_links(spark: SparkSession, folder: str) -> DataFrame:
    """Of whole pages, with a link to themselves in front: links to other places, relative ones aside."""
    own = F.concat(F.lit('<p><a class=x href="'), F.col("url"), F.lit('">this page</a></p>'), F.col("html")).alias("html")
    found = html_evidence.links(html_evidence.with_evidence(table(spark, folder, "pages").select("page_id", own)), "page_id")
    return found.groupBy("page_id", "url").agg(F.count("*").alias("n"))


@query(r"""
with h as (select page_id, '<div style="width:1px;background:url(//t.example/p?' || page_id || ')">x<img src="' || url || '" width="1"><img src="cid:logo"><a href="' || url || '">l</a></div>' as html, url from pages)
select page_id, 'image' as kind, 'img-src' as source, url, case when starts_with(url, 'https') then 'https' else 'http' end as scheme, true as tiny, position('?' in split_part(url, '#', 1)) > 0 as query_parameters from h
union all select page_id, 'css-background', 'style-attribute', '//t.example/p?' || page_id, 'protocol-relative', true, true from h
""")
def html_evidence_signals(spark: SparkSession, folder: str) -> DataFrame:
    html = F.concat(F.lit('<div style="width:1px;background:url(//t.example/p?'), F.col("page_id").cast("string"), F.lit(')">x<img src="'), "url", F.lit('" width="1"><img src="cid:logo"><a href="'), "url", F.lit('">l</a></div>'))
    rows = html_evidence.remote_resources(html_evidence.with_evidence(table(spark, folder, "pages").select("page_id", html.alias("html"))), "page_id")
    return rows.select("page_id", "kind", "source", "url", "scheme", F.array_contains("signals", "tiny-dimensions").alias("tiny"), F.array_contains("signals", "query-parameters").alias("query_parameters"))


@query(f"""
select page_id, '<!doctype html><html><head><meta charset="utf-8"><meta http-equiv="Content-Security-Policy" content="{html_evidence.POLICY.replace("'", "''")}"></head><body><p>x</p><img height="1px" width="40" src="' || replace(url, '&', '&amp;')
  || '"><img><img src="logo.png"><a href="https:/l.example/' || page_id || '" rel="noopener noreferrer">l</a><a href="mailto:a@b" rel="noopener noreferrer">m</a>kept <b>b</b></body></html>' as preview from pages
""")
def html_preview(spark: SparkSession, folder: str) -> DataFrame:
    return _page(spark, folder).select("page_id", html_evidence.sanitised("html").alias("preview"))


@query("""
select doc_id, account, labels, sender_filter, has_attachment, body from (
  select doc_id, 'gmail:a' as account, lang as labels, array_to_string(list_sort(list_distinct(['example', 'mail', source, source || '@mail.example'])), ' ') as sender_filter, 1::integer as has_attachment,
    text || chr(10) || 'see [lien externe] ' || source || chr(10) as body from documents)
""")
def index_rows(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    catalogue = docs.select("doc_id", F.lit("gmail:a").alias("source_account"), F.to_json(F.array("lang")).alias("label_ids"), F.lit(1).cast("long").alias("timestamp_ms"), F.lit("m").alias("message_id"), F.lit("").alias("folder"))
    rows = index.search_rows(catalogue, multipart(spark, folder)).filter("error is null")
    return rows.select("doc_id", "account", F.array_join("labels", " ").alias("labels"), F.array_join("sender_filter", " ").alias("sender_filter"), "has_attachment", F.regexp_replace("body", "\r?\n", "\n").alias("body"))


@query("""
select i as doc_id, true as headers_match, true as bytes_match, true as hashes_match, true as known_names, true as in_order from (select unnest(generate_series(0, (select count(*) from documents) - 1)) as i)
""")
def synthetic_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Each generated message against what parsing its RAW gives; the generator's own numbers are beyond SQL."""
    n = table(spark, folder, "documents").count()
    made = synthetic.messages(spark, synthetic.Corpus(n, profile="personal"))
    # RAW, with attachments of up to a megabyte, is read here only: its parts, its size, that of its text and its payload's hash
    cut = {f"raw_{name}": c for name, c in mime.synthetic_cut().items()}
    payload = F.expr("substring(raw, octet_length(raw) - get(attachments, 0).bytes + 1)")
    text_bytes = F.octet_length(F.substring_index(F.col("raw").cast("string"), mime.ATTACHED, 1))
    made = made.withColumns(cut | {"raw_bytes": F.octet_length("raw"), "text_bytes": text_bytes, "payload_hash": F.sha2(payload, 256)}).drop("raw")
    read = dict(zip(("timestamp", "sender", "recipients", "subject", "folder", "account", "body"), mime.synthetic_fields("raw_head", {"head": F.col("raw_head"), "body": F.col("raw_body")}), strict=False))
    same = [read[c] == F.col(c) for c in ("timestamp", "sender", "subject", "folder", "account", "body")] + [read["recipients"] == F.array_join("recipients", ", ")]
    head = F.format_string("\r\n--attachment; filename=%s; hash=%s\r\n", F.col("attachments")[0]["filename"], F.col("attachments")[0]["content_hash"])
    attached = F.size("attachments") > 0
    held = F.when(attached, F.octet_length(head) + F.get("attachments", F.lit(0))["bytes"]).otherwise(0)
    hashes = F.when(attached, F.col("payload_hash") == F.col("attachments")[0]["content_hash"]).otherwise(True)
    names = F.col("sender").rlike("^[^@]+@(north|south)[.]example$") & (F.size("recipients") >= 1)
    return made.select(
        "doc_id", reduce(lambda a, b: a & b, same).alias("headers_match"), (F.col("text_bytes") + held == F.col("raw_bytes")).alias("bytes_match"), hashes.alias("hashes_match"), names.alias("known_names"),
        (F.floor((F.col("timestamp") - 1_577_836_800) / 28_800) == F.col("doc_id")).alias("in_order"),
    )


@query("select doc_id, translate(rtrim(to_base64(encode(text)), '='), '+/', '-_') as encoded, md5(text) as digest from documents")
def base64url_decode(spark: SparkSession, folder: str) -> DataFrame:
    encoded = F.regexp_replace(F.translate(F.base64(F.encode("text", "UTF-8")), "+/", "-_"), "[=\r\n]", "")
    return table(spark, folder, "documents").select("doc_id", encoded.alias("encoded")).withColumn("digest", F.md5(text.decode_base64url("encoded")))
