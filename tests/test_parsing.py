"""MIME, delivery reports, HTML evidence: literal messages and their results."""

import random

import pytest
from pyspark.sql import functions as F

from lettermill.operators import delivery_report, html_evidence, mime
from lettermill.plans import parsing_queries

MIXED = (
    b"Subject: =?utf-8?q?caf=C3=A9?=\r\nFrom: A <a@x.y>\r\nTo: b@x.y\r\nBcc: c@x.y\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=B\r\n\r\n"
    b"--B\r\nContent-Type: multipart/alternative; boundary=C\r\n\r\n--C\r\nContent-Type: text/plain; charset=iso-8859-1\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\nna=EFf\r\n"
    b"--C\r\nContent-Type: text/html\r\n\r\n<p>hi</p>\r\n--C--\r\n"
    b"--B\r\nContent-Type: text/plain; name=n.txt\r\nContent-Disposition: attachment; filename=n.txt\r\nContent-Transfer-Encoding: base64\r\n\r\nbm90ZQ==\r\n"
    b"--B\r\nContent-Type: image/png; name=i.png\r\nContent-ID: <i1>\r\nContent-Disposition: inline\r\n\r\nPNG\r\n"
    b"--B\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment\r\nContent-ID: <p1>\r\n\r\nPDF\r\n"
    b"--B\r\nContent-Type: message/rfc822\r\n\r\nSubject: inner\r\n\r\ninner body\r\n--B--\r\n"
)


def test_mixed_message(spark):
    df = spark.createDataFrame([(1, MIXED), (2, None), (3, b""), (4, b"\xff\xfe no headers")], "doc_id long, raw binary")
    parsed = mime.with_parsed(df).cache()
    row = parsed.filter("doc_id = 1").select("parsed.*").first()
    assert (row["subject"], row["sender"], row["recipients"]) == ("café", "A <a@x.y>", "b@x.y c@x.y")
    assert row["body"] == "naïf\nhi\nnote\n" and row["attachment_text"] == "note" and row["attachment_types"] == ["text/plain", "application/pdf"] and row["attachment_count"] == 2
    parts = mime.parts(parsed).filter("doc_id = 1").orderBy("part_id").collect()
    assert [(p["part_id"], p["mime"], p["downloadable"]) for p in parts] == [(0, "text/plain", False), (1, "text/html", False), (2, "text/plain", True), (3, "image/png", False), (4, "application/pdf", True), (5, "message/rfc822", False)]
    assert [r["part_id"] for r in mime.attachments(mime.parts(parsed)).filter("doc_id = 1").collect()] == [2, 4]
    assert {r["content_id"] for r in mime.resources(mime.parts(parsed)).collect()} == {"i1", "p1"}
    assert bytes(mime.attachment_bytes(mime.parts(parsed), 1, 2).first()[0]) == b"note" and mime.attachment_bytes(mime.parts(parsed), 1, 0).count() == 0
    document = mime.html_documents(parsed).first()
    assert document["html"].strip() == "<p>hi</p>" and [r["content_id"] for r in document["resources"]] == ["i1", "p1"]
    assert parsed.filter("doc_id = 2").select("parsed.error").first()[0] == "no RAW" and parsed.filter("doc_id in (3, 4) and parsed.error is null").count() == 2
    found = {(r["part_id"], r["outcome"], r["text"]) for r in mime.extractions(mime.parts(parsed)).filter("doc_id = 1").collect()}
    assert found == {(2, "extracted", "note"), (4, "unsupported", "")}


def test_messages_hold_whole_texts(spark, tmp_path):
    rng = random.Random(8)
    texts = ["short", "", "é" * 60 + "tail", "line\n" * 500 + "end\n", "".join(rng.choice("ab é🙂\n-=") for _ in range(50_000)), "x" * 57, "y" * 58, "--b\n\nFrom z\n.\n"]
    rows = [(i, text, "en", "web", len(text)) for i, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in parsing_queries.mime_messages(spark, str(tmp_path)).collect()}
    assert {i: r["attachment_text"] for i, r in found.items()} == dict(enumerate(texts))
    assert {i: r["body"] for i, r in found.items()} == {i: f"{text}\nsee [lien externe] web\n" for i, text in enumerate(texts)}
    raw = parsing_queries.multipart(spark, str(tmp_path)).filter("doc_id = 4").first()["raw"]
    assert max(map(len, bytes(raw).split(b"Content-Disposition: attachment")[1].split(b"--b0")[0].splitlines())) == 76
    sizes = {(r["doc_id"], r["part_id"]): r["decoded_bytes"] for r in parsing_queries.mime_parts(spark, str(tmp_path)).collect()}
    assert all(sizes[i, part] == len(text.encode()) for i, text in enumerate(texts) for part in (0, 2))
    stats = parsing_queries.attachment_extraction(spark, str(tmp_path)).first()
    assert (stats["bytes"], stats["chars"]) == (sum(len(t.encode()) for t in texts), sum(map(len, texts)))


def report(kind="delivery-status", second="message/delivery-status", body="", root="multipart/report", third=""):
    text = f"MIME-Version: 1.0\r\nContent-Type: {root}; report-type={kind}; boundary=R\r\n\r\n--R\r\n\r\nhello\r\n--R\r\nContent-Type: {second}\r\n\r\n{body}"
    return (text + (f"\r\n--R\r\nContent-Type: text/rfc822-headers\r\n\r\n{third}" if third else "") + "\r\n--R--\r\n").encode()


def dsn(**change):
    fields = {"Final-Recipient": "rfc822; a@x.y", "Action": "failed", "Status": "5.1.1"} | {k.replace("_", "-"): v for k, v in change.items()}
    return "Reporting-MTA: dns; mx\r\n\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)


def mdn(disposition="automatic-action/mdn-sent-automatically; displayed/error,x", final="rfc822; a@x.y"):
    return f"Reporting-UA: ua\r\nFinal-Recipient: {final}\r\nOriginal-Message-ID: <m@x>\r\nDisposition: {disposition}\r\n"


MDN = {"kind": "disposition-notification", "second": "message/disposition-notification"}


@pytest.mark.parametrize(
    ("raw", "kind", "validity", "reason"),
    [
        (b"Subject: x\r\n\r\ny", "ordinary", "valid", None),
        (report(root="multipart/mixed"), "dsn", "malformed", "DSN is not multipart/report"),
        (report(root="multipart/mixed", second="message/disposition-notification"), "mdn", "malformed", "MDN is not multipart/report"),
        (b"Content-Type: multipart/report; report-type=disposition-notification; boundary=R\r\n\r\n--R\r\n\r\nx\r\n--R--\r\n", "mdn", "malformed", "multipart/report has no structured report part"),
        (report(second="message/global-delivery-status"), "dsn", "unsupported", "RFC 6533 global report types are not implemented"),
        (report(second="message/global-disposition-notification"), "mdn", "unsupported", "RFC 6533 global report types are not implemented"),
        (report(kind="x", body=dsn()), "dsn", "unsupported", "DSN part has an unsupported report-type"),
        (report(kind="delivery-status", second="message/disposition-notification", body=mdn()), "mdn", "unsupported", "MDN part has an unsupported report-type"),
        (report(second="message/global-headers"), "dsn", "unsupported", "RFC 6533 global report type is not implemented"),
        (report(second="text/plain"), "dsn", "malformed", "multipart/report has an unexpected structured report part"),
        (report(body=dsn()), "dsn", "valid", None),
        (report(body=dsn(Action="Delayed", Will_Retry_Until="later")), "dsn", "valid", None),
        (report(body=dsn(Will_Retry_Until="later")), "dsn", "malformed", "Will-Retry-Until is only valid for delayed delivery"),
        (report(body=dsn(Action="bounced")), "dsn", "malformed", "unsupported Action value"),
        (report(body=dsn(Action=None)), "dsn", "malformed", "Action is required"),
        (report(body=dsn(Status="5.01.1")), "dsn", "malformed", "invalid Status syntax"),
        (report(body=dsn(Final_Recipient="a@x.y")), "dsn", "malformed", "Final-Recipient is required"),
        (report(body="Reporting-MTA: dns; mx\r\n"), "dsn", "malformed", "at least one recipient is required"),
        (report(body="X: y\r\n\r\nAction: failed\r\n"), "dsn", "malformed", "Reporting-MTA is required"),
        (report(**MDN, body=mdn()), "mdn", "valid", None),
        (report(**MDN, body=mdn("displayed")), "mdn", "malformed", "invalid Disposition syntax or value"),
        (report(**MDN, body=mdn(final="me")), "mdn", "malformed", "Final-Recipient is required"),
        (report(**MDN, body="Final-Recipient: rfc822; a@x.y\r\n"), "mdn", "malformed", "Disposition is required"),
    ],
)
def test_report_kinds(raw, kind, validity, reason):
    found = delivery_report.analyse(raw)
    assert (found["kind"], found["validity"], found["reason"]) == (kind, validity, reason)


def test_report_fields(spark):
    body = dsn(Diagnostic_Code="smtp; 550\r\n  no such user", Original_Recipient="rfc822; o@x.y") + "\r\nFinal-Recipient: rfc822;b@x.y\r\nAction: delivered\r\nStatus: 2.0.0\r\n"
    df = spark.createDataFrame([(1, report(body=body, third="Message-ID: <orig@x>\r\nSubject: s")), (2, report(**MDN, body=mdn())), (3, None)], "doc_id long, raw binary")
    found = delivery_report.with_report(df).cache()
    rows = {(r["doc_id"], r["final_recipient"]): r for r in delivery_report.recipients(found).collect()}
    assert rows[1, "a@x.y"]["diagnostic_code"] == "550 no such user" and rows[1, "a@x.y"]["original_recipient"] == "o@x.y" and rows[1, "b@x.y"]["status"] == "2.0.0" and (2, "a@x.y") in rows
    first, second, third = (r["report"] for r in found.orderBy("doc_id").collect())
    assert first["original_message_id"] == "<orig@x>" and first["has_third_part"] and first["message_fields"] == {"reporting-mta": "dns; mx"}
    assert second["disposition"]["modifiers"] == ["error", "x"] and second["original_message_id"] == "<m@x>" and third["kind"] == "unparseable"


@pytest.mark.parametrize(("status", "sound"), [("5.1.1", True), ("2.0.0", True), ("4.999.10", True), ("3.1.1", False), ("5.1", False), ("5.1.1.1", False), ("5.01.1", False), ("5.1000.1", False), ("5.a.1", False), ("5..1", False)])
def test_status_syntax(status, sound):
    assert delivery_report.reasonable_status(status) is sound


def test_html_evidence():
    found = html_evidence.evidence(
        '<img src="https://h.example/a?x" width="1px" srcset="//c.example/b 2x, cid:i 1x"><div style="display:none;background:url(\'http://h.example/c\')"></div>'
        '<style>p{background:url(https://s.example/d)}</style><a href="https://l.example">x</a><a href="mailto:a@b">y</a><img src="logo.png" style="width:1px;opacity:0"><img src="ftp://x/y">'
    )
    rows = [(r["source"], r["url"], r["scheme"], r["host"], r["signals"]) for r in found["remote_resources"]]
    assert rows == [
        ("img-src", "https://h.example/a?x", "https", "h.example", ["tiny-dimensions", "query-parameters"]),
        ("img-srcset", "//c.example/b", "protocol-relative", "c.example", ["tiny-dimensions"]),
        ("style-attribute", "http://h.example/c", "http", "h.example", ["hidden"]),
        ("style-block", "https://s.example/d", "https", "s.example", []),
    ]
    assert found["local_references"] == ["cid:i", "logo.png"] and found["links"] == ["https://l.example"]
    assert html_evidence.evidence(None) == html_evidence.evidence("") == {"remote_resources": [], "local_references": [], "links": []}


@pytest.mark.parametrize(
    ("url", "found"),
    [
        ("https:/x.y/a", ("https", "x.y", False)), ("HTTP:x.y?q", ("http", "x.y", True)), ("http:\\\\X.Y\\z", ("http", "x.y", False)), (" \thttp://u:p@h.example:80/a#?b ", ("http", "h.example", False)), ("ht\ntp://a.b", ("http", "a.b", False)),
        ("//t.example/p?1", ("protocol-relative", "t.example", True)), ("http://é.example", ("http", "xn--9ca.example", False)), ("http://%41.b", ("http", "a.b", False)), ("http://[::1]:9/", ("http", "[::1]", False)), ("http://0x7f.1/", ("http", "127.0.0.1", False)),
        ("http://", None), ("http:///?", None), ("http://a b/", None), ("http://a:99999/", None), ("http://1.2.3.4.5/", None), ("http://[x]/", None), ("ftp://x/y", None), ("logo.png", None), ("http://a:b/", None), ("//", None),
    ],
)
def test_remote_urls(url, found):
    assert html_evidence.remote(url) == found


def test_html_evidence_survives_fragments():
    rng = random.Random(1)
    pool = ['<img src="http://x/', "<style>", "url(", "</style>", "<a href=", '"', ">", "<!--", "&amp", "\x00", "<table><div>", "é"]
    for _ in range(300):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))
        assert html_evidence.evidence(text) == html_evidence.evidence(text) and html_evidence.sanitise(text).startswith("<!doctype html>")


def test_preview():
    shown = html_evidence.sanitise('<p onclick="x()">a<script>b()</script><img src="cid:i%31"><img src="http://t/p"><b>c</b></p>', {"i1": "/part/3"})
    body = shown.split("<body>")[1].split("</body>")[0]
    assert body == '<p>a<img src="/part/3"><img src="http://t/p"><b>c</b></p>' and "default-src 'none'; img-src 'self'" in shown  # the policy keeps remote images from loading
    assert [html_evidence.normal_cid(x) for x in ("<a@b>", "&lt;a@b&gt;", "a%40b", "%zz", " ", " a b ", "%ff", "<%3Ca%3E>")] == ["a@b", "a@b", "a@b", None, None, "a b", None, "a"]
    inside = lambda text: html_evidence.sanitise(text).split("<body>")[1].split("</body>")[0]
    assert inside("a<object><p>b<div>c") == "a<p>b<div>c</div></p>" and inside("x<script>y") == "x" and inside("<b>a</i></b></b>c") == "<b>a</b>c"
    assert inside('<a href="javascript:x()" title="t&quot;">l</a><a href="/r?a=1&amp;b">m</a><br>') == '<a title="t&quot;" rel="noopener noreferrer">l</a><a href="/r?a=1&amp;b" rel="noopener noreferrer">m</a><br>'
    assert html_evidence.rewrite_cids('src="cid:x" src="CID:y"', {"y": "/p"}) == 'src="cid:x" src="/p"'


def test_synthetic_attachments_are_not_decoded(spark, tmp_path):
    """Of RAW only what stands before an attachment is made text, and the query reads RAW in one place."""
    import os
    import re

    from lettermill.plans import parsing_queries

    head = "Date-Unix: 5\r\nFrom: a\r\nTo: b\r\nSubject: \u00e9\r\nX-Folder: f\r\nX-Account: c\r\n".encode()
    odd = b"\r\n--attachment; x\r\n\xff\r\n\r\n\r\n--attachment;"
    raws = [(0, head + b"\r\nb\xff\xc3dy" + odd), (1, head + b"X: \r\n--attachment; x\r\n\r\n two \r\n\r\nparts " + odd), (2, head + b"\r\n" + odd), (3, head[:-2])]
    rows = spark.createDataFrame(raws, "doc_id long, raw binary")
    got = [r["body"] for r in rows.select("doc_id", *mime.synthetic_fields()).orderBy("doc_id").collect()]
    assert got == ["b\ufffd\ufffddy", "two \r\n\r\nparts", "", ""]
    os.mkdir(tmp_path / "documents.parquet")
    spark.range(40).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    done = parsing_queries.synthetic_messages(spark, str(tmp_path))
    assert len({tuple(r)[1:] for r in done.collect()}) == 1 and done.filter("headers_match and bytes_match and hashes_match").count() == 40
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < len(re.findall(r"\braw#", plan)) < 12, plan  # was read for every header, again and again


def test_synthetic_fields(spark):
    raw = b"Date-Unix: 5\r\nFrom: a\r\nTo: b\r\nSubject: s: t\r\nX-Folder: f\r\nX-Account: c\r\nSubject: last\r\n\r\n body \r\n--attachment; filename=x\r\n\xff\xfe"
    df = spark.createDataFrame([(raw,)], "raw binary")
    assert df.select(*mime.synthetic_fields()).first().asDict() == {"timestamp": 5, "sender": "a", "recipients": "b", "subject": "last", "folder": "f", "account": "c", "body": "body", "raw_bytes": len(raw)}
    with pytest.raises(Exception, match="missing archived header"):
        df.select(F.replace(F.col("raw").cast("string"), F.lit("X-Folder"), F.lit("Y")).cast("binary").alias("raw")).select(*mime.synthetic_fields()).collect()


def test_extraction_providers(spark, tmp_path):
    from lettermill.operators import extraction

    here = extraction.discover(path=str(tmp_path))
    assert [p.available for p in here] == [True, False] and extraction.selected("application/pdf", here) is None and extraction.selected("text/csv", here).id == "text"
    fake = extraction.Provider("fake", "command", ("application/pdf",), True, ("cat",))
    assert extraction.extract("application/pdf", b"pdf", None, [*here, fake]) == ("extracted", "pdf")
    assert extraction.selected("application/pdf", [fake], {"application/pdf": "other"}) is None
    assert extraction.run_command(("sleep", "5"), b"", timeout=0.1) == ("failed", "") and extraction.run_command(("false",), b"") == ("failed", "") and extraction.run_command(("cat",), b"\xff") == ("failed", "")
    assert extraction.extract("image/png", b"", None, here) == ("unsupported", "")
    parsed = mime.with_parsed(spark.createDataFrame([(1, MIXED)], "doc_id long, raw binary"))
    found = {(r["part_id"], r["outcome"]) for r in extraction.extractions(mime.parts(parsed)).collect()}
    assert (2, "extracted") in found and len(found) == 2


def test_user_callback(spark):
    df = spark.createDataFrame([(1, MIXED)], "doc_id long, raw binary")
    rows = mime.map_messages(df, lambda row, message: [(row["doc_id"], message["To"])], "doc_id long, to string").collect()
    assert [tuple(r) for r in rows] == [(1, "b@x.y")]


def test_catalogue_validation(spark):
    from lettermill.schemas import APPLICATION_ID, CATALOGUE, SchemaError, validate_catalogue

    tables = {name: spark.createDataFrame([], schema) for name, schema in CATALOGUE.items()}
    validate_catalogue(tables, APPLICATION_ID, 1)
    for bad in ((tables, 0, 1), (tables, APPLICATION_ID, 2), ({k: v for k, v in tables.items() if k != "messages"}, APPLICATION_ID, 1)):
        with pytest.raises(SchemaError):
            validate_catalogue(*bad)
