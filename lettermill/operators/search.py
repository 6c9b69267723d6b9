"""Structured search: free text and filters combined with AND, best or newest first."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_date_ms
from ..functions.text import snippet
from . import ranking

DEFAULT_LIMIT = 50
#: Columns of a result row.
RESULT = ["doc_id", "message_id", "score", "timestamp_ms", "sender", "recipients", "subject", "snippet", "labels", "attachment_count"]


@dataclass(frozen=True)
class SearchRequest:
    """What to look for; what is left out doesn't filter. ``date_from`` is inclusive, ``date_to`` exclusive (ms)."""

    text: str = ""
    sender: str | None = None
    recipients: str | None = None
    date_from: int | None = None
    date_to: int | None = None
    attachment: str = "all"
    mime: str | None = None
    labels: tuple[str, ...] = field(default_factory=tuple)
    limit: int = DEFAULT_LIMIT

    def has_filters(self) -> bool:
        """Whether any filter is set; a list of blank labels counts."""
        return any(x is not None for x in (self.sender, self.recipients, self.date_from, self.date_to, self.mime)) or self.attachment != "all" or bool(self.labels)


def fold(value: str) -> str:
    """A-Z in lower case, all else as it is."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in value)


def address_clause(column: str, value: str) -> Column:
    """A whole address must be among the values; else all its tokens must be. A text without tokens is no clause."""
    address = fold(value.strip().strip("<").strip(">"))
    if "@" in address:
        return F.array_contains(column, address)
    found = [fold(t) for t in "".join(c if c.isalnum() else " " for c in value).split()]
    return reduce(lambda a, b: a & b, [F.array_contains(column, t) for t in found]) if found else F.lit(True)


def date_clause(column: str, start: int | None, end: int | None) -> Column:
    """start <= time < end, either side open."""
    clause = F.lit(True)
    if start is not None:
        clause = clause & (F.col(column) >= start)
    if end is not None:
        clause = clause & (F.col(column) < end)
    return clause


def mime_clause(value: str) -> Column | None:
    """``image/*`` is a family, anything else a type; blank is no clause."""
    wanted = fold(value.strip())
    if not wanted:
        return None
    if wanted.endswith("/*"):
        return F.array_contains("attachment_family", wanted[:-2])
    return F.array_contains("attachment_mime", wanted)


def label_clauses(labels: tuple[str, ...]) -> list[Column]:
    """Every label that isn't blank must be there, exactly."""
    return [F.array_contains("labels", label.strip()) for label in labels if label.strip()]


def filters(request: SearchRequest) -> Column:
    """All clauses but the text, combined with AND; none: everything."""
    clauses = [date_clause("timestamp_ms", request.date_from, request.date_to)]
    if request.sender is not None:
        clauses.append(address_clause("sender_filter", request.sender))
    if request.recipients is not None:
        clauses.append(address_clause("recipient_filter", request.recipients))
    if request.attachment != "all":
        clauses.append(F.col("has_attachment") == (1 if request.attachment == "with" else 0))
    if request.mime is not None and (clause := mime_clause(request.mime)) is not None:
        clauses.append(clause)
    return reduce(lambda a, b: a & b, clauses + label_clauses(request.labels))


def _filter_terms(request: SearchRequest) -> list[tuple[str, str]]:
    """Column and value of every filter that looks for a value in a list."""
    found = []
    for column, value in (("sender_filter", request.sender), ("recipient_filter", request.recipients)):
        if value is not None:
            address = fold(value.strip().strip("<").strip(">"))
            found += [(column, x) for x in ([address] if "@" in address else [fold(t) for t in "".join(c if c.isalnum() else " " for c in value).split()])]
    if request.mime is not None and (wanted := fold(request.mime.strip())):
        found.append(("attachment_family", wanted[:-2]) if wanted.endswith("/*") else ("attachment_mime", wanted))
    return found + [("labels", label.strip()) for label in request.labels if label.strip()]


def filter_scores(docs: DataFrame, request: SearchRequest) -> DataFrame:
    """``doc_id, extra``: what the filters of a request add to the score of each row that passes them.

    A value in a list counts as a term that is there once in a field as long as the list; whether there is an attachment counts
    as a term in a field of one; a range of dates counts 1. Frequencies are those of all rows: one pass for them, a row wide.
    """
    terms, has = _filter_terms(request), request.attachment != "all"
    columns = sorted({c for c, _ in terms})
    wanted = 1 if request.attachment == "with" else 0
    counts = [F.count("*").alias("n"), F.count_if(F.col("has_attachment") == wanted).alias("df_has")]
    counts += [F.count_if(F.array_contains(c, v)).alias(f"df{i}") for i, (c, v) in enumerate(terms)] + [F.avg(F.coalesce(F.size(c), F.lit(0))).alias(f"mean_{c}") for c in columns]
    passing = docs.filter(filters(request)).select("doc_id", *[F.size(c).alias(f"size_{c}") for c in columns])
    rows = passing.crossJoin(F.broadcast(docs.agg(*counts)))  # one row
    one = F.lit(1.0)
    extra = [ranking.bm25(one, F.col(f"size_{c}"), F.col("n"), F.col(f"df{i}"), F.col(f"mean_{c}")) for i, (c, _) in enumerate(terms)]
    extra += [ranking.bm25(one, one, F.col("n"), F.col("df_has"), one)] * has + [one] * (request.date_from is not None or request.date_to is not None)
    return rows.select("doc_id", reduce(lambda a, b: a + b, extra, F.lit(0.0)).alias("extra"))


def search(docs: DataFrame, request: SearchRequest, strict_scoring: bool = False) -> DataFrame:
    """Rows of the search projection that match, ``request.limit`` at most: by score with text, else newest first.

    Ties go to the smaller doc_id. An empty request or a limit of 0 gives no rows. Filters come before the limit. With
    ``strict_scoring``, filters beside a text add to the score, as clauses of one query do.
    """
    text = request.text.strip()
    if request.limit <= 0 or not text and not request.has_filters():
        return docs.limit(0).select(*result_columns(F.lit(0.0)))
    matching = docs.filter(filters(request))
    if text:
        scores = ranking.scored(docs, text)
        if strict_scoring:
            scores = with_filters(scores, filter_scores(docs, request))
        matching = matching.select(*result_columns(F.lit(0.0))).drop("score").join(scores, "doc_id").select(*RESULT)  # snippets, not bodies
        return matching.orderBy(F.desc("score"), "doc_id").limit(request.limit)
    return matching.select(*result_columns(F.lit(0.0))).orderBy(F.desc("timestamp_ms"), "doc_id").limit(request.limit)


def with_filters(scores: DataFrame, extra: DataFrame) -> DataFrame:
    """Scores with what the filters add."""
    return scores.join(extra, "doc_id").select("doc_id", F.round(F.col("score") + F.col("extra"), 6).alias("score"))


def result_columns(score: Column) -> list[Column]:
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return [
        F.col("doc_id"), blank("message_id"), score.alias("score"), F.coalesce("timestamp_ms", F.lit(0).cast("long")).alias("timestamp_ms"), blank("sender"), blank("recipients"),
        blank("subject"), snippet("body").alias("snippet"), F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), F.coalesce("attachment_count", F.lit(0).cast("long")).alias("attachment_count"),
    ]


def legacy_request(query: str, limit: int = 20) -> SearchRequest:
    """A request from one line: ``after: before: from: to:`` words are filters, the last of each holds; the rest is text."""
    found: dict[str, str] = {}
    text = []
    for word in query.split():
        key, colon, value = word.partition(":")
        if colon and key in ("after", "before", "from", "to"):
            found[key] = value
        else:
            text.append(word)
    date = lambda key: parse_date_ms(found[key]) if key in found else None
    return SearchRequest(" ".join(text), found.get("from"), found.get("to"), date("after"), date("before"), limit=limit)


def search_line(docs: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Search by one line."""
    return search(docs, legacy_request(query, limit))


def date_count(docs: DataFrame, start: int, end: int) -> DataFrame:
    """``n``: rows of start <= time <= end."""
    return docs.filter(F.col("timestamp_ms").between(start, end)).agg(F.count("*").alias("n"))


def date_search(docs: DataFrame, start: int, end: int, limit: int = 20) -> DataFrame:
    """The first ids of start <= time <= end, all of score 1."""
    return docs.filter(F.col("timestamp_ms").between(start, end)).select("doc_id", F.lit(1.0).alias("score")).orderBy("doc_id").limit(limit)


def distinct_labels(docs: DataFrame, labels: str = "labels") -> DataFrame:
    """``label``: each label that occurs, in order."""
    return docs.select(F.explode(labels).alias("label")).distinct().orderBy("label")


def exists_by_key(wanted: DataFrame, held: DataFrame, key: list[str]) -> DataFrame:
    """``wanted`` with a column ``known``: whether its key is held."""
    marks = held.select(*key).distinct().withColumn("_known", F.lit(True))
    return wanted.join(marks, key, "left").withColumn("known", F.coalesce("_known", F.lit(False))).drop("_known")
