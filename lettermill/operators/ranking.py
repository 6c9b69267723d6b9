"""Postings, BM25 and the text query language: terms, phrases, fields, AND, OR, NOT, + and -, parentheses."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LONGEST_TOKEN, tokens

K1, B = 1.2, 0.75
#: Fields that text without a prefix searches, with their weights.
FIELDS = {"sender": 1.0, "recipients": 1.0, "subject": 1.0, "body": 1.0, "account": 1.0, "label": 1.0, "attachment_type": 1.0, "attachment_text": 0.7}
#: Search-projection columns of list-valued fields.
_LISTS = {"label": "labels", "attachment_type": "attachment_types"}
ALSO = {"folder": 1.0}


class QueryError(ValueError):
    """The query text is not in the language."""


def field_text(docs: DataFrame, name: str) -> Column:
    """A field's text; lists are joined by spaces; a missing column is empty."""
    column = _LISTS.get(name, name)
    if column not in docs.columns:
        return F.lit("")
    return F.array_join(F.coalesce(column, F.array().cast("array<string>")), " ") if name in _LISTS else F.coalesce(F.col(column), F.lit(""))


def postings(docs: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """``field, term, doc_id, tf, positions, dl``: each field's terms with their positions; dl is the field's length.

    A text's tokens are sorted within its row and cut where the term changes, so nothing is shuffled.
    """
    fields = fields or [*FIELDS, *ALSO]
    texts = F.array(*[F.struct(F.lit(name).alias("field"), tokens(field_text(docs, name)).alias("found")) for name in fields])
    rows = docs.select("doc_id", F.inline(texts)).filter(F.size("found") > 0)
    placed = F.array_sort(F.transform("found", lambda t, i: F.struct(t.alias("term"), i.alias("position"))))
    rows = rows.select("doc_id", "field", F.size("found").alias("dl"), placed.alias("placed"))
    term = lambda i: F.element_at("placed", i)["term"]
    starts = F.filter(F.sequence(F.lit(1), F.col("dl")), lambda i: (i == 1) | (term(i) != term(F.greatest(i - 1, F.lit(1)))))
    rows = rows.withColumn("starts", starts)
    end = lambda k: F.coalesce(F.get("starts", k + 1), F.col("dl") + 1)
    cut = F.transform("starts", lambda s, k: F.struct(term(s).alias("term"), F.transform(F.slice("placed", s, end(k) - s), lambda x: x["position"]).alias("positions")))
    return rows.select("doc_id", "field", "dl", F.inline(cut)).select("field", "term", "doc_id", F.size("positions").alias("tf"), "positions", "dl")


def field_stats(docs: DataFrame, fields: list[str]) -> DataFrame:
    """``field, n, avgdl``: rows, and mean tokens of a field over all rows."""
    sizes = F.array(*[F.struct(F.lit(name).alias("field"), F.size(tokens(field_text(docs, name))).alias("dl")) for name in fields])
    return docs.select(F.inline(sizes)).groupBy("field").agg(F.count("*").alias("n"), (F.sum("dl") / F.count("*")).alias("avgdl"))


def bm25(tf: Column, dl: Column, n: Column, df: Column, avgdl: Column) -> Column:
    """The score of one term in one field."""
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


@dataclass(frozen=True)
class Term:
    """Words that must follow each other, in one field or any."""

    words: tuple[str, ...]
    field: str | None = None


@dataclass(frozen=True)
class Node:
    """must, should and must-not parts."""

    must: tuple = ()
    should: tuple = ()
    never: tuple = ()


_TOKEN = re.compile(r'\s*(?:(?P<open>\()|(?P<close>\))|(?P<sign>[+-])(?=\S)|(?P<field>[A-Za-z_]+):(?=\S)|"(?P<phrase>[^"]*)"|(?P<word>[^\s()"]+))')


def _words(text: str) -> tuple[str, ...]:
    plain = "".join(c if c.isalnum() else " " for c in text.lower())
    return tuple(w for w in plain.split() if len(w.encode()) < LONGEST_TOKEN)


def parse(query: str) -> Node:
    """The query as a tree; unknown fields, open quotes and parentheses are errors."""
    pieces, at = [], 0
    query = query.strip()
    while at < len(query):
        found = _TOKEN.match(query, at)
        if not found:
            raise QueryError(f"unexpected text at {at}: {query[at:]}")
        pieces.append((found.lastgroup, found[found.lastgroup]))
        at = found.end()
    tree, rest = _sequence(pieces)
    if rest:
        raise QueryError("unexpected )")
    return tree


def _sequence(pieces: list[tuple[str, str]]) -> tuple[Node, list[tuple[str, str]]]:
    """Operands up to a closing parenthesis; AND binds closer than OR."""
    groups: list[list[tuple[str, object]]] = []
    joined, negated = False, False
    while pieces and pieces[0][0] != "close":
        kind, value = pieces[0]
        if kind == "word" and value in ("AND", "OR", "NOT"):
            pieces = pieces[1:]
            joined = value == "AND" or joined and value == "NOT"
            negated = negated or value == "NOT"
            continue
        sign = "?"
        if kind == "sign":
            sign, pieces = value, pieces[1:]
            if not pieces:
                raise QueryError("a sign without a term")
        operand, pieces = _operand(pieces)
        sign = "-" if negated or sign == "-" else sign
        if joined and groups:
            groups[-1].append((sign, operand))
        else:
            groups.append([(sign, operand)])
        joined = negated = False
    parts: dict[str, list] = {"+": [], "-": [], "?": []}
    for group in groups:
        if len(group) == 1:
            parts[group[0][0]].append(group[0][1])
        else:
            never = tuple(x for s, x in group if s == "-")
            parts["?"].append(Node(must=tuple(x for s, x in group if s != "-"), never=never))
    return Node(tuple(parts["+"]), tuple(parts["?"]), tuple(parts["-"])), pieces


def _operand(pieces: list[tuple[str, str]]) -> tuple[object, list[tuple[str, str]]]:
    kind, value = pieces[0]
    name = None
    if kind == "field":
        name, pieces = value, pieces[1:]
        if name not in FIELDS | ALSO:
            raise QueryError(f"unknown field {name}")
        if not pieces or pieces[0][0] not in ("word", "phrase"):
            raise QueryError(f"no term after {name}:")
        kind, value = pieces[0]
    if kind == "open":
        tree, pieces = _sequence(pieces[1:])
        if not pieces:
            raise QueryError("missing )")
        return tree, pieces[1:]
    if kind in ("word", "phrase"):
        return Term(_words(value), name), pieces[1:]
    raise QueryError(f"unexpected {value}")


def terms(tree: object) -> list[Term]:
    """All terms of a tree, those that must not occur too."""
    if isinstance(tree, Term):
        return [tree]
    return [t for part in (*tree.must, *tree.should, *tree.never) for t in terms(part)]


def _holds(tree: object, of: dict[Term, str]) -> Column:
    if isinstance(tree, Term):
        return F.col(of[tree]) > 0
    must = [_holds(x, of) for x in tree.must]
    never = [~_holds(x, of) for x in tree.never]
    some = [reduce(lambda a, b: a | b, [_holds(x, of) for x in tree.should])] if tree.should and not must else []
    clauses = must + some + never
    return reduce(lambda a, b: a & b, clauses) if must or some else F.lit(False)


def _score(tree: object, of: dict[Term, str]) -> Column:
    if isinstance(tree, Term):
        return F.col(of[tree])
    return reduce(lambda a, b: a + b, [F.when(_holds(x, of), _score(x, of)).otherwise(0.0) for x in (*tree.must, *tree.should)], F.lit(0.0))


def term_scores(docs: DataFrame, term: Term) -> DataFrame:
    """``doc_id, score``: BM25 of a term or phrase, summed over its fields. A phrase scores as the sum of its words' idf."""
    return wide_scores(docs, [term]).filter("t0 > 0").select("doc_id", F.col("t0").alias("score"))


def _times(words: list[str]) -> Column:
    """How often the tokens ``found`` hold these words in a row."""
    if not words:
        return F.lit(0)
    if len(words) == 1:
        times = F.size(F.filter("found", lambda x: x == words[0]))
    else:
        starts = F.sequence(F.lit(1), F.greatest(F.size("found") - len(words) + 1, F.lit(1)))
        times = F.size(F.filter(starts, lambda at: F.slice("found", at, len(words)) == F.array(*map(F.lit, words))))
    return F.when(F.array_contains("found", words[0]), times).otherwise(0)


def wide_scores(docs: DataFrame, found: list[Term]) -> DataFrame:
    """``doc_id, t0, t1, ...``: the scores of several terms, of rows that have any.

    All terms take one pass over the texts for their statistics and one for their hits, whatever their number. Every field
    is tokenised once a pass; only rows with hits are looked at further, and none is shuffled but for the final sums.
    """
    weights = FIELDS | ALSO
    of = {t: [t.field] if t.field else list(FIELDS) for t in found}
    fields = list(dict.fromkeys(f for fs in of.values() for f in fs))
    if not any(t.words for t in found):
        return docs.limit(0).select("doc_id", *[F.lit(0.0).alias(f"t{i}") for i in range(len(found))])
    texts = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(weights[f]).alias("weight"), tokens(field_text(docs, f)).alias("found")) for f in fields])
    rows = docs.select("doc_id", F.inline(texts))
    words = list(dict.fromkeys(w for t in found for w in t.words))
    counts = [F.count_if(F.array_contains("found", w)).alias(f"df{i}") for i, w in enumerate(words)]
    stats = rows.groupBy("field").agg(F.count("*").alias("n"), (F.sum(F.size("found")) / F.count("*")).alias("avgdl"), *counts)
    tf = [F.when(F.col("field").isin(*of[t]), _times(list(t.words))).otherwise(0).alias(f"tf{i}") for i, t in enumerate(found)]
    some = reduce(lambda a, b: a | b, [F.array_contains("found", t.words[0]) for t in found if t.words])
    hits = rows.filter(some).select("doc_id", "field", "weight", F.size("found").alias("dl"), *tf)
    hits = hits.join(F.broadcast(stats), "field")  # a row for each field of the schema
    df = {w: F.col(f"df{i}") for i, w in enumerate(words)}
    sums = []
    for i, t in enumerate(found):
        one = reduce(lambda a, b: a + b, [bm25(F.col(f"tf{i}"), F.col("dl"), F.col("n"), df[w], F.col("avgdl")) for w in t.words], F.lit(0.0))
        sums.append(F.coalesce(F.sum(F.when(F.col(f"tf{i}") > 0, F.col("weight") * one)), F.lit(0.0)).alias(f"t{i}"))
    return hits.filter(" or ".join(f"tf{i} > 0" for i in range(len(found)))).groupBy("doc_id").agg(*sums)


def combined(tree: object, of_term: Callable[[Term], DataFrame], docs: DataFrame) -> DataFrame:
    """``doc_id, score`` (six decimals) of the rows for which a tree holds, from the scores of its terms."""
    found = list(dict.fromkeys(terms(tree)))
    if not found:
        return docs.limit(0).select("doc_id", F.lit(0.0).alias("score"))
    of = {term: f"t{i}" for i, term in enumerate(found)}
    parts = [of_term(term).select("doc_id", F.lit(of[term]).alias("t"), "score") for term in found]
    wide = reduce(lambda a, b: a.unionByName(b), parts).groupBy("doc_id").agg(*[F.coalesce(F.sum(F.when(F.col("t") == t, F.col("score"))), F.lit(0.0)).alias(t) for t in of.values()])
    return judged(wide, tree, of)


def judged(wide: DataFrame, tree: object, of: dict[Term, str]) -> DataFrame:
    """``doc_id, score`` of the rows for which a tree holds; ``of`` names each term's column of scores (0: not there)."""
    return wide.filter(_holds(tree, of)).select("doc_id", F.round(_score(tree, of), 6).alias("score"))


def scored(docs: DataFrame, query: str) -> DataFrame:
    """``doc_id, score`` of the rows that match a query."""
    tree = parse(query)
    found = list(dict.fromkeys(terms(tree)))
    if not found:
        return docs.limit(0).select("doc_id", F.lit(0.0).alias("score"))
    return judged(wide_scores(docs, found), tree, {t: f"t{i}" for i, t in enumerate(found)})
