"""Full-text search in the dialect of SQLite's FTS5: its query language, tokens without diacritics, its bm25 (less is better).

Phrases in quotes or joined by ``+``, prefixes (``word*``), ``^`` for a column's first token, column filters (``col:``,
``{a b}:``, ``-col:``), ``NEAR(a b, n)``, implicit AND, NOT, AND, OR and parentheses. Terms are found in arrays of tokens, so
a search takes one pass for the counts of its phrases and one for the matching rows.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, replace
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import K1, QueryError
from .ranking import B as LENGTH_SHARE

#: The columns of a message that are searched, in order.
COLUMNS = ("sender", "recipients", "subject", "body", "folder", "account")
DEFAULT_LIMIT, NEAR = 20, 10
#: The least weight of a phrase that most rows hold (fixed value).
LEAST_IDF = 1e-6

_TOKEN = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([A-Za-z0-9_\x1a\u0080-\U0010ffff]+)|([(){}:+*^,-]))')


@dataclass(frozen=True)
class Phrase:
    """Words in a row, the last one perhaps a prefix; ``first``: only at a column's beginning; ``columns``: only in these."""

    words: tuple[str, ...]
    prefix: bool = False
    first: bool = False
    columns: tuple[str, ...] = COLUMNS


@dataclass(frozen=True)
class Near:
    """Phrases of one column with at most ``within`` tokens between the first and the last."""

    phrases: tuple[Phrase, ...]
    within: int = NEAR


@dataclass(frozen=True)
class Both:
    left: object
    right: object


@dataclass(frozen=True)
class Either:
    left: object
    right: object


@dataclass(frozen=True)
class Without:
    left: object
    right: object


@lru_cache
def _plain_letters() -> tuple[str, str]:
    """Latin letters with a mark, and the letters without it."""
    found = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        letter = chr(code).lower()
        parts = unicodedata.normalize("NFD", letter)
        if len(letter) == 1 and len(parts) > 1 and all(unicodedata.combining(c) for c in parts[1:]):
            found[letter] = parts[0]
    return "".join(found), "".join(found.values())


def tokens(value: Column | str) -> Column:
    """Runs of letters, numbers and private characters, in lower case and without diacritics."""
    marked, plain = _plain_letters()
    text = F.translate(F.lower(F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(""))), marked, plain)
    return F.filter(F.split(F.regexp_replace(text, r"(?<=[\p{L}\p{N}\p{Co}])\p{Mn}+", ""), r"[^\p{L}\p{N}\p{Co}]+"), lambda x: x != "")


def words(text: str) -> tuple[str, ...]:
    """The same of a query's string."""
    marked, plain = _plain_letters()
    text = text.lower().translate(str.maketrans(marked, plain))
    kept = "".join(c if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co" else "" if unicodedata.category(c) == "Mn" else " " for c in text)
    return tuple(kept.split())


class _Reader:
    """Reads a query from left to right: OR binds least, then AND, then NOT; terms side by side bind most."""

    def __init__(self, query: str):
        self.pieces: list[tuple[str, str]] = []
        at, query = 0, query.rstrip()
        while at < len(query):
            found = _TOKEN.match(query, at)
            if not found:
                raise QueryError(f"syntax error near {query[at:].lstrip()[:20]!r}")
            text, word, mark = found.groups()
            self.pieces.append(("string", text.replace('""', '"')) if text is not None else ("word", word) if word else ("mark", mark))
            at = found.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        place = self.at + ahead
        return self.pieces[place] if place < len(self.pieces) else ("end", "")

    def take(self, *wanted: tuple[str, str]) -> bool:
        if self.peek() in wanted:
            self.at += 1
            return True
        return False

    def need(self, mark: str) -> None:
        if not self.take(("mark", mark)):
            raise QueryError(f"syntax error near {self.peek()[1]!r}")

    def query(self) -> object:
        tree = self.either()
        if self.peek()[0] != "end":
            raise QueryError(f"syntax error near {self.peek()[1]!r}")
        return tree

    def either(self) -> object:
        tree = self.both()
        while self.take(("word", "OR")):
            tree = Either(tree, self.both())
        return tree

    def both(self) -> object:
        tree = self.without()
        while self.take(("word", "AND")):
            tree = Both(tree, self.without())
        return tree

    def without(self) -> object:
        tree = self.beside()
        while self.take(("word", "NOT")):
            tree = Without(tree, self.beside())
        return tree

    def beside(self) -> object:
        tree = self.limited()
        while (self.peek()[0] in ("string", "word") and self.peek() not in (("word", "AND"), ("word", "OR"), ("word", "NOT"))) or self.peek() in (("mark", "^"), ("mark", "{"), ("mark", "("), ("mark", "-")):
            other = self.limited()  # a string without words counts for nothing beside others
            blank = lambda t: isinstance(t, Phrase) and not t.words
            tree = tree if blank(other) else other if blank(tree) else Both(tree, other)
        return tree

    def limited(self) -> object:
        """A group, phrase or NEAR, with its column filter."""
        start, columns = self.at, None
        unless = self.take(("mark", "-"))
        if self.take(("mark", "{")):
            columns = []
            while self.peek()[0] in ("string", "word"):
                columns.append(self.peek()[1])
                self.at += 1
            self.need("}")
            self.need(":")
        elif self.peek()[0] in ("string", "word") and self.peek(1) == ("mark", ":"):
            columns = [self.peek()[1]]
            self.at += 2
        elif unless:
            raise QueryError(f"syntax error near {self.pieces[start][1]!r}")
        if columns is not None:
            names = {c.lower() for c in columns}
            if unknown := names - set(COLUMNS):
                raise QueryError(f"no such column: {min(unknown)}")
            names = set(COLUMNS) - names if unless else names
        if self.take(("mark", "(")):
            tree = self.either()
            self.need(")")
        elif self.peek() == ("word", "NEAR") and self.peek(1) == ("mark", "("):
            tree = self.near()
        else:
            first = self.take(("mark", "^"))
            tree = replace(self.phrase(), first=first)
        return tree if columns is None else _within(tree, names)

    def near(self) -> Near:
        self.at += 2
        phrases, within = [], NEAR
        while self.peek()[0] in ("string", "word"):
            phrases.append(self.phrase())
        if self.take(("mark", ",")):
            kind, value = self.peek()
            if kind != "word" or not (value.isascii() and value.isdigit()):
                raise QueryError(f"expected integer, got {value!r}")
            within, self.at = int(value), self.at + 1
        self.need(")")
        if not phrases:
            raise QueryError("syntax error near ')'")
        return Near(tuple(phrases), within)

    def phrase(self) -> Phrase:
        found: tuple[str, ...] = ()
        while True:
            kind, value = self.peek()
            if kind not in ("string", "word") or kind == "word" and value in ("AND", "OR", "NOT"):
                raise QueryError(f"syntax error near {value!r}")
            self.at += 1
            found += words(value)
            if not self.take(("mark", "+")):
                break
        return Phrase(found, self.take(("mark", "*")))


def _within(tree: object, names: set[str]) -> object:
    """The tree with its phrases limited to some columns, and to those that they were limited to before."""
    if isinstance(tree, Phrase):
        return replace(tree, columns=tuple(c for c in tree.columns if c in names))
    if isinstance(tree, Near):
        return replace(tree, phrases=tuple(_within(p, names) for p in tree.phrases))
    return type(tree)(_within(tree.left, names), _within(tree.right, names))


def parse(query: str) -> object | None:
    """The query as a tree; None if it is empty. What isn't in the language is a QueryError."""
    return _Reader(query).query() if query.strip() else None


def phrases(tree: object) -> list[Phrase]:
    """All phrases of a tree, in order."""
    if isinstance(tree, Phrase):
        return [tree]
    if isinstance(tree, Near):
        return list(tree.phrases)
    return phrases(tree.left) + phrases(tree.right)


def _starts(phrase: Phrase, column: str) -> Column:
    """Where a phrase starts in the tokens of a column, from 1."""
    none = F.array().cast("array<int>")
    if not phrase.words or column not in phrase.columns:
        return none
    held, count = F.col(f"tokens.{column}"), len(phrase.words)

    def fits(token: Column, number: int) -> Column:
        word = phrase.words[number]
        return F.startswith(token, F.lit(word)) if phrase.prefix and number == count - 1 else token == word

    last = F.lit(1) if phrase.first else F.greatest(F.size(held) - count + 1, F.lit(1))
    found = F.filter(F.sequence(F.lit(1), last), lambda at: reduce(lambda a, b: a & b, [F.coalesce(fits(F.get(held, at + i - 1), i), F.lit(False)) for i in range(count)]))
    some = F.exists(held, lambda token: fits(token, 0))
    return F.when(some, found).otherwise(none)


def _together(near: Near, column: str, of: dict[Phrase, str]) -> list[Column]:
    """For each phrase of a NEAR group its starts in the column that are in some group."""
    held = [F.col(f"{of[p]}.{column}") for p in near.phrases]
    if len(held) == 1:
        return held
    reach = [near.within + len(p.words) for p in near.phrases]
    ends = F.filter(F.array_distinct(F.concat(*held)), lambda m: reduce(lambda a, b: a & b, [_any_between(s, m, r) for s, r in zip(held, reach, strict=True)]))
    return [_near_any(s, ends, r) for s, r in zip(held, reach, strict=True)]


def _any_between(starts: Column, end: Column, reach: int) -> Column:
    return F.exists(starts, lambda at: (at <= end) & (at >= end - reach))


def _near_any(starts: Column, ends: Column, reach: int) -> Column:
    return F.filter(starts, lambda at: F.exists(ends, lambda m: (at <= m) & (at >= m - reach)))


def _holds(tree: object, of: dict[Phrase, str]) -> Column:
    if isinstance(tree, Phrase):
        return reduce(lambda a, b: a | b, [F.size(f"{of[tree]}.{c}") > 0 for c in COLUMNS])
    if isinstance(tree, Near):
        return reduce(lambda a, b: a | b, [F.size(_together(tree, c, of)[0]) > 0 for c in COLUMNS])
    left, right = _holds(tree.left, of), _holds(tree.right, of)
    return left & right if isinstance(tree, Both) else left | right if isinstance(tree, Either) else left & ~right


def _times(tree: object, of: dict[Phrase, str], matched: Column) -> list[tuple[Phrase, Column]]:
    """Each phrase with how often a row has it, as far as the part of the query that it is in holds."""
    if isinstance(tree, Phrase):
        return [(tree, F.when(matched, sum((F.size(f"{of[tree]}.{c}") for c in COLUMNS), F.lit(0))).otherwise(0))]
    if isinstance(tree, Near):
        held = [_together(tree, c, of) for c in COLUMNS]
        return [(p, F.when(matched, sum((F.size(h[i]) for h in held), F.lit(0))).otherwise(0)) for i, p in enumerate(tree.phrases)]
    sides = (tree.left, tree.right) if not isinstance(tree, Without) else (tree.left,)
    found = [x for side in sides for x in _times(side, of, matched & _holds(side, of))]
    return found + ([(p, F.lit(0)) for p in phrases(tree.right)] if isinstance(tree, Without) else [])


def search(docs: DataFrame, query: str, start: int | None = None, end: int | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """``doc_id, score`` of the rows that match, the least score first, ``limit`` at most; ties go to the smaller doc_id.

    ``docs`` has ``doc_id``, ``timestamp_ms`` and any of COLUMNS; ``start <= timestamp_ms <= end`` where these are given.
    Scores are FTS5's: over rows, phrases and columns of the whole table, before the dates are looked at.
    """
    tree = parse(query)
    if tree is None:
        return docs.limit(0).select("doc_id", F.lit(0.0).alias("score"))
    held = F.struct(*[(tokens(c) if c in docs.columns else F.array().cast("array<string>")).alias(c) for c in COLUMNS])
    rows = docs.select("doc_id", "timestamp_ms", held.alias("tokens"))
    of = {p: f"p{i}" for i, p in enumerate(dict.fromkeys(phrases(tree)))}
    spots = [F.struct(*[_starts(p, c).alias(c) for c in COLUMNS]).alias(name) for p, name in of.items()]
    rows = rows.select("doc_id", "timestamp_ms", sum((F.size(f"tokens.{c}") for c in COLUMNS), F.lit(0)).alias("length"), *spots)
    counts = [F.count_if(_holds(p, of)).alias(f"n_{name}") for p, name in of.items()]
    stats = rows.agg(F.count("*").alias("rows_"), (F.sum("length") / F.count("*")).alias("mean"), *counts)
    matched = _holds(tree, of)
    times = _times(tree, of, F.lit(True))
    hits = rows.filter(matched)
    for bound, side in ((start, F.col("timestamp_ms") >= start), (end, F.col("timestamp_ms") <= end)):
        hits = hits if bound is None else hits.filter(side)
    hits = hits.select("doc_id", "length", *[t.alias(f"t{i}") for i, (_, t) in enumerate(times)]).crossJoin(F.broadcast(stats))  # one row
    found = score([(f"t{i}", F.col(f"n_{of[p]}")) for i, (p, _) in enumerate(times)], F.col("rows_"), F.col("mean"))
    return hits.select("doc_id", F.round(found, 6).alias("score")).orderBy("score", "doc_id").limit(limit)


def score(times: list[tuple[str, Column]], rows: Column, mean: Column) -> Column:
    """The dialect's bm25 of a row: of each phrase the column of how often it is there, and the rows that have it."""
    found = F.lit(0.0)
    for name, n in times:
        idf = F.log((rows - n + 0.5) / (n + 0.5))
        idf = F.when(idf > 0, idf).otherwise(LEAST_IDF)
        found = found - idf * F.col(name) * (K1 + 1) / (F.col(name) + K1 * (1 - LENGTH_SHARE + LENGTH_SHARE * F.col("length") / mean))
    return found
