"""The full-text dialect on an index: phrases, prefixes, NEAR and column filters from postings alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import ddl
from ..session import kept
from . import fulltext
from .block_index import BlockIndex
from .fulltext import COLUMNS, DEFAULT_LIMIT, Phrase


class FulltextIndex(BlockIndex):
    """Postings of folded tokens. Lengths are those of whole messages, as the dialect's bm25 takes them."""

    fields_ = list(COLUMNS)
    whole = True
    kept_columns = ddl("doc_id long, timestamp_ms long, " + ", ".join(f"{c} string" for c in COLUMNS))

    @classmethod
    def tokens_of(cls, docs: DataFrame) -> DataFrame:
        return docs.select("doc_id", *[(fulltext.tokens(c) if c in docs.columns else F.array().cast("array<string>")).alias(c) for c in COLUMNS])

    @classmethod
    def rows_of(cls, docs: DataFrame) -> DataFrame:
        missing = {c: F.lit(None).cast("string") for c in COLUMNS if c not in docs.columns}
        return docs.withColumns(missing).sortWithinPartitions("timestamp_ms") if missing else docs.sortWithinPartitions("timestamp_ms")

    def _starts(self, rows: DataFrame, phrases: dict[Phrase, str]) -> DataFrame:
        """``doc_id, length`` and of each phrase, by column, where it starts (from 1): of messages that have any of its words."""
        words = {(w, p.prefix and i == len(p.words) - 1) for p in phrases for i, w in enumerate(p.words)}
        name = {key: f"w{i}" for i, key in enumerate(sorted(words))}
        is_ = lambda key: F.startswith("term", F.lit(key[0])) if key[1] else F.col("term") == key[0]
        spots = [F.array_sort(F.flatten(F.collect_list(F.when(is_(key), F.col("positions"))))).alias(n) for key, n in name.items()]
        held = rows.groupBy("doc_id", "field").agg(F.first("dl").alias("length"), *spots)

        def moved(word: str, by: int) -> Column:
            return F.transform(word, lambda x: x - by)

        def starts(p: Phrase) -> Column:
            if not p.words:
                return F.array().cast("array<int>")
            at = [moved(name[w, p.prefix and i == len(p.words) - 1], i - 1) for i, w in enumerate(p.words)]
            found = reduce(F.array_intersect, at) if len(at) > 1 else at[0]
            return F.filter(found, lambda x: x == 1) if p.first else found

        none = F.array().cast("array<int>")
        found = held.select("doc_id", "field", "length", *[F.when(F.col("field").isin(*p.columns), starts(p)).otherwise(none).alias(n) for p, n in phrases.items()])
        of = lambda n, c: F.coalesce(F.first(F.when((F.col("field") == c) & (F.size(n) > 0), F.col(n)), ignorenulls=True), none).alias(c)
        return found.groupBy("doc_id").agg(F.first("length").alias("length"), *[F.struct(*[of(n, c) for c in COLUMNS]).alias(n) for n in phrases.values()])

    def search(self, query: str, start: int | None = None, end: int | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
        """As ``fulltext.search`` over the same messages: the same rows, scores and order.

        Reads the postings of the query's words, of those that begin like its prefixes, and, with dates, the times of the messages.
        """
        tree = fulltext.parse(query)
        none = self.messages.limit(0).select("doc_id", F.lit(0.0).alias("score"))
        found = {p: f"p{i}" for i, p in enumerate(dict.fromkeys(fulltext.phrases(tree)))} if tree is not None else {}
        words = {w for p in found for w in (p.words[:-1] if p.prefix else p.words)}
        prefixes = {p.words[-1] for p in found if p.prefix and p.words}
        if not words and not prefixes:
            return none
        columns = sorted({c for p in found for c in p.columns})
        rows = self.postings(self.blocks_of(sorted(words), columns, sorted(prefixes)), positions=True)
        rows = kept(self._starts(rows, found), "starts")
        held = {p: F.count_if(fulltext._holds(p, found)).alias(n) for p, n in found.items()}
        counts = rows.agg(*held.values()).first()  # a number for each phrase
        hits = rows.filter(fulltext._holds(tree, found))
        if start is not None or end is not None:
            time = F.col("timestamp_ms")
            within = (F.lit(True) if start is None else time >= start) & (F.lit(True) if end is None else time <= end)
            hits = hits.join(self.messages.filter(within).select("doc_id"), "doc_id")
        mean = sum(s["tokens"] for s in self.state.values()) / self.n if self.n else 0.0
        times = fulltext._times(tree, found, F.lit(True))
        hits = hits.select("doc_id", "length", *[t.alias(f"t{i}") for i, (_, t) in enumerate(times)])
        score = fulltext.score([(f"t{i}", F.lit(counts[found[p]])) for i, (p, _) in enumerate(times)], F.lit(self.n), F.lit(mean))
        return hits.select("doc_id", F.round(score, 6).alias("score")).orderBy("score", "doc_id").limit(limit)
