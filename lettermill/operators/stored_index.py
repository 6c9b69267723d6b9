"""The derived index on disk: ranked search over blocks of postings, with filters over the messages."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import snippet, tokens
from ..functions.types import ddl
from ..schemas import SEARCH_DOCS
from . import ranking
from .block_index import BlockIndex, _exists
from .blocks import BLOCK
from .search import RESULT, SearchRequest, filter_scores, filters, result_columns, with_filters

ALL_FIELDS = [*ranking.FIELDS, *ranking.ALSO]
MESSAGES = T.StructType([*SEARCH_DOCS.fields, *ddl("snippet string").fields])
#: Postings of a query's words from which on blocks are skipped: below, reading all is cheaper than finding a threshold.
SKIP_FROM = 1 << 20
#: A score's last decimal.
STEP = 1e-6


class NothingIndexed(ValueError):
    """No message could be indexed."""


class StoredIndex(BlockIndex):
    """The index of the search projection, for ``SearchRequest``."""

    fields_ = ALL_FIELDS
    kept_columns = MESSAGES

    @classmethod
    def tokens_of(cls, docs: DataFrame) -> DataFrame:
        return docs.select("doc_id", *[tokens(ranking.field_text(docs, f)).alias(f) for f in ALL_FIELDS])

    @classmethod
    def rows_of(cls, docs: DataFrame) -> DataFrame:
        return docs.withColumn("snippet", snippet("body")).sortWithinPartitions("timestamp_ms")

    @classmethod
    def open(cls, spark: SparkSession, folder: str, parsed: Callable[[], tuple[DataFrame, int]]) -> StoredIndex:
        """The index below a folder; if there is none or it is empty, it is built.

        ``parsed`` gives the search projection of the messages that are present, and how many couldn't be read. An index of
        nothing is an error, if that is because none could be read.
        """
        if _exists(spark, f"{folder}/state"):
            index = cls(spark, folder)
            if index._states and index.n:
                return index
        docs, failed = parsed()
        index = cls.write(docs, folder)
        if not index.n and failed:
            raise NothingIndexed(f"none of {failed} messages could be read")
        return index

    @property
    def fields(self) -> dict[str, tuple[int, float]]:
        """Messages and mean tokens of each field."""
        return {f: (s["n"], s["tokens"] / s["n"] if s["n"] else 0.0) for f, s in self.state.items()}

    # scores

    def _of_field(self, value: Callable[[str], float | int]) -> Column:
        return reduce(lambda c, f: c.when(F.col("field") == f, F.lit(value(f))), self.fields, F.when(F.lit(False), F.lit(0.0)))

    def _weighted(self, df: Column) -> Column:
        """The score of a row's term in its field."""
        weights = ranking.FIELDS | ranking.ALSO
        n, avgdl = self._of_field(lambda f: float(self.fields[f][0])), self._of_field(lambda f: float(self.fields[f][1]))
        return self._of_field(lambda f: weights[f]) * ranking.bm25(F.col("tf"), F.col("dl"), n, df, avgdl)

    def _scored_postings(self, words: list[str], fields: list[str], held: DataFrame | None = None, positions: bool = False) -> DataFrame:
        """Postings with ``df`` and ``score``. Frequencies are broadcast: a row for each word and field of a query."""
        rows = self.postings(self.blocks_of(words, fields) if held is None else held, positions)
        return rows.join(F.broadcast(self.frequencies(words, fields)), ["term", "field"]).withColumn("score", self._weighted(F.col("df")))

    def term_scores(self, term: ranking.Term) -> DataFrame:
        """``doc_id, score`` of a word or phrase, as by ``ranking.term_scores``."""
        words = list(term.words)
        if not words:
            return self.messages.limit(0).select("doc_id", F.lit(0.0).alias("score"))
        fields = [term.field] if term.field else list(ranking.FIELDS)
        if len(words) == 1:
            return self._scored_postings(words, fields).groupBy("doc_id").agg(F.sum("score").alias("score"))
        rows = self._scored_postings(words, fields, positions=True)
        one = reduce(lambda a, b: a + b, [self._weighted(F.col(f"df{i}")) for i in range(len(words))])
        return self._phrases(rows, words).groupBy("doc_id").agg(F.sum(one).alias("score"))

    def scored(self, query: str, held: DataFrame | None = None) -> DataFrame:
        """``doc_id, score`` of the messages that match a query; one pass over postings if no term is a phrase.

        ``held``: the blocks to read, if not all.
        """
        tree = ranking.parse(query)
        found = list(dict.fromkeys(ranking.terms(tree)))
        if not found or any(len(t.words) != 1 for t in found):
            return ranking.combined(tree, self.term_scores, self.messages)
        words, fields = _asked(found)
        rows = self._scored_postings(words, fields, held)
        of = {term: f"t{i}" for i, term in enumerate(found)}
        hit = lambda t: (F.col("term") == t.words[0]) & F.col("field").isin(*([t.field] if t.field else ranking.FIELDS))
        wide = rows.groupBy("doc_id").agg(*[F.coalesce(F.sum(F.when(hit(t), F.col("score"))), F.lit(0.0)).alias(name) for t, name in of.items()])
        return ranking.judged(wide, tree, of)

    @staticmethod
    def _phrases(rows: DataFrame, words: list[str]) -> DataFrame:
        """Rows of messages that hold the words in a row; ``tf`` counts how often."""
        spots = [F.flatten(F.collect_list(F.when(F.col("term") == w, F.col("positions")))).alias(f"p{i}") for i, w in enumerate(words)]
        counts = [F.max(F.when(F.col("term") == w, F.col("df"))).alias(f"df{i}") for i, w in enumerate(words)]
        held = rows.groupBy("field", "doc_id", "dl").agg(*spots, *counts)
        # the starts of the phrase: positions of the first word that are those of each other one, moved back
        moved = lambda i: F.transform(f"p{i}", lambda p: p - i)
        starts = reduce(F.array_intersect, map(moved, range(1, len(words))), F.col("p0"))
        return held.withColumn("tf", F.size(starts)).filter("tf > 0")

    # the best, without reading all

    def best_blocks(self, request: SearchRequest) -> DataFrame | None:
        """The blocks that can hold one of the best ``request.limit`` messages; None: all, as nothing bounds them.

        For words any of which will do. The best blocks of all words give a first threshold: the score of the last of the
        messages asked for, among those that they hold and that pass the filters. A block is left out if its bound, with the
        best that all other words can add, stays below it. So a message of a block that is left out isn't among the best,
        and what others miss of their scores is too little to matter.
        """
        tree = ranking.parse(request.text.strip())
        found = list(dict.fromkeys(ranking.terms(tree)))
        if not found or tree.must or tree.never or any(not isinstance(x, ranking.Term) or len(x.words) != 1 for x in tree.should):
            return None
        words, fields = _asked(found)
        times: dict[tuple[str, str], int] = {}  # a word that is asked for several times counts as often
        for t in ranking.terms(tree):
            for f in [t.field] if t.field else ranking.FIELDS:
                times[t.words[0], f] = times.get((t.words[0], f), 0) + 1
        if self.at_most(words) < SKIP_FROM:
            return None
        held = self.blocks_of(words, fields)
        lists = held.groupBy("term", "field", "generation").agg(F.max("impact").alias("impact"), F.sum(F.col("postings").cast("long")).alias("postings")).collect()
        lists = [r for r in lists if (r["term"], r["field"]) in times]
        if sum(r["postings"] for r in lists) < SKIP_FROM:
            return None
        df = {(r["term"], r["field"]): r["df"] for r in self.frequencies(words, fields).collect()}
        weights, scale = ranking.FIELDS | ranking.ALSO, {}
        for r in lists:  # a block's bound is its impact times this: the impact was taken at another mean length, which can't make it more than in proportion
            n, mean = self.fields[r["field"]]
            then = self._states[r["generation"]][r["field"]]["mean"] or 1.0
            have = df[r["term"], r["field"]]
            idf = math.log(1 + (n - have + 0.5) / (have + 0.5))
            scale[r["term"], r["field"], r["generation"]] = times[r["term"], r["field"]] * weights[r["field"]] * idf * (ranking.K1 + 1) * max(1.0, mean / then)
        most: dict[tuple[str, str], float] = {}
        for r in lists:
            key = (r["term"], r["field"])
            most[key] = max(most.get(key, 0.0), r["impact"] * scale[*key, r["generation"]])
        each = lambda value: reduce(lambda c, k: c.when((F.col("term") == k[0]) & (F.col("field") == k[1]) & (F.col("generation") == k[2]), F.lit(value(k))), scale, F.when(F.lit(False), F.lit(0.0)))
        bound = F.col("impact") * each(scale.get)
        wanted = 4 + 2 * -(-request.limit // BLOCK) * len(most)
        top = [r["bound"] for r in held.select(bound.alias("bound")).orderBy(F.desc("bound")).limit(wanted).collect()]
        first = self.scored(request.text.strip(), held.filter(bound >= top[-1]))
        if request.has_filters():
            first = first.join(self.messages.filter(filters(request)).select("doc_id"), "doc_id")
        scores = [r["score"] for r in first.select("score").orderBy(F.desc("score")).limit(request.limit).collect()]
        if len(scores) < request.limit:
            return None
        threshold, whole = scores[-1] - 2 * STEP, sum(most.values())
        least = {k: (threshold - (whole - most[k[:2]])) / scale[k] if scale[k] else 0.0 for k in scale}
        return held.filter(F.col("impact") >= each(least.get))

    def search(self, request: SearchRequest, strict_scoring: bool = False) -> DataFrame:
        """As ``search.search``, from the index: the same rows in the same order."""
        text = request.text.strip()
        if not text or request.limit <= 0:
            return self._best(request, None)
        if strict_scoring:
            return self._best(request, with_filters(self.scored(text), filter_scores(self.messages, request)))
        return self._best(request, self.scored(text, self.best_blocks(request)))

    def _best(self, request: SearchRequest, scores: DataFrame | None) -> DataFrame:
        docs = self.messages
        columns = [F.coalesce("snippet", F.lit("")).alias("snippet") if name == "snippet" else c for name, c in zip(RESULT, result_columns(F.lit(0.0)), strict=True)]
        if request.limit <= 0 or scores is None and not request.has_filters():
            return docs.limit(0).select(*columns)
        matching = docs.filter(filters(request))
        if scores is not None:
            matching = matching.select(*columns).drop("score").join(scores, "doc_id").select(*RESULT)
            return matching.orderBy(F.desc("score"), "doc_id").limit(request.limit)
        return matching.select(*columns).orderBy(F.desc("timestamp_ms"), "doc_id").limit(request.limit)

    def search_all(self, requests: dict[str, SearchRequest]) -> DataFrame:
        """``request`` and the result rows of several named requests, as one job."""
        found = [self.search(r).select(F.lit(name).alias("request"), *RESULT) for name, r in requests.items()]
        return reduce(lambda a, b: a.unionByName(b), found)


def _asked(found: list[ranking.Term]) -> tuple[list[str], list[str]]:
    """The words and the fields of single-word terms."""
    return sorted({t.words[0] for t in found}), list(dict.fromkeys(f for t in found for f in ([t.field] if t.field else ranking.FIELDS)))
