"""An index on disk in generations: blocks of postings in order of their terms, and the messages themselves.

A build is one generation; an update adds one with the blocks of new and changed messages, the ids that it replaces or
removes, whose older rows are dead from then on, and how often it takes each term away. The row of ``state`` is written last
and names the live generations, so an update that fails leaves the index as it was. Generations that aren't much larger than
what came after them are merged with it, dealt anew by their size and without their dead rows: their number grows with the
logarithm of the corpus, and what is dead stays a part of what is alive.

A generation's blocks are dealt in ranges of terms, so a term or a prefix is found in few folders (partition pruning) and
there by the statistics of sorted files. Texts are never scanned.
"""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property, reduce
from itertools import chain

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import ddl
from ..session import broadcast_if_small, is_small, kept, placed, removed
from .blocks import BLOCKS, MESSAGE_ROWS, RUN_ROWS, batches_of, blocks, purged, runs

#: Tokens of a range of terms, and most ranges of a generation. A generation is merged with all that follow it, if these
#: have together a GROWTH-th of its tokens or more.
RANGE_TOKENS, MOST, GROWTH = 8_000_000, 4096, 2
#: Tokens from which on a generation has a range for each core at least.
SPREAD_TOKENS = 100_000
#: How the index and what it is made from are compressed.
PACKED = {"compression": "zstd"}
PARTS = ("state", "gone", "lost", "ranges", "blocks", "messages")
STATE = "field string, n long, tokens long, mean double, held long, live array<int>"
RANGES = "bucket int, lo string, hi string, postings long"
LOST = "term string, field string, lost long"


class BlockIndex:
    """An index below a folder, as of its last state. What is small of it (a row a field, a row a range) is read once."""

    #: What a subclass says: its fields, whether lengths are those of messages, and the columns of messages that it keeps.
    fields_: list[str] = []
    whole = False
    kept_columns: T.StructType

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @classmethod
    def tokens_of(cls, docs: DataFrame) -> DataFrame:
        """``doc_id`` and an array of tokens for each field."""
        raise NotImplementedError

    @classmethod
    def rows_of(cls, docs: DataFrame) -> DataFrame:
        """What is kept of messages."""
        raise NotImplementedError

    # writing

    @classmethod
    def write(cls, docs: DataFrame, folder: str) -> BlockIndex:
        """Build the index of the search projection ``docs``, over whatever is there."""
        index = cls(docs.sparkSession, folder)
        for part in PARTS:  # the state goes first: no reader takes a half-written index
            removed(index.spark, f"{folder}/{part}")
        n, tokens = index._add(docs, 0)
        index._commit(0, n, tokens, index._means(n, tokens), sum(tokens.values()), [0])
        return cls(docs.sparkSession, folder)

    def update(self, changed: DataFrame, removed: DataFrame) -> BlockIndex:
        """The index after ``changed`` rows of the search projection, new or in place of old ones, and without ``removed(doc_id)``."""
        new, state = self.last + 1, self.state
        self._cleared(new)
        if not self.n:  # nothing is replaced, and what older generations may still hold is dead
            n, tokens = self._add(changed, new)
            self._commit(new, n, tokens, self._means(n, tokens), sum(tokens.values()), [new])
            return type(self)(self.spark, self.folder)
        ids = kept(changed.select("doc_id").union(removed.select("doc_id")).distinct(), "ids")
        old = self.messages.join(broadcast_if_small(ids), "doc_id", "left_semi")
        seen = Observation()
        found = self.tokens_of(old)
        sizes = [F.sum(F.size(f)).alias(f) for f in self.fields_]
        found.observe(seen, F.count("*").alias("n"), *sizes).select(
            "doc_id", F.array(*[F.struct(F.lit(f).alias("field"), F.array_distinct(f).alias("terms")) for f in self.fields_]).alias("held")
        ).write.mode("overwrite").options(**PACKED).parquet(self._path("gone", new))
        lost = self.spark.read.parquet(self._path("gone", new)).select(F.inline("held")).select("field", F.explode("terms").alias("term"))
        lost.groupBy("term", "field").agg(F.count("*").alias("lost")).select("term", "field", "lost").write.mode("overwrite").options(**PACKED).parquet(self._path("lost", new))
        n, tokens = self._add(changed, new)
        gone = seen.get
        total = {f: state[f]["tokens"] + tokens[f] - (gone[f] or 0) for f in self.fields_}
        self._commit(new, self.n + n - gone["n"], total, self._means(n, tokens), sum(tokens.values()), [*self.live, new])
        return type(self)(self.spark, self.folder)._merged()

    def _path(self, part: str, generation: int) -> str:
        return f"{self.folder}/{part}/generation={generation}"

    def _cleared(self, generation: int) -> None:
        """Nothing is left of an update that failed."""
        for part in PARTS:
            removed(self.spark, self._path(part, generation))

    def _add(self, docs: DataFrame, generation: int) -> tuple[int, dict[str, int]]:
        """Write a generation of these messages; their number, and tokens by field."""
        seen = Observation()
        rows = self.rows_of(docs).observe(seen, F.count("*").alias("n")).select(*self.kept_columns.names)
        with ThreadPoolExecutor(1) as beside, batches_of(self.spark, MESSAGE_ROWS):  # messages and runs don't need each other
            writing = beside.submit(rows.write.mode("overwrite").options(**PACKED).parquet, self._path("messages", generation))
            parts, place = placed(runs(self.tokens_of(docs), self.fields_, self.whole), "runs", **PACKED)
            writing.result()
        sums = {r["field"]: r["tokens"] for r in parts.groupBy("field").agg(F.sum("tokens").alias("tokens")).collect()}
        tokens = {f: sums.get(f, 0) for f in self.fields_}
        n = seen.get["n"]
        self._deal(parts, generation, tokens, self._means(n, tokens))
        removed(self.spark, place)
        return n, tokens

    def _means(self, n: int, tokens: dict[str, int]) -> dict[str, float]:
        """Mean lengths as blocks are ordered by them."""
        whole = sum(tokens.values())
        return {f: (whole if self.whole else tokens[f]) / n if n else 0.0 for f in self.fields_}

    def _deal(self, parts: DataFrame, generation: int, tokens: dict[str, int], means: dict[str, float]) -> None:
        """Write the blocks of ``parts`` in ranges of terms."""
        total = sum(tokens.values())
        ranges = min(MOST, max(total // RANGE_TOKENS, self.spark.sparkContext.defaultParallelism if total >= SPREAD_TOKENS else 1))
        dealt = parts.repartitionByRange(ranges, "term", "field", "first").sortWithinPartitions("term", "field")  # a frequent term takes several ranges
        made = blocks(dealt, means).withColumn("bucket", F.spark_partition_id())
        with batches_of(self.spark, RUN_ROWS):
            made.write.mode("overwrite").options(**PACKED).partitionBy("bucket").parquet(self._path("blocks", generation))
        written = self.spark.read.schema(ddl(f"{BLOCKS}, bucket int")).parquet(self._path("blocks", generation))
        bounds = written.groupBy("bucket").agg(F.min("term").alias("lo"), F.max("term").alias("hi"), F.sum(F.col("postings").cast("long")).alias("postings"))
        bounds.coalesce(1).write.mode("overwrite").parquet(self._path("ranges", generation))

    def _commit(self, generation: int, n: int, tokens: dict[str, int], means: dict[str, float], held: int, live: list[int]) -> None:
        fixed = {"n": n, "held": held, "live": F.array(*map(F.lit, live))}
        row = lambda f: F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast(kind.dataType).alias(kind.name) for kind in ddl(STATE) for v in [(fixed | {"field": f, "tokens": tokens[f], "mean": means[f]})[kind.name]]])
        self.spark.range(1).coalesce(1).select(F.inline(F.array(*map(row, self.fields_)))).write.mode("overwrite").parquet(self._path("state", generation))

    def _merged(self) -> BlockIndex:
        """The index after the merges that its growth asks for."""
        held = [self._states[g][self.fields_[0]]["held"] for g in self.live]
        start, total = len(held) - 1, held[-1]
        while start and held[start - 1] <= GROWTH * total:
            start -= 1
            total += held[start]
        return self._merge(start, self.folder) if start < len(held) - 1 else self

    def compacted(self, folder: str) -> BlockIndex:
        """A new index below another folder with what is alive here, as one generation; nothing is tokenised again."""
        for part in PARTS:
            removed(self.spark, f"{folder}/{part}")
        return self._merge(0, folder)

    def _merge(self, start: int, folder: str) -> BlockIndex:
        """The live generations from the ``start``-th on as one."""
        into = type(self)(self.spark, folder)
        some, rest = self.live[start:], self.live[:start]
        new = self.last + 1
        into._cleared(new)
        of = F.col("generation").isin(*some)
        self.messages.filter(of).select(*self.kept_columns.names).write.mode("overwrite").options(**PACKED).parquet(into._path("messages", new))
        parts = self._held.filter(of)
        lost_again = None
        if self._gone is not None and is_small(self._gone):
            without = lambda *lists: parts.select("term", "field", "generation", "postings", "ids", *lists).mapInArrow(purged(self.spark, self._gone, self.live, lists), _schema(lists))
            lost_again = without().filter("dead > 0").groupBy("term", "field").agg((-F.sum(F.col("dead").cast("long"))).alias("lost"))
            parts = without("tf", "dl", "positions").filter("postings > 0").withColumn("first", F.col("ids")[0]).withColumn("positions", F.flatten("positions"))
        elif self._gone is not None:
            posting = parts.select("term", "field", "generation", F.inline(F.arrays_zip("ids", "tf", "dl", "positions"))).withColumnRenamed("ids", "doc_id")
            marked = kept(posting.join(broadcast_if_small(self._gone), "doc_id", "left").withColumn("dead", self._dead()), "marked")
            lost_again = marked.filter("dead").groupBy("term", "field").agg((-F.count("*")).alias("lost"))
            one = lambda c: F.array(c).alias(c)
            parts = marked.filter("not dead").select("term", "field", F.col("doc_id").alias("first"), F.lit(1).alias("postings"), F.array("doc_id").alias("ids"), one("tf"), one("dl"), "positions")
        else:
            parts = parts.withColumn("first", F.col("ids")[0]).withColumn("positions", F.flatten("positions"))
        tokens = {f: self.state[f]["tokens"] for f in self.fields_}
        means = self._means(self.n, tokens)
        into._deal(parts, new, tokens, means)
        if rest:
            before = self._part("gone", "doc_id long, generation int").filter(of)
            before.select("doc_id").distinct().write.mode("overwrite").options(**PACKED).parquet(into._path("gone", new))
            lost = self._part("lost", f"{LOST}, generation int").filter(of).select("term", "field", "lost")
            lost = lost if lost_again is None else lost.unionByName(lost_again)
            lost.groupBy("term", "field").agg(F.sum("lost").alias("lost")).filter("lost <> 0").write.mode("overwrite").options(**PACKED).parquet(into._path("lost", new))
        held = sum(self._states[g][self.fields_[0]]["held"] for g in some) if rest else sum(tokens.values())
        into._commit(new, self.n, tokens, means, held, [*rest, new])
        return type(self)(self.spark, folder)

    def vacuum(self) -> None:
        """Remove the files of generations that aren't live any more; readers of older states lose them."""
        for part in PARTS:
            for g in range(self.last + 1):
                if g not in self.live:
                    removed(self.spark, self._path(part, g))

    # reading

    @cached_property
    def _states(self) -> dict[int, dict[str, dict]]:
        out: dict[int, dict[str, dict]] = {}
        for r in self.spark.read.schema(ddl(f"{STATE}, generation int")).parquet(f"{self.folder}/state").collect():
            out.setdefault(r["generation"], {})[r["field"]] = r.asDict()
        return out

    @property
    def last(self) -> int:
        return max(self._states)

    @property
    def state(self) -> dict[str, dict]:
        """Of each field: messages, tokens in all; of the last generation, mean lengths when it was made, tokens; the live generations."""
        return self._states[self.last]

    @property
    def live(self) -> list[int]:
        return self.state[self.fields_[0]]["live"]

    @property
    def n(self) -> int:
        """Live messages."""
        return self.state[self.fields_[0]]["n"]

    def _part(self, part: str, schema: str | T.StructType) -> DataFrame:
        """The live generations of a part; without any, no rows."""
        schema = ddl(schema) if isinstance(schema, str) else schema
        paths = [self._path(part, g) for g in self.live if _exists(self.spark, self._path(part, g))]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{part}").parquet(*paths)

    @cached_property
    def _held(self) -> DataFrame:
        return self._part("blocks", f"{BLOCKS}, generation int, bucket int")

    @cached_property
    def _ranges(self) -> list[tuple[int, int, str, str, int]]:
        """``generation, bucket, lo, hi, postings``: at most MOST rows a generation."""
        rows = self._part("ranges", f"{RANGES}, generation int").collect()
        return [(r["generation"], r["bucket"], r["lo"], r["hi"], r["postings"]) for r in rows]

    def _order(self) -> Column:
        """The place of a row's generation among the live ones."""
        return F.create_map(*map(F.lit, chain.from_iterable((g, i) for i, g in enumerate(self.live))))[F.col("generation")]

    @cached_property
    def _gone(self) -> DataFrame | None:
        """``doc_id, until``: the place in the order of generations below which a message's rows are dead; None without any."""
        if not any(_exists(self.spark, self._path("gone", g)) for g in self.live):
            return None
        rows = self._part("gone", "doc_id long, generation int")
        return kept(rows.groupBy("doc_id").agg(F.max(self._order()).alias("until")), "gone")

    def _dead(self) -> Column:
        return F.coalesce(F.col("until") > self._order(), F.lit(False))

    def _alive(self, rows: DataFrame) -> DataFrame:
        """Rows that no later generation replaces. The ids of dead ones are broadcast, up to a checked size."""
        if self._gone is None:
            return rows
        return rows.join(broadcast_if_small(self._gone), "doc_id", "left").filter(~self._dead()).drop("until")

    @cached_property
    def messages(self) -> DataFrame:
        return self._alive(self._part("messages", T.StructType([*self.kept_columns.fields, *ddl("generation int").fields])))

    def _between(self, low: str, high: str | None, word: Column) -> Column:
        """Rows for which ``word`` holds, in the folders that have terms of ``low <= term <= high`` (None: any further)."""
        of: dict[int, list[int]] = {}
        for g, b, lo, hi, _ in self._ranges:
            if low <= hi and (high is None or lo <= high):
                of.setdefault(g, []).append(b)
        return reduce(lambda a, b: a | b, [(F.col("generation") == g) & F.col("bucket").isin(*bs) for g, bs in of.items()], F.lit(False)) & word

    def at_most(self, words: Iterable[str]) -> int:
        """Postings of the ranges that these words are in: as many as theirs, or more."""
        return sum({(g, b): n for w in words for g, b, lo, hi, n in self._ranges if lo <= w <= hi}.values())

    def blocks_of(self, words: Iterable[str], fields: Iterable[str], prefixes: Iterable[str] = ()) -> DataFrame:
        """Blocks of some words, and of words that begin so, in some fields."""
        term = F.col("term")
        clauses = [self._between(w, w, term == w) for w in words]
        for p in prefixes:
            end = _after(p)
            clauses.append(self._between(p, end, (term >= p) & (F.lit(True) if end is None else term < end)))
        return self._held.filter(reduce(lambda a, b: a | b, clauses, F.lit(False)) & F.col("field").isin(*fields))

    def postings(self, found: DataFrame, positions: bool = False) -> DataFrame:
        """``term, field, doc_id, tf, dl`` and, where wanted, ``positions`` of the live postings in these blocks."""
        lists = ["ids", "tf", "dl", *["positions"] * positions]
        rows = found.select("term", "field", "generation", F.inline(F.arrays_zip(*lists))).withColumnRenamed("ids", "doc_id")
        return self._alive(rows)

    def frequencies(self, words: Iterable[str], fields: Iterable[str]) -> DataFrame:
        """``term, field, df``: live messages with these words in these fields; a row for each word and field at most."""
        words, fields = list(words), list(fields)
        counts = self.blocks_of(words, fields).groupBy("term", "field").agg(F.sum(F.col("postings").cast("long")).alias("df"))
        if len(self.live) > 1:
            lost = self._part("lost", f"{LOST}, generation int").filter(F.col("term").isin(*words) & F.col("field").isin(*fields))
            counts = counts.unionByName(lost.select("term", "field", (-F.col("lost")).alias("df"))).groupBy("term", "field").agg(F.sum("df").alias("df"))
        return counts


def _schema(lists: Iterable[str]) -> T.StructType:
    """What ``purged`` gives."""
    return T.StructType([f for f in ddl(f"{BLOCKS}, dead int").fields if f.name in ("term", "field", "postings", "ids", "dead", *lists)])


def _after(prefix: str) -> str | None:
    """The least text that is greater than all that begin with the prefix, in order of code points; None: there is none."""
    kept_ = prefix.rstrip(chr(0x10FFFF))
    if not kept_:
        return None
    code = ord(kept_[-1]) + 1
    return kept_[:-1] + chr(0xE000 if 0xD800 <= code <= 0xDFFF else code)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)

