"""URL rules by a sort-merge range join.

A host's labels are reversed into a canonical key that ends in a dot, so a host and all its subdomains are one interval
of keys. Pages and rules are dealt into ranges of keys (pages of one host may fall into several ranges, by path and
page_id); a rule goes to every range that its interval meets. Each range is sorted and swept once: a stack holds the
rules whose intervals enclose the current key, nested as their hosts are; of those whose path is a prefix of the page's
path, the longest wins.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_batch

#: Pages sampled for each range to place the ranges' bounds.
SAMPLES = 20
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KINDS = "bucket int, key string, kind int, page_id long, host string, path string, verdict string"


def with_host_and_path(pages: DataFrame) -> DataFrame:
    """``page_id, host, path`` of ``pages(page_id, url)``; both are empty for a null url or one without ``://``."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).select("page_id", F.coalesce(rest, F.lit("")).alias("rest"))
    raw = F.regexp_extract("rest", r"^[^/?#]*", 0)
    path = F.regexp_extract(F.expr(r"substring(rest, length(regexp_extract(rest, '^[^/?#]*', 0)) + 1)"), r"(?s)^[^?#]*", 0)
    return parts.select("page_id", F.translate(raw, _UPPER, _LOWER).alias("host"), path.alias("path"))


def _key(host: str):
    return F.concat(F.array_join(F.reverse(F.split(F.col(host), r"\.", -1)), "."), F.lit("."))


def _page_bucket(bounds: list[tuple[str, str, int]]):
    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = zip(*(batch.column(c).to_pylist() for c in ("key", "path", "page_id")), strict=True)
            buckets = [bisect_right(bounds, (k, p, -1 if i is None else i)) for k, p, i in rows]
            n = batch.num_rows
            columns = [pa.array(buckets, pa.int32()), batch.column("key"), pa.array([1] * n, pa.int32()), batch.column("page_id"), batch.column("host"), batch.column("path"), pa.nulls(n, pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["bucket", "key", "kind", "page_id", "host", "path", "verdict"])

        return step

    return by_batch(make)


def _rule_buckets(bounds: list[tuple[str, str, int]]):
    keys = [k for k, _, _ in bounds]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [[], [], [], [], []]
            for key, host, path, verdict in zip(*(batch.column(c).to_pylist() for c in ("key", "host", "path", "verdict")), strict=True):
                for bucket in range(bisect_left(keys, key), bisect_left(keys, key[:-1] + "/") + 1):  # "/" follows "."
                    for column, value in zip(rows, (bucket, key, host, path, verdict), strict=True):
                        column.append(value)
            n = len(rows[0])
            text = [pa.array(c, pa.string()) for c in rows[1:]]
            columns = [pa.array(rows[0], pa.int32()), text[0], pa.array([0] * n, pa.int32()), pa.nulls(n, pa.int64()), *text[1:]]
            return pa.RecordBatch.from_arrays(columns, ["bucket", "key", "kind", "page_id", "host", "path", "verdict"])

        return step

    return by_batch(make)


class _Active:
    """The rules of one host, on the stack."""

    def __init__(self, key: str):
        self.key, self.rules, self.lengths = key, {}, []

    def add(self, path: str, host: str, verdict: str) -> None:
        if path not in self.rules or verdict < self.rules[path][1]:  # of equal rules, allow
            self.rules[path] = (host + path, verdict)
            self.lengths = sorted({len(p) for p in self.rules}, reverse=True)

    def longest(self, path: str) -> tuple[str, str] | None:
        return next((self.rules[path[:n]] for n in self.lengths if n <= len(path) and path[:n] in self.rules), None)


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bucket, stack = None, []
    for batch in batches:
        found = []
        for at, key, kind, page_id, host, path, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != bucket:
                bucket, stack = at, []
            while stack and not key.startswith(stack[-1].key):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1].key != key:
                    stack.append(_Active(key))
                stack[-1].add(path, host, verdict)
                continue
            fits = [x for x in (a.longest(path) for a in stack) if x]
            rule, said = max(reversed(fits), key=lambda x: len(x[0])) if fits else (None, DEFAULT)
            found.append((page_id, host, path, rule, said))
        kinds = (pa.int64(), *[pa.string()] * 4)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], kinds[i]) for i in range(5)], ["page_id", "host", "path", "rule", "verdict"])


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages(page_id, url)`` by ``rules(host, path, verdict)``.

    A rule fits its host and all subdomains if the page's path starts with the rule's. The longest rule (host and path
    together; of equal ones that of the longer host) wins; its text and verdict are returned. Where none fits, ``rule``
    is null and the verdict ``allow``. Of equal rules with different verdicts the alphabetically first holds. Rules with
    a null or empty host or a null path don't count. Repeated pages are judged one by one, also with a null page_id. An
    empty page table gives no rows; without rules every page gets the default. Long urls are read whole.
    """
    spark = pages.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    urls = with_host_and_path(pages).withColumn("key", _key("host"))
    sample = urls.select("key", "path", F.coalesce("page_id", F.lit(-1)).alias("page_id")).orderBy(F.xxhash64("page_id", "path")).limit(SAMPLES * ranges).collect()
    sample = sorted((r["key"], r["path"], r["page_id"]) for r in sample)
    bounds = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []
    rules = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict").filter("host <> '' and path is not null").withColumn("key", _key("host"))
    rows = urls.select("page_id", "host", "path", "key").mapInArrow(_page_bucket(bounds), _KINDS)
    rows = rows.union(rules.mapInArrow(_rule_buckets(bounds), _KINDS)).repartition("bucket").sortWithinPartitions("bucket", "key", "kind", "path", "page_id")
    return rows.mapInArrow(_swept, "page_id long, host string, path string, rule string, verdict string")


#: The rules of the registered query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

#: The same for the table ``pages`` with these rules.
SQL = (
    "with rules(host, path, verdict) as (values " + ", ".join(map(str, RULES)) + "),\n"
    """
cut as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
parts as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path
  from cut
),
fits as (
  select p.page_id, r.host || r.path as rule, r.verdict, row_number() over (partition by p.page_id order by length(r.host || r.path) desc, length(r.host) desc, r.verdict) as k
  from parts p join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
)
select p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') as verdict from parts p left join (select * from fits where k = 1) f using (page_id)
"""
)
