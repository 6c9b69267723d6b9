"""Line dedup by site-relative frequency, in DataFrame operations only.

The lines of each page are counted once a page and host; a line on more than ``ratio`` of its host's pages is boilerplate
of that host and dropped from its pages, whatever the host's size, as long as it is repeated at all (on ``least`` pages: a
host of one or two pages says nothing about repetition). A host's boilerplate is small: fewer than (mean distinct lines of
a page) / ratio lines. It is written to the shared folder; Spark broadcasts it only if
its size there is below the session's broadcast threshold, and else joins by host, splitting large hosts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Share of a host's pages, and the number of pages that makes a line a repeated one.
RATIO, REPEATED = 0.1, 3


def _mark(line: Column) -> Column:
    """128 bits of a line without the spaces around it, as a string: Spark's array functions look those up by hash."""
    return F.md5(F.trim(line))


def boilerplate(docs: DataFrame, host: Column, ratio: float = RATIO, least: int = REPEATED) -> DataFrame:
    """``host, marks``: each host's boilerplate lines; hosts without any have no row."""
    pages = docs.select(host.alias("host"), F.col("text").cast("string").alias("text")).filter("host is not null")
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    marks = pages.select("host", F.explode(F.array_distinct(F.transform(lines, _mark))).alias("mark"))
    on = marks.groupBy("host", "mark").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    found = on.join(totals, "host").filter(F.col("n") > F.lit(ratio) * F.col("pages"))
    return found.groupBy("host").agg(F.collect_list("mark").alias("marks"))


def drop_boilerplate(docs: DataFrame, host: Column, ratio: float = RATIO, least: int = REPEATED, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with boilerplate lines cut from ``text`` and two more columns, ``counts``: its lines, and those dropped.

    Lines end at a line feed; spaces around them don't count when they are compared. Blank lines are never dropped. A
    null text stays null and has no lines; a null host has no boilerplate, but its pages stay. Repeated rows are pages
    of their own. A line exactly at the ratio stays. Long texts are split whole; an empty table gives no rows. Other columns pass through; ones called as ``counts`` are replaced.
    """
    columns = [c for c in docs.columns if c not in counts]
    found = written(boilerplate(docs, host, ratio, least), "boilerplate").select(F.col("host").alias("_lm_host"), F.col("marks").alias("_lm_marks"))
    rows = docs.withColumn("_lm_site", host)
    rows = rows.join(found, F.col("_lm_site") == F.col("_lm_host"), "left")
    lines = F.split(F.col("text").cast("string"), "\n")
    # the page's own boilerplate lines, by one hashed intersection with those of the host
    hits = F.when(F.col("_lm_marks").isNotNull(), F.array_intersect(F.transform("_lm_lines", _mark), "_lm_marks"))
    rows = rows.withColumn("_lm_lines", lines).withColumn("_lm_hits", hits)
    kept = F.filter("_lm_lines", lambda x: (F.trim(x) == "") | ~F.array_contains("_lm_hits", _mark(x)))
    rows = rows.withColumn("_lm_kept", F.when(F.size(F.coalesce("_lm_hits", F.array().cast("array<string>"))) > 0, kept).otherwise(F.col("_lm_lines")))
    n_lines, n_kept = (F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long") for c in ("_lm_lines", "_lm_kept"))
    text = F.when(F.size("_lm_lines") == F.size("_lm_kept"), F.col("text")).otherwise(F.array_join("_lm_kept", "\n"))
    return rows.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in columns], n_lines.alias(counts[0]), (n_lines - n_kept).alias(counts[1]))


#: The same for the table ``documents`` with its sources as hosts.
SQL = f"""
with page as (select doc_id, source, text, string_split(text, chr(10)) as lines from documents),
seen as (
  select source, line, count(*) as n
  from (select source, unnest(list_distinct(list_filter(list_transform(lines, lambda x: trim(x)), lambda x: x <> ''))) as line from page where source is not null)
  group by all
),
total as (select source, count(*) as pages from page group by all),
boiler as (select source, list(line) as marks from seen join total using (source) where n >= {REPEATED} and n > {RATIO} * pages group by source),
cut as (
  select doc_id, text, lines, case when marks is null then lines else list_filter(lines, lambda x: trim(x) = '' or not list_contains(marks, trim(x))) end as kept
  from page left join boiler using (source)
)
select doc_id, coalesce(len(lines), 0)::bigint as n_lines, (coalesce(len(lines), 0) - coalesce(len(kept), 0))::bigint as n_dropped,
  md5(array_to_string(kept, chr(10))) as text_md5
from cut
"""
