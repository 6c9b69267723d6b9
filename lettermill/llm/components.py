"""Connected components of an edge table by alternating large-star and small-star rounds (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, measured


def _marked(edges: DataFrame) -> tuple[DataFrame, dict]:
    """The edges written, and what tells one round's from another's."""
    return measured(edges, "edges", n=F.count("*"), total=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges(a, b)``; the component is the smallest node reachable.

    Every round is written to the shared folder, so its lineage is short, and the one before is removed. A node of very many edges is aggregated
    map-side, and its join is one that Spark may split.
    """
    now, mark = _marked(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    while mark["n"]:
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").union(small_least.select("u", "m")).distinct()
        last, before = now, mark
        now, mark = _marked(small.toDF("u", "v"))
        discard(last)
        if mark == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.toDF("node", "component").union(roots)
