"""Nearest-rank percentiles: the value at index round((n - 1) * fraction) of the sorted values, half away from zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rank_index(n: Column, fraction: float) -> Column:
    """The zero-based index for ``n`` values."""
    return F.floor((n - 1) * F.lit(fraction) + F.lit(0.5)).cast("long")


#: Steps that a group's distinct values are dealt into, by sampled quantiles of the value.
STEPS = 256


def ranked(df: DataFrame, value: str, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Distinct values of each group (of all rows, without ``by``) with ``_upto``, rows up to the value, and ``_all``.

    Rows are summed by value (``weight``: a column that says how often a row counts), values by steps between sampled
    quantiles of a group's distinct values, so that an outlier doesn't put all others into one step; steps are summed up
    in order, and values only within their step. So no task orders more than the steps of a group or the values of a step.
    """
    by = by or []
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg((F.sum(weight) if weight else F.count("*")).alias("_n"))
    cuts = F.percentile_approx(F.col(value), F.array(*[F.lit(i / STEPS) for i in range(1, STEPS)]), F.lit(4 * STEPS))
    bounds = counted.groupBy(*by).agg(F.array_distinct(cuts).alias("_cuts"), F.sum("_n").alias("_all"))
    rows = counted.join(bounds, by) if by else counted.crossJoin(bounds)  # one row
    halves = F.array(*[F.lit(STEPS >> k) for k in range(1, STEPS.bit_length())])
    # how many cuts are below the value, by halves: the cuts are sorted, and get gives null beyond their end
    step = F.aggregate(halves, F.lit(0), lambda at, half: F.when(F.get("_cuts", at + half - 1) < F.col(value), at + half).otherwise(at))
    rows = rows.withColumn("_step", step).drop("_cuts")
    before = F.coalesce(F.sum("_s").over(W.partitionBy(*by).orderBy("_step").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    steps = rows.groupBy(*by, "_step").agg(F.sum("_n").alias("_s")).withColumn("_before", before)
    within = W.partitionBy(*by, "_step").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    return rows.join(steps, [*by, "_step"]).withColumn("_upto", F.col("_before") + F.sum("_n").over(within)).select(*by, value, "_upto", "_all")


def nearest_rank(df: DataFrame, value: str, fractions: dict[str, float], by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """A row for each group (all rows, without ``by``) with a column for each fraction; no rows: 0 for the whole."""
    by = by or []
    at = [F.min(F.when(F.col("_upto") > rank_index(F.col("_all"), f), F.col(value))) for f in fractions.values()]
    return ranked(df, value, by, weight).groupBy(*by).agg(*[(a if by else F.coalesce(a, F.lit(0))).alias(name) for name, a in zip(fractions, at, strict=True)])


def plain_nearest_rank(values: list[int], fraction: float) -> int:
    """The same for a list on the driver (latencies)."""
    ordered = sorted(values)
    return ordered[int((len(ordered) - 1) * fraction + 0.5)] if ordered else 0
