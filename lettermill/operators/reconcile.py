"""Two sources of one mailbox, held against each other: which records are the same, in passes from strong to weak keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import kept

ONE, MANY, SEVERAL = "one-to-one", "one-to-many", "many-to-one"
AMBIGUOUS, ONLY_A, ONLY_B = "ambiguous", "only-a", "only-b"
#: Passes over messages: the same bytes, the same Message-ID, the same time and size.
PASSES = {"digest": ["digest"], "message-id": ["message_id"], "date-size": ["date_ms", "size"]}


def _key(columns: list[str]) -> Column:
    """A struct of the columns; null, if one of them is: such a row isn't compared."""
    known = F.lit(True)
    for c in columns:
        known = known & F.col(c).isNotNull()
    return F.when(known, F.struct(*columns))


def _counted(rows: DataFrame, side: str) -> DataFrame:
    return rows.filter("_key is not null").groupBy("_key").agg(F.count("*").alias(f"n_{side}"), F.min("id").alias(f"{side}_one"))


def reconcile(a: DataFrame, b: DataFrame, passes: dict[str, list[str]] | None = None) -> DataFrame:
    """``pass, kind, a_id, b_id``: a row for each correspondence of ``a`` and ``b`` (``id`` and the passes' columns), and for what has none.

    In each pass rows of equal keys correspond: one and one, one of ``a`` and many of ``b`` (a message in several mailboxes), or
    many of ``a`` and one of ``b``. They are done with; the others go on to the next pass. Rows whose key stands several times
    on both sides in some pass, and that no later pass tells apart, are ``ambiguous`` (with the first such pass), and never
    paired with each other; the others stand on one side only. A null in a key matches nothing. Ids are unique within a side.
    """
    found = None
    left = {"a": a.withColumn("_met", F.lit(None).cast("string")), "b": b.withColumn("_met", F.lit(None).cast("string"))}
    for name, columns in (passes or PASSES).items():
        keyed = {side: rows.withColumn("_key", _key(columns)) for side, rows in left.items()}
        both = kept(_counted(keyed["a"], "a").join(_counted(keyed["b"], "b"), "_key"), "both")
        kind = F.when((F.col("n_a") == 1) & (F.col("n_b") == 1), ONE).when(F.col("n_a") == 1, MANY).otherwise(SEVERAL).alias("kind")
        first = keyed["b"].join(both.filter("n_a = 1"), "_key").select(F.lit(name).alias("pass"), kind, F.col("a_one").alias("a_id"), F.col("id").alias("b_id"))
        second = keyed["a"].join(both.filter("n_a > 1 and n_b = 1"), "_key").select(F.lit(name).alias("pass"), kind, F.col("id").alias("a_id"), F.col("b_one").alias("b_id"))
        links = first.unionByName(second)
        found = links if found is None else found.unionByName(links)
        marks = both.select("_key", ((F.col("n_a") == 1) | (F.col("n_b") == 1)).alias("_done"))
        for side, rows in keyed.items():
            rest = rows.join(marks, "_key", "left").filter("not coalesce(_done, false)")
            met = F.coalesce("_met", F.when(F.col("_done").isNotNull(), F.lit(name)))
            left[side] = kept(rest.withColumn("_met", met).drop("_key", "_done"), f"left_{side}")
    none = F.lit(None)
    for side, only in (("a", ONLY_A), ("b", ONLY_B)):
        ids = {"a": [F.col("id").alias("a_id"), none.cast(b.schema["id"].dataType).alias("b_id")], "b": [none.cast(a.schema["id"].dataType).alias("a_id"), F.col("id").alias("b_id")]}[side]
        found = found.unionByName(left[side].select(F.col("_met").alias("pass"), F.when(F.col("_met").isNull(), only).otherwise(AMBIGUOUS).alias("kind"), *ids))
    return found
