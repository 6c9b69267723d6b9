"""The driver's tables in the roles of the message engine's: documents as messages, orders as catalogue rows, and so on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import address_values
from ..session import spread, table

START_MS, STEP_MS = 1_577_836_800_000, 28_800_000
_MIMES = ("image/png", "image/jpeg", "application/pdf", "text/csv")


def messages(spark: SparkSession, folder: str, all_cores: bool = False) -> DataFrame:
    """``documents`` as the search projection: source as account, lang as label, every third third-day a message."""
    docs = table(spark, folder, "documents")
    docs = spread(docs) if all_cores else docs
    kind = F.element_at(F.array(*map(F.lit, _MIMES)), (F.col("doc_id") % 4 + 1).cast("int"))
    has = F.col("doc_id") % 10 < 3
    none = F.array().cast("array<string>")
    sender = F.concat(F.col("source"), F.lit(" Sender <"), F.col("source"), F.lit("@mail.example>"))
    recipients = F.concat(F.lit("team-"), F.col("lang"), F.lit("@list.example"))
    return docs.select(
        "doc_id",
        F.concat(F.lit("<"), F.col("doc_id").cast("string"), F.lit("@messages>")).alias("message_id"),
        (F.lit(START_MS) + F.col("doc_id") * STEP_MS).alias("timestamp_ms"),
        sender.alias("sender"),
        recipients.alias("recipients"),
        F.concat(F.col("lang"), F.lit(" note "), (F.col("doc_id") % 100).cast("string")).alias("subject"),
        F.col("text").alias("body"),
        F.lit("").alias("attachment_text"),
        F.lit("").alias("folder"),
        F.col("source").alias("account"),
        F.when(F.col("doc_id") % 5 == 0, F.array(F.col("lang"), F.lit("STARRED"))).otherwise(F.array("lang")).alias("labels"),
        F.when(has, F.array(kind)).otherwise(none).alias("attachment_types"),
        F.when(has, 1).otherwise(0).cast("long").alias("attachment_count"),
        F.when(has, 1).otherwise(0).alias("has_attachment"),
        F.when(has, F.array(kind)).otherwise(none).alias("attachment_mime"),
        F.when(has, F.array(F.split_part(kind, F.lit("/"), F.lit(1)))).otherwise(none).alias("attachment_family"),
        address_values(sender).alias("sender_filter"),
        address_values(recipients).alias("recipient_filter"),
    )


#: The same columns that the search queries' SQL needs.
MESSAGES = f"""
messages as (
  select doc_id, {START_MS} + doc_id * {STEP_MS} as timestamp_ms, text as body, source as account, lang,
    case when doc_id % 5 = 0 then [lang, 'STARRED'] else [lang] end as labels,
    case when doc_id % 10 < 3 then ['image/png', 'image/jpeg', 'application/pdf', 'text/csv'][doc_id % 4 + 1] end as mime,
    lang || ' note ' || (doc_id % 100)::varchar as subject,
    source || ' Sender <' || source || '@mail.example>' as sender, 'team-' || lang || '@list.example' as recipients
  from documents
)
"""


def tokens_sql(text: str) -> str:
    """The index tokens of a text in DuckDB."""
    return f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '' and strlen(x) < 40)"


def bm25_sql(words: list[str], fields: dict[str, tuple[str, float]], where: str = "true", limit: int = 50) -> str:
    """Top rows of a disjunction of words over fields (name: expression, weight)."""
    token_rows = " union all ".join(f"select doc_id, '{f}' as field, {w} as weight, {tokens_sql(x)} as toks from messages" for f, (x, w) in fields.items())
    listed = ", ".join(f"'{w}'" for w in words)
    return f"""
with {MESSAGES.strip()},
tok as ({token_rows}),
stats as (select field, count(*) as n, sum(len(toks)) / count(*) as avgdl from tok group by field),
tf as (
  select doc_id, field, weight, len(toks) as dl, w, len(list_filter(toks, lambda x: x = w)) as tf
  from tok cross join (select unnest([{listed}]) as w)
),
df as (select field, w, count(*) as df from tf where tf > 0 group by field, w),
scored as (
  select doc_id, round(sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) as score
  from tf join df using (field, w) join stats using (field) where tf > 0 group by doc_id
)
select doc_id, score from scored join messages m using (doc_id) where {where} order by score desc, doc_id limit {limit}
"""
