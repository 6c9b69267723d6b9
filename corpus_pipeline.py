"""From raw documents to token ids: language ID, line dedup, near-dedup, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read back for the next.
All but the last return the columns of ``documents``, and further ones whatever their names. An empty table passes through
every stage as an empty table; long texts are taken whole; what becomes of nulls, empty texts, ties and repeated rows is
stated for each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.llm import bpe, language
from lettermill.llm.decontaminate import contamination
from lettermill.llm.near_dup import near_duplicates
from lettermill.llm.shared import written
from lettermill.llm.site_lines import drop_boilerplate

#: A document whose language isn't known (no letters) or is less certain than this is rejected, with more than CHANCES
#: languages in proportion less certain.
LEAST_SCORE, CHANCES = 0.3, 4
#: Percent of shared five-word shingles that makes near duplicates.
SIMILAR = 80
#: Text in a block of the encoding: half of what the operator takes, as the stages before leave less memory to it.
BLOCK_BYTES = 6_000_000
#: A column of a stage's own, which it drops again.
MADE = "_lm_made"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language: those with ``und`` or an uncertain prediction go.

    A null or empty text, or one without a letter, goes. Repeated rows are judged alike and all stay or go. Languages that
    are equally likely count as uncertain as their score is. Without a labelled row to learn from, no language is known, and
    all documents with a letter stay.
    """
    model = language.train(docs, ~language.held_out())
    if not model.languages:
        return docs.filter(F.col("text").cast("string").rlike(language.LETTER))
    found = language.identify(docs, model, into=MADE)
    least = LEAST_SCORE * min(1, CHANCES / len(model.languages))
    kept = (F.col(f"{MADE}.lang_pred") != language.UNKNOWN) & (F.col(f"{MADE}.score") >= least)
    return found.filter(kept).select(*[F.col(f"`{c}`") for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source; ``n_chars`` counts what is left.

    A null text stays null, a null source has no boilerplate. Repeated rows are pages of their own and all stay. A line at
    exactly the ratio stays. A document of boilerplate only stays with an empty text.
    """
    cut = drop_boilerplate(docs, F.col("source"), counts=(f"{MADE}_lines", MADE))
    if "n_chars" in docs.columns:
        shorter = F.when(F.col(MADE) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        cut = cut.withColumn("n_chars", shorter)
    return cut.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id.

    Rows of one doc_id are one document: all of them stay or go. Documents with a null doc_id, a null or empty text or
    without words are in no group and stay. Which document of a group stays doesn't depend on the order of rows.
    """
    verdicts = near_duplicates(docs, percent=SIMILAR)
    dropped = written(verdicts.filter("not kept").select("doc_id").distinct(), "dropped")
    return docs.join(dropped, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth repeats windows of benchmark items.

    A document of exactly a twentieth goes. Null and empty texts stay, as all do with an empty benchmark; repeated rows are
    judged alike.
    """
    judged = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), into=MADE)
    return judged.filter(~F.col(f"{MADE}.contaminated")).select(*[F.col(f"`{c}`") for c in docs.columns])


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, token_ids`` (little-endian unsigned 32-bit) of each document.

    A null or empty text has no ids; repeated rows have a row each.
    """
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    found = bpe.encode(docs, ranks, pattern, columns=["doc_id"], decoded=True, block_bytes=BLOCK_BYTES)
    n_tokens = F.expr("octet_length(token_ids) div 4").cast("long")
    return found.select("doc_id", n_tokens.alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("token_bytes", 256).alias("decoded_sha256"), "token_ids")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: Language ID and BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
