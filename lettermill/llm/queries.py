"""The registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fim, language, periodic, pii, quality, site_lines, sql, url_rules
from .decontaminate import contamination
from .near_dup import near_duplicates
from .token_counts import length_histogram
from .token_files import token_files
from .top_k import SQL as TOP_K_SQL
from .top_k import top_k


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"), columns=["doc_id"])
    return found.select("doc_id", *[F.col(f"contamination.{c}").alias(c) for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")])


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents")
    found = language.identify(docs, language.train(docs, ~language.held_out()), columns=["doc_id"])
    return found.select("doc_id", language.held_out().alias("held_out"), F.col("language.lang_pred").alias("lang_pred"), F.col("language.score").alias("score"))


def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents").select("doc_id", "text")
    found = pii.personal_data(docs, pii.train(docs), columns=["doc_id"])
    counts = [F.col(f"pii.n_{kind}").alias(f"n_{kind}") for kind in pii.KINDS]
    n_spans = F.when(F.col("pii.spans") == "", 0).otherwise(F.size(F.split("pii.spans", ","))).cast("long").alias("n_spans")
    return found.select("doc_id", *counts, F.sha2("pii.base", 256).alias("base_sha256"), F.col("pii.spans").alias("spans"), n_spans)


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return length_histogram(_read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_site_lines(spark: SparkSession, folder: str) -> DataFrame:
    found = site_lines.drop_boilerplate(_read(spark, folder, "documents"), F.col("source"))
    return found.select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("text_md5"))


def op6_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _read(spark, folder, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def op7_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(url_rules.RULES, "host string, path string, verdict string")
    return url_rules.judge(_read(spark, folder, "pages"), rules)


def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files(_read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op9_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_read(spark, folder, "documents"), percent=85)


def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    found = bpe.encode(_read(spark, folder, "documents"), ranks, pattern, columns=["doc_id"], decoded=True)
    n_tokens = F.expr("octet_length(token_ids) div 4").cast("long")
    return found.select("doc_id", n_tokens.alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("token_bytes", 256).alias("decoded_sha256"))


def op11_quality(spark: SparkSession, folder: str) -> DataFrame:
    found = quality.quality(_read(spark, folder, "documents"), _read(spark, folder, "labels"), ~quality.held_out(), columns=["doc_id"])
    return found.select("doc_id", quality.held_out().alias("held_out"), F.col("quality.score").alias("score"), F.col("quality.predicted").alias("predicted"))


def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    found = fim.fill_in_middle(_read(spark, folder, "documents"), columns=["doc_id"])
    fields = [F.col(f"fim.{c}").alias(c) for c in ("n", "form", "prefix_chars", "middle_chars")]
    digests = [F.sha2("fim.output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("fim.form"), F.col("fim.output")), 256).alias("restored_sha256")]
    return found.select("doc_id", *fields, *digests)


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic.periodic_runs(periodic.planted(_read(spark, folder, "documents")), columns=["doc_id"])
    best = [F.col(f"periodic.{c}").alias(c) for c in ("start", "length", "period")]
    digests = [F.sha2(periodic.runs_text(F.col("periodic.runs")), 256).alias("runs_sha256"), F.sha2("periodic.collapsed", 256).alias("collapsed_sha256")]
    n_runs, exponent = F.size("periodic.runs").cast("long"), F.expr("1000 * periodic.length div periodic.period")
    return found.select("doc_id", n_runs.alias("n_runs"), *best, exponent.alias("exponent_milli"), *digests)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_decontaminate, op2_language, op3_pii, op4_token_counts, op5_site_lines, op6_top_k, op7_url_rules,
        op8_token_files, op9_near_duplicates, op10_bpe, op11_quality, op12_fill_in_middle, op13_periodic_runs,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": sql.CONTAMINATION, "op5_site_lines": site_lines.SQL, "op6_top_k": TOP_K_SQL, "op7_url_rules": url_rules.SQL,
        "op9_near_duplicates": sql.NEAR_DUPLICATES, "op12_fill_in_middle": fim.SQL, "op13_periodic_runs": periodic.SQL,
    }
