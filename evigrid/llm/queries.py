"""Registered queries of this package: each operator on its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    centroids, chat_format, decontaminate, divergence, fingerprints, html_text, line_dedup, mixing, near_dedup, quality_classifier, quality_rules, suffix_dedup,
    token_files)
from .shared import docs_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_chat_format", chat_format.SQL)
def op1(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.chat_digest(rows.unionByName(spark.createDataFrame(chat_format.INTRUDER, rows.schema)))


@query("op2_html_extraction")
def op2(spark, sf_dir):
    return html_text.page_texts(table(spark, sf_dir, "pages"))


@query("op3_benchmark_decontamination")
def op3(spark, sf_dir):
    return decontaminate.leaks(docs_of(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query("op4_minhash_near_dedup")
def op4(spark, sf_dir):
    return near_dedup.near_duplicates(docs_of(spark, sf_dir))


@query("op5_quality_rules")
def op5(spark, sf_dir):
    return quality_rules.quality_rules(docs_of(spark, sf_dir), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


@query("op6_line_dedup", line_dedup.SQL)
def op6(spark, sf_dir):
    return line_dedup.line_dedup(docs_of(spark, sf_dir)).drop("runs")


@query("op7_suffix_array_dedup")
def op7(spark, sf_dir):
    out = suffix_dedup.suffix_dedup(docs_of(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"))


@query("op8_token_files")
def op8(spark, sf_dir):
    return token_files.token_digest(docs_of(spark, sf_dir))


@query("op9_mixing", mixing.SQL)
def op9(spark, sf_dir):
    return mixing.mixed_documents(docs_of(spark, sf_dir)).select(
        "doc_id", "lang", "source", "mix_domain", "mix_epoch", "mix_tokens", "mix_start", "mix_take")


@query("op10_quality_classifier")
def op10(spark, sf_dir):
    return quality_classifier.classify(docs_of(spark, sf_dir), table(spark, sf_dir, "labels")).select(
        "doc_id", "text_score", "page_score", "score", "kept")


@query("op11_source_divergence", divergence.SQL)
def op11(spark, sf_dir):
    return divergence.divergence(docs_of(spark, sf_dir))


@query("op12_centroid_clusters", centroids.SQL)
def op12(spark, sf_dir):
    return centroids.centroid_clusters(table(spark, sf_dir, "embeddings"))


@query("op13_document_fingerprints")
def op13(spark, sf_dir):
    return fingerprints.fingerprint_digest(docs_of(spark, sf_dir))
