"""The training-data pipeline: stages that each run one operator on all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.llm import decontaminate, mixing, near_dedup, quality_classifier, token_files
from evigrid.llm.shared import docs_of, settled

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    scored = quality_classifier.classify(docs, _table(spark, sf_dir, "labels"))
    return scored.where("kept").select(*DOCUMENT)


def _told_apart(docs: DataFrame) -> DataFrame:
    """docs with `row_id`: the doc_id where it stands once, else a hash of id and text, and `shared_id`: whether it is such a hash."""
    counts = settled(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("seen_id"), F.lit(True).alias("again")))
    marked = docs.select(*DOCUMENT).join(counts, F.col("doc_id").eqNullSafe(F.col("seen_id")), "left").withColumn("shared_id", F.coalesce("again", F.lit(False)))
    return marked.select(*DOCUMENT, "shared_id", F.when(F.col("shared_id"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id").cast("long")).alias("row_id"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near copies stays, the one with the smallest id. Texts decide, not ids: of several texts with one doc_id, or
    without any, each is a document with a hash of both as its id, and of rows equal in id and text one stays."""
    rows = _told_apart(docs)
    found = near_dedup.near_duplicates(rows.select(F.col("row_id").alias("doc_id"), "text"))
    others = found.where("doc_id <> class_id").select(F.col("doc_id").alias("row_id"))
    kept = rows.join(others.hint("merge"), "row_id", "left_anti")
    once = kept.where("NOT shared_id").select(*DOCUMENT)
    return once.unionByName(kept.where("shared_id").dropDuplicates(["doc_id", "text"]).select(*DOCUMENT))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    found = decontaminate.leaks(docs, _table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("leaked")).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("leaked")), "left_anti").select(*DOCUMENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The prefix of each leaf's seeded stream up to its budget. The document in which a budget ends stays whole; one that
    a second epoch takes again is there twice."""
    return mixing.mixed_documents(docs).select(*DOCUMENT)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents; a row per document, read back from them."""
    return token_files.token_digest(docs)


STAGES = [("quality_classifier", keep_good), ("near_dedup", drop_near_copies), ("decontamination", drop_leaks), ("mixing", mix_sources),
          ("token_files", write_tokens)]

#: Trained models and hashed arrivals have no SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
