"""Readers and writers: document blocks, device snapshots, run logs, text corpora, job tables, golden cases, chunks."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from ..operators.ordering import top_per_key

_STRINGS = t.ArrayType(t.StringType())
# Captions come as one string or a list; both are read as text and told apart afterwards.
BLOCK_SCHEMA = ("type STRING, page_idx INT, text STRING, aside_text STRING, table_body STRING, image_caption STRING, "
                "table_caption STRING, chart_caption STRING")
CAPTIONS = ("image_caption", "table_caption", "chart_caption")
EVIDENCE = "ARRAY<STRUCT<page: INT, source: STRING, bbox: ARRAY<DOUBLE>, agreement: BOOLEAN>>"
SNAPSHOT_SCHEMA = (
    "device STRING, package STRING, package_full_name STRING, source STRUCT<file: STRING, pages: ARRAY<INT>>, "
    f"pins ARRAY<STRUCT<pin_number: STRING, name: STRING, type: STRING, side: STRING, side_order: INT, description: STRING, evidence: {EVIDENCE}>>, "
    "conflicts ARRAY<STRUCT<pin_number: STRING, field: STRING, values: MAP<STRING, STRING>, pages: ARRAY<INT>, resolved: STRING>>")
GOLDEN_SCHEMA = (
    "case_id STRING, family_id STRING, category_id STRING, subcategory_id STRING, name STRING, expected_part_type STRING, expected_package_type STRING, "
    "blind_mode BOOLEAN, required_features ARRAY<STRING>, required_dimensions MAP<STRING, STRUCT<nominal: DOUBLE, tolerance: DOUBLE>>, "
    "known_missing_dimensions ARRAY<STRING>, expected_gate STRING, expected_topology STRUCT<solid_count: INT, minimum_face_count: INT>")
# Extensions of text documents
TEXT_EXTENSIONS = ("md", "markdown")
TEXT_GLOB = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in e) for e in TEXT_EXTENSIONS) + "}"
LOG_FILES = {"build.log": "build", "verify.log": "verify", "props.log": "props"}


def _caption(name: str) -> Column:
    """A list stays a list, a bare string becomes a list of one, also one that begins with a bracket."""
    listed = F.when(F.col(name).rlike(r'^\s*\[\s*("[\s\S]*|null[\s\S]*)?\]\s*$'), F.from_json(name, _STRINGS))
    return F.when(F.col(name).isNotNull(), F.coalesce(listed, F.array(name)))


def parent_folder(path: str = "_path") -> Column:
    return F.element_at(F.split(path, "/"), -2)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Block lists, one JSON array per file; the folder of a file names its document. `seq` is the place in the list."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("_path"), "value")
    parsed = F.from_json("value", t.ArrayType(t.StructType.fromDDL(BLOCK_SCHEMA)))
    rows = raw.select(parent_folder().alias("doc_id"), F.posexplode(parsed).alias("seq", "_b")).select(
        "doc_id", F.col("seq").cast("bigint").alias("seq"), "_b.*")
    return rows.withColumns({c: _caption(c) for c in CAPTIONS})


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Device snapshots with their defaults: absent texts are empty, absent lists empty, an absent side unknown."""
    raw = spark.read.schema(SNAPSHOT_SCHEMA).json(path, multiLine=True)
    pin_type = t.StructType.fromDDL(SNAPSHOT_SCHEMA)["pins"].dataType
    conflict_type = t.StructType.fromDDL(SNAPSHOT_SCHEMA)["conflicts"].dataType

    def filled(p):
        empty = F.lit("")
        return F.struct(
            F.coalesce(p.pin_number, empty).alias("pin_number"), F.coalesce(p["name"], empty).alias("name"), F.coalesce(p.type, F.lit("PAS")).alias("type"),
            F.coalesce(p.side, F.lit("unknown")).alias("side"), F.coalesce(p.side_order, F.lit(0)).alias("side_order"),
            F.coalesce(p.description, empty).alias("description"), p.evidence.alias("evidence"))
    return raw.select(
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("device", "package", "package_full_name")], "source",
        F.transform(F.coalesce("pins", F.from_json(F.lit("[]"), pin_type)), filled).alias("pins"),
        F.coalesce("conflicts", F.from_json(F.lit("[]"), conflict_type)).alias("conflicts"))


def write_snapshots(snapshots: DataFrame, path: str) -> None:
    snapshots.write.mode("overwrite").json(path)


def read_run_logs(spark: SparkSession, path: str, jobs: DataFrame) -> DataFrame:
    """Lines of every run log below `path`/<job_id>/; `line_no` is the place in the file.

    Any other *.log of a job is its compile report. A job without files stays, as one row with no line.
    """
    raw = spark.read.text(f"{path}/*/*.log", wholetext=True).select(F.col("_metadata.file_path").alias("_path"), "value")
    kinds = F.create_map(*[F.lit(x) for kv in LOG_FILES.items() for x in kv])
    kind = F.coalesce(F.try_element_at(kinds, F.element_at(F.split("_path", "/"), -1)), F.lit("symbol"))
    lines = raw.select(parent_folder().alias("job_id"), kind.alias("log_kind"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "text"))
    return jobs.select("job_id").join(lines, "job_id", "left")


def _below(file: str, folder: str) -> Column:
    """Path of a file below a folder, without its extension. The folder is found by its last names, as Spark writes it with a scheme."""
    tail = "/" + folder.rstrip("/").split("://")[-1].strip("/") + "/"
    return F.regexp_replace(F.substring_index(F.url_decode(F.replace(F.col(file), F.lit("+"), F.lit("%2B"))), tail, -1), r"\.[^./]+$", "")


_NAMES = "path string, is_folder boolean, size bigint"


def _hidden(name: str) -> bool:
    """What Spark's readers leave out as well."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _entries(folders: Iterable[str], deep: bool) -> Iterator[pd.DataFrame]:
    """What lies in folders, or with `deep` all files in them and in the folders below, some thousands at a time."""
    left, found = list(folders), []
    while left:
        with os.scandir(left.pop()) as entries:
            for e in entries:
                if _hidden(e.name):
                    continue
                if e.is_dir() and deep:
                    left.append(e.path)
                    continue
                found.append((e.path, e.is_dir(), e.stat().st_size))
                if len(found) >= 10_000:
                    yield pd.DataFrame(found, columns=["path", "is_folder", "size"])
                    found = []
    yield pd.DataFrame(found, columns=["path", "is_folder", "size"])


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        yield rows[~rows["is_folder"]]
        yield from _entries(rows.loc[rows["is_folder"], "path"], True)


def _contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Files with their bytes; what is held is a few megabytes and the file that goes beyond them."""
    for rows in batches:
        held, size = [], 0
        for path in rows["path"]:
            with open(path, "rb") as file:
                held.append((path, file.read()))
            size += len(held[-1][1])
            if size > 8_000_000:
                yield pd.DataFrame(held, columns=["path", "content"])
                held, size = [], 0
        yield pd.DataFrame(held, columns=["path", "content"])


def _mounted(spark: SparkSession, path: str) -> str | None:
    """The path on the executors of a folder that they see as a mounted one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toUri()
    return whole.getPath() if whole.getScheme() == "file" else None


#: Bytes that a task reads of a corpus; a file counts as the given number of bytes more
TASK_BYTES, FILE_COST = 32_000_000, 4096


def read_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Markdown documents (doc_id, path, text) below a folder, and the files of other types (doc_id, path, reason) with the reason for leaving them.

    A document's id is its path below the folder without the extension, which may be in either case. Only names are read of
    refused files, never their content. Of a mounted folder tasks list the files and read them, so the driver holds no list of
    them. Folders elsewhere are left to Spark's readers, which keep the list in the driver and pass over empty files.
    """
    from ..session import settled
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    reason = F.concat(F.lit("unsupported:"), extension).alias("reason")
    root = _mounted(spark, path)
    if root is None:
        names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        rejects = names.where(~extension.isin(*TEXT_EXTENSIONS)).select(_below("_metadata.file_path", path).alias("doc_id"), "path", reason)
        texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", TEXT_GLOB).text(path, wholetext=True)
        return texts.select(_below("_metadata.file_path", path).alias("doc_id"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")), rejects
    top = spark.range(0, 1, 1, 1).mapInPandas(lambda batches: (e for _ in batches for e in _entries([root], False)), _NAMES)
    names = settled(top.repartition(spark.sparkContext.defaultParallelism, "path").mapInPandas(_walk, _NAMES).select("path", "size"))
    wanted = names.where(extension.isin(*TEXT_EXTENSIONS))
    cost = wanted.agg(F.sum(F.col("size") + FILE_COST)).first()[0] or 0
    doc_id = F.regexp_replace(F.substring("path", len(root.rstrip("/")) + 2, 2**31 - 1), r"\.[^./]+$", "").alias("doc_id")
    texts = wanted.select("path").repartition(cost // TASK_BYTES + 1).mapInPandas(_contents, "path string, content binary")
    return texts.select(doc_id, "path", F.col("content").cast("string").alias("text")), names.where(~extension.isin(*TEXT_EXTENSIONS)).select(doc_id, "path", reason)


def read_job_table(spark: SparkSession, table: str, url: str | None = None, path: str | None = None, partition_column: str | None = None,
                   bounds: tuple[str, str] | None = None, partitions: int = 64, properties: dict | None = None) -> DataFrame:
    """A job table from parquet, or over JDBC in parallel ranges of a column; filters and columns are pushed down."""
    if path:
        return spark.read.parquet(path)
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **(properties or {}))
    if partition_column and bounds:
        reader = reader.options(partitionColumn=partition_column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load()


def read_golden_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Golden cases, and their expected dimensions as rows (case_id, field, nominal, tolerance)."""
    cases = spark.read.schema(GOLDEN_SCHEMA).json(path, multiLine=True).fillna(False, ["blind_mode"])
    rows = cases.select("case_id", F.explode("required_dimensions").alias("field", "_d"))
    return cases, rows.select("case_id", "field", "_d.nominal", "_d.tolerance")


def write_reports(results: DataFrame, path: str) -> None:
    """One folder of report files per case."""
    results.write.mode("overwrite").partitionBy("case_id").json(path)


def write_chunks(chunks: DataFrame, path: str, buckets: int = 256) -> None:
    """Replace the chunks of every incoming document in a table partitioned by document bucket.

    Each affected bucket is rewritten as a whole: the kept rows are read, joined with the new ones and written
    to a staging folder first, so that no partition is overwritten while it is read.
    """
    spark = chunks.sparkSession
    bucket = F.pmod(F.xxhash64("document_id"), F.lit(buckets)).cast("int")
    newest = top_per_key(chunks, ["id"], [F.desc("updated_at"), F.desc("chunk_index")], 1).drop("_rank").withColumn("bucket", bucket)
    try:
        old = spark.read.parquet(path)
    except Exception as missing:  # the first write finds no table
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        newest.write.partitionBy("bucket").parquet(path)
        return
    from ..session import settled
    hit = newest.select("bucket").distinct()
    kept = old.join(hit, "bucket", "left_semi").join(newest.select("document_id").distinct(), "document_id", "left_anti")
    merged = settled(kept.select(newest.columns).unionByName(newest))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
