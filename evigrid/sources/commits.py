"""Sinks with a commit step: what a job writes is staged first and seen only once its batch is committed.

A table is a folder with `data/<batch>-<random>/`, the staged files, and `commits/<batch>`, a line that names the folder of a batch. A batch is written under its number:
repeating it, after a failure or by a second run, changes nothing, and a job that dies leaves files that no commit names. Nothing that is read is ever rewritten.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    place, files = _files(spark, path)
    return files.exists(place)


def commit_batch(df: DataFrame, root: str, batch: int, partition_by: Sequence[str] = (), file_format: str = "parquet") -> bool:
    """Write df as batch number `batch` of the table at `root`; False if that batch is there already."""
    spark = df.sparkSession
    if _exists(spark, f"{root}/commits/{batch}"):
        return False
    folder = f"{batch}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).format(file_format).save(f"{root}/data/{folder}")
    place, files = _files(spark, f"{root}/commits/{batch}")
    try:
        line = files.create(place, False)  # of two writers one fails here
    except Exception:
        if not files.exists(place):
            raise
        return False
    line.write(bytearray(f"{folder}\n".encode()))
    line.close()
    return True


def committed(spark: SparkSession, root: str) -> dict[int, str]:
    """Folders of the committed batches by number. A line that is still being written is no commit."""
    if not _exists(spark, f"{root}/commits"):
        return {}
    lines = spark.read.text(f"{root}/commits", wholetext=True).where(F.col("value").endswith("\n"))
    # a row for each batch
    return {int(r.batch): f"{root}/data/{r.value.strip()}" for r in lines.select(F.col("_metadata.file_name").alias("batch"), "value").collect()}


def read_committed(spark: SparkSession, root: str, schema: str, file_format: str = "parquet") -> DataFrame:
    """All rows of the committed batches, with their `batch`."""
    parts = [spark.read.schema(schema).format(file_format).load(folder).withColumn("batch", F.lit(batch).cast("long")) for batch, folder in sorted(committed(spark, root).items())]
    if not parts:
        return spark.createDataFrame([], f"{schema}, batch bigint")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def latest_of(rows: DataFrame, key: str) -> DataFrame:
    """The rows of each key from the last batch that has the key."""
    last = rows.groupBy(key).agg(F.max("batch").alias("batch"))
    return rows.join(last, [key, "batch"])


CHUNKS = "id string, document_id string, content string, chunk_index int, updated_at bigint"


def read_chunks(spark: SparkSession, root: str, schema: str = CHUNKS) -> DataFrame:
    """Chunks of every document as its last batch has them."""
    return latest_of(read_committed(spark, root, schema), "document_id").drop("batch")


def compact(spark: SparkSession, root: str, schema: str, key: str, batch: int, into: str) -> bool:
    """Write what `latest_of` gives as the one batch of a new table."""
    return commit_batch(latest_of(read_committed(spark, root, schema), key).drop("batch"), into, batch)


def _put_file(target: str, value: str) -> None:
    folder = os.path.dirname(target)
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/.{uuid.uuid4().hex}.part", "w", encoding="utf-8", newline="") as out:
        out.write(value)
    os.replace(out.name, target)


def put_files(files: DataFrame, root: str, batch: str) -> str:
    """Write (path, value) as text files below `root`/`batch`, which appears as a whole; the folder. For files whose names mean something.

    `root` must be a mounted path that all executors see. A file is written under a hidden name and then renamed, so a task that runs twice leaves one,
    and what a task that dies was writing is passed over by readers.
    """
    spark, folder = files.sparkSession, f"{root}/{batch}"
    if urlparse(root).scheme not in ("", "file"):
        raise ValueError(f"named files are written to mounted paths, which {root} is not")
    if _exists(spark, folder):
        return folder
    staged = f"{root}/.staged-{uuid.uuid4().hex}"
    local = urlparse(staged).path

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path, value in zip(rows["path"], rows["value"], strict=True):
                _put_file(f"{local}/{path}", value)
            yield pd.DataFrame({"n": [len(rows)]})

    files.select("path", "value").mapInPandas(put, "n bigint").agg(F.sum("n")).collect()
    place, system = _files(spark, staged)
    target, _ = _files(spark, folder)
    if system.exists(place):
        system.rename(place, target)
    return folder
