"""Session defaults. Only settings the operators rely on; sizes stay with the cluster."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def local_session(cpus: int | None = None, app: str = "evigrid") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own session."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("EVIGRID_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(cpus))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def measured_joins(spark: SparkSession) -> SparkSession:
    """A session like this one that broadcasts a side of a join only by its measured size, or where a hint says so.

    Before a run Spark knows the size of the files. Rows derived from them (exploded, with arrays and texts) take a hundred times
    that, so a side that seems to be small fills the driver. The shuffled size, which adaptive execution sees, is right.
    """
    limit, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set(measured, spark.conf.get(measured, None) or spark.conf.get(limit))
    own.conf.set(limit, "-1")
    return own


_LOCAL_FOLDER: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; only a local master falls back to a folder of
    its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and spark.sparkContext.master.startswith("local"):
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_FOLDER:
            _LOCAL_FOLDER[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        named = _LOCAL_FOLDER[app]
    if named is None:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return named


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/evigrid-{spark.sparkContext.applicationId}"


def settled(df: DataFrame) -> DataFrame:
    """Write a frame that several branches read to the shared folder and read it back.

    The branches then scan a columnar table instead of computing the frame once each, and a lost executor
    costs a scan and not the lineage. `clear_settled` removes what an application has written.
    """
    path = f"{_own_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_settled(spark: SparkSession) -> None:
    """Remove all that `settled` has written in this application, once the results built on it are written elsewhere."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
