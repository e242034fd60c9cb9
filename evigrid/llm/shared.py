"""Tables in the shared folder that an operator's steps hand on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.session import settled

__all__ = ["components", "docs_of", "free_name", "settled"]


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or with underscores until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): the smallest node of each node's connected component; nodes without an edge don't appear.

    In each round every node moves to the first of itself and its neighbours, and the edges are contracted to distinct ones between
    different nodes. First is the smallest in even rounds, which takes a star down at once, and the smallest hash in odd ones, which
    halves long paths, so rounds are few. A round is a written table; a node of very many edges costs one row per task.
    """
    left = settled(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    nodes = settled(left.select(F.col("a").alias("node")).unionByName(left.select(F.col("b").alias("node"))).distinct())
    labels, turn = nodes.withColumn("comp", F.col("node")), 0
    while not left.isEmpty():
        def place(c, t=turn):
            return F.struct((F.xxhash64(F.lit(t), c) if t % 2 else F.lit(0)).alias("h"), F.col(c).alias("to"))

        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.least(F.min(place("b")), F.min(place("a"))).alias("first"))
        first = settled(first.select(F.col("a").alias("u"), F.col("first.to").alias("to")))
        moved = left.join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b").where("x <> y")
        left = settled(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        labels = settled(labels.join(first.toDF("comp", "to"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")))
        turn += 1
    least = labels.groupBy("comp").agg(F.min("node").alias("least"))
    return settled(labels.join(least, "comp").select("node", F.col("least").alias("comp")))
