"""Two-level ordered operators against plain windows, on any partitioning."""

import pytest
from pyspark.sql import functions as F

from evigrid.operators import ordering as o


@pytest.fixture(scope="module")
def frame(spark):
    # One key holds most of the rows.
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"), F.col("id").alias("at"),
        F.when(F.col("id") % 7 == 0, F.col("id")).alias("mark"))
    return df


@pytest.mark.parametrize("parts", [1, 8, 50])
def test_bucketed_equals_plain(frame, rows, parts):
    df = frame.repartition(parts)
    order, bucket = [F.col("at")], F.floor(F.col("at") / 64)
    for make in (lambda b: o.ranked(df, ["key"], order, b, "v"),
                 lambda b: o.running_sum(df, ["key"], order, b, F.col("at"), "v"),
                 lambda b: o.last_known(df, ["key"], order, b, {"v": F.col("mark")}),
                 lambda b: o.previous_row(df, ["key"], order, b, {"v": F.col("at")}),
                 lambda b: o.next_row(df, ["key"], order, b, {"v": F.col("at")})):
        assert rows(make(bucket), "key", "at", "v") == rows(make(None), "key", "at", "v")


def test_top_per_key_is_limited_before_the_shuffle(frame):
    plan = o.top_per_key(frame, ["key"], [F.desc("at")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_settled_tables_can_be_cleared(spark):
    import pytest
    from evigrid import session
    df = session.settled(spark.range(5).toDF("id"))
    assert df.count() == 5
    session.clear_settled(spark)
    with pytest.raises(Exception, match="(?i)not.*exist|does not|FILE_NOT_EXIST"):
        df.count()


def test_numbers_of_a_language_are_dealt_in_buckets(spark, tmp_path):
    """s4_text_corpus: a language with all documents is numbered in more than one task, null languages too."""
    from evigrid.plans import QUERIES
    docs = [(i, f"text {i}", None if i % 40 == 0 else "en", "s", 6) for i in range(3000)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["text"], r["reason"]) for r in QUERIES["s4_text_corpus"](spark, str(tmp_path)).collect()}
    want, seen = {}, {}
    for i, text, lang, _, _ in docs:
        seen[lang] = k = seen.get(lang, 0) + 1
        want[f"{lang or 'none'}/{i}"] = (None, "unsupported:txt") if k % 5 == 0 else (text, None)
    assert got == want
    from evigrid.plans import source_queries
    held, put = [], source_queries._put
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        source_queries._put = lambda spark, rows, name: held.append(rows) or put(spark, rows, name)
        QUERIES["s4_text_corpus"](spark, str(tmp_path))
        assert held[0].where("path LIKE 'en/%'").select(F.spark_partition_id()).distinct().count() > 1
    finally:
        source_queries._put = put
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
