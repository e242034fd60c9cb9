"""Sinks with a commit step."""

import os

import pytest

from evigrid.sources import commits

SCHEMA = "id string, document_id string, content string, chunk_index int, updated_at bigint"


def chunks(spark, *rows):
    return spark.createDataFrame([(i, d, c, 0, 1) for i, d, c in rows], SCHEMA)


def test_a_batch_counts_once_and_only_when_committed(spark, tmp_path, rows):
    root = str(tmp_path / "t")
    assert commits.read_chunks(spark, root).count() == 0
    assert commits.commit_batch(chunks(spark, ("1", "a", "x"), ("2", "a", "y"), ("3", "b", "z")), root, 1)
    assert not commits.commit_batch(chunks(spark, ("9", "a", "again")), root, 1)
    # staged files of a job that died, and a commit that was cut off
    chunks(spark, ("8", "b", "lost")).write.parquet(f"{root}/data/2-dead")
    (tmp_path / "t" / "commits" / "2").write_text("2-dead")
    assert rows(commits.read_chunks(spark, root), "id", "content") == [("1", "x"), ("2", "y"), ("3", "z")]
    assert commits.commit_batch(chunks(spark, ("4", "a", "new")), root, 3)
    assert rows(commits.read_chunks(spark, root), "id", "content") == [("3", "z"), ("4", "new")]
    assert commits.compact(spark, root, SCHEMA, "document_id", 1, str(tmp_path / "small"))
    assert rows(commits.read_committed(spark, str(tmp_path / "small"), SCHEMA), "id", "batch") == [("3", 1), ("4", 1)]


def test_partitioned_json_reports(spark, tmp_path, rows):
    root = str(tmp_path / "r")
    df = spark.createDataFrame([("c1", "ok"), ("c2", "bad")], "case_id string, status string")
    commits.commit_batch(df, root, 7, ("case_id",), "json")
    assert rows(commits.read_committed(spark, root, "case_id string, status string", "json"), "case_id", "status", "batch") == [("c1", "ok", 7), ("c2", "bad", 7)]
    assert len([d for d in os.listdir(f"{root}/data/{os.listdir(f'{root}/data')[0]}") if d.startswith("case_id=")]) == 2


def test_named_files_appear_as_a_whole(spark, tmp_path):
    df = spark.createDataFrame([("a/x.log", "1\r\n2"), ("b/ü y.md", ""), ("a/deep/z", "é")], "path string, value string")
    folder = commits.put_files(df.repartition(3), str(tmp_path), "one")
    assert {os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names if not f.endswith(".crc")} == {"a/x.log", "b/ü y.md", "a/deep/z"}
    assert open(f"{folder}/a/x.log", newline="").read() == "1\r\n2"
    assert commits.put_files(df.limit(1), str(tmp_path), "one") == folder and os.path.exists(f"{folder}/b/ü y.md")
    with pytest.raises(ValueError, match="mounted"):
        commits.put_files(df, "hdfs://host/x", "one")
