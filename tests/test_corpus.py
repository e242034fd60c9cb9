"""A corpus of files is listed and read by tasks, and no row of the table it comes from is lost."""

import duckdb
import pytest

from evigrid.plans import ORACLES, QUERIES
from evigrid.sources import commits, files


def test_repeated_ids_empty_and_missing_values_stay(spark, tmp_path):
    """s4_text_corpus: rows with one language and id shared a file, empty files were passed over, null ids came first and null texts came back empty."""
    docs = [(i // 3, f"text {i // 3}", "en") for i in range(60)] + [(i, "" if i % 2 else None, "de") for i in range(11)]
    docs += [(None, "no id", "de"), (5, "a\r\nb", None), (5, "c", "none"), *((i, f"odd {i}", lang) for i, lang in enumerate(("a/b c", "", "_x", ".h", "..", "50%+")))]
    spark.createDataFrame([(*d, "s", 1) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")

    def bag(rows):
        return sorted((tuple(r) for r in rows), key=str)
    got = QUERIES["s4_text_corpus"](spark, str(tmp_path)).select("doc_id", "text", "reason").collect()
    assert bag(got) == bag(con.execute(ORACLES["s4_text_corpus"]).fetchall()) and len(got) == len(docs)


def test_the_driver_holds_no_list_of_a_corpus(spark, tmp_path):
    """Spark's readers keep every file of the folder in the driver, twice in s4_text_corpus."""
    for i in range(90):
        commits._put_file(f"{tmp_path}/c/{i % 3}/x{i % 2}/{i}.{('md', 'txt', 'MarkDown')[i % 3]}", f"t{i}")
    docs, rejects = files.read_corpus(spark, f"{tmp_path}/c")
    assert not any(f"{tmp_path}/c/" in f for d in (docs, rejects) for f in d.inputFiles())
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted((f"{i % 3}/x{i % 2}/{i}", f"t{i}") for i in range(90) if i % 3 != 1)
    assert sorted(r.doc_id for r in rejects.collect()) == sorted(f"1/x{i % 2}/{i}" for i in range(90) if i % 3 == 1)


def test_what_a_dying_task_was_writing_is_no_file(spark, tmp_path, monkeypatch):
    commits._put_file(f"{tmp_path}/en/1.md", "whole")
    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(commits.os, "replace", lambda *_: (_ for _ in ()).throw(OSError("dies")))
        commits._put_file(f"{tmp_path}/en/2.md", "part")
    docs, rejects = files.read_corpus(spark, str(tmp_path))
    assert [r.doc_id for r in docs.collect()] == ["en/1"] and rejects.count() == 0
