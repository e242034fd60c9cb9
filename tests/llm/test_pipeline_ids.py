"""Pipeline stages on repeated and missing ids and on empty tables; token files outside mounted folders."""

import pytest

import corpus_pipeline
from evigrid.llm import token_files


def test_near_copies_are_told_by_text_and_not_by_id(spark, docs, prose, rows):
    a, b, c = prose(60, 1), prose(60, 2), prose(60, 3)
    near = a + " more"
    given = docs([(1, a), (2, near), (2, b), (3, c), (3, c), (None, prose(60, 4)), (None, prose(60, 4)), (None, prose(60, 5)), (4, ""), (4, ""), (5, None), (6, b), (7, prose(60, 5))])
    out = corpus_pipeline.drop_near_copies(spark, given, None).collect()
    kept = sorted((str(r.doc_id), r.text) for r in out)
    texts = [t for _, t in kept if t]
    # of every class one text; the clean text of an id stays although its other text is a copy
    assert sorted(texts) == sorted([t for t in texts if t in (a, near)][:1] + [b, c, prose(60, 4), prose(60, 5)])
    assert len([t for t in texts if t in (a, near)]) == 1
    assert [k for k in kept if not k[1]] == [("4", ""), ("5", None)]
    assert corpus_pipeline.drop_near_copies(spark, docs([]), None).count() == 0


def test_ids_that_stand_once_keep_their_smallest(spark, docs, prose):
    text = prose(80, 6)
    out = corpus_pipeline.drop_near_copies(spark, docs([(9, text), (4, text), (12, text + " x"), (1, prose(50, 7))]), None)
    assert sorted(r.doc_id for r in out.collect()) == [1, 4]


def test_token_files_need_a_mounted_folder(docs):
    for folder in ("hdfs://host/x", "s3a://bucket/x"):
        with pytest.raises(ValueError, match="memory-mapped"):
            token_files.write_ids(docs([(1, "a")]), folder)


def test_token_files_are_read_by_as_many_tasks_as_files(spark, docs, prose):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = token_files.write_ids(docs([(k, prose(30, k)) for k in range(80)]))
        out = token_files.read_digest(manifest)
        assert out.rdd.getNumPartitions() == manifest.count() > 1 and out.count() == 80
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
