"""Readers and sinks on files that Spark writes from the driver tables to the shared folder: what is read back must be what the tables say."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.ordering import ranked
from ..session import shared_folder
from ..sources import commits, files
from .registry import query, table
from .shapes import ctes, frame


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _put(spark, rows, name):
    return commits.put_files(rows, _folder(spark, name), "batch-1")


# Captions come as a list, a bare string or not at all
@query("s1_document_blocks", """WITH o AS (SELECT CAST(o_custkey % 40 AS VARCHAR) AS doc_id, o_orderkey, o_custkey, o_orderpriority, o_orderstatus, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) - 1 AS seq FROM orders)
  SELECT doc_id, seq, CASE WHEN o_orderkey % 3 = 0 THEN 'table' ELSE 'text' END AS type, CAST(o_orderkey % 9 AS INT) AS page_idx, o_orderpriority AS text,
    CASE o_orderkey % 3 WHEN 0 THEN '[' || o_orderstatus || '] x|' || CAST(o_custkey AS VARCHAR) WHEN 1 THEN '[' || o_orderstatus || '] x' END AS captions FROM o""")
def s1(spark, sf):
    caption = F.when(F.col("o_orderkey") % 3 == 0, F.to_json(F.array(F.concat(F.lit("["), "o_orderstatus", F.lit("] x")), F.col("o_custkey").cast("string")))).when(
        F.col("o_orderkey") % 3 == 1, F.concat(F.lit('"['), "o_orderstatus", F.lit('] x"')))
    # the struct of one field ends with the brace that the block needs, behind the caption
    block = F.concat(F.lit('{"type": "'), F.when(F.col("o_orderkey") % 3 == 0, "table").otherwise("text"), F.lit('", "page_idx": '), (F.col("o_orderkey") % 9).cast("string"),
                     F.coalesce(F.concat(F.lit(', "table_caption": '), caption), F.lit("")), F.lit(', "text": '), F.get(F.split(F.to_json(F.struct("o_orderpriority")), ":", 2), 1))
    docs = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 40).cast("string").alias("doc")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", block.alias("b")))), lambda x: x["b"]), ",\n").alias("value"))
    folder = _put(spark, docs.select(F.concat("doc", F.lit("/content_list.json")).alias("path"), F.concat(F.lit("["), "value", F.lit("]")).alias("value")), "blocks")
    return files.read_blocks(spark, f"{folder}/*/content_list.json").select("doc_id", "seq", "type", "page_idx", "text", F.array_join("table_caption", "|").alias("captions"))


@query("s2_device_snapshots", """SELECT 'D' || CAST(o_custkey % 30 AS VARCHAR) AS device, '' AS package, CAST(o_orderkey AS VARCHAR) AS pin_number, o_orderstatus AS name,
    CASE WHEN o_orderkey % 2 = 0 THEN 'left' ELSE 'unknown' END AS side, 'PAS' AS type, 0 AS side_order FROM orders""")
def s2(spark, sf):
    pin = F.struct(F.col("o_orderkey").cast("string").alias("pin_number"), F.col("o_orderstatus").alias("name"), F.when(F.col("o_orderkey") % 2 == 0, "left").alias("side"))
    devices = table(spark, sf, "orders").groupBy(F.concat(F.lit("D"), (F.col("o_custkey") % 30).cast("string")).alias("device")).agg(F.collect_list(pin).alias("pins"))
    folder = _put(spark, devices.select(F.concat("device", F.lit("/snapshot.json")).alias("path"), F.to_json(F.struct("device", "pins")).alias("value")), "snapshots")
    return files.read_snapshots(spark, f"{folder}/*/snapshot.json").select("device", "package", F.inline("pins")).select(
        "device", "package", "pin_number", "name", "side", "type", "side_order")


@query("s3_run_logs", """WITH e AS (SELECT CAST(user_id % 20 AS VARCHAR) AS job_id, CASE user_id % 3 WHEN 0 THEN 'build' WHEN 1 THEN 'verify' ELSE 'symbol' END AS log_kind, event_type, event_id FROM events WHERE user_id % 20 < 15)
  SELECT job_id, log_kind, CAST(row_number() OVER (PARTITION BY job_id, log_kind ORDER BY event_id) - 1 AS INT) AS line_no, event_type AS text FROM e
  UNION ALL SELECT DISTINCT CAST(user_id % 20 AS VARCHAR), NULL, NULL, NULL FROM events WHERE user_id % 20 >= 15""")
def s3(spark, sf):
    events = table(spark, sf, "events").withColumn("job_id", (F.col("user_id") % 20).cast("string"))
    name = F.element_at(F.array(F.lit("build.log"), F.lit("verify.log"), F.lit("wson8.log")), (F.col("user_id") % 3 + 1).cast("int"))
    logs = events.where("user_id % 20 < 15").groupBy("job_id", name.alias("name")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]), "\r\n").alias("value"))
    folder = _put(spark, logs.select(F.concat_ws("/", "job_id", "name").alias("path"), "value"), "logs")
    return files.read_run_logs(spark, folder, events.select("job_id").distinct()).select("job_id", "log_kind", F.col("line_no").cast("int").alias("line_no"), "text")


@query("s4_text_corpus", """WITH l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents)
  SELECT coalesce(lang, 'none') || '/' || CAST(doc_id AS VARCHAR) AS doc_id, text, NULL AS reason FROM l WHERE k % 5 <> 0
  UNION ALL SELECT coalesce(lang, 'none') || '/' || CAST(doc_id AS VARCHAR), NULL, 'unsupported:txt' FROM l WHERE k % 5 = 0""")
def s4(spark, sf):
    # a language is a few groups at most, so its texts are numbered in buckets of ids; null is a language of its own
    docs = table(spark, sf, "documents").withColumns({"_lang": F.coalesce("lang", F.lit("")), "_none": F.col("lang").isNull()})
    bucket = F.coalesce(F.floor(F.col("doc_id") / 1024), F.lit(2**62))
    docs = ranked(docs, ["_lang", "_none"], [F.asc_nulls_last("doc_id"), F.col("text")], bucket, "k")
    extension = F.when(F.col("k") % 5 == 0, ".txt").when(F.col("k") % 2 == 0, ".md").otherwise(".MarkDown")
    # An id may stand in several rows and a text be missing, so the name of a file also has the number of its row and what is missing
    language = F.regexp_replace(F.regexp_replace(F.url_encode(F.coalesce("lang", F.lit("none"))), "^[.]", "%2E"), "^_", "%5F")
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit("."), F.col("k"), F.when(F.col("_none"), "u").otherwise(""), F.when(F.col("text").isNull(), "n").otherwise(""))
    rows = docs.select(F.concat(language, F.lit("/"), name, extension).alias("path"), F.coalesce("text", F.lit("")).alias("value"))
    folder = _put(spark, rows, "corpus")
    read, refused = files.read_corpus(spark, folder)

    def part(group):
        return F.regexp_extract("doc_id", r"^(?:([^/]*)/)?([^/.]*)[.]\d+u?(n?)$", group)
    none = F.lit(None).cast("string")
    doc_id = F.concat(F.url_decode(part(1)), F.lit("/"), F.nullif(part(2), F.lit("none"))).alias("doc_id")
    return read.select(doc_id, F.when(part(3) == "", F.col("text")).alias("text"), none.alias("reason")).unionByName(refused.select(doc_id, none.alias("text"), "reason"))


# A second batch replaces the documents it has, and repeating it changes nothing
@query("s5_committed_chunks", ctes("old_chunks", "new_chunks") + """ SELECT * FROM old_chunks WHERE document_id NOT IN (SELECT document_id FROM new_chunks) UNION ALL SELECT * FROM new_chunks""")
def s5(spark, sf):
    root, old, new = _folder(spark, "chunks"), frame(spark, sf, "old_chunks"), frame(spark, sf, "new_chunks")
    for batch, rows in enumerate((old, new, new.limit(0))):
        commits.commit_batch(rows, root, min(batch, 1))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in old.schema.fields)
    return commits.read_chunks(spark, root, schema)


@query("s7_case_reports", ctes("golden_expected") + " SELECT case_id, field, nominal, tolerance FROM golden_expected")
def s7(spark, sf):
    root = _folder(spark, "reports")
    cases = frame(spark, sf, "golden_expected").withColumn("part", F.pmod(F.xxhash64("case_id"), F.lit(16)))
    commits.commit_batch(cases, root, 1, ("part",), "json")
    return commits.read_committed(spark, root, "case_id string, field string, nominal double, tolerance double", "json").drop("batch", "part")


@query("s8_golden_cases", """SELECT CAST(p_partkey AS VARCHAR) AS case_id, p_partkey % 2 = 0 AS blind_mode, 'f' || CAST(p_size % 7 AS VARCHAR) AS field, CASE WHEN p_size % 5 <> 0 THEN CAST(p_size AS DOUBLE) END AS nominal, CAST(8 AS DOUBLE) AS tolerance FROM part""")
def s8(spark, sf):
    number = F.col("p_size").cast("double")
    case = F.struct(F.col("p_partkey").cast("string").alias("case_id"), F.when(F.col("p_partkey") % 2 == 0, True).alias("blind_mode"), F.create_map(
        F.concat(F.lit("f"), (F.col("p_size") % 7).cast("string")), F.struct(F.when(F.col("p_size") % 5 != 0, number).alias("nominal"), F.lit(8.0).alias("tolerance"))).alias("required_dimensions"))
    parts = table(spark, sf, "part").groupBy((F.col("p_partkey") % 25).cast("string").alias("k")).agg(F.to_json(F.collect_list(case)).alias("value"))
    folder = _put(spark, parts.select(F.concat("k", F.lit(".json")).alias("path"), "value"), "golden")
    cases, expected = files.read_golden_cases(spark, f"{folder}/*.json")
    return cases.select("case_id", "blind_mode").join(expected, "case_id")
