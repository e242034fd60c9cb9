"""Lines that many documents share, dropped everywhere but in the last document that holds them. DataFrame functions only.

A line's key is the line without space and \\t \\n \\v \\f \\r at its ends and with A-Z in lower case. Keys of at least MIN_CHARS code
points that stand in at least MIN_DOCS documents lose all their lines except in the document of the largest doc_id with it.

1. The keys of a document's lines become 128-bit hashes in place; only long ones are spread to rows, with their positions.
2. The rows are range-partitioned by (hash, doc_id descending) and sorted by these and by position. As doc_id is part of the range, a line
   that a third of all documents share is dealt over many partitions; rows of one (hash, doc_id) stay together, so the rows of
   a document for a key are gathered without another shuffle.
3. In that order the first row of a key is its largest doc_id. Heads and numbers of documents are taken per partition first and
   then combined, so a frequent key costs one row per partition.
4. All others are dropped: the keep bitmap of a document goes out run-length compressed, as the runs of its dropped lines; texts
   don't move before the runs are joined to them.

Defined cases: a null or empty text is one empty line. Rows that repeat a doc_id count as one document, share its drops by position and
give a row each. A null doc_id is a document of its own that is smaller than any other; several such rows are one document.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_CHARS, MIN_DOCS = 20, 3
#: Upper case that keys don't tell from lower case; only ASCII
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENDS = " \t\n\x0b\f\r"


def key_of(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(ENDS)), UPPER, LOWER)


def _lines(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.split(text, "\n", -1).alias("lines"))


def dropped_runs(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, runs (array of first, n: maximal runs of dropped lines, in order) of the documents that lose lines."""
    keys = F.transform("lines", lambda line, i: F.struct(key_of(line).alias("k"), i.alias("pos")))
    long = F.filter(keys, lambda x: F.length(x["k"]) >= min_chars)
    hashed = F.transform(long, lambda x: F.struct(F.xxhash64(x["k"]).alias("h1"), F.xxhash64(F.lit(1), x["k"]).alias("h2"), x["pos"].alias("pos")))
    rows = _lines(docs).select("doc_id", F.inline(hashed))
    ordered = rows.repartitionByRange("h1", "h2", F.col("doc_id").desc(), ).sortWithinPartitions("h1", "h2", F.col("doc_id").desc(), "pos")
    held = ordered.groupBy("h1", "h2", "doc_id").agg(F.collect_list("pos").alias("pos"))
    heads = held.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("head")).where(F.col("n_docs") >= min_docs)
    lost = held.join(heads, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("head"))).select("doc_id", "pos")
    at = F.array_sort(F.array_distinct(F.flatten(F.collect_list("pos"))))
    every = lost.groupBy("doc_id").agg(at.alias("p"))
    step = F.sequence(F.lit(0), F.size("p") - 1)
    opens = F.filter(step, lambda i: (i == 0) | (F.get("p", i) - F.get("p", i - 1) > 1))
    runs = F.transform("o", lambda i, k: F.struct(F.get("p", i).alias("first"), (F.coalesce(F.get("o", k + 1), F.size("p")) - i).alias("n")))
    return every.withColumn("o", opens).select("doc_id", runs.alias("runs"))


def kept_lines(lines: Column, runs: Column) -> Column:
    """The lines outside the runs, in order: slices between one run's end and the next one's start."""
    n = F.coalesce(F.size(runs), F.lit(0))
    start = F.transform(F.sequence(F.lit(0), n), lambda k: F.when(k == 0, 0).otherwise(F.get(runs, k - 1)["first"] + F.get(runs, k - 1)["n"]))
    parts = F.transform(start, lambda s, k: F.slice(lines, s + 1, F.coalesce(F.get(runs, k)["first"], F.size(lines)) - s))
    return F.flatten(parts)


def line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, runs, kept_sha256 (of the kept lines joined by \\n): one row per row of docs."""
    lost = dropped_runs(docs).select(F.col("doc_id").alias("lost_id"), "runs")
    joined = _lines(docs).join(lost, F.col("doc_id").eqNullSafe(F.col("lost_id")), "left").withColumn(
        "runs", F.filter(F.coalesce("runs", F.array().cast("array<struct<first:int,n:int>>")), lambda r: r["first"] < F.size("lines")))
    joined = joined.withColumn("runs", F.transform("runs", lambda r: F.struct(
        r["first"].alias("first"), F.least(r["n"], F.size("lines") - r["first"]).alias("n"))))
    dropped = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r["n"])
    kept = F.array_join(kept_lines(F.col("lines"), F.col("runs")), "\n")
    return joined.select("doc_id", F.size("lines").cast("long").alias("n_lines"), dropped.alias("n_dropped"), "runs",
                         F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
shared AS (
  SELECT k, max(doc_id) AS head FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE head IS NOT NULL AND doc_id <> head) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE head IS NULL OR doc_id = head), '')) AS kept_sha256
FROM keyed LEFT JOIN shared USING (k) GROUP BY doc_id
"""
