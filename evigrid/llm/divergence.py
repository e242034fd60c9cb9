"""How the sources of a language differ in their words: an audit over term frequencies with identical texts collapsed.

A term is a run of ASCII letters and non-ASCII characters, with A-Z in lower case. A language keeps the V terms that at least MIN_DOCS of its
documents hold. Each (lang, source) group, and each language, gives a kept term p = 1 + floor(10^9 * (count + 1) / (N + V)), where N is the sum of its
counts over kept terms. The divergence at a term is f = floor((p - q)^2 / q), q being the p of another source (`pair`, summed over all kept
terms) or of the language (`term`, only where p > q). All arithmetic is in integers.

1. Documents are counted by (lang, text, source) under the text's 256-bit hash, so only numbers move; one copy of each text of a language goes to the
   place of its counts. A text that a third of all rows repeat collapses in the tasks that read it.
2. Each distinct text is split once, in numpy; its term counts enter every source with the multiplicity of the text there, its term set with the same weight
   as document frequency. Tasks add up what they have, to a bounded number of rows, before a row leaves them.
3. Rows move once more, by (language, term); counts of a term become one row with an array of the sources that have it.
4. Pairs are evaluated sparsely. A term that neither source has gives f(p0, q0), the same for all such terms. What a term of one source alone adds
   depends on its count only, so counts are tallied first and f is computed once for each. Only terms that two sources share give a pair row, as a
   correction to these sums, and tasks add those up before they leave. p is computed in two steps, so that 64 bits hold up to 9e13 words.
5. Group totals are a written table; whether it is broadcast is Spark's decision from its size.

Defined cases: null text, lang and source are ''. Every row is a document, whatever its doc_id. A group without terms still stands in all pairs. A
language without kept terms has value 0 in its pairs and no terms. A language with one source has no pairs. Extra columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import settled
from .words import LOWER, text_chunks, word_hashes, words_of

MIN_DOCS, TOP = 3, 200
#: p is in units of 1 / (the product of both)
SCALE = (10**5, 10**4)
#: Bytes of texts whose terms are added up before they leave a task
BLOCK_BYTES = 4 << 20
#: Rows of sums that a task holds before it adds them up or hands them on
HELD_ROWS = 1 << 20
GAP = np.zeros(256, bool)
GAP[:128] = True
GAP[[*range(65, 91), *range(97, 123)]] = False


def distinct_texts(docs: DataFrame) -> DataFrame:
    """lang, text, held (array of source, n): each text of a language once, with its number of documents per source."""
    def part(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)

    rows = docs.select(part("lang"), part("source"), part("text")).withColumn("key", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    counts = rows.groupBy("lang", "key", "source").agg(F.count(F.lit(1)).alias("n"))
    held = counts.groupBy("lang", "key").agg(F.collect_list(F.struct("source", "n")).alias("held"))
    return rows.groupBy("lang", "key").agg(F.first("text").alias("text")).join(held.hint("merge"), ["lang", "key"]).select("lang", "text", "held")


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for block in _blocks(batches):
        held.append(block)
        rows += block.num_rows
        if rows > HELD_ROWS:
            held = _added(held)
            rows = sum(b.num_rows for b in held)
            if 2 * rows > HELD_ROWS:
                yield from held
                held, rows = [], 0
    if held:
        yield from _added(held)


def _added(blocks: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    sums = pa.Table.from_batches(blocks).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("n_docs", "sum")])
    return sums.select(["lang", "source", "term", "n_sum", "n_docs_sum"]).rename_columns(["lang", "source", "term", "n", "n_docs"]).combine_chunks().to_batches()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, n_docs of a few megabytes of texts."""
    for batch in batches:
        lang, held = batch.column(0), batch.column(2)
        size = held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(size)])
        flat = held.flatten()
        source, copies = flat.field("source"), flat.field("n").to_numpy(zero_copy_only=False)
        langs, sources = lang.dictionary_encode(), source.dictionary_encode()
        lang_code, source_code = (a.indices.to_numpy(zero_copy_only=False).astype(np.int64) for a in (langs, sources))
        n_sources = max(len(sources.dictionary), 1)
        for texts in text_chunks(batch.column(1), BLOCK_BYTES):
            words = words_of(texts, GAP)
            if not len(words.start):
                continue
            _, one, term = np.unique(word_hashes(texts, words, lower=True), return_index=True, return_inverse=True)
            n_terms = len(one)
            low = LOWER[texts.data].tobytes()
            names = pa.array([low[s:e].decode() for s, e in zip(words.start[one].tolist(), words.end[one].tolist(), strict=True)], pa.string())
            seen, count = np.unique(words.row * n_terms + term, return_counts=True)
            row, term = texts.first + seen // n_terms, seen % n_terms
            # a line for each source that holds the text
            times = size[row]
            line = np.repeat(np.arange(len(row)), times)
            item = np.repeat(first[row], times) + np.arange(len(line)) - np.repeat(np.cumsum(times) - times, times)
            key = (lang_code[row[line]] * n_sources + source_code[item]) * n_terms + term[line]
            order = np.argsort(key, kind="stable")
            key = key[order]
            at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            weight = copies[item][order]
            group, term = key[at] // n_terms, key[at] % n_terms
            yield pa.RecordBatch.from_arrays([
                langs.dictionary.take(pa.array(group // n_sources)), sources.dictionary.take(pa.array(group % n_sources)), names.take(pa.array(term)),
                pa.array(np.add.reduceat(weight * count[line][order], at)), pa.array(np.add.reduceat(weight, at))], ["lang", "source", "term", "n", "n_docs"])


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, n, held (array of source, n): the terms that at least min_docs documents of the language hold."""
    tally = distinct_texts(docs).mapInArrow(_tally, "lang string, source string, term string, n long, n_docs long")
    # dealt by term once; both groupings keep to that
    by_source = tally.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    return by_source.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"), F.collect_list(F.struct("source", "n")).alias("held")).where(
        F.col("n_docs") >= min_docs).select("lang", "term", "n", "held")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _p(count: Column | int, total: Column, terms: Column, scale: tuple[int, int]) -> Column:
    """1 + floor(scale * (count + 1) / (total + terms)); null where a language keeps no terms."""
    more = (F.lit(count).cast("long") if isinstance(count, int) else count) + 1
    whole = F.when(terms > 0, total + terms)
    return 1 + scale[1] * _div(scale[0] * more, whole) + _div(scale[1] * ((scale[0] * more) % whole), whole)


def _f(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def _pairs(terms: DataFrame, groups: DataFrame, scale: tuple[int, int]) -> DataFrame:
    """lang, source, item, value of every two sources of a language."""
    a = groups.select("lang", F.col("source").alias("a"), F.col("total").alias("na"), "n_terms")
    b = groups.select("lang", F.col("source").alias("b"), F.col("total").alias("nb"))
    p0, q0 = (_p(0, F.col(x), F.col("n_terms"), scale) for x in ("na", "nb"))
    pairs = settled(a.join(b, "lang").where("a <> b").withColumns({"p0": p0, "q0": q0}))
    tallied = settled(terms.select("lang", F.inline("held")).groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("m")))
    p0, q0 = F.col("p0"), F.col("q0")
    p, q = (_p(F.col("n"), F.col(x), F.col("n_terms"), scale) for x in ("na", "nb"))

    def times(m: Column, value: Column) -> Column:
        return (m.cast("decimal(18,0)") * value.cast("decimal(19,0)")).cast("decimal(38,0)").alias("v")

    neither = pairs.select("lang", "a", "b", F.coalesce(times(F.col("n_terms"), _f(p0, q0)), F.lit(0).cast("decimal(38,0)")).alias("v"))
    left = tallied.withColumnRenamed("source", "a").join(pairs, ["lang", "a"]).select("lang", "a", "b", times(F.col("m"), _f(p, q0) - _f(p0, q0)))
    right = tallied.withColumnRenamed("source", "b").join(pairs, ["lang", "b"]).select("lang", "a", "b", times(F.col("m"), _f(p0, q) - _f(p0, q0)))
    both = terms.where(F.size("held") > 1).select("lang", "held", F.inline("held")).toDF("lang", "held", "a", "x").select(
        "lang", "a", "x", F.inline("held")).toDF("lang", "a", "x", "b", "y").where("a < b").join(pairs, ["lang", "a", "b"])
    both = both.withColumns({"p": _p(F.col("x"), F.col("na"), F.col("n_terms"), scale), "q": _p(F.col("y"), F.col("nb"), F.col("n_terms"), scale)})
    p, q = F.col("p"), F.col("q")
    there, back = (_f(u, v) - _f(u, v0) - _f(u0, v) + _f(u0, v0) for u, v, u0, v0 in ((p, q, p0, q0), (q, p, q0, p0)))
    met = both.groupBy("lang", "a", "b").agg(*(F.sum(x.cast("decimal(19,0)")).cast("decimal(38,0)").alias(n) for x, n in ((there, "there"), (back, "back"))))
    common = met.select("lang", F.inline(F.array(F.struct("a", "b", F.col("there").alias("v")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("back").alias("v")))))
    return neither.unionByName(left).unionByName(right).unionByName(common).groupBy("lang", "a", "b").agg(F.sum("v").cast("long").alias("value")).select(
        "lang", F.col("a").alias("source"), F.col("b").alias("item"), "value")


def _outstanding(terms: DataFrame, groups: DataFrame, scale: tuple[int, int]) -> DataFrame:
    """lang, source, item, value of the terms that a source has more of than its language."""
    rows = terms.select("lang", F.col("term").alias("item"), F.col("n").alias("all_n"), F.inline("held")).join(groups, ["lang", "source"])
    rows = rows.withColumn("p", _p(F.col("n"), F.col("total"), F.col("n_terms"), scale)).withColumn(
        "q", _p(F.col("all_n"), F.col("all_total"), F.col("n_terms"), scale))
    return rows.where("p > q").select("lang", "source", "item", _f(F.col("p"), F.col("q")).alias("value"))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, scale: tuple[int, int] = SCALE) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: all other sources of the language, and the `top` terms of each source."""
    terms = settled(kept_terms(docs, min_docs))
    present = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).distinct()
    totals = terms.select("lang", F.inline("held")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    whole = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("n").alias("all_total"))
    groups = settled(present.join(totals, ["lang", "source"], "left").join(whole, "lang", "left").na.fill(0, ["total", "n_terms", "all_total"]))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    columns = ("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")
    pair = _pairs(terms, groups, scale).withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    term = _outstanding(terms, groups, scale).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return pair.select(*columns).unionByName(term.select(*columns))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
counts AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sized AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
grp_total AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM grp LEFT JOIN counts USING (lang, source) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + s.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (k.n + 1)) // (s.total + s.v)::HUGEINT AS q
  FROM grp_total g JOIN sized s USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair_sum AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair_sum s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
