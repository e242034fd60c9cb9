"""Document chunks: splitting, sections, context, upsert, hybrid search."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import thresholds as T
from ..session import settled
from .ordering import last_known, running_sum, top_per_key

# Fixed patterns: separators from coarse to fine, of plain text and of Markdown
SEPARATORS = ("\n\n", "\n", "。", "，", " ", "")
MARKDOWN_SEPARATORS = ("\n#{1,6} ", "```\n", "\n\\*\\*\\*+\n", "\n---+\n", "\n___+\n", "\n\n", "\n", " ", "")


def stride_chunks(docs: DataFrame, size: int = T.CHUNK_SIZE, overlap: int = T.CHUNK_OVERLAP) -> DataFrame:
    """Fixed windows of `size` characters every `size - overlap`; nothing but the row itself is needed."""
    step = size - overlap
    length = F.length("text")
    last = F.greatest(F.lit(0), F.ceil((length - overlap) / step).cast("int") - 1)
    rows = docs.where(length > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    return rows.select("doc_id", "chunk_index", F.substr("text", F.col("chunk_index") * step + 1, F.lit(size)).alias("content"))


def split_recursively(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Split at the coarsest separator present, pack pieces up to `size`, go finer inside longer pieces.

    Separators are patterns. One stays at the head of the piece it opens; neighbouring chunks share up to `overlap` characters.
    """
    level = next((i for i, s in enumerate(separators) if s == "" or re.search(s, text)), len(separators) - 1)
    mark, finer = separators[level], separators[level + 1:]
    if mark:
        head, *rest = re.split(f"({mark})", text)
        pieces = [p for p in [head, *(m + r for m, r in zip(rest[::2], rest[1::2], strict=True))] if p]
    else:
        pieces = list(text)
    chunks: list[str] = []
    held: list[str] = []
    width = 0

    def close() -> None:
        joined = "".join(held).strip()
        if joined:
            chunks.append(joined)
    for piece in pieces:
        if len(piece) >= size and finer:
            if held:
                close()
            held, width = [], 0
            chunks += split_recursively(piece, size, overlap, finer)
            continue
        if width + len(piece) > size and held:
            close()
            while held and (width > overlap or width + len(piece) > size):
                width -= len(held.pop(0))
        held.append(piece)
        width += len(piece)
    if held:
        close()
    return chunks


def recursive_chunks(docs: DataFrame, size: int = T.CHUNK_SIZE, overlap: int = T.CHUNK_OVERLAP,
                     separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """Chunks at natural boundaries; each document is read once, batch by batch, without a shuffle."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, i, c) for d, t in zip(batch["doc_id"], batch["text"]) if t
                    for i, c in enumerate(split_recursively(t, size, overlap, separators))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "content"])
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(
        run, "doc_id string, chunk_index int, content string")


def markdown_sections(lines: DataFrame) -> DataFrame:
    """Section number and header path of every line; header marks inside code fences are text.

    lines(doc_id, line_no, line) are the lines of one text value each, so a document group is as small as
    that value. A header resets the deeper ones.
    """
    key, order = ["doc_id"], [F.col("line_no")]
    text = F.trim("line")
    fence = text.rlike("^(```|~~~)").cast("int")
    fenced = running_sum(lines, key, order, None, fence, "_fences")
    level = F.when((F.col("_fences") % 2 == 0) & text.rlike("^#{1,4} +\\S"), F.length(F.regexp_extract(text, "^(#+)", 1)))
    marked = fenced.withColumn("_level", level)
    title = F.trim(F.regexp_extract(text, "^#+ +(.*)$", 1))
    heads = {f"_h{n}": F.when(F.col("_level") == n, F.struct("line_no", title.alias("title"))) for n in (1, 2, 3, 4)}
    known = last_known(marked, key, order, None, heads)
    known = running_sum(known, key, order, None, F.col("_level").isNotNull().cast("int"), "section")
    parts, above = [], F.lit(-1).cast("bigint")
    for n in (1, 2, 3, 4):
        here = F.col(f"_h{n}.line_no")
        parts.append(F.when(here > above, F.col(f"_h{n}.title")))
        above = F.greatest(above, F.coalesce(here, F.lit(-1)))
    return known.select("doc_id", "line_no", "line", F.col("section").cast("int").alias("section"),
                        F.concat_ws(" > ", *parts).alias("path"))


def section_chunks(sections: DataFrame, size: int = T.CHUNK_SIZE, overlap: int = T.CHUNK_OVERLAP) -> DataFrame:
    """Size-limited chunks of every section, cut at Markdown's marks and named by its header path."""
    key = ["doc_id", "section", "path"]
    texts = sections.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))),
                                                                lambda s: s.line), "\n").alias("text"))
    joined = texts.select(F.to_json(F.struct(*key)).alias("doc_id"), "text")
    fields = F.from_json("doc_id", "doc_id string, section int, path string")
    return recursive_chunks(joined, size, overlap, MARKDOWN_SEPARATORS).withColumn("_k", fields).select(
        "_k.doc_id", "_k.section", "_k.path", "chunk_index", "content",
        F.concat_ws(" > ", "_k.doc_id", F.nullif("_k.path", F.lit(""))).alias("source_name"))


def add_context(chunks: DataFrame, contexts: DataFrame, key: list[str]) -> DataFrame:
    """Supplied context, where not empty, in front of the content with a blank line between."""
    joined = chunks.join(contexts.select(*key, "context"), key, "left")
    has = F.coalesce("context", F.lit("")) != ""
    return joined.withColumns({"content": F.when(has, F.concat("context", F.lit("\n\n"), "content")).otherwise(F.col("content")),
                               "enriched": has}).drop("context")


def upsert_chunks(existing: DataFrame, incoming: DataFrame, replace_documents: bool = False) -> DataFrame:
    """Rows after an idempotent upsert by chunk id; optionally the old rows of every incoming document go first."""
    key = "document_id" if replace_documents else "id"
    newest = top_per_key(incoming, ["id"], [F.desc("updated_at"), F.desc("chunk_index")], 1).drop("_rank")
    return existing.join(incoming.select(key).distinct(), key, "left_anti").unionByName(newest)


def dense_scores(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Cosine of every query with the chunks of its tenant (and course, where the query names one).

    queries(query_id, tenant_id, course_id, embedding), chunks(id, tenant_id, course_id, embedding).
    """
    def norm(v):
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))

    def doubles(v):
        return F.transform(v, lambda x: x.cast("double"))
    q = queries.select("query_id", "tenant_id", F.col("course_id").alias("_course"), doubles("embedding").alias("_q")).withColumn("_qn", norm("_q"))
    c = chunks.select("id", "tenant_id", "course_id", doubles("embedding").alias("_c")).withColumn("_cn", norm("_c"))
    pairs = c.join(q, "tenant_id").where(F.col("_course").isNull() | (F.col("_course") == F.col("course_id")))
    dot = F.aggregate(F.zip_with("_q", "_c", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return pairs.select("query_id", "id", F.when(F.col("_qn") * F.col("_cn") > 0, dot / (F.col("_qn") * F.col("_cn"))).otherwise(0.0).alias("dense"))


def sparse_scores(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Inner product of sparse vectors through their shared terms.

    queries(query_id, tenant_id, course_id, sparse), chunks(id, tenant_id, course_id, sparse). Terms are
    joined, never chunks with queries; sums are formed in part before the shuffle.
    """
    q = queries.select("query_id", "tenant_id", F.col("course_id").alias("_course"), F.explode("sparse").alias("term", "_qw"))
    c = chunks.select("id", "tenant_id", "course_id", F.explode("sparse").alias("term", "_cw"))
    pairs = c.join(q, ["tenant_id", "term"]).where(F.col("_course").isNull() | (F.col("_course") == F.col("course_id")))
    return pairs.groupBy("query_id", "id").agg(F.sum(F.col("_qw") * F.col("_cw")).alias("sparse"))


#: Chunks of a block, and queries that meet a block in one task
BLOCK, SLICE = 4096, 256
#: Pairs of queries and chunks of one tenant, over all tenants, up to which they are simply joined
DIRECT = 1 << 20


def _unit(v: Column) -> Column:
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(length > 0, F.transform(v, lambda x: x / length)).otherwise(F.transform(v, lambda x: F.lit(0.0)))


def _prepared(rows: DataFrame, key: str) -> DataFrame:
    """Rows with a tenant, unit vectors `_u` and terms `_s`, written once."""
    terms = F.coalesce("sparse", F.create_map().cast("map<string,double>"))
    return settled(rows.where("tenant_id IS NOT NULL").select(
        key, "tenant_id", "course_id", _unit(F.transform("embedding", lambda x: x.cast("double"))).alias("_u"), terms.alias("_s")))


def _blocked(rows: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """Chunks with the block they lie in. Vectors of a block agree in the signs of as many components as its tenant has doublings of blocks, so that
    they point to one side; what is still too many is cut by a hash."""
    bits = F.greatest(F.lit(0), F.least(F.lit(12), F.ceil(F.log2(F.col("_n") / block)))).cast("int")
    signs = F.aggregate(F.slice("_u", 1, bits), F.lit(0), lambda a, x: a * 2 + (x > 0).cast("int"))
    rows = rows.join(sizes, "tenant_id").withColumn("_side", F.when(F.col("_n") > block, signs).otherwise(0))
    full = settled(rows.groupBy("tenant_id", "_side").agg(F.count(F.lit(1)).alias("_m")))
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("_m") / block)).cast("int")
    return rows.join(full, ["tenant_id", "_side"]).select("id", "tenant_id", "course_id", "_u", "_s", (F.col("_side").cast("long") * (1 << 32) + part).alias("block"))


def _bounds(queries: DataFrame, blocks: DataFrame, dense_weight: float, sparse_weight: float) -> DataFrame:
    """query_id, tenant_id, block, bound: no chunk of the block scores higher for the query.

    The cosine is at most the query's with the middle of the block's unit vectors plus the length of the longest way from there, and at most 1; a term adds at most the
    query's weight times the block's largest.
    """
    key = ["tenant_id", "block"]
    spread = blocks.select(*key, F.posexplode("_u").alias("i", "x"))
    middle = spread.groupBy(*key, "i").agg(F.avg("x").alias("x")).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("_m"))
    way = F.sqrt(F.aggregate(F.zip_with("_u", "_m", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x))
    place = settled(blocks.join(middle, key).groupBy(*key).agg(F.max(way).alias("_r"), F.first("_m").alias("_m")))
    largest = blocks.select(*key, F.explode("_s").alias("term", "_w")).groupBy(*key, "term").agg(F.max("_w").alias("_w"))
    terms = queries.select("query_id", "tenant_id", F.explode("_s").alias("term", "_qw")).join(largest, ["tenant_id", "term"]).groupBy("query_id", *key).agg(
        F.sum(F.greatest(F.lit(0.0), F.col("_qw") * F.col("_w"))).alias("_t"))
    dot = F.aggregate(F.zip_with("_u", "_m", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    near = queries.join(place, "tenant_id").select("query_id", *key, F.least(F.lit(1.0), dot + F.col("_r")).alias("_d"))
    # a little more than what rounding of the score can add
    return near.join(terms, ["query_id", *key], "left").select("query_id", *key, (dense_weight * F.col("_d") + sparse_weight * F.coalesce("_t", F.lit(0.0)) + 2e-6).alias("bound"))


def _best_of_block(top_k: int, dense_weight: float, sparse_weight: float):
    def best(key: tuple, chunks: pa.Table, queries: pa.Table) -> pa.Table:
        n, m = chunks.num_rows, queries.num_rows
        if not n or not m:
            return pa.table({c: chunks.column("id")[:0] if c == "id" else queries.column("query_id")[:0] if c == "query_id" else pa.array([], pa.float64()) for c in ("query_id", "id", "score")})
        c, q = (np.array(t.column("_u").to_pylist(), np.float64).reshape(t.num_rows, -1) for t in (chunks, queries))
        score = dense_weight * (q @ c.T)
        entries = [t.column("_s").combine_chunks() for t in (chunks, queries)]
        rows = [np.repeat(np.arange(t.num_rows), np.diff(np.asarray(e.offsets))) for t, e in zip((chunks, queries), entries, strict=True)]
        names = pc.unique(entries[1].keys)
        there = pc.index_in(entries[0].keys, names).to_numpy(zero_copy_only=False)
        weight, held = entries[0].items.to_numpy(zero_copy_only=False), ~np.isnan(there.astype(np.float64))
        at, term, weight = rows[0][held], there[held].astype(np.int64), weight[held]
        order = np.argsort(term, kind="stable")
        at, weight, starts = at[order], weight[order], np.searchsorted(term[order], np.arange(len(names) + 1))
        wanted = pc.index_in(entries[1].keys, names).to_numpy(zero_copy_only=False)
        for row, t, w in zip(rows[1].tolist(), wanted.tolist(), entries[1].items.to_pylist(), strict=True):
            some = slice(starts[t], starts[t + 1])
            score[row, at[some]] += sparse_weight * w * weight[some]
        course = [pc.fill_null(pc.cast(t.column("course_id"), pa.string()), "\x00none").to_numpy() for t in (chunks, queries)]
        open_ = (course[1] == "\x00none")[:, None] | (course[1][:, None] == course[0][None, :])
        ids = np.unique(chunks.column("id").to_numpy(), return_inverse=True)[1]
        picked = []
        for row in range(m):
            may = np.flatnonzero(open_[row])
            first = may[np.lexsort((ids[may], -np.round(score[row, may], 6)))[:top_k]]
            picked += [(row, k) for k in first.tolist()]
        left, right = ([p[x] for p in picked] for x in (0, 1))
        return pa.table({"query_id": queries.column("query_id").take(pa.array(left, pa.int64())), "id": chunks.column("id").take(pa.array(right, pa.int64())),
                         "score": pa.array(score[left, right] if picked else [], pa.float64())})
    return best


def hybrid_search(queries: DataFrame, chunks: DataFrame, top_k: int = 3, dense_weight: float = 0.5,
                  sparse_weight: float = 0.5, sure: float = T.HIT_CONFIDENCE, block: int = BLOCK, direct: int = DIRECT) -> DataFrame:
    """Top chunks of every query by the weighted sum of cosine and term product, with the confidence of the best. Exact; weights must not be negative.

    queries(query_id, tenant_id, course_id, embedding, sparse), chunks(id, tenant_id, course_id, embedding, sparse). Chunks of a tenant are cut into blocks with an upper
    bound of what they can score. Each query first meets the block with the highest bound; its k-th score there rules out the blocks that can't reach it,
    and the others are met next. A task scores one block for a slice of queries in numpy and hands on the k best of each query: neither a tenant nor a frequent word is a join key
    of chunks and queries. Where the tenants' pairs are few by count, they are joined.
    """
    rows, asked = _prepared(chunks, "id"), _prepared(queries, "query_id")
    sizes = settled(rows.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("_n")))
    pairs = asked.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("_q")).join(sizes, "tenant_id").agg(F.sum(F.col("_n") * F.col("_q"))).first()[0] or 0
    if pairs <= direct:
        sides = [x.withColumnsRenamed({"_u": "embedding", "_s": "sparse"}) for x in (asked, rows)]
        both = dense_scores(*sides).join(sparse_scores(*sides), ["query_id", "id"], "left")
        score = dense_weight * F.col("dense") + sparse_weight * F.coalesce("sparse", F.lit(0.0))
        return _top(both.select("query_id", "id", score.alias("score")), top_k, sure)
    held = _blocked(rows, sizes, block)
    places = settled(held.select("tenant_id", "block").distinct())
    kinds = {f.name: f.dataType.simpleString() for f in [*held.schema.fields, *asked.schema.fields]}
    key = ["tenant_id", "block", "slice"]

    def scored(pairs: DataFrame) -> DataFrame:
        cut = F.pmod(F.xxhash64("query_id"), F.ceil(F.col("_n") / SLICE)).cast("int")
        sizes = pairs.groupBy("tenant_id", "block").agg(F.count(F.lit(1)).alias("_n"))
        dealt = settled(pairs.join(sizes, ["tenant_id", "block"]).select("query_id", "tenant_id", "block", cut.alias("slice")))
        blocks = held.join(dealt.select(*key).distinct(), ["tenant_id", "block"]).select(*key, "id", "course_id", "_u", "_s")
        meeting = asked.join(dealt, ["query_id", "tenant_id"]).select(*key, "query_id", F.col("course_id").alias("course_id"), "_u", "_s")
        return blocks.toDF(*blocks.columns).groupBy(*key).cogroup(meeting.toDF(*meeting.columns).groupBy(*key)).applyInArrow(
            _best_of_block(top_k, dense_weight, sparse_weight), f"query_id {kinds['query_id']}, id {kinds['id']}, score double")

    if places.groupBy("tenant_id").count().where("count > 1").isEmpty():
        every = scored(asked.select("query_id", "tenant_id").join(places, "tenant_id"))
    else:
        bounds = settled(_bounds(asked, held, dense_weight, sparse_weight))
        first = settled(top_per_key(bounds, ["query_id"], [F.desc("bound"), F.asc("block")], 1).drop("_rank"))
        found = settled(scored(first))
        reached = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= top_k, F.min("score")).alias("_least"))
        rest = bounds.join(first.select("query_id", F.col("block").alias("_met")), "query_id").where("block <> _met").join(reached, "query_id", "left")
        more = scored(rest.where(F.col("_least").isNull() | (F.col("bound") >= F.col("_least"))).select("query_id", "tenant_id", "block"))
        every = found.unionByName(more)
    return _top(every, top_k, sure)


def _top(scored: DataFrame, top_k: int, sure: float) -> DataFrame:
    hits = top_per_key(scored.withColumn("score", F.round("score", 6)), ["query_id"], [F.desc("score"), F.asc("id")], top_k, "place")
    # At most top_k rows of a query are left here.
    best = F.max("score").over(Window.partitionBy("query_id"))
    return hits.withColumn("confidence", F.round(best, 4)).withColumn("is_high_confidence", best >= sure)


def term_vectors(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Sparse vector (word to count) of every row, from all of its words."""
    words = F.explode(F.split(F.lower(text), "[^a-z0-9]+")).alias("_w")
    counts = docs.select(*keys, words).where(F.col("_w") != "").groupBy(*keys, "_w").agg(F.count("*").cast("double").alias("_n"))
    # One entry per distinct word of one text value.
    return counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_w", "_n"))).alias("sparse"))


def merged_ids(*columns: str):
    """Ordered distinct union of id arrays."""
    return F.array_distinct(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in columns]))
