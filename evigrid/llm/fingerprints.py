"""MinHash fingerprints of documents, their likeness, and the pairs that share bands of them.

A fingerprint is the signature of the document's shingles of SHINGLE words: for each of PERMUTATIONS universal hash functions (a * x + b mod 2^64 of a
32-bit shingle hash, of which the upper bits count) the smallest value, hashed to 16 bits, in hex. The share of equal values estimates the Jaccard similarity of
two shingle sets. Words are runs of other bytes than space and \\t \\n \\v \\f \\r; a text of fewer words is one shingle.

`fingerprint_digest` also fingerprints an edited text of each document: its last floor(n / 2) code points are replaced by the first as many of the next document
in descending doc_id.

1. The order is found from narrow rows (doc_id, hash of the text): range-partitioned, of which the first row of each part goes to the driver. These few
   places (PARTS_PER_TASK times the number of shuffle partitions) are the bounds of the parts.
2. Texts move once, to the part their place is in, and each part also gets the first text of the part after it, so that no part waits for another. After the
   last part comes the first one's.
3. A task streams its parts in order and holds a chunk of about a megabyte, or the longest single text, and the text before it.

`near_copies` is the search: equal word sequences are one text, signatures are cut into bands, and texts that share a band are candidates whose Jaccard
similarity is verified on their whole shingle sets. A band value of many texts is dealt in blocks: members of a block meet in one task, pairs of
blocks in others, and only verified links leave a task, so no list of pairs is built. A pair that shares several bands is counted in its first one.

Defined cases: a null or empty text has no shingles; all such texts share one fingerprint of only ones and are alike. Documents without doc_id come last; rows of one
doc_id are in the order of a hash of their texts. A single document is its own next one. Extra columns are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import components, settled
from .words import BASE, mixed, shingle_hashes, signed, text_chunks, word_hashes, words_of

SHINGLE, PERMUTATIONS, SIMILARITY = 5, 128, 0.8
#: Two texts of similarity s share none of 128 / ROWS bands with probability (1 - s^ROWS)^(128 / ROWS): 5e-8 at 0.8
ROWS = 4
#: Texts of a band value that meet in one task
BLOCK = 256
#: Parts of the order for each shuffle partition: parts are dealt by hash, and several even the load out
PARTS_PER_TASK = 4
#: Bytes of text fingerprinted at once
CHUNK = 1 << 20
#: Smallest values taken at once: shingles of a pass
PASS = 1 << 15


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and additions of n hash functions, from a fixed rule."""
    seeds = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(BASE))
    return seeds[:n] | np.uint64(1), seeds[n:]


def signatures(hashes: np.ndarray, ptr: np.ndarray, n: int = PERMUTATIONS) -> np.ndarray:
    """The smallest value of each hash function over the shingles of each row, hashed to 16 bits: a matrix of rows by functions."""
    a, b = _functions(n)
    out = np.zeros((len(ptr) - 1, n), np.uint64)
    held = np.flatnonzero(np.diff(ptr))
    if len(held):
        x = hashes >> np.uint64(32)
        # passes of whole rows that fit the cache; a row longer than that is a pass of its own
        cuts, start = [0], ptr[held]
        while cuts[-1] < len(held):
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ptr[held + 1], start[cuts[-1]] + PASS, "right"))))
        for first, last in zip(cuts, cuts[1:], strict=False):
            rows = held[first:last]
            some, at = x[ptr[rows[0]]:ptr[rows[-1] + 1]], ptr[rows] - ptr[rows[0]]
            values = np.empty_like(some)
            for k in range(n):
                np.multiply(some, a[k], out=values)
                np.add(values, b[k], out=values)
                out[rows, k] = np.minimum.reduceat(values, at)
    # smallest values of long texts all begin with zero bits, so they are hashed before they are cut
    out = mixed(out) >> np.uint64(48)
    out[np.diff(ptr) == 0] = 0xFFFF
    return out.astype(">u2")


def _signed_texts(texts: list[str]) -> np.ndarray:
    parts = []
    for chunk in text_chunks(pa.array(texts, pa.large_string()), CHUNK):
        words = words_of(chunk)
        parts.append(signatures(*shingle_hashes(word_hashes(chunk, words), words.ptr, SHINGLE)))
    return np.concatenate(parts) if parts else np.zeros((0, PERMUTATIONS), ">u2")


def _hex(signature: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in signature]


def likeness(a: Column, b: Column) -> Column:
    """The share of equal values of two fingerprints of the same length."""
    width = 4
    n = F.floor(F.length(a) / width).cast("int")
    same = F.filter(F.sequence(F.lit(0), n - 1), lambda k: F.substring(a, k * width + 1, F.lit(width)) == F.substring(b, k * width + 1, F.lit(width)))
    return F.size(same) / n


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of every row, without moving a text."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(_hex(_signed_texts(texts)), pa.string())],
                                             ["doc_id", "n_chars", "fingerprint"])

    return _rows(docs).mapInArrow(sign, "doc_id long, n_chars long, fingerprint string")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _placed(docs: DataFrame) -> DataFrame:
    """Rows with their place: ascending (lost, back, tie) is descending doc_id, rows without one last."""
    return _rows(docs).withColumns({"lost": F.col("doc_id").isNull().cast("int"), "back": F.coalesce(F.bitwise_not("doc_id"), F.lit(0)), "tie": F.xxhash64("text")})


PLACE = ["lost", "back", "tie"]


def _bounds(rows: DataFrame, parts: int) -> list[tuple[int, int, int]]:
    """The smallest place of each of at most `parts` parts of about the same number of rows."""
    dealt = rows.select(*PLACE).repartitionByRange(parts, *PLACE).withColumn("part", F.spark_partition_id())
    firsts = dealt.groupBy("part").agg(F.min(F.struct(*PLACE)).alias("first")).collect()
    return sorted({tuple(r["first"]) for r in firsts})


def _part_of(bounds: list[tuple[int, int, int]]):
    backs = {lost: np.array([b for n, b, _ in bounds if n == lost], np.int64) for lost in (0, 1)}
    before = {0: 0, 1: len(backs[0])}

    @F.pandas_udf("int")
    def part(lost: pd.Series, back: pd.Series, tie: pd.Series) -> pd.Series:
        out = np.zeros(len(lost), np.int64)
        lost, back, tie = lost.to_numpy(), back.to_numpy(), tie.to_numpy()
        for n in (0, 1):
            at = np.flatnonzero(lost == n)
            low, high = (np.searchsorted(backs[n], back[at], side) for side in ("left", "right"))
            out[at] = before[n] + high - 1
            for k in at[high > low].tolist():  # the doc_id of a bound: the tie decides
                out[k] = bisect.bisect_right(bounds, (n, int(back[k]), int(tie[k]))) - 1
        return pd.Series(np.maximum(out, 0).astype(np.int32))

    return part


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, edge, doc_id, text) in order; a row with edge closes its part and is only the next text of the row before it."""
    held = None

    def done(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
        edited = []
        for text, after in zip(texts, following, strict=True):
            half = len(text) // 2
            edited.append(text[:len(text) - half] + after[:half])
        own, new = _signed_texts(texts), _signed_texts(edited)
        return own, pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            pa.array(_hex(own)), pa.array(_hex(new)), pa.array((own == new).mean(1), pa.float64())],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited"])

    def chunks():
        """Lists of rows of one part, of about a chunk of text, and the text after the last one."""
        nonlocal held
        rows, size = [], 0
        for batch in batches:
            for part, edge, doc, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if held is not None:
                    rows.append(held)
                    size += len(held[1])
                    if edge or size > CHUNK:
                        yield rows, text
                        rows, size = [], 0
                held = None if edge else (doc, text)

    for rows, after in chunks():
        texts = [t for _, t in rows]
        own, out = done([d for d, _ in rows], texts, texts[1:] + [after])
        following = np.concatenate([own[1:], _signed_texts([after])])
        yield out.append_column("near_next", pa.array((own == following).mean(1), pa.float64()))


def fingerprint_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    rows = _placed(docs)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(rows, PARTS_PER_TASK * tasks)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if not bounds:
        return rows.limit(0).select(*(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in schema.split(", ")))
    part = _part_of(bounds)(*PLACE)
    # the first text of each part closes the part before it: one row for each bound
    ids = sorted({~b for lost, b, _ in bounds if not lost})
    near = rows.where(F.col("doc_id").isin(ids) if len(ids) == len(bounds) else F.col("doc_id").isin(ids) | F.col("doc_id").isNull())
    firsts = near.withColumn("part", part).join(
        F.broadcast(docs.sparkSession.createDataFrame(bounds, "lost int, back long, tie long")), PLACE, "left_semi").groupBy("part").agg(F.first("text").alias("text"))
    edges = firsts.select(((F.col("part") - 1 + len(bounds)) % len(bounds)).cast("int").alias("part"), F.lit(1).alias("edge"), F.lit(None).cast("long").alias("doc_id"), "text",
                          *(F.lit(0).cast(k).alias(c) for c, k in zip(PLACE, ("int", "long", "long"), strict=True)))
    dealt = rows.select(part.alias("part"), F.lit(0).alias("edge"), "doc_id", "text", *PLACE).unionByName(edges)
    dealt = dealt.repartition(tasks, "part").sortWithinPartitions("part", "edge", *PLACE)
    return dealt.select("part", "edge", "doc_id", "text").mapInArrow(_edit, schema)


def _signed_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) with the distinct shingles in order and a hash of each band."""
    for batch in batches:
        keys, at = batch.column(0), 0
        for chunk in text_chunks(batch.column(1), CHUNK):
            words = words_of(chunk)
            hashes, ptr = shingle_hashes(word_hashes(chunk, words), words.ptr, SHINGLE)
            held = signatures(hashes, ptr).astype(np.uint64).reshape(chunk.n, -1, ROWS)
            band = np.zeros(held.shape[:2], np.uint64)
            for k in range(ROWS):
                band = mixed(band + held[:, :, k] + np.uint64(1))
            sets = [np.unique(hashes[s:e]) for s, e in zip(ptr, ptr[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([
                keys.slice(at, chunk.n), pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32), signed(np.concatenate(sets))),
                pa.ListArray.from_arrays(np.arange(chunk.n + 1, dtype=np.int32) * band.shape[1], signed(band.ravel()))], ["key", "shingles", "bands"])
            at += chunk.n


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A 128-bit hash of each text's sequence of words; null without words."""
    for batch in batches:
        out = []
        for chunk in text_chunks(batch.column(1), CHUNK):
            words = words_of(chunk)
            hashes = word_hashes(chunk, words)
            out += [hashlib.md5(hashes[s:e].tobytes()).hexdigest() if e > s else None for s, e in zip(words.ptr, words.ptr[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["doc_id", "text", "key"])


def _meet(similarity: float):
    def meet(group: pa.Table) -> pa.Table:
        """Links between the members of two blocks of a band value (or within one): numbers of links per member, and a forest that joins what is linked."""
        rows = group.sort_by([("blk", "ascending"), ("key", "ascending")])
        keys, blk = rows.column("key").to_pylist(), rows.column("blk").to_numpy()
        band = rows.column("i")[0].as_py()
        bands = np.array(rows.column("bands").to_pylist(), np.int64)
        sets = [np.array(x, np.int64) for x in rows.column("shingles").to_pylist()]
        within = blk[0] == blk[-1]
        size, root, n_links, forest = np.array([len(x) for x in sets]), list(range(len(keys))), np.zeros(len(keys), np.int64), []

        def top(k):
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for k in range(len(keys)):
            later = np.arange(k + 1, len(keys)) if within else np.flatnonzero((blk > blk[k]) if k + 1 < len(keys) else np.zeros(len(keys), bool))
            # a pair belongs to the first band it shares, and sizes alone rule many out
            later = later[~(bands[later, :band] == bands[k, :band]).any(1)]
            later = later[np.minimum(size[later], size[k]) >= similarity * np.maximum(size[later], size[k])]
            for j in later.tolist():
                common = len(np.intersect1d(sets[k], sets[j], assume_unique=True))
                if common >= similarity * (size[k] + size[j] - common):
                    n_links[[k, j]] += 1
                    a, b = top(k), top(j)
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        forest.append((keys[k], keys[j]))
        some = np.flatnonzero(n_links)
        return pa.table({"a": pa.array([keys[k] for k in some] + [a for a, _ in forest], pa.string()),
                         "b": pa.array([None] * len(some) + [b for _, b in forest], pa.string()),
                         "n": pa.array([*n_links[some].tolist(), *[0] * len(forest)], pa.int64())})
    return meet


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id (the smallest doc_id linked to it through texts of at least this similarity), n_links (other texts that are near it).

    Texts without words are all one class and have no links."""
    rows = settled(_rows(docs).mapInArrow(_keys, "doc_id long, text string, key string"))
    texts = rows.where("key IS NOT NULL").groupBy("key").agg(F.first("text").alias("text"))
    nodes = settled(texts.mapInArrow(_signed_nodes, "key string, shingles array<long>, bands array<long>"))
    places = nodes.select("key", F.posexplode("bands").alias("i", "value"))
    shared = places.groupBy("i", "value").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    dealt = places.join(shared, ["i", "value"]).withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
    dealt = dealt.withColumn("blk", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    dealt = dealt.select("key", "i", "value", "blk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "key", "i", "value", "blk", F.least("blk", "other").alias("low"), F.greatest("blk", "other").alias("high"))
    met = settled(dealt.join(nodes, "key").groupBy("i", "value", "low", "high").applyInArrow(_meet(similarity), "a string, b string, n long"))
    linked = components(met.where("b IS NOT NULL").select("a", "b"))
    counts = met.groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n_links"))
    ids = settled(rows.select("doc_id", "key").join(linked.withColumnRenamed("node", "key"), "key", "left").join(counts, "key", "left").select(
        "doc_id", F.coalesce("comp", "key", F.lit("")).alias("comp"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    first = ids.groupBy("comp").agg(F.min("doc_id").alias("class_id"))
    return ids.join(first, "comp").select("doc_id", "class_id", "n_links")
