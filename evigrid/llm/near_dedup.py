"""Near-duplicate documents by ProbMinHash, banding and verification.

Weighted shingles are the distinct five-word shingles of a text with their counts. The similarity of two texts is the
probability Jaccard of these weights, sum over shared i of 1 / sum over j of max(x_j / x_i, y_j / y_i); for texts
without repeated shingles it is the plain Jaccard similarity.

1. Texts of equal word sequences (128-bit hash) are one class from the start; its smallest doc_id stands for it.
2. ProbMinHash: the arrivals of a Poisson process of rate count for every shingle fall on random registers; a register keeps
   the shingle that came first. A shingle stops as soon as its next arrival is later than the latest register.
3. Banding: texts that agree in all registers of a band share a bucket. Each one is compared with the head of its bucket, the
   smallest id, so a bucket costs as many comparisons as it has members. Both texts are read whole and the similarity is exact.
4. What a bucket's head doesn't link may still be linked to each other. A family is what shared buckets connect. Families whose
   verified links leave more than one part are cut into blocks of bounded size, and every pair of blocks that don't lie
   in one and the same part is compared in a task of its own: by registers first, then exactly, best first, leaving out pairs
   that are connected by then. This loses no link, writes no list of pairs, and one very large family is many tasks.
5. Classes are the connected components of all verified links.

A pair of similarity 0.8 shares none of 24 bands of 4 registers with probability 3e-6.

Defined cases: a null, empty or all-space text is alone in its class. A text of fewer than five words has one shingle of all its
words. Rows that repeat a doc_id are one document with all their texts: each of them may link it. Rows without doc_id are in
no class. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, settled
from .words import mixed, shingle_hashes, signed, text_chunks, weighted, word_hashes, words_of

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
#: Share of equal registers under which a pair isn't verified: 4.4 standard deviations below 0.8 for 96 registers
PLAUSIBLE = 0.62
#: Most texts of a family on one side of a comparison task, and their most bytes
BLOCK, BLOCK_BYTES = 128, 4 << 20


def registers(h: np.ndarray, row: np.ndarray, count: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """(n, m) uint32: for every row and register the shingle whose arrival came first; 0 in rows without shingles."""
    first = np.full(n * m, np.inf)
    holder = np.zeros(n * m, np.uint64)
    h, row, rate = h.copy(), row.copy(), count.astype(np.float64)
    state, time = h.copy(), np.zeros(len(h))
    has = np.zeros(n, bool)
    has[row] = True
    while len(h):
        state = mixed(state + np.uint64(0x9E3779B97F4A7C15))
        uniform = ((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        time = time - np.log(uniform) / rate
        latest = np.where(has, first.reshape(n, m).max(1), 0.0)
        alive = time < latest[row]
        h, row, rate, state, time = h[alive], row[alive], rate[alive], state[alive], time[alive]
        at = row * m + (mixed(state ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        holder[at[won]] = h[won]
    return (holder >> np.uint64(32)).astype(np.uint32).reshape(n, m)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, column = batch.column(0), batch.column(1)
        for texts in text_chunks(column):
            words = words_of(texts)
            hashes = word_hashes(texts, words)
            shingles, ptr = shingle_hashes(hashes, words.ptr, SHINGLE)
            sums = []
            for step in (0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93):
                place = np.arange(len(hashes)) - np.repeat(words.ptr[:-1], np.diff(words.ptr))
                terms = mixed(hashes ^ mixed(place.astype(np.uint64) * np.uint64(step) + np.uint64(step)))
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
                sums.append(total[words.ptr[1:]] - total[words.ptr[:-1]])
            sketch = registers(*weighted(shingles, ptr), texts.n)
            n_words = np.diff(words.ptr)
            flat = pa.py_buffer(np.ascontiguousarray(sketch))
            yield pa.RecordBatch.from_arrays([
                ids.slice(texts.first, texts.n), signed(sums[0]), signed(sums[1]), pa.array(n_words),
                pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * REGISTERS), texts.n, [None, flat]).cast(pa.binary())],
                ["doc_id", "k1", "k2", "n_words", "sketch"])


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2 (128 bits that name the word sequence), n_words, sketch (registers as little-endian uint32)."""
    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _sketches, "doc_id long, k1 long, k2 long, n_words long, sketch binary")


def _band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, BANDS, ROWS).astype(np.uint64)
        keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (n, BANDS)).copy()
        for j in range(ROWS):
            keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, j])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), signed(keys.ravel())], ["doc_id", "bucket"])


def profile_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of one text in ascending order, and their counts."""
    for texts in text_chunks(pa.array([text or ""])):
        words = words_of(texts)
        shingles, _ = shingle_hashes(word_hashes(texts, words), words.ptr, SHINGLE)
        return np.unique(shingles, return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two profiles; 0 if either is empty."""
    (ha, ca), (hb, cb) = a, b
    if not len(ha) or not len(hb):
        return 0.0
    shared, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    x, y = ca[ia].astype(float), cb[ib].astype(float)
    only_a, only_b = ca.sum() - x.sum(), cb.sum() - y.sum()
    ratio = y / x
    total = 0.0
    for r in np.unique(ratio):
        of = ratio == r
        total += x[of].sum() / (np.maximum(x, y / r).sum() + only_a + only_b / r)
    return total


def _products(left: list, right: list, value) -> np.ndarray:
    """Sums of value(count) over the keys that two rows share, for all rows of left and right; rows are (keys, counts)."""
    keys = np.concatenate([np.unique(np.concatenate([k for k, _ in side])) for side in (left, right)])
    keys, times = np.unique(keys, return_counts=True)
    keys = keys[times > 1]
    total = np.zeros((len(left), len(right)))
    for first in range(0, len(keys), 4096):
        some = keys[first:first + 4096]
        dense = [np.zeros((len(side), len(some)), np.float32) for side in (left, right)]
        for matrix, side, weigh in ((dense[0], left, value), (dense[1], right, np.ones_like)):
            for i, (k, c) in enumerate(side):
                at = np.searchsorted(some, k)
                at[at == len(some)] = 0
                hit = some[at] == k
                matrix[i, at[hit]] = weigh(c[hit])
        total += dense[0] @ dense[1].T
    return total


def similarities(left: list, right: list) -> np.ndarray:
    """Similarities of all profiles of two blocks; those whose shared shingles have unequal counts come one by one."""
    tagged = [[(h ^ mixed(c.astype(np.uint64)), c) for h, c in side] for side in (left, right)]
    shared, same = _products(left, right, np.ones_like), _products(*tagged, np.ones_like)
    weight = _products(*tagged, lambda c: c)
    sums = [np.array([c.sum() for _, c in side], float) for side in (left, right)]
    out = weight / np.maximum(sums[0][:, None] + sums[1][None, :] - weight, 1)
    for x, y in zip(*np.nonzero(shared != same), strict=True):
        out[x, y] = similarity(left[x], right[y])
    return out


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, of = None, None
    for batch in batches:
        out: tuple[list, list] = ([], [])
        for a, b, text, head in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if known is None or known != (b, head):  # rows come by head
                known, of = (b, head), profile_of(head)
            if similarity(profile_of(text), of) >= THRESHOLD:
                out[0].append(a)
                out[1].append(b)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], ["a", "b"])


def _block_links(pdf):
    """Verified links between the two sides of one comparison task, without those that earlier ones already connect."""
    import pandas as pd

    left, right = pdf[pdf.side == 0], pdf[pdf.side == 1]
    within = not len(right)
    if within:
        right = left
    rows = pd.concat([left, right])
    doc, texts = rows.doc_id.to_numpy(), rows.text.to_list()
    parent: dict[int, int] = {}

    def root(k):
        while parent.setdefault(k, k) != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for d, comp in zip(doc, rows.comp, strict=True):
        parent[root(int(d))] = root(int(comp))
    wide = [np.frombuffer(b"".join(s.sketch), np.uint32).reshape(len(s), REGISTERS) for s in (left, right)]
    equal = np.zeros((len(left), len(right)), np.int16)
    for j in range(REGISTERS):
        equal += wide[0][:, j, None] == wide[1][None, :, j]
    xs, ys = np.nonzero(equal >= PLAUSIBLE * REGISTERS)
    if not len(xs):
        return pd.DataFrame([], columns=["a", "b"])
    some = [np.unique(xs), np.unique(ys)]
    exact = similarities([profile_of(texts[x]) for x in some[0]], [profile_of(texts[len(left) + y]) for y in some[1]])
    exact = exact[np.searchsorted(some[0], xs), np.searchsorted(some[1], ys)]
    found = []
    for k in np.flatnonzero(exact >= THRESHOLD):
        a, b = int(doc[xs[k]]), int(doc[len(left) + ys[k]])
        if root(a) != root(b):
            parent[root(a)] = root(b)
            found.append((a, b))
    return pd.DataFrame(found, columns=["a", "b"])


def _blocks(members: DataFrame) -> DataFrame:
    """(doc_id, family, comp, sketch, block): a family's members by part in blocks of about BLOCK, by counts of
    (family, hash slice) and not by a window over the family; small families are one block."""
    sizes = members.groupBy("family").agg(F.count("*").alias("n"), F.sum("n_words").alias("w"))
    cut = sizes.select("family", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("w") * 8 / BLOCK_BYTES)).cast("int").alias("n_blocks"))
    parts = members.groupBy("family", "comp").agg(F.count("*").alias("size"))
    # parts of a block's size or more get blocks of their own; the rest share blocks by hash
    own = F.when(F.col("size") >= BLOCK, F.col("comp"))
    placed = members.join(cut, "family").join(parts, ["family", "comp"])
    slot = F.pmod(F.xxhash64("doc_id"), F.when(F.col("size") >= BLOCK, F.ceil(F.col("size") / BLOCK)).otherwise(F.col("n_blocks")))
    return placed.select("doc_id", "family", "comp", "sketch", own.alias("own"), slot.cast("int").alias("slot"))


def _across(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links inside families that stand in more than one part: tasks are pairs of blocks."""
    placed = settled(_blocks(members))
    blocks = placed.groupBy("family", "own", "slot").agg(F.count("*").alias("size")).withColumn("block", F.xxhash64("own", "slot"))
    blocks = settled(blocks)
    one, two = blocks.alias("l"), blocks.alias("r")
    same_part = F.coalesce(F.col("l.own") == F.col("r.own"), F.lit(False))
    pairs = one.join(two, (F.col("l.family") == F.col("r.family")) & (F.col("l.block") <= F.col("r.block")) & ~same_part)
    pairs = pairs.select(F.col("l.family").alias("family"), F.col("l.block").alias("lb"), F.col("r.block").alias("rb"),
                         F.xxhash64("l.family", "l.block", "r.block").alias("task"))
    pairs = settled(pairs)
    sides = pairs.select("family", F.col("lb").alias("block"), F.lit(0).alias("side"), "task").unionByName(
        pairs.where("lb <> rb").select("family", F.col("rb").alias("block"), F.lit(1).alias("side"), "task"))
    rows = placed.withColumn("block", F.xxhash64("own", "slot")).join(texts, "doc_id").join(sides, ["family", "block"])
    return rows.select("task", "side", "doc_id", "comp", "sketch", "text").groupBy("task").applyInPandas(_block_links, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), class_size, n_links (verified links that the document's word sequence
    takes part in; those to equal sequences aren't counted): one row per doc_id."""
    flat = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = settled(sketches(docs))
    heads = every.where("n_words > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    member = settled(every.join(heads, ["k1", "k2"]).select("doc_id", "rep", "n_words", "sketch"))
    reps = settled(member.where("doc_id = rep").groupBy("doc_id", "sketch").agg(F.max("n_words").alias("n_words")))
    owners = member.groupBy("doc_id").agg(F.min("rep").alias("rep"), F.max("rep").alias("other"))
    owners = settled(owners)
    buckets = settled(reps.select("doc_id", "sketch").mapInArrow(_band_keys, "doc_id long, bucket long"))
    tops = buckets.groupBy("bucket").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    near = settled(buckets.join(tops, "bucket").where("doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b")).distinct())
    wanted = near.select(F.col("a").alias("doc_id")).unionByName(near.select(F.col("b").alias("doc_id"))).distinct()
    texts = settled(flat.join(wanted.hint("merge"), "doc_id"))
    pairs = near.hint("merge").join(texts.select(F.col("doc_id").alias("a"), "text"), "a").join(
        texts.select(F.col("doc_id").alias("b"), F.col("text").alias("head")).hint("merge"), "b")
    links = settled(pairs.select("a", "b", "text", "head").sortWithinPartitions("b").mapInArrow(_verified, "a long, b long"))
    # texts of one repeated doc_id are one document
    links = links.unionByName(member.join(owners.where("rep <> other").select("doc_id", F.col("rep").alias("b")), "doc_id").where(
        "rep <> b").select(F.col("rep").alias("a"), "b"))
    family, part = components(near), components(links)
    placed = settled(family.select(F.col("node").alias("doc_id"), F.col("comp").alias("family")).join(
        part.select(F.col("node").alias("doc_id"), "comp"), "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id")))
    split = placed.groupBy("family").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("family")
    more = _across(placed.join(split, "family").join(reps, "doc_id"), texts)
    links = settled(links.unionByName(more).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    classes = components(links)
    degree = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(
        F.count("*").alias("n_links"))
    named = owners.drop("other").join(classes.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
    alone = every.select("doc_id").distinct()
    rows = settled(alone.join(named, "doc_id", "left").select(
        "doc_id", F.coalesce("comp", "rep", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")))
    sizes = rows.groupBy("class_id").agg(F.count("*").alias("class_size"))
    return rows.join(sizes, "class_id").select("doc_id", "class_id", "class_size", "n_links")
