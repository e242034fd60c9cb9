"""Documents that hold passages of benchmark items, in any order, by greedy string tiling.

Words are lower-cased runs of anything but space and ASCII punctuation.

1. Seeds: every MIN_MATCH words of the items, hashed. A document and an item that share a seed are joined. A benchmark of at most
   BENCHMARK_CHARS characters (counted first) is sent to all tasks and joined there; a larger one is joined by a shuffle of the
   seeds that documents and items share, with the pair's texts joined after.
2. Of such a pair, Karp-Rabin hashes of MIN_MATCH words give the equal places; runs of them on one diagonal are the maximal matches.
   The longest match goes first: its words are marked in both texts. A match that meets marked words is cut to its unmarked parts of
   MIN_MATCH words at least, which wait for their turn by length. So no word is used twice, and moved passages count.
   Matches of equal length go by the item's place, then by the document's.
3. A pair is a leak if its tiles cover COVERAGE of the item's words.

Defined cases: null and empty texts match nothing. Items of fewer than MIN_MATCH words are no passages and match nothing. Rows that repeat
an id are documents or items of their own; equal results are reported once each. Null ids are kept. Extra columns are ignored. An empty
documents or benchmark table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settled
from .words import SEPARATOR, shingle_hashes, text_chunks, word_hashes, words_of

MIN_MATCH, COVERAGE = 5, 0.5
#: Largest benchmark that is sent to every task; its words take about two bytes of memory for each character
BENCHMARK_CHARS = 16 << 20
LEAK = "doc_id long, item_id long, item_words long, covered long, tiles long, coverage double"


def tokens(texts) -> tuple[np.ndarray, np.ndarray]:
    words = words_of(texts, SEPARATOR)
    return word_hashes(texts, words, lower=True), words.ptr


def _grams(words: np.ndarray) -> np.ndarray:
    if len(words) < MIN_MATCH:
        return np.zeros(0, np.uint64)
    return shingle_hashes(words, np.array([0, len(words)]), MIN_MATCH)[0]


def tiling(doc: np.ndarray, item: np.ndarray, doc_grams: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(place in doc, place in item, words) of the tiles, in the order in which they were marked."""
    a, b = _grams(doc) if doc_grams is None else doc_grams, _grams(item)
    if not len(a) or not len(b):
        return []
    order = np.argsort(b, kind="stable")
    ranked = b[order]
    lo, hi = np.searchsorted(ranked, a, "left"), np.searchsorted(ranked, a, "right")
    times = hi - lo
    i = np.repeat(np.arange(len(a)), times)
    j = order[np.repeat(lo, times) + np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)]
    by = np.lexsort((i, j - i))
    i, j = i[by], j[by]
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1)
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate([first, [len(i)]])) + MIN_MATCH - 1
    waiting = [(-int(n), int(y), int(x)) for n, y, x in zip(size, j[first], i[first], strict=True)]
    heapq.heapify(waiting)
    used_doc, used_item, out = np.zeros(len(doc), bool), np.zeros(len(item), bool), []
    while waiting:
        n, y, x = heapq.heappop(waiting)
        used = used_doc[x:x - n] | used_item[y:y - n]
        if not used.any():
            used_doc[x:x - n] = used_item[y:y - n] = True
            out.append((x, y, -n))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[1], used.astype(np.int8), [1]])))
        for s, e in zip(edge[::2], edge[1::2], strict=True):
            if e - s >= MIN_MATCH:
                heapq.heappush(waiting, (int(s - e), int(y + s), int(x + s)))
    return out


def _leak(doc, item, grams=None):
    """Words of item that tiles cover and their number, or None if it's no leak. The words that any shared seed covers bound
    what tiles can, so most pairs end there."""
    most = np.zeros(len(item) + 1, np.int64)
    seeds = np.flatnonzero(np.isin(_grams(item), _grams(doc) if grams is None else grams))
    np.add.at(most, seeds, 1)
    np.add.at(most, seeds + MIN_MATCH, -1)
    if np.count_nonzero(np.cumsum(most[:-1])) < COVERAGE * len(item):
        return None
    found = tiling(doc, item, grams)
    covered = sum(n for _, _, n in found)
    return (covered, len(found)) if covered >= COVERAGE * len(item) else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.float64()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                      ["doc_id", "item_id", "item_words", "covered", "tiles", "coverage"])


def item_words(texts: pa.Array) -> list[np.ndarray]:
    out = []
    for some in text_chunks(texts):
        hashes, ptr = tokens(some)
        out += [hashes[ptr[k]:ptr[k + 1]] for k in range(some.n)]
    return out


def _against(ids: list, words: list[np.ndarray]):
    """Leaks of a batch of documents against a benchmark in memory."""
    grams = [np.unique(_grams(w)) for w in words]
    seeds = np.concatenate([*grams, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(words)), [len(g) for g in grams])
    order = np.argsort(seeds, kind="stable")
    seeds, owner = seeds[order], owner[order]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a quick first test: does any seed share the low bits
        bits = 22
        marked = np.zeros(1 << bits, bool)
        marked[(seeds & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
        for batch in batches:
            docs = batch.column(0)
            for texts in text_chunks(batch.column(1)):
                hashes, ptr = tokens(texts)
                all_grams, gram_ptr = shingle_hashes(hashes, ptr, MIN_MATCH)
                maybe = np.flatnonzero(marked[(all_grams & np.uint64((1 << bits) - 1)).astype(np.int64)])
                if not len(maybe) or not len(seeds):
                    continue
                maybe = maybe[seeds[np.minimum(np.searchsorted(seeds, all_grams[maybe]), len(seeds) - 1)] == all_grams[maybe]]
                out = []
                row_of = np.searchsorted(gram_ptr, maybe, "right") - 1
                for row in np.unique(row_of):
                    doc, g = hashes[ptr[row]:ptr[row + 1]], all_grams[gram_ptr[row]:gram_ptr[row + 1]]
                    if len(doc) < MIN_MATCH:
                        continue
                    hit = np.unique(all_grams[maybe[row_of == row]])
                    lo, hi = np.searchsorted(seeds, hit, "left"), np.searchsorted(seeds, hit, "right")
                    for k in np.unique(np.concatenate([owner[s:e] for s, e in zip(lo, hi, strict=True)])):
                        if leak := _leak(doc, words[k], g):
                            out.append((docs[texts.first + int(row)].as_py(), ids[k], len(words[k]), *leak, leak[0] / len(words[k])))
                if out:
                    yield _batch(out)
    return find


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in text_chunks(batch.column(1)):
            hashes, ptr = tokens(texts)
            all_grams, gram_ptr = shingle_hashes(hashes, ptr, MIN_MATCH)
            counts = np.where(np.diff(ptr) >= MIN_MATCH, np.diff(gram_ptr), 0)
            rows = np.repeat(np.arange(texts.n), np.diff(gram_ptr))
            keep = counts[rows] > 0
            yield pa.RecordBatch.from_arrays([pa.array(all_grams[keep].view(np.int64)), batch.column(0).take(pa.array(rows[keep] + texts.first))],
                                             ["seed", "key"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        ids, items = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for k, (doc, item) in enumerate(zip(item_words(batch.column(2)), item_words(batch.column(3)), strict=True)):
            if leak := _leak(doc, item):
                out.append((ids[k], items[k], len(item), *leak, leak[0] / len(item)))
        yield _batch(out)


def _by_shuffle(docs: DataFrame, items: DataFrame) -> DataFrame:
    docs = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    items = items.withColumn("key", F.xxhash64("item_id", "text"))
    seed = "seed long, key long"
    mine = docs.select("key", "text").mapInArrow(_seeds, seed).distinct()
    theirs = items.select("key", "text").mapInArrow(_seeds, seed).distinct().withColumnRenamed("key", "item_key")
    pairs = settled(mine.join(theirs, "seed").select("key", "item_key").distinct())
    full = pairs.join(docs, "key").join(items.select(F.col("key").alias("item_key"), "item_id", F.col("text").alias("item")), "item_key")
    return full.select("doc_id", "item_id", "text", "item").mapInArrow(_pairs, LEAK)


def leaks(docs: DataFrame, benchmark: DataFrame, limit: int = BENCHMARK_CHARS) -> DataFrame:
    """doc_id, item_id, item_words, covered (words of the item in tiles), tiles, coverage: one row for each document and item of which
    at least COVERAGE is in the document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chars = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    if chars > limit:
        return _by_shuffle(docs, items).distinct()
    rows = items.collect()  # at most `limit` bytes
    words = item_words(pa.array([r.text for r in rows], pa.string())) if rows else []
    return docs.mapInArrow(_against([r.item_id for r in rows], words), LEAK).distinct()
