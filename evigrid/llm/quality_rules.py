"""Quality rules by statistics, and an isolation forest over them.

1. Statistics of every whole text: words, code points in words, symbols, repeated lines, words in repeated three-word windows. Two
   of them decide at once: base_failed.
2. The forest is fitted on at most SAMPLE labelled documents, those of the smallest md5 of the id. It has a part for each of GROUPS, which
   together hold all RATIOS, so that a document that is odd in one statistic isn't made usual by the others: TREES trees, each over FOREST
   documents, with random splits until a document is alone or the depth is the logarithm of FOREST. A part's score is 2 to the power of
   minus the mean path length over the expected one, so what is split off early is near 1. A part's level is the score that all but LOST of
   the labelled documents of good quality stay at or under. The score of a document is that of the part where it is furthest over the
   level, moved and halved so that 0.5 is at the level. A statistic that is the same in all of the sample can't be split.
3. Every document is scored. The threshold is the score that all but LOST of the labelled documents of good quality stay at or under,
   taken exactly over all labels, or a lower one (in thousandths) if it judges fewer labelled documents of either quality wrongly; a
   document over it is an anomaly and isn't kept. Labels of documents that fail the base rules don't count.

Words are runs of anything but space and \\t \\n \\v \\f \\r. Defined cases: a null or empty text has no words and fails the base rules.
Rows that repeat a doc_id are scored each. Null ids are kept. Without labels that match, or of good quality, there is no threshold and the base
rules decide. Labels with a null are left out. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settled
from .words import BASE, _INVERSE, mixed, powers, shingle_hashes, text_chunks, word_hashes, words_of

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEATED = 50, 50
SAMPLE, TREES, FOREST = 4096, 128, 256
LOST = 0.002
SEED = 29
#: Cells into which a round of `quantiles` cuts a range
BINS = 1024
#: What the forest sees, from the statistics: per word or line, so that length alone is no anomaly
GROUPS = (("symbols", "marks", "capitals"), ("word_length",), ("dup_lines",), ("repeats",), ("digits",))
RATIOS = ("symbols", "marks", "capitals", "word_length", "dup_lines", "repeats", "digits")
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, " + ", ".join(f"{f} double" for f in RATIOS)


def _table(bytes_: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(bytes_)] = True
    return out


_SYMBOL, _CAPITAL, _DIGIT = _table(SYMBOLS), _table(bytes(range(65, 91))), _table(b"0123456789")
_MARK = _table(bytes(b for b in range(33, 127) if not chr(b).isalnum()))


def statistics(texts) -> dict[str, np.ndarray]:
    """The columns of STATS for the rows of a chunk."""
    data, offsets, n = texts.data, texts.offsets, len(texts.data)

    def per_row(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    words = words_of(texts)
    n_words = np.diff(words.ptr)
    first = (data & 0xC0) != 0x80
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    # lines: a break after each \n and at the end of each text
    breaks = np.flatnonzero(data == 10)
    row = np.concatenate([np.searchsorted(offsets, breaks, "right") - 1, np.arange(texts.n)])
    order = np.argsort(np.concatenate([2 * breaks, 2 * offsets[1:] - 1]), kind="stable")
    at = np.concatenate([breaks, offsets[1:]])[order]
    row = row[order]
    begin = np.empty(len(at), np.int64)
    begin[0:1] = 0
    begin[1:] = at[:-1]
    after = np.concatenate([np.ones(len(breaks), np.int64), np.zeros(texts.n, np.int64)])[order]
    begin[1:] += after[:-1]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(n), dtype=np.uint64)])
    solid = np.concatenate([[0], np.cumsum(~blank, dtype=np.int64)])
    spoken = solid[at] > solid[begin]
    key = mixed((sums[at] - sums[begin]) * powers(n + 1, _INVERSE)[begin] + (at - begin).astype(np.uint64))
    key = key[spoken] ^ mixed(row[spoken].astype(np.uint64) + np.uint64(1))
    one = np.unique(key, return_index=True)[1]
    n_lines = np.bincount(row, minlength=texts.n)
    spoken_rows = row[spoken]
    dup = np.bincount(spoken_rows, minlength=texts.n) - np.bincount(spoken_rows[one], minlength=texts.n)
    # three-word windows
    triples, ptr = shingle_hashes(word_hashes(texts, words), words.ptr, 3)
    owner = np.repeat(np.arange(texts.n), np.diff(ptr))
    full = n_words[owner] >= 3
    place = (np.arange(len(triples)) - ptr[owner] + words.ptr[owner])[full]
    tagged = triples[full] ^ mixed(owner[full].astype(np.uint64) + np.uint64(1))
    _, inverse, times = np.unique(tagged, return_inverse=True, return_counts=True)
    again = place[times[inverse] > 1]
    covered = np.zeros(len(words.start), bool)
    for j in range(3):
        covered[again + j] = True
    total = np.concatenate([[0], np.cumsum(covered, dtype=np.int64)])
    repeats = total[words.ptr[1:]] - total[words.ptr[:-1]]
    chars, symbols = per_row(first & ~blank), per_row(_SYMBOL[data])
    some, letters = np.maximum(n_words, 1), np.maximum(chars, 1)
    return {
        "n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeats, "n_lines": n_lines,
        "word_length": chars / some, "symbols": symbols / some, "dup_lines": dup / np.maximum(n_lines, 1), "repeats": repeats / some,
        "capitals": per_row(_CAPITAL[data]) / letters, "marks": per_row(_MARK[data]) / some, "digits": per_row(_DIGIT[data]) / letters}


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in STATS.split(", ")]
    kinds = [pa.float64() if c in RATIOS else pa.int64() for c in names]
    for batch in batches:
        for texts in text_chunks(batch.column(1)):
            found = statistics(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.first, texts.n), *[
                pa.array(found[c], k) for c, k in zip(names, kinds, strict=True)]], ["doc_id", *names])


def text_statistics(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_stats, f"doc_id long, {STATS}")


def _expected(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow_forest(x: np.ndarray, seed: int = SEED) -> tuple:
    """Trees as flat arrays (feature, cut, left child, path length at a leaf), the right child being next to the left one; -1: leaf."""
    rng = np.random.default_rng(seed)
    size = min(FOREST, len(x))
    depth = int(np.ceil(np.log2(max(size, 2))))
    feature, cut, child, path, roots = [], [], [], [], []

    def node() -> int:
        for column, value in ((feature, -1), (cut, 0.0), (child, 0), (path, 0.0)):
            column.append(value)
        return len(feature) - 1

    for _ in range(TREES):
        roots.append(node())
        todo = [(roots[-1], x[rng.choice(len(x), size, replace=False)], 0)]
        while todo:
            k, some, level = todo.pop()
            low, high = some.min(0), some.max(0)
            wide = np.flatnonzero(high > low)
            if level >= depth or len(some) <= 1 or not len(wide):
                path[k] = level + float(_expected(len(some)))
                continue
            f = int(rng.choice(wide))
            at = rng.uniform(low[f], high[f])
            feature[k], cut[k] = f, at
            child[k] = node()
            node()
            less = some[:, f] < at
            todo += [(child[k], some[less], level + 1), (child[k] + 1, some[~less], level + 1)]
    return (np.array(roots), np.array(feature), np.array(cut), np.array(child), np.array(path), float(_expected(size)))


def forest_scores(forest: tuple, x: np.ndarray) -> np.ndarray:
    roots, feature, cut, child, path, expected = forest
    total = np.zeros(len(x))
    for root in roots:
        at = np.full(len(x), root)
        while True:
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                break
            k = at[inner]
            at[inner] = child[k] + (x[inner, feature[k]] >= cut[k])
        total += path[at]
    return 2.0 ** (-total / len(roots) / max(expected, 1e-9))


def _part_scores(forests: list[tuple], batch: pa.RecordBatch) -> list[np.ndarray]:
    return [forest_scores(forest, np.column_stack([batch.column(f).to_numpy() for f in group])) if batch.num_rows else np.zeros(0)
            for forest, group in zip(forests, GROUPS, strict=True)]


def _parts(forests: list[tuple]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, _part_scores(forests, batch))],
                                             [*batch.schema.names, *[f"part{i}" for i in range(len(GROUPS))]])
    return score


def _scorer(forests: list[tuple], levels: list[float]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            over = [part - level for part, level in zip(_part_scores(forests, batch), levels, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(0.5 + np.max(over, axis=0) / 2)], [*batch.schema.names, "score"])
    return score


def quantiles(rows: DataFrame, columns: list[str], at: float) -> list[float] | None:
    """Exact quantiles of finite columns, between neighbours in proportion; None without rows.

    The range that holds a wanted rank is cut into BINS, and the bin with the rank is the next range, down to the least and the largest value in
    it, until these are one. So no task holds the values of a column; a round counts in the tasks and sends at most BINS counts for
    each of two ranks of a column, and a double is reached in a few rounds.
    """
    first = rows.agg(F.count("*"), *[f(c) for c in columns for f in (F.min, F.max)]).first()
    if not first[0]:
        return None
    place = at * (first[0] - 1)
    low_rank, high_rank = math.floor(place), math.ceil(place)
    found = {(c, rank): (first[1 + 2 * i], first[2 + 2 * i], rank) for i, c in enumerate(columns) for rank in (low_rank, high_rank)}
    while wanted := [k for k, (low, high, _) in found.items() if low < high]:
        tests = []
        for j, k in enumerate(wanted):
            low, high, _ = found[k]
            value = F.col(k[0])
            cell = F.least(F.lit(BINS - 1), F.floor((value - F.lit(low)) / F.lit(high - low) * BINS).cast("int"))
            tests.append(F.when(value.between(low, high), F.struct(F.lit(j).alias("j"), cell.alias("cell"), value.alias("value"))))
        counts = rows.select(F.inline(F.array_compact(F.array(*tests)))).groupBy("j", "cell").agg(F.count("*"), F.min("value"), F.max("value")).collect()
        done = set()
        for j, _, n, low, high in sorted(map(tuple, counts)):
            rank = found[wanted[j]][2]
            if j not in done and rank < n:
                done.add(j)
                found[wanted[j]] = low, high, rank
            elif j not in done:
                found[wanted[j]] = *found[wanted[j]][:2], rank - n
    values = [(found[c, low_rank][0], found[c, high_rank][0]) for c in columns]
    return [a if a == b else (high_rank - place) * a + (place - low_rank) * b for a, b in values]


def _calibrated(parts: DataFrame) -> tuple[list[float], float | None]:
    """The level of each part and the threshold, from (quality, part0 ...) of labelled documents that pass the base rules."""
    good = F.col("quality") == 1
    levels = quantiles(parts.where(good), [f"part{i}" for i in range(len(GROUPS))], 1 - LOST)
    if levels is None:
        return [0.5] * len(GROUPS), None
    scored = parts.select("quality", (F.lit(0.5) + F.greatest(*[F.col(f"part{i}") - F.lit(v) for i, v in enumerate(levels)]) / 2).alias("score"))
    threshold, = quantiles(scored.where(good), ["score"], 1 - LOST)
    fine = F.ceil(F.col("score") * 1000)
    rows = scored.groupBy(fine.alias("k")).agg(
        F.count_if(good), F.count_if(~good), F.count_if(good & (F.col("score") > F.lit(threshold))), F.count_if(~good & (F.col("score") <= F.lit(threshold)))).collect()
    k, goods, bads, lost, missed = np.array(sorted(map(tuple, rows)), np.int64).T
    wrong = goods.sum() - np.cumsum(goods) + np.cumsum(bads)
    wrong[k >= threshold * 1000] = len(k) + goods.sum() + bads.sum()
    best = len(k) - 1 - int(np.argmin(wrong[::-1]))
    return levels, float(k[best]) / 1000 if wrong[best] < lost.sum() + missed.sum() else threshold


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed, score (0 without a forest), kept: one row per row of docs."""
    stats = settled(text_statistics(docs))
    good = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min("quality").alias("quality"))
    known = settled(stats.join(good, "doc_id"))
    base = (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEATED) * F.col("n_words"))
    sample = known.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), *RATIOS).limit(SAMPLE).select(*RATIOS).toPandas()
    threshold = None
    if len(sample):
        forests = [grow_forest(sample[list(group)].to_numpy(float)) for group in GROUPS]
        shape = f"doc_id long, {STATS}"
        parts = known.where(~base).select(*stats.columns, F.col("quality").cast("long").alias("quality")).mapInArrow(
            _parts(forests), ", ".join([shape, "quality long", *[f"part{i} double" for i in range(len(GROUPS))]]))
        levels, threshold = _calibrated(settled(parts.drop(*stats.columns)))
        stats = stats.mapInArrow(_scorer(forests, levels), f"{shape}, score double")
    else:
        stats = stats.withColumn("score", F.lit(0.0))
    anomaly = F.col("score") > F.lit(threshold) if threshold is not None else F.lit(False)
    return stats.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & ~anomaly)
