"""Removal of byte strings of a minimum length that occur more than once in a corpus.

A byte goes if some string of MIN_BYTES bytes that covers it starts at two places at least, in one text or in two. Strings never
cross texts, and all are judged on the texts as given.

1. Every window of MIN_BYTES bytes has a key that depends on its bytes alone: the smallest hash of its 32-byte grams. A piece is a
   run of consecutive windows of one key, with all their bytes. Equal windows have equal keys, so only pieces of one key
   need to be compared, and a key with one occurrence is done.
2. Equal pieces (key and 64-bit hash) are counted once, by a partial aggregate. If all pieces of a key are equal, all of
   their windows repeat.
3. Otherwise the distinct pieces of a key go to one block with those of other keys. A block's suffixes are sorted, and intervals of
   equal prefixes grow by breadth-first backward extension on the Burrows-Wheeler transform: the queue of round l holds intervals
   of strings of l bytes, each extended by the bytes that stand before it, and a new right end is a common prefix of l. Rounds end
   at MIN_BYTES, so what has no value by then shares at least that many bytes. The extension walks runs of the transform, which
   are few where texts repeat.
4. A key whose distinct pieces hold more than BLOCK_BYTES is cut again by the smallest hash of longer grams, and at last by the
   whole window, where all pieces of a key are equal. So a block is always bounded, and nothing is dropped.

Defined cases: a null or empty text has no bytes and keeps none. Texts under MIN_BYTES bytes lose nothing. Rows that repeat doc_id and
text are occurrences like any other and have the same result each; null ids are allowed. Extra columns are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settled
from .words import BASE, _INVERSE, mixed, powers, text_chunks

MIN_BYTES = 400
#: Lengths of the grams that name a window: the first for all texts, the others where one key holds too much
GRAMS = (32, 200)
BLOCK_BYTES = 2 << 20
#: Windows in one piece at most
PIECE = 2048
PLACE_BITS = 24
RANGES = "array<int>"


def grams(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte strings, by doubling: hash of 2s bytes from those of s bytes; k by its binary digits."""
    whole = (1 << 64) - 1
    power, step = data.astype(np.uint64) + np.uint64(1), 1
    done, length = None, 0
    while True:
        if k & step:
            if done is None:
                done, length = power, step
            else:
                n = len(data) - length - step + 1
                done = done[:n] * np.uint64(pow(BASE, step, 1 << 64)) + power[length:length + n]
                length += step
        if 2 * step > k:
            return mixed(done)
        n = len(power) - step
        power = power[:n] * np.uint64(pow(BASE, step, 1 << 64) & whole) + power[step:step + n]
        step *= 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of values[i : i + width] for every i, from minima of blocks run forwards and backwards."""
    n = len(values)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def pieces(data: np.ndarray, offsets: np.ndarray, k: int, size: int = MIN_BYTES):
    """Pieces of all rows: key, hash of the bytes, row, first window in the row, number of windows, whether the gram that gives the
    key moves inside the piece, without which no window of the piece equals another of it."""
    lengths = np.diff(offsets)
    n = len(data)
    if not n or lengths.max() < size:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none, none.astype(bool)
    hashes = grams(data, k)
    # the place, in as many low bits for every text, decides between equal hashes: the first counts
    mask = (1 << PLACE_BITS) - 1
    low = np.arange(len(hashes)) & mask
    least = sliding_min((hashes & ~np.uint64(mask)) | low.astype(np.uint64), size - k + 1)
    at = np.arange(len(least))
    place = at + (((least & np.uint64(mask)).astype(np.int64) - at) & mask)
    least = hashes[place]
    valid = np.zeros(n + 1, np.int8)
    long = lengths >= size
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, offsets[1:][long] - size + 1, -1)
    at = np.flatnonzero(np.cumsum(valid[:n]))
    key = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    inside = np.arange(len(at)) - np.repeat(first, np.diff(np.concatenate([first, [len(at)]])))
    first = np.flatnonzero(inside % PIECE == 0)
    moves = np.zeros(len(at), np.int64)
    moves[1:] = place[at[1:]] != place[at[:-1]]
    moves[first] = 0
    twice = np.add.reduceat(moves, first) > 0
    count = np.diff(np.concatenate([first, [len(at)]]))
    start = at[first]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(n), out=sums[1:])
    end = start + count + size - 1
    text = mixed((sums[end] - sums[start]) * powers(n + 1, _INVERSE)[start] + count.astype(np.uint64))
    row = np.searchsorted(offsets, start, "right") - 1
    return key[first], text, row, start - offsets[row], count, twice


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, by prefix doubling; 0 ends a text, and ends differ by their place."""
    n = len(symbols)
    ends = np.flatnonzero(symbols == 0)
    until = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    packed = np.zeros(n, np.int64)
    width = 7
    for j in range(width):
        part = np.zeros(n, np.int64)
        part[:max(0, n - j)] = symbols[j:]
        part[until < j] = 0
        packed = (packed << 9) | part
    order = np.argsort(packed, kind="stable")
    head = np.ones(n, bool)
    head[1:] = (packed[order[1:]] != packed[order[:-1]]) | (until[order[1:]] < width)
    del packed
    rank = np.empty(n, np.int64)
    while True:
        at = np.flatnonzero(head)
        group = np.repeat(at, np.diff(np.concatenate([at, [n]])))
        rank[order] = group
        alone = head.copy()
        alone[:-1] &= head[1:]
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            return order
        some = order[open_]
        key = (group[open_] << 32) | rank[some + width]
        by = np.argsort(key)
        order[open_] = some[by]
        key = key[by]
        head[open_[1:]] |= key[1:] != key[:-1]
        width *= 2


def shared_prefixes(symbols: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Common prefix of every suffix with the one before it, up to `least`: values of `least` stand for that or more."""
    n, k = len(symbols), int(np.count_nonzero(symbols == 0))
    before = symbols[order - 1]
    by = np.argsort(before.astype(np.uint16), kind="stable")
    jump = np.empty(n, np.int64)  # from a suffix to the one that is longer by the byte before
    jump[by] = np.arange(n)
    fresh = np.ones(n, bool)
    fresh[1:] = before[1:] != before[:-1]
    run_start = np.flatnonzero(fresh)
    run = np.cumsum(fresh) - 1
    run_end = np.concatenate([run_start[1:], [n]]) - 1
    run_byte = before[run_start].astype(np.int64)
    common = np.full(n + 1, least, np.int32)
    common[0] = common[n] = -1
    # strings of one byte; each end of a text is a string of its own
    firsts = symbols[order]
    edge = np.flatnonzero((firsts[1:] != firsts[:-1]) | (firsts[1:] == 0)) + 1
    common[edge] = 0
    lo = np.concatenate([[0], edge])
    hi = np.concatenate([edge, [n]]) - 1
    for length in range(1, least):
        spread = run[hi] - run[lo] + 1
        if not len(spread):
            break
        of = np.repeat(np.arange(len(lo)), spread)
        r = run[lo][of] + np.arange(len(of)) - np.repeat(np.cumsum(spread) - spread, spread)
        byte = run_byte[r]
        text = byte > 0
        of, r, byte = of[text], r[text], byte[text]
        left, right = jump[np.maximum(run_start[r], lo[of])], jump[np.minimum(run_end[r], hi[of])]
        key = of * 512 + byte
        place = np.argsort(key, kind="stable")
        key = key[place]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        last = np.ones(len(key), bool)
        last[:-1] = new[1:]
        lo, hi = left[place[new]], right[place[last]]
        unset = common[hi + 1] == least
        lo, hi = lo[unset], hi[unset]
        common[hi + 1] = length
    return common[:n]


def repeated_windows(texts: list[np.ndarray], times: np.ndarray, size: int = MIN_BYTES) -> list[np.ndarray]:
    """For each text, which windows of `size` bytes occur twice or more; text i stands for times[i] equal ones."""
    lengths = np.array([len(t) for t in texts])
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    symbols = np.zeros(starts[-1], np.int64)
    for t, s in zip(texts, starts, strict=False):
        symbols[s:s + len(t)] = t
        symbols[s:s + len(t)] += 1
    order = suffix_order(symbols)
    common = shared_prefixes(symbols, order, size)
    head = np.flatnonzero(common < size)
    owner = np.repeat(np.arange(len(texts)), lengths + 1)
    weight = np.add.reduceat(np.asarray(times)[owner[order]], head)
    flag = np.empty(len(symbols), bool)
    flag[order] = np.repeat(weight >= 2, np.diff(np.concatenate([head, [len(order)]])))
    return [flag[s:s + max(0, n - size + 1)] for s, n in zip(starts, lengths, strict=False)]


def flat_ranges(flags: np.ndarray) -> np.ndarray:
    """[first, end, first, end, ...] of the runs of True."""
    return np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))).astype(np.int32)


def _cut(k: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_chunks(batch.column(2)):
                key, text, row, start, count, twice = pieces(texts.data, texts.offsets, k)
                rows = pa.array(row + texts.first)
                yield pa.RecordBatch.from_arrays([
                    pa.array(key.view(np.int64)), pa.array(text.view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows),
                    pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), batch.column(3).take(rows),
                    pa.array(twice)], ["key", "piece", "id", "id2", "start", "n", "times", "twice"])
    return cut


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted pieces of each text."""
    for batch in batches:
        data, wanted = batch.column(0), batch.column(1)
        for i in range(batch.num_rows):
            raw = data[i].as_py()
            raw = raw.encode() if isinstance(raw, str) else raw
            of = wanted[i].values.flatten()
            out = [raw[s:s + n + MIN_BYTES - 1] for s, n in zip(of[0].to_pylist(), of[1].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([of[2], of[3], of[4], pa.array(out, pa.binary())], ["key", "piece", "times", "data"])


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeating windows of pieces that come sorted by key: whole keys are gathered to blocks of bounded size."""
    held: list[tuple] = []
    size = 0

    def out():
        found = repeated_windows([np.frombuffer(h[3], np.uint8) for h in held], np.array([h[2] for h in held]))
        return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.int64()),
                                           pa.array([flat_ranges(f) for f in found], pa.list_(pa.int32()))], ["key", "piece", "ranges"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and size >= BLOCK_BYTES // 4 and row[0] != held[-1][0]:
                yield out()
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield out()


def _repeating(rows: DataFrame, level: int = 0) -> DataFrame:
    """(id, id2, found) of the rows (id, id2, data, times) that have repeating windows: found lists the runs of them,
    each of them as (first, end) window."""
    last = level == len(GRAMS)
    k = MIN_BYTES if last else GRAMS[level]
    # null ids are told apart by id2
    every = settled(rows.mapInArrow(_cut(k), "key long, piece long, id long, id2 long, start int, n int, times long, twice boolean"))
    by_piece = settled(every.groupBy("key", "piece").agg(
        F.sum("times").alias("times"), F.max("twice").alias("twice"), F.min(F.struct("id2", "id", "start", "n")).alias("at")))
    windows = F.col("times") * F.col("at.n") if last else F.col("times") * F.when(F.col("twice"), 2).otherwise(1)
    by_key = settled(by_piece.groupBy("key").agg(
        F.count("*").alias("pieces"), F.sum(windows).alias("windows"), F.sum("times").alias("total"),
        F.sum(F.col("at.n") + F.lit(MIN_BYTES)).alias("bytes")).where("windows > 1"))
    # of whole windows, all of one key are equal; of shorter grams, those of a key with one piece that stands at two places
    equal = by_key if last else by_key.where("pieces = 1 AND total > 1")
    whole = by_piece.join(equal.select("key"), "key").select("key", "piece", F.array(F.lit(0), F.col("at.n")).alias("ranges"))
    found = whole
    if not last:
        apart = by_piece.join(by_key.where("pieces > 1 OR total = 1").select("key", (F.col("bytes") > BLOCK_BYTES).alias("hot")), "key")
        wanted = apart.groupBy(F.col("at.id").alias("wid"), F.col("at.id2").alias("wid2")).agg(
            F.collect_list(F.struct("at.start", "at.n", "key", "piece", "times", "hot")).alias("wanted"))
        joined = rows.join(wanted, F.col("id").eqNullSafe(F.col("wid")) & (F.col("id2") == F.col("wid2")))

        def of(hot: bool) -> DataFrame:
            here = F.filter("wanted", lambda w: w["hot"] == hot)
            return joined.select("data", here.alias("wanted")).where("size(wanted) > 0").mapInArrow(
                _slices, "key long, piece long, times long, data binary")

        found = found.unionByName(of(False).repartition("key").sortWithinPartitions("key").mapInArrow(
            _judged, f"key long, piece long, ranges {RANGES}"))
        if not by_key.where("pieces > 1 OR total = 1").where(F.col("bytes") > BLOCK_BYTES).isEmpty():
            again = settled(of(True).select(F.col("key").alias("id"), F.col("piece").alias("id2"), "data", "times"))
            deeper = _repeating(again, level + 1)
            found = found.unionByName(deeper.select(F.col("id").alias("key"), F.col("id2").alias("piece"), F.flatten("found").alias("ranges")))
    found = settled(found.where("size(ranges) > 0"))
    at = F.transform("ranges", lambda r: r + F.col("start"))
    return every.join(found, ["key", "piece"]).select("id", "id2", at.alias("ranges")).groupBy("id", "id2").agg(
        F.collect_list("ranges").alias("found"))


def removed_spans(found: list[list[int]] | None, size: int = MIN_BYTES) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the windows cover, in order."""
    out: list[list[int]] = []
    for first, end in sorted((r[i], r[i + 1] - 1 + size) for r in found or () for i in range(0, len(r), 2)):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return [(a, b) for a, b in out]


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, found = batch.columns
        spans, kept, sizes = [], [], []
        for text, runs in zip(texts, found.to_pylist(), strict=True):
            raw = text.as_buffer() if text.is_valid else b""
            cut = removed_spans(runs)
            digest, at, view = hashlib.sha256(), 0, memoryview(raw) if raw is not None else memoryview(b"")
            for a, b in cut:
                digest.update(view[at:a])
                at = b
            digest.update(view[at:])
            spans.append([{"first": a, "end": b} for a, b in cut])
            kept.append(digest.hexdigest())
            sizes.append(len(view))
        yield pa.RecordBatch.from_arrays([
            ids, pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))),
            pa.array(kept, pa.string())], ["doc_id", "n_bytes", "spans", "kept_sha256"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (array of first, end: the maximal runs of bytes to remove), kept_sha256 (of the other bytes); a
    row per document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("data"))
    rows = rows.select("id", F.xxhash64("id", "data").alias("id2"), F.col("data").cast("binary").alias("data"), F.lit(1).cast("long").alias("times"))
    found = _repeating(rows).select(F.col("id").alias("fid"), F.col("id2").alias("fid2"), "found")
    joined = rows.join(found, F.col("id").eqNullSafe(F.col("fid")) & (F.col("id2") == F.col("fid2")), "left")
    return joined.select("id", "data", "found").mapInArrow(
        _removed, "doc_id long, n_bytes long, spans array<struct<first:int,end:int>>, kept_sha256 string")


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """The digest of `repeated_spans`: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["first"])
    return repeated_spans(docs).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
