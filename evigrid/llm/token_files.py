"""Documents as token ids in flat binary files, and their way back.

Format: a folder with, for each part, three files of little-endian numbers without headers: <part>.ids, token ids as unsigned 16-bit integers
if the vocabulary allows it and else 32-bit; <part>.off, n + 1 offsets into the ids as signed 64-bit integers; <part>.doc, n document ids as
signed 64-bit integers. The manifest, a table, has for each part its file, order, documents, documents without id (they come first), ids, and
`base`, the ids of all parts before it: the prefix sum that makes offsets global. Files are read through memory maps.

1. Documents are range-partitioned by doc_id and sorted in the partitions, so parts are in ascending order of doc_id.
2. A task writes its part under a name of its own and hands back one manifest row, so a task that runs again or twice leaves a file that no
   manifest names. The folder is below the shared folder of the cluster; as files are mapped, it must be mounted, and other
   schemes than a path or file: are refused. Files are read back by as many tasks as there are files.
3. Encoding: byte-level BPE never joins across a single space or line end between two other characters, so a text is cut there; each distinct
   piece is encoded once by the tokenizers library and remembered, in two generations of bounded size, the older of which is dropped.
   New pieces are encoded together, and the numbers of bytes of their tokens tell where each one ends.

Defined cases: a null or empty text is the end id alone. Rows that repeat a doc_id are documents of their own, in the order of their
texts. Documents without id come first. Extra columns are ignored. An empty table gives an empty folder and result.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigrid.session import shared_folder

from .shared import settled
from .words import _INVERSE, Texts, mixed, powers, text_chunks

END_ID = 0
#: Pieces in each of the two generations that a worker remembers: about 220 bytes each
REMEMBERED = 700_000
#: Bytes of new pieces that are encoded as one text
CALL_BYTES = 1 << 10
_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), *range(28, 33)]] = True
_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_encoders: dict[str, "Encoder"] = {}

MANIFEST = "part int, file string, n_docs long, n_null long, n_ids long, width int"


def tokenizer_path() -> str:
    import public_tokenizers
    return str(public_tokenizers.path("byte_bpe_50k.json"))


class Encoder:
    """Ids of whole texts, with a memory of pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = 2 if max(vocabulary.values(), default=0) < 1 << 16 else 4
        self.kind = np.uint16 if self.width == 2 else np.uint32
        # a token of byte-level BPE has a character for each of its bytes
        self.bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes[i] = len(token)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.mark = {ord(c): self.plain(c) for c in ".,"}

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def whole_rows(self, texts: Texts) -> np.ndarray:
        """Which rows must be encoded whole: those with special tokens, or with space beside space or at an end."""
        data, offsets = texts.data, texts.offsets
        n = len(data)
        out = np.zeros(texts.n, bool)
        if not n:
            return out
        space = _SPACE[data]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        at = np.flatnonzero(space)
        at = at[first[at] | first[at + 1] | space[np.minimum(at + 1, n - 1)]]
        lead = np.flatnonzero(_LEAD[data])
        two, three = data[np.minimum(lead + 1, n - 1)], data[np.minimum(lead + 2, n - 1)]
        wide = ((data[lead] == 0xC2) & ((two == 0x85) | (two == 0xA0)) | (data[lead] == 0xE1) & (two == 0x9A) | (data[lead] == 0xE3) & (two == 0x80) & (three == 0x80)
                | (data[lead] == 0xE2) & ((two == 0x81) | (two == 0x80) & ((three <= 0x8A) | (three == 0xA8) | (three == 0xA9) | (three == 0xAF))))
        places = [at, lead[wide]]
        raw = data.tobytes()
        for name in self.special:
            k = raw.find(name)
            while k >= 0:
                places.append(np.array([k]))
                k = raw.find(name, k + 1)
        out[np.searchsorted(offsets, np.concatenate(places), "right") - 1] = True
        return out

    def learn(self, new: list[bytes]) -> None:
        """Encode new pieces, many in a call. A full stop or comma after a letter is a token of its own, so only the rest is encoded."""
        known, older, marked, wanted = self.known, self.older, [], {}
        for piece in new:
            rest = piece[:-1]
            if piece[-1] in b".," and rest[-1:].isalpha() and len(rest) > 1:
                marked.append(piece)
                if rest not in known:
                    wanted[rest] = None
            else:
                wanted[piece] = None
        held, size, calls = [], 0, []
        for piece in wanted:
            if piece in older:
                known[piece] = older[piece]
            elif piece[0] in b" \n":
                held.append(piece)
                size += len(piece)
                if size >= CALL_BYTES:
                    calls.append(held)
                    held, size = [], 0
            else:
                known[piece] = self.plain(piece.decode())
        if held:
            calls.append(held)
        for first in range(0, len(calls), 64):
            some = calls[first:first + 64]
            for held, encoding in zip(some, self.tokenizer.encode_batch_fast([b"".join(c).decode() for c in some], add_special_tokens=False), strict=True):
                ids = np.array(encoding.ids, self.kind)
                cuts = (np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum([len(p) for p in held])) + 1) * self.width
                raw, at = ids.tobytes(), 0
                for piece, cut in zip(held, cuts.tolist(), strict=True):
                    known[piece] = raw[at:cut]
                    at = cut
        for piece in marked:
            known[piece] = known[piece[:-1]] + self.mark[piece[-1]]

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a chunk, and the offsets of the rows in them."""
        data, offsets, n = texts.data, texts.offsets, len(texts.data)
        whole = self.whole_rows(texts)
        cut = (data == 32) | (data == 10)
        cut[offsets[:-1][offsets[:-1] < n]] = True
        start = np.flatnonzero(cut)
        row = np.searchsorted(offsets, start, "right") - 1
        keep = ~whole[row] | (start == offsets[row])
        start, row = start[keep], row[keep]
        end = np.append(start[1:], n) if len(start) else start
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(n), dtype=np.uint64)])
        hashes = mixed((sums[end] - sums[start]) * powers(n + 1, _INVERSE)[start] + (end - start).astype(np.uint64))
        hashes[whole[row]] += np.uint64(1)  # a text of its own is no piece
        _, one, same = np.unique(hashes, return_index=True, return_inverse=True)
        raw = data.tobytes()
        keys = [raw[s:e] for s, e in zip(start[one].tolist(), end[one].tolist(), strict=True)]
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        alone = {k: self.plain(keys[k].decode()) for k in np.flatnonzero(whole[row[one]]).tolist()}
        known, older = self.known, self.older
        new = []
        for k, piece in enumerate(keys):
            if piece not in known and k not in alone:
                if piece in older:
                    known[piece] = older[piece]
                else:
                    new.append(piece)
        self.learn(new)
        found = list(map(known.get, keys)) if not alone else [alone[k] if k in alone else known[p] for k, p in enumerate(keys)]
        flat = np.frombuffer(b"".join(found), self.kind)
        size = np.array([len(f) for f in found], np.int64) // self.width
        first = np.cumsum(size) - size
        sizes = size[same]
        total = np.cumsum(sizes)
        ids = flat[np.repeat(first[same] - total + sizes, sizes) + np.arange(total[-1] if len(total) else 0)]
        per_row = np.bincount(row, sizes, texts.n).astype(np.int64) if len(row) else np.zeros(texts.n, np.int64)
        return ids, np.concatenate([[0], np.cumsum(per_row)])


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _writer(folder: str, tokenizer: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        encoder = _encoder(tokenizer)
        part = TaskContext.get().partitionId()
        name = f"{part:06d}-{uuid.uuid4().hex}"
        at = n_docs = n_null = 0
        files = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if files is None:
                os.makedirs(folder, exist_ok=True)
                files = [open(f"{folder}/{name}.{kind}", "wb") for kind in ("ids", "off", "doc")]
                files[1].write(np.zeros(1, np.int64).tobytes())
            docs = batch.column(0)
            n_null += docs.null_count
            n_docs += len(docs)
            files[2].write(docs.fill_null(0).to_numpy().astype("<i8").tobytes())
            for texts in text_chunks(batch.column(1)):
                ids, until = encoder.encode(texts)
                # an end id after each document
                files[0].write(np.insert(ids, until[1:], END_ID).astype(encoder.kind).tobytes())
                files[1].write((at + until[1:] + np.arange(1, texts.n + 1)).astype("<i8").tobytes())
                at += len(ids) + texts.n
        if files:
            for f in files:
                f.close()
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in (
                (part, pa.int32()), (f"{folder}/{name}", pa.string()), (n_docs, pa.int64()), (n_null, pa.int64()), (at, pa.int64()),
                (encoder.width, pa.int32()))], [c.split()[0] for c in MANIFEST.split(", ")])
    return write


def write_ids(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Write the files; the manifest with `base`."""
    spark = docs.sparkSession
    # below the application's own folder, which clear_settled removes
    folder = folder or f"{shared_folder(spark)}/evigrid-{spark.sparkContext.applicationId}/ids-{uuid.uuid4().hex}"
    if urlparse(folder).scheme not in ("", "file"):
        raise ValueError(f"token files are memory-mapped: {folder} is not a mounted path that all executors see")
    local = urlparse(folder).path if folder.startswith("file:") else folder
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    parts = settled(ordered.mapInArrow(_writer(local, tokenizer or tokenizer_path()), MANIFEST))
    # one row for each file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = np.memmap(row["file"] + ".ids", "<u2" if row["width"] == 2 else "<u4", "r")
            offsets, docs = (np.memmap(f"{row['file']}.{kind}", "<i8", "r") for kind in ("off", "doc"))
            for first in range(0, row["n_docs"], 4096):
                last = min(first + 4096, row["n_docs"])
                sums = [zlib.crc32(ids[offsets[k]:offsets[k + 1]].astype("<u4").tobytes()) for k in range(first, last)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(docs[first:last], pa.int64(), mask=np.arange(first, last) < row["n_null"]), pa.array(row["base"] + offsets[first:last]),
                    pa.array(np.diff(offsets[first:last + 1])), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digest(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    files = max(manifest.count(), 1)  # a row for each file
    return manifest.select("part", "file", "width", "n_docs", "n_null", "base").repartitionByRange(files, "part").mapInArrow(
        _reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    return read_digest(write_ids(docs, tokenizer=tokenizer))


def read_ids(spark: SparkSession, manifest: DataFrame, doc_id: int) -> list[list[int]]:
    """The ids of one document, one list for each row of it: a look into the maps of the parts that may hold it."""
    out = []
    for row in manifest.orderBy("part").collect():
        offsets, docs = (np.memmap(f"{row.file}.{kind}", "<i8", "r") for kind in ("off", "doc"))
        ids = np.memmap(row.file + ".ids", "<u2" if row.width == 2 else "<u4", "r")
        for k in range(*(row.n_null + np.searchsorted(docs[row.n_null:], doc_id, side) for side in ("left", "right"))):
            out.append(ids[offsets[k]:offsets[k + 1]].tolist())
    return out
