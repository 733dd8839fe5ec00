"""Pack documents into training sequences along a space-filling curve.

A document's token ids are hashed to a signed vector, projected to a few dimensions and given the
position of its cell on a Hilbert curve.  Rows are range-sorted by that position, so neighbours on
the curve, which use similar words, share sequences.  Every range is packed by the task that holds
it: pieces are cut where a sequence is full, and what is left at the end of a range goes into
sequences whose lengths are powers of two, so nothing is padded at all.

One shuffle moves the ids; copies of one text share a position and are dealt out by their id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm.common import each_text, mix64
from timeloom.llm.tokens import default_vocabulary, encoder, in_portions
from timeloom.plans.session import stage

#: Buckets of the hashed vector, dimensions kept, bits per dimension, half width of the grid.
BUCKETS, DIMENSIONS, BITS, REACH = 256, 4, 12, 4.0
#: Sequences of one range are numbered from its number times this.
RANGE_SEQUENCES = 1 << 40
PIECES = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, "
          "offset long")


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """The position on the Hilbert curve of each row of integer coordinates (Skilling 2004)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:  # undo the excess work, from the top bit
        low = bit - 1
        for d in range(dims):
            on = (x[d] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] ^= swap
        bit >>= 1
    for d in range(1, dims):  # Gray code
        x[d] ^= x[d - 1]
    flips = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        flips ^= np.where((x[-1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    x ^= flips
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):  # interleave
        for d in range(dims):
            key = key << 1 | (x[d] >> b & 1)
    return key


class Projection:
    """Ids -> a few coordinates, the same on every machine."""

    def __init__(self, seed: int = 11):
        self.plane = np.random.default_rng(seed).standard_normal((BUCKETS, DIMENSIONS))

    def vector(self, ids: np.ndarray) -> np.ndarray:
        h = mix64(ids.astype(np.uint64))
        sign = np.where(h >> np.uint64(63), 1.0, -1.0)
        v = np.bincount((h % np.uint64(BUCKETS)).astype(np.int64), sign, BUCKETS)
        size = np.sqrt(v @ v)
        return v @ self.plane / size if size else np.zeros(DIMENSIONS)

    def keys(self, vectors: list[np.ndarray]) -> np.ndarray:
        place = (np.array(vectors).reshape(-1, DIMENSIONS) + REACH) / (2 * REACH)
        cells = np.clip(np.floor(place * (1 << BITS)), 0, (1 << BITS) - 1)
        return hilbert_key(cells.astype(np.int64), BITS)


def tokenize(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """doc_id, curve position and ids of every document; ids in 16 bits where they all fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, plane = encoder(vocabulary), Projection()
        end = np.array([end_id], "<u4").tobytes()
        kind = "<u2" if max(len(words.closes), end_id + 1) <= 1 << 16 else "<u4"
        for batch, texts in each_text(batches):
            at = 0
            for portion in in_portions(texts):
                ids = [np.frombuffer(code + end, "<u4") for code in words.encode_many(portion)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(portion)),
                    pa.array(plane.keys([plane.vector(i) for i in ids])),
                    pa.array([i.astype(kind).tobytes() for i in ids], pa.binary()),
                    pa.array([len(i) for i in ids], pa.int64()),
                ], names=["doc_id", "curve", "ids", "doc_tokens"])
                at += len(portion)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return source.mapInArrow(run, "doc_id long, curve long, ids binary, doc_tokens long")


class Packer:
    """Cuts a stream of documents into full sequences."""

    def __init__(self, length: int, first_sequence: int):
        self.length, self.sequence = length, first_sequence
        self.open: list[tuple] = []  # pieces of the sequence that is not full yet
        self.filled = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        at = 0
        while at < len(ids):
            take = min(self.length - self.filled, len(ids) - at)
            self.open.append((doc_id, at, ids[at:at + take], len(ids)))
            self.filled += take
            at += take
            if self.filled == self.length:
                yield from self._close(self.open)
                self.open, self.filled = [], 0

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, ids, total in pieces:
            yield doc_id, start, len(ids), ids.tobytes(), total, self.sequence, offset
            offset += len(ids)
        self.sequence += 1

    def finish(self) -> Iterator[tuple]:
        """The rest, in sequences of falling powers of two."""
        left, rest = self.filled, self.open
        self.open, self.filled = [], 0
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            now = []
            while size:
                doc_id, start, ids, total = rest.pop(0)
                now.append((doc_id, start, ids[:size], total))
                if len(ids) > size:
                    rest.insert(0, (doc_id, start + size, ids[size:], total))
                size -= len(now[-1][2])
            yield from self._close(now)


def pack(docs: DataFrame, length: int = 4096, vocabulary: str | None = None, end_id: int = 2,
         batch_ids: int = 1 << 20) -> DataFrame:
    """Pieces of documents placed in sequences of at most ``length`` tokens.

    Columns: doc_id, start (its ids before the piece), length, ids (little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset.  Every id of every row is in exactly one piece.  A missing or
    empty text is its end id alone; a missing doc_id is kept as missing; rows that repeat are packed
    once each; further columns are ignored; an empty table gives no pieces.
    """
    vocabulary = vocabulary or default_vocabulary()
    made = stage(tokenize(docs, vocabulary, end_id), "packing_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(length, TaskContext.get().partitionId() * RANGE_SEQUENCES)
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            totals = batch.column(3).to_pylist()
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                raw = batch.column(2)[i].as_buffer()
                ids = np.frombuffer(raw, f"<u{raw.size // totals[i]}").astype("<u4")
                for row in packer.add(doc_id, ids):
                    rows.append(row)
                    size += row[2]
                if size >= batch_ids:
                    yield _batch(rows)
                    rows, size = [], 0
        rows.extend(packer.finish())
        if rows:
            yield _batch(rows)

    ordered = made.repartitionByRange("curve", "doc_id", "doc_tokens").sortWithinPartitions(
        "curve", "doc_id", "doc_tokens", "ids")
    return ordered.mapInArrow(run, PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([
        pa.array(c, pa.binary() if n == "ids" else pa.int64())
        for n, c in zip(names, columns, strict=True)
    ], names=names)
