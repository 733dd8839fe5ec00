"""Token ids of all documents in binary files, and back.

A file holds the documents of one range of ids, in ascending order::

    magic | chunk ... chunk | document ids | valid ids | lengths | chunk starts | footer

Chunks are patched frame-of-reference blocks (``pfor``).  The footer has the number of documents,
chunks and ids, so a reader finds everything from the end of the file.

Each task writes a file of a name of its own and reports it; only reported files count.  A task that
is run again writes another file, and what a lost one left is never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timeloom.llm import pfor
from timeloom.llm.common import each_text
from timeloom.llm.tokens import default_vocabulary, encoder, in_portions
from timeloom.plans.session import fresh_path, stage

MAGIC = b"TLPFOR01"
CHUNK = 1024 * pfor.BLOCK
FOOTER = np.dtype([("docs", "<u8"), ("chunks", "<u8"), ("ids", "<u8"), ("magic", "S8")])
MANIFEST = "part int, file string, n_docs long, n_ids long"


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class FileWriter:
    """Streams documents into one file; keeps one chunk of ids and the document table."""

    def __init__(self, out, percentile: float):
        self.out, self.percentile = out, percentile
        self.pending: list[np.ndarray] = []
        self.n_pending = self.n_ids = 0
        self.at = len(MAGIC)
        self.starts: list[int] = []
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        out.write(MAGIC)

    def _chunks(self, last: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.empty(0, np.uint32)
        cut = len(ids) if last else len(ids) // CHUNK * CHUNK
        for first in range(0, cut, CHUNK):
            raw = pfor.encode(ids[first:min(first + CHUNK, cut)], self.percentile)
            self.starts.append(self.at)
            self.out.write(raw)
            self.at += len(raw)
        self.pending, self.n_pending = [ids[cut:]], len(ids) - cut

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.pending.append(ids)
        self.n_pending += len(ids)
        self.n_ids += len(ids)
        if self.n_pending >= CHUNK:
            self._chunks(last=False)

    def close(self) -> None:
        self._chunks(last=True)
        known = np.array([d is not None for d in self.doc_ids], "u1")
        ids = np.array([d or 0 for d in self.doc_ids], "<i8")
        foot = np.array([(len(ids), len(self.starts), self.n_ids, MAGIC)], FOOTER)
        for part in (ids, known, np.array(self.lengths, "<u8"), np.array(self.starts, "<u8"), foot):
            self.out.write(part.tobytes())


def read_file(handle) -> tuple[list[int | None], np.ndarray, Iterator[np.ndarray]]:
    """Document ids, lengths, and the chunks of ids one after the other."""
    size = handle.size()
    handle.seek(size - FOOTER.itemsize)
    foot = np.frombuffer(handle.read(FOOTER.itemsize), FOOTER)[0]
    if foot["magic"] != MAGIC:
        raise ValueError("not a token file")
    docs, chunks = int(foot["docs"]), int(foot["chunks"])
    tail = docs * 17 + chunks * 8
    end = size - FOOTER.itemsize - tail
    handle.seek(end)
    raw = handle.read(tail)
    ids, known = np.frombuffer(raw, "<i8", docs), np.frombuffer(raw, "u1", docs, docs * 8)
    lengths = np.frombuffer(raw, "<u8", docs, docs * 9)
    starts = np.append(np.frombuffer(raw, "<u8", chunks, docs * 17), np.uint64(end)).tolist()

    def each() -> Iterator[np.ndarray]:
        for a, b in zip(starts, starts[1:], strict=False):
            handle.seek(a)
            yield pfor.decode(handle.read(b - a))

    return [int(d) if k else None for d, k in zip(ids, known, strict=True)], lengths, each()


def write_token_files(docs: DataFrame, path: str | None = None, vocabulary: str | None = None,
                      end_id: int | None = 1, percentile: float = 0.9, id_column: str = "doc_id",
                      text_column: str = "text") -> DataFrame:
    """Encode every text, append ``end_id``, write files; returns the written manifest.

    ``docs`` is sorted by id over all files (ties: by text).  A missing text is empty, a missing id
    comes first.  The manifest has one row per file: part, file, n_docs, n_ids.  An empty table
    gives no files or files without documents.  Other columns are ignored.
    """
    target = path or fresh_path(docs.sparkSession, "token_files")
    vocabulary = vocabulary or default_vocabulary()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary)
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        store, root = _store(target)
        store.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.pfor"
        writer = None
        with store.open_output_stream(f"{root}/{name}") as out:
            writer = FileWriter(out, percentile)
            for batch, texts in each_text(batches):
                ids = iter(batch.column(0).to_pylist())
                for portion in in_portions(texts):
                    for code in words.encode_many(portion):
                        writer.add(next(ids), np.frombuffer(code + end, "<u4"))
            writer.close()
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "file": [f"{target}/{name}"],
            "n_docs": [len(writer.doc_ids)], "n_ids": [writer.n_ids],
        })

    ordered = docs.select(F.col(id_column).cast("long").alias("id"),
                          F.col(text_column).alias("text")
                          ).repartitionByRange("id").sortWithinPartitions("id", "text")
    return stage(ordered.mapInArrow(write, MANIFEST), "token_manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit).

    ``start`` counts the ids of all documents before it, over all files.
    """
    files = manifest.where(F.col("n_docs") > 0)
    n = max(1, files.count())
    # One row per file: the only step that sees all of them, and it sees no document.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, place = _store(row["file"])
                with store.open_input_file(place) as handle:
                    yield from _documents(*read_file(handle), row["first"])

    return files.select("file", "first").repartition(n).mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids binary")


def _documents(ids: list, lengths: np.ndarray, chunks: Iterator[np.ndarray], first: int,
               most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Documents cut out of the stream of chunks, in batches of about ``most`` ids."""
    rows: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids": []}
    held, at, size = np.empty(0, np.uint32), 0, 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array(rows["doc_id"], pa.int64()), pa.array(rows["start"], pa.int64()),
            pa.array(rows["n_tokens"], pa.int64()), pa.array(rows["ids"], pa.binary()),
        ], names=list(rows))

    for doc_id, length in zip(ids, lengths.tolist(), strict=True):
        parts = [held[at:at + length]]
        need = length - len(parts[0])
        at += len(parts[0])
        while need > 0:
            held, at = next(chunks), min(need, CHUNK)
            parts.append(held[:at])
            need -= len(parts[-1])
        rows["doc_id"].append(doc_id)
        rows["start"].append(first)
        rows["n_tokens"].append(length)
        rows["ids"].append(b"".join(p.astype("<u4").tobytes() for p in parts))
        first += length
        size += length
        if size >= most:
            yield batch()
            rows, size = {k: [] for k in rows}, 0
    if rows["doc_id"]:
        yield batch()
