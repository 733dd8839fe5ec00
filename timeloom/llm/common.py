"""What several operators share: words, word memos, tables in, and constants of hashing."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are runs of anything but the six ASCII white spaces; bytes.split() cuts just there.
WORD_BREAK = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"

# Distinct words a Python worker remembers before it starts afresh.
MEMO_WORDS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    root = os.fspath(Path(__file__).resolve().parents[2])
    # Python workers find this package where the driver has it; a cluster may ship it instead.
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of rows that go to a Python worker at a time.
BATCH_BYTES = 4 << 20


def bound_batches(df: DataFrame) -> None:
    """Arrow batches of whole texts are cut by bytes, as both the executor and its worker hold them."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def crc_of_id(column: str = "doc_id") -> Column:
    """The crc32 of an id written as text; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


class Memo(dict):
    """A dict that fills itself; ``trim`` keeps it bounded between two documents."""

    def __init__(self, make: Callable, most: int = MEMO_WORDS):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()


def text_bytes(column: pa.Array, row: int) -> bytes:
    """A text cell as UTF-8; a missing one is empty."""
    value = column[row]
    return value.as_buffer().to_pybytes() if value.is_valid else b""


def each_text(batches: Iterator[pa.RecordBatch], name: str = "text"
              ) -> Iterator[tuple[pa.RecordBatch, Iterator[bytes]]]:
    """Every batch with a lazy iterator over its texts, so only one text is unpacked at a time."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(name))
        yield batch, (text_bytes(column, i) for i in range(len(column)))


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_numbers(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: Rows of a table of fixed-width ids and counts that may be broadcast (some 10 MB).
BROADCAST_ROWS = 400_000


def if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a staged table of narrow rows for broadcast when it is counted to be small.

    A larger one is joined by shuffle; the result is the same.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)
