"""Fill-in-the-middle: texts cut at two unit ranks and put together in another order.

A text is a sequence of units, here its lines.  The two cuts are drawn as unit ranks, but a text is
cut at bytes and reported in code points, so both are looked up in an indexable skip list (Pugh 1990):
the lowest lane links unit to unit, every express lane above skips ``FAN`` links of the one below, and
each link carries its width in units, in code points and in bytes.  A search starts in the topmost
lane, follows links as long as they do not pass the rank, and adds up their widths; so it meets both
cuts exactly after at most ``FAN`` links a lane, and the middle is never scanned.  Heights are given by
the position of a unit instead of coin flips: the lanes of a text are always the same.

One text is in memory at a time, with about eight bytes for each of its lines and one for each of its
bytes; no shuffle takes place.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom.llm.common import each_text

FAN = 16
#: Bytes of output after which a batch is handed on.
BATCH_BYTES = 4 << 20
PLAIN, PSM, SPM = "plain", "psm", "spm"


class SkipList:
    """Lanes of links over units; ``widths`` has a row per unit: units, code points, bytes."""

    def __init__(self, widths: np.ndarray):
        self.lanes = [widths]
        while len(self.lanes[-1]) > FAN:
            below = self.lanes[-1]
            self.lanes.append(np.add.reduceat(below, np.arange(0, len(below), FAN), axis=0))

    def before(self, rank: int) -> tuple[int, int]:
        """Code points and bytes of the first ``rank`` units."""
        at, passed = 0, np.zeros(3, np.int64)
        for lane in reversed(self.lanes):
            at *= FAN  # the node of the lane above stands here in this one
            while at < len(lane) and passed[0] + lane[at, 0] <= rank:
                passed += lane[at]
                at += 1
        return int(passed[1]), int(passed[2])


def line_widths(text: bytes) -> np.ndarray:
    """Widths of the lines of a UTF-8 text; a line ends behind its line feed or with the text."""
    raw = np.frombuffer(text, np.uint8)
    ends = np.flatnonzero(raw == 10) + 1
    if len(raw) and (not len(ends) or ends[-1] != len(raw)):
        ends = np.append(ends, len(raw))
    sizes = np.diff(ends, prepend=0)
    points = sizes
    if len(raw) and not text.isascii():
        # All bytes but continuation bytes start a code point.
        points = np.add.reduceat((raw & 0xC0) != 0x80, ends - sizes, dtype=np.int64)
    return np.column_stack([np.ones_like(sizes), points, sizes])


def cuts(widths: np.ndarray, first: int, second: int) -> tuple[tuple[int, int], tuple[int, int]]:
    """Code points and bytes before the lower and before the higher of two drawn ranks."""
    choices = len(widths) + 1
    low, high = sorted((first % choices, second % choices))
    lanes = SkipList(widths)
    return lanes.before(low), lanes.before(high)


def _draws(seed: str, key: str) -> list[Column]:
    """Four unsigned 32-bit numbers from the hash of seed and id; a missing id is empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: str = "7", rate: int = 100, spm_rate: int = 50,
                   marks: Sequence[str] = ("<P>", "<S>", "<M>"), text: str = "text",
                   key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n, form, prefix_chars, middle_chars, output.

    n is the number of lines.  Of the texts ``rate`` per cent are transformed, and ``spm_rate`` per cent of
    these with the suffix first; what is drawn depends on ``seed`` and id alone, so rows that repeat an id
    are cut at ranks from the same draws.  An empty or missing text, and one that contains a mark, stays as
    it is (form ``plain``, widths NULL).  A row without id draws as if it were the empty text.  Texts of any
    length are cut whole; lines end at line feeds only.  Other columns are ignored, whatever their names;
    an empty table gives no rows.
    """
    pre, suf, mid = (m.encode() for m in marks)

    def cut(body: bytes, h: Sequence[int]) -> tuple[int, str, int | None, int | None, list[bytes]]:
        widths = line_widths(body)
        if not body or pre in body or suf in body or mid in body or h[2] % 100 >= rate:
            return len(widths), PLAIN, None, None, [body]
        (points, start), (upto, end) = cuts(widths, h[0], h[1])
        whole = memoryview(body)
        prefix, middle, suffix = whole[:start], whole[start:end], whole[end:]
        if h[3] % 100 < spm_rate:
            return len(widths), SPM, points, upto - points, [suf, suffix, pre, prefix, mid, middle]
        return len(widths), PSM, points, upto - points, [pre, prefix, suf, suffix, mid, middle]

    def rows(done: list, first: int, ids: pa.Array) -> pa.RecordBatch:
        n, form, points, middle, output = zip(*done, strict=True)
        return pa.RecordBatch.from_arrays([
            ids.slice(first, len(done)), pa.array(n, pa.int64()), pa.array(form), pa.array(points, pa.int64()),
            pa.array(middle, pa.int64()), pa.array(output, pa.binary()),
        ], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in each_text(batches, "text"):
            draws = zip(*(batch.column(2 + i).to_pylist() for i in range(4)), strict=True)
            done, size, first = [], 0, 0
            for body, h in zip(texts, draws, strict=True):
                *facts, parts = cut(body, h)
                done.append((*facts, b"".join(parts)))
                size += len(body)
                if size > BATCH_BYTES:
                    yield rows(done, first, batch.column(0))
                    first, done, size = first + len(done), [], 0
            if done:
                yield rows(done, first, batch.column(0))

    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *_draws(seed, key))
    out = source.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, "
                                 "output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, marks: Sequence[str] = ("<P>", "<S>", "<M>")) -> Column:
    """The text that an output was made from; no text with a mark inside is ever transformed."""
    pieces = F.split(output, "|".join(f"\\Q{m}\\E" for m in marks), -1)
    moved = F.when(form == SPM, F.concat(pieces[2], pieces[3], pieces[1])).otherwise(
        F.concat(pieces[1], pieces[3], pieces[2]))
    return F.when(form == PLAIN, output).otherwise(moved)
