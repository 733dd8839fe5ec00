"""Patched frame-of-reference blocks: a compact, seekable coding of unsigned 32-bit integers.

A block holds ``BLOCK`` values.  Its minimum is subtracted; the differences are packed at the width
that fits a chosen percentile of them; those that do not fit go to an exception list of positions
and values.  An index has the start of every block's words, so any block can be read alone.

Within a block the values stand in ``LANES`` columns and ``ROWS`` rows, and a column's values follow
each other in its words, so packing works on whole blocks at a time.
"""

from __future__ import annotations

import numpy as np

LANES, ROWS = 8, 32
BLOCK = LANES * ROWS
HEAD = np.dtype([("values", "<u8"), ("blocks", "<u4"), ("words", "<u4"), ("exceptions", "<u4")])


def bit_length(x: np.ndarray) -> np.ndarray:
    """Bits needed for each value below 2**32."""
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, ROWS, LANES) values below 2**width -> (blocks, width * LANES) words."""
    words = np.zeros((len(values), width, LANES), np.uint32)
    for row in range(ROWS):
        word, shift = divmod(row * width, 32)
        words[:, word] |= values[:, row] << np.uint32(shift)
        if shift + width > 32:
            words[:, word + 1] |= values[:, row] >> np.uint32(32 - shift)
    return words.reshape(len(values), width * LANES)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    words = words.reshape(len(words), width, LANES)
    out = np.empty((len(words), ROWS, LANES), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for row in range(ROWS):
        word, shift = divmod(row * width, 32)
        value = words[:, word] >> np.uint32(shift)
        if shift + width > 32:
            value = value | words[:, word + 1] << np.uint32(32 - shift)
        out[:, row] = value & mask
    return out.reshape(len(words), BLOCK)


def encode(values: np.ndarray, percentile: float = 0.9) -> bytes:
    """One chunk of blocks; the last block is filled up with its last value."""
    values = np.ascontiguousarray(values, np.uint32)
    n = len(values)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(1, HEAD).tobytes()
    padded = np.pad(values, (0, blocks * BLOCK - n), mode="edge").reshape(blocks, BLOCK)
    base = padded.min(axis=1)
    rest = padded - base[:, None]
    at = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    widths = bit_length(np.partition(rest, at, axis=1)[:, at])
    late = bit_length(rest) > widths[:, None]
    exc_block, exc_at = np.nonzero(late)
    exc_values = rest[late]
    rest[late] = 0
    starts = np.concatenate([[0], np.cumsum(widths.astype(np.uint32) * LANES)]).astype("<u4")
    words = np.empty(starts[-1], np.uint32)
    for width in np.unique(widths):
        if width:
            which = np.flatnonzero(widths == width)
            places = starts[which][:, None] + np.arange(int(width) * LANES, dtype=np.uint32)
            words[places] = _pack(rest[which].reshape(-1, ROWS, LANES), int(width))
    head = np.array([(n, blocks, len(words), len(exc_at))], HEAD)
    counts = np.bincount(exc_block, minlength=blocks).astype("<u2")
    return b"".join(x.tobytes() for x in (
        head, base.astype("<u4"), widths, counts, starts, words.astype("<u4"),
        exc_at.astype("u1"), exc_values.astype("<u4"),
    ))


class Chunk:
    """The blocks of one encoded chunk."""

    def __init__(self, raw: bytes | memoryview):
        self.head = np.frombuffer(raw, HEAD, 1)[0]
        blocks, at = int(self.head["blocks"]), HEAD.itemsize

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(raw, kind, n, at)
            at += got.nbytes
            return got

        if not blocks:
            return
        self.base, self.widths = take("<u4", blocks), take("u1", blocks)
        self.counts, self.starts = take("<u2", blocks), take("<u4", blocks + 1)
        self.words = take("<u4", int(self.head["words"]))
        self.exc_at = take("u1", int(self.head["exceptions"]))
        self.exc_values = take("<u4", int(self.head["exceptions"]))

    def values(self) -> np.ndarray:
        n, blocks = int(self.head["values"]), int(self.head["blocks"])
        if not n:
            return np.empty(0, np.uint32)
        out = np.zeros((blocks, BLOCK), np.uint32)
        for width in np.unique(self.widths):
            if width:
                which = np.flatnonzero(self.widths == width)
                places = self.starts[which][:, None] + np.arange(int(width) * LANES, dtype=np.uint32)
                out[which] = _unpack(self.words[places], int(width))
        out[np.repeat(np.arange(blocks), self.counts), self.exc_at] = self.exc_values
        return (out + self.base[:, None]).reshape(-1)[:n]

    def block(self, i: int) -> np.ndarray:
        """One block by the index of block starts; nothing else is unpacked."""
        width = int(self.widths[i])
        out = np.zeros((1, BLOCK), np.uint32)
        if width:
            out = _unpack(self.words[self.starts[i]:self.starts[i + 1]][None], width)
        first = int(self.counts[:i].sum())
        here = slice(first, first + int(self.counts[i]))
        out[0, self.exc_at[here]] = self.exc_values[here]
        return (out[0] + self.base[i])[:max(0, int(self.head["values"]) - i * BLOCK)]


def decode(raw: bytes | memoryview) -> np.ndarray:
    return Chunk(raw).values()
