"""Approximate nearest neighbours by inner product: randomly rotated one-bit codes.

A vector is stored as the signs of its randomly rotated direction from a centre, one bit each, with two
correction scalars (Gao and Long 2024).  With o the direction, P the rotation and x the sign vector
divided by its length, <x, P q> / <x, P o> estimates <o, q> without bias, and deviates with high probability
by no more than |q| * sqrt((1 - <x, P o>**2) / <x, P o>**2) * ``CONFIDENCE`` / sqrt(bits - 1).  So for every
candidate the estimate of its inner product and a bound of the error follow from its bits alone.  Vectors
whose estimate plus bound reaches the k-th best found so far are reranked: their inner product is computed
in double precision from the original vectors.  The k-th best exact value only rises, and within a batch
the k-th best of estimate minus bound stands in for it.

``ROTATIONS`` independent rotations give as many bits for each dimension; more bits mean a narrower bound
and fewer vectors to rerank, not other results.  The centre is the mean of at most ``CENTRE_ROWS`` vectors,
drawn by a hash of the id; it steers how good the codes are, and every vector is coded.  There are no
buckets: every code is looked at, so what is missed is what the bound's confidence misses.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.llm.pairing import matrix, meet
from timeloom.plans.session import stage

ROTATIONS, CONFIDENCE, CENTRE_ROWS = 4, 1.9, 4096
#: Queries estimated at once, candidates at once, and pairs reranked at once.
QUERY_GROUP, CANDIDATES, PAIRS = 256, 4096, 1 << 16
_NONE = np.iinfo(np.int64).max


@lru_cache(maxsize=8)
def rotation(length: int, rotations: int) -> np.ndarray:
    """Rotations of vectors of this length, one below the other; lengths are kept."""
    draw = np.random.default_rng((length, 29))
    turns = [np.linalg.qr(draw.standard_normal((length, length)))[0] for _ in range(rotations)]
    return (np.concatenate(turns) / np.sqrt(rotations)).astype(np.float32)


def encode(vectors: np.ndarray, centre: np.ndarray, rotations: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits; the factor that turns a sign sum into an inner product; the error for |q| = 1."""
    apart = vectors - centre
    distance = np.sqrt(np.square(apart).sum(axis=1))
    turned = (apart / np.where(distance, distance, 1)[:, None]).astype(np.float32) @ rotation(
        vectors.shape[1], rotations).T
    bits = turned.shape[1]
    likeness = np.maximum(np.abs(turned).sum(axis=1, dtype=float) / np.sqrt(bits), 1e-9)
    error = np.sqrt(np.maximum(1 - likeness**2, 0)) / likeness * CONFIDENCE / np.sqrt(max(bits - 1, 1))
    return np.packbits(turned >= 0, axis=1), distance / (likeness * np.sqrt(bits)), distance * error


class Reranked:
    """The k best candidates of each query so far, for vectors of one length."""

    def __init__(self, keys: np.ndarray, vectors: np.ndarray, centre: np.ndarray, rotations: int, k: int):
        self.keys, self.vectors, self.k = keys, vectors, k
        self.turned = vectors.astype(np.float32) @ rotation(vectors.shape[1], rotations).T
        self.base, self.length = vectors @ centre, np.sqrt(np.square(vectors).sum(axis=1))
        self.score = np.full((len(keys), k), -np.inf)
        self.found = np.full((len(keys), k), _NONE)
        self.reranked = 0

    def add(self, keys: np.ndarray, vectors: np.ndarray, codes: np.ndarray, factor: np.ndarray,
            error: np.ndarray) -> None:
        bits = self.turned.shape[1]
        signs = np.unpackbits(codes, axis=1, count=bits).astype(np.float32) * 2 - 1
        for first in range(0, len(self.keys), QUERY_GROUP):
            group = slice(first, first + QUERY_GROUP)
            guess = (self.turned[group] @ signs.T) * factor + self.base[group, None]
            spread = self.length[group, None] * (error * (1 + 1e-3) + 1e-9)
            own = self.keys[group, None] == keys
            low = np.where(own, -np.inf, guess - spread)
            bar = self.score[group, -1]
            if len(keys) > self.k:
                bar = np.maximum(bar, np.partition(low, len(keys) - self.k, axis=1)[:, len(keys) - self.k])
            row, column = np.nonzero((guess + spread >= bar[:, None]) & ~own)
            for at in range(0, len(row), PAIRS):
                self._rerank(first, row[at:at + PAIRS], column[at:at + PAIRS], keys, vectors)

    def _rerank(self, first: int, row: np.ndarray, column: np.ndarray, keys: np.ndarray, vectors: np.ndarray) -> None:
        self.reranked += len(row)
        touched, row = np.unique(row, return_inverse=True)
        at = first + touched
        exact = np.einsum("ij,ij->i", self.vectors[at[row]], vectors[column])
        rows = np.concatenate([np.repeat(np.arange(len(at)), self.k), row])
        score = np.concatenate([self.score[at].reshape(-1), exact])
        found = np.concatenate([self.found[at].reshape(-1), keys[column]])
        order = np.lexsort((found, -score, rows))
        rank = np.arange(len(order)) - np.searchsorted(rows[order], np.arange(len(at)))[rows[order]]
        best = order[rank < self.k]
        self.score[at], self.found[at] = score[best].reshape(-1, self.k), found[best].reshape(-1, self.k)

    def results(self) -> pa.RecordBatch:
        row, place = np.nonzero(np.isfinite(self.score))
        return pa.RecordBatch.from_arrays([
            pa.array(self.keys[row]), pa.array(self.found[row, place]), pa.array(self.score[row, place]),
        ], names=["query_id", "vec_id", "score"])


class _Cell:
    """The queries of a cell by length; columns of a batch: key, v, code, factor, error."""

    def __init__(self, held: list[pa.RecordBatch], centres: dict[int, np.ndarray], rotations: int, k: int):
        self.best: dict[int, Reranked] = {}
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        for length, rows, vectors in _by_length(table):
            centre = centres.get(length, np.zeros(length))
            self.best[length] = Reranked(table.column(0).to_numpy()[rows], vectors, centre, rotations, k)

    def add(self, batch: pa.RecordBatch) -> None:
        for first in range(0, len(batch), CANDIDATES):
            part = batch.slice(first, CANDIDATES)
            keys, factor, error = (part.column(i).to_numpy() for i in (0, 3, 4))
            for length, rows, vectors in _by_length(part):
                if length in self.best:
                    codes = b"".join(part.column(2).take(pa.array(rows)).to_pylist())
                    self.best[length].add(keys[rows], vectors, np.frombuffer(codes, np.uint8).reshape(len(rows), -1),
                                          factor[rows], error[rows])

    def results(self) -> Iterator[pa.RecordBatch]:
        for best in self.best.values():
            yield best.results()


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, rows and vectors in double precision."""
    lengths, flat = matrix(batch.column(1))
    starts = np.cumsum(lengths) - lengths
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        yield length, rows, flat[starts[rows][:, None] + np.arange(length)].astype(float)


def usable(vectors: DataFrame, vector: str, key: str) -> DataFrame:
    """key and v of the rows with a key and a vector that is whole, finite and not zero."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    known = F.col(key).isNotNull() & x.isNotNull() & ~bad & F.exists(x, lambda v: v != 0)
    narrow = vectors.schema[vector].dataType.simpleString() == "array<float>"
    return vectors.where(known).select(F.col(key).cast("long").alias("key"),
                                       (F.col(vector) if narrow else x).alias("v"))


def centres_of(data: DataFrame, rows: int = CENTRE_ROWS) -> dict[int, np.ndarray]:
    """The mean vector for each length among at most ``rows`` vectors, drawn by a hash of the id."""
    drawn = data.orderBy(F.xxhash64("key", F.lit(31)), "key", "v").limit(rows).collect()
    by_length: dict[int, list] = {}
    for row in drawn:
        by_length.setdefault(len(row.v), []).append(row.v)
    return {length: np.mean(np.array(found, float), axis=0) for length, found in by_length.items()}


def coded(data: DataFrame, centres: dict[int, np.ndarray], rotations: int) -> DataFrame:
    """key, v, code, factor, error of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [b""] * len(batch)
            factor, error = np.zeros(len(batch)), np.zeros(len(batch))
            for length, rows, vectors in _by_length(batch):
                bits, factor[rows], error[rows] = encode(vectors, centres.get(length, np.zeros(length)), rotations)
                for row, code in zip(rows.tolist(), bits, strict=True):
                    codes[row] = code.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(codes, pa.binary()), pa.array(factor), pa.array(error)],
                names=["key", "v", "code", "factor", "error"])

    kind = data.schema["v"].dataType.simpleString()
    return data.mapInArrow(run, f"key long, v {kind}, code binary, factor double, error double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, vector: str = "embedding", key: str = "vec_id",
            rotations: int = ROTATIONS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k other rows of largest inner product found for each query.

    Scores are exact inner products in double precision; a candidate is missed where the error bound
    fails, so recall is high but not certain.  Ties go to the smaller key.  Rows without key, and vectors
    that are missing, zero or empty or have missing or non-finite components, take no part; vectors of
    another length than the query's are no candidates for it.  Rows with the query's own key are left out.
    Rows that repeat a key are candidates each; as a query the smallest of their vectors counts, once.
    Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    data = stage(usable(vectors, vector, key), "vectors")
    centres = centres_of(data)
    asked = usable(vectors.where(is_query), vector, key).groupBy("key").agg(F.min("v").alias("v"))
    queries, candidates = (stage(coded(d, centres, rotations), "codes") for d in (asked, data))
    found = meet(queries, candidates, lambda held: _Cell(held, centres, rotations, k),
                 "query_id long, vec_id long, score double")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
