"""Exact top-k by inner product: branch and bound over columns of dimensions.

Vectors of integers are held dimension by dimension.  For a group of queries the products are summed
block of dimensions by block; after each block a candidate's best possible score is its sum so far plus
the product of what is left of both lengths (Cauchy and Schwarz), and candidates that can no longer reach
any query's k-th best are taken out, so later blocks work on compacted columns (de Vries et al. 2002).

Blocks of queries meet shards of candidates in the cells of a shuffle (:mod:`timeloom.llm.pairing`); each
cell returns its best k of every query, and these are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.llm.pairing import matrix, meet
from timeloom.plans.session import stage

#: Queries that share bounds, dimensions summed between two bounds, candidates.
QUERY_GROUP, DIMENSION_BLOCK, CANDIDATES = 128, 16, 8192
#: Share of candidates still alive above which compacting does not pay.
DENSE = 0.8


def quantized(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", scale: int = 64) -> DataFrame:
    """key and floor(scale * x) of every component; only whole, finite vectors with a key."""
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (
        F.abs(v.cast("double")) == float("inf")))
    return vectors.where(F.col(key).isNotNull() & x.isNotNull() & ~bad).select(
        F.col(key).cast("long").alias("key"),
        F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("double")).alias("v"))


def _tail_norms(x: np.ndarray) -> np.ndarray:
    """Lengths of what is left from each block of dimensions on: (blocks + 1, rows)."""
    blocks = [np.square(x[i:i + DIMENSION_BLOCK]).sum(axis=0) for i in range(0, len(x), DIMENSION_BLOCK)]
    squares = np.array([*blocks, np.zeros(x.shape[1])])
    return np.sqrt(squares[::-1].cumsum(axis=0)[::-1])


class Best:
    """The best k of each query so far: higher scores, then smaller keys."""

    def __init__(self, keys: np.ndarray, columns: np.ndarray, k: int):
        self.keys, self.columns, self.k = keys, columns, k
        self.norms = _tail_norms(columns)
        self.bound = np.full(len(keys), -np.inf)
        self.found = [(np.empty(0), np.empty(0, np.int64)) for _ in keys]

    def add(self, keys: np.ndarray, columns: np.ndarray) -> None:
        """Candidates, one per column; keys ascend."""
        norms = _tail_norms(columns)
        for first in range(0, len(self.keys), QUERY_GROUP):
            self._group(slice(first, first + QUERY_GROUP), keys, columns, norms)

    def _group(self, group: slice, keys: np.ndarray, columns: np.ndarray, norms: np.ndarray) -> None:
        queries, own, bound = self.columns[:, group], self.norms[:, group], self.bound[group]
        sums = np.zeros((queries.shape[1], len(keys)))
        for block, first in enumerate(range(0, len(columns), DIMENSION_BLOCK), 1):
            part = slice(first, first + DIMENSION_BLOCK)
            sums += queries[part].T @ columns[part]
            if np.isneginf(bound).any() or block == len(norms) - 1:
                continue
            # The slack covers the rounding of the lengths; sums are whole numbers and exact.
            rest = own[block][:, None] * norms[block][None, :] * (1 + 1e-9) + 1e-3
            alive = (sums + rest >= bound[:, None]).any(axis=0)
            if alive.mean() < DENSE:
                sums, columns, norms, keys = sums[:, alive], columns[:, alive], norms[:, alive], keys[alive]
            if not len(keys):
                return
        # Rows with the query's own key, however many, must not take places of others.
        sums[self.keys[group][:, None] == keys[None, :]] = -np.inf
        k, least = self.k, bound
        if len(keys) > k:
            least = np.maximum(bound, np.partition(sums, len(keys) - k, axis=1)[:, len(keys) - k])
        row, column = np.nonzero(sums >= least[:, None])
        scores, found = sums[row, column], keys[column]
        cuts = np.searchsorted(row, np.arange(queries.shape[1] + 1))
        for i in range(queries.shape[1]):
            here = slice(cuts[i], cuts[i + 1])
            at = group.start + i
            fresh = found[here] != self.keys[at]
            old_scores, old_keys = self.found[at]
            s = np.concatenate([old_scores, scores[here][fresh]])
            c = np.concatenate([old_keys, found[here][fresh]])
            order = np.lexsort((c, -s))[:self.k]
            self.found[at] = s[order], c[order]
            if len(order) == self.k:
                self.bound[at] = s[order[-1]]


class _Cell:
    """The best of the queries of a cell, by length of the vectors."""

    def __init__(self, held: list[pa.RecordBatch], k: int):
        self.best: dict[int, Best] = {}
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        for length, keys, columns in _by_length(table):
            self.best[length] = Best(keys, columns, k)

    def add(self, batch: pa.RecordBatch) -> None:
        for first in range(0, len(batch), CANDIDATES):
            for length, keys, columns in _by_length(batch.slice(first, CANDIDATES)):
                if length in self.best:
                    self.best[length].add(keys, columns)

    def results(self) -> Iterator[pa.RecordBatch]:
        for best in self.best.values():
            sizes = [len(keys) for _, keys in best.found]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(best.keys, sizes)),
                pa.array(np.concatenate([keys for _, keys in best.found])),
                pa.array(np.concatenate([scores for scores, _ in best.found]).astype(np.int64)),
            ], names=["query_id", "vec_id", "score"])


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, ascending keys, and the vectors as columns."""
    keys = batch.column(0).to_numpy()
    lengths, flat = matrix(batch.column(1))
    starts = np.cumsum(lengths) - lengths
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        rows = rows[np.argsort(keys[rows], kind="stable")]
        yield length, keys[rows], flat[starts[rows] + np.arange(length)[:, None]]


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, vector: str = "embedding",
          key: str = "vec_id", scale: int = 64) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query its k best other rows, exactly.

    Scores are inner products of floor(scale * x), summed as doubles: exact as long as the lengths of two
    such vectors multiply to less than 2**53.  Ties go to the smaller key.  Vectors that are missing
    or have missing or non-finite components, and rows without key, take no part; vectors of another
    length than the query's are no candidates for it.  Rows with the query's own key are left out; rows
    that repeat another key are candidates each.  Of rows that repeat a query's key the smallest vector
    asks, once.  Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    data = stage(quantized(vectors, vector, key, scale), "vectors")
    queries = stage(quantized(vectors.where(is_query), vector, key, scale).groupBy("key").agg(
        F.min("v").alias("v")), "queries")
    found = meet(queries, data, lambda held: _Cell(held, k), "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
