"""Every query before every candidate, in cells of a shuffle.

Queries are dealt into blocks of bounded size and candidates into shards.  A cell is one block with one
shard; a query row goes to the cells of its block and a candidate row to the cells of its shard, and a
task holds the queries of its cell while the candidates stream past it, so a shard may have any size.
Nothing passes through the driver and nothing is broadcast.  With N candidates, Q queries, B blocks and
S shards, B * N + S * Q rows are shuffled; S is only as large as it takes to give every core a cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries that one task holds, and candidates below which a shard is not worth a task.
BLOCK_ROWS, SHARD_ROWS = 65_536, 4096


class Visitor(Protocol):
    """Holds the queries of a cell and sees its candidates batch by batch."""

    def add(self, candidates: pa.RecordBatch) -> None: ...

    def results(self) -> Iterator[pa.RecordBatch]: ...


def meet(queries: DataFrame, candidates: DataFrame, make: Callable[[list[pa.RecordBatch]], Visitor],
         schema: str) -> DataFrame:
    """The results of all cells.  Both tables are staged and have the same columns; the first names a query.

    ``make`` gets the queries of a cell; their rows must be distinct in the first column.
    """
    spark = queries.sparkSession
    blocks = max(1, -(-queries.count() // BLOCK_ROWS))
    wanted = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks)
    shards = max(1, min(wanted, -(-candidates.count() // SHARD_ROWS)))
    block = F.pmod(F.xxhash64(queries.columns[0]), F.lit(blocks)).cast("int")
    # Round robin over each file: rows that repeat an id do not meet in one shard.
    shard = F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int")
    every_shard, every_block = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (shards, blocks))
    dealt = queries.withColumns({"_block": block, "_role": F.lit(0)}).withColumn("_shard", every_shard).unionByName(
        candidates.withColumns({"_shard": shard, "_role": F.lit(1)}).withColumn("_block", every_block))
    cells = dealt.withColumn("_cell", F.col("_block") * shards + F.col("_shard")).repartitionById(
        blocks * shards, "_cell").select("_role", *queries.columns).sortWithinPartitions("_role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, visitor = [], None
        for batch in batches:
            first = batch.column(0).to_pylist().count(0)  # queries stand first
            rows = batch.select(batch.schema.names[1:])
            if first:
                held.append(rows.slice(0, first))
            if first < len(batch) and held:
                visitor = visitor or make(held)
                visitor.add(rows.slice(first))
        if visitor is not None:
            yield from visitor.results()

    return cells.mapInArrow(run, schema)


def matrix(column: pa.Array):
    """Lengths of the vectors of a list column, and all their components in a row."""
    offsets = column.offsets.to_numpy()
    return offsets[1:] - offsets[:-1], column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
