"""The prefix trie of conversations, peeled from its leaves to its root.

A conversation is a sequence of turns, and every distinct sequence of first turns is a node.  Nodes are
not looked for from the top, by writing out all prefixes of all conversations, but by truncation: start
at the greatest depth; the nodes there are the conversations that end there, grouped.  Strip the last turn
of each node found, add the conversations that end one turn earlier, and group again by what is left.
Each grouping finds the nodes of one depth and, in the same pass, adds up what their children hand on:
members, children, leaves and saved tokens.  A node travels once, however many conversations share it.

A turn is a 128-bit hash and a size, and a prefix the hash of the chain of its turns, so texts never
leave the task that reads them.  Before the peeling two things shorten it.  Equal conversations become
one path with a count.  And a path is tested at depths 8, 16, 32, ...: where it is the only one with its
prefix, everything below belongs to it alone and is written at once.  What is left to peel level by
level is the part that paths share; a very long conversation adds no rounds of its own.

All groupings are sums, minima and counts that are combined before the shuffle, so a turn that a third
of all conversations start with meets in one task as one row per map task.  Each level is written to the
shared folder; a lost executor repeats one level at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom.plans.session import fresh_path, stage

#: Bytes of a prefix key.
KEY = 16
#: Depth at which a path is first tested for being alone; then at twice, four times ... this depth.
FIRST_TEST = 8
#: Bytes of conv_ids hashed as one row.
CHUNK = 1 << 16
#: The key of the prefix without turns.
ROOT = b""


def turn_lists(turns: DataFrame) -> DataFrame:
    """conv_id, turns: the digest and the size of the text of every turn, in turn order.

    A missing turn number comes first, equal ones are ordered by digest; a missing role or text is empty.
    Rows without conv_id belong to no conversation.  24 bytes a turn: a conversation of ten million turns
    is a row of some 250 MB, which is the bound here.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn"), F.unhex(digest).alias("digest"), F.octet_length(text).cast("long").alias("size"))
        .alias("turn"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))


def with_shared_openings(lists: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """Every conversation c rebuilt: the first h turns of conversation c - c % ``group``, then its own
    turns after the first h, with h = crc32(c as text) % ``most``; nothing where that one is absent."""
    lists = stage(lists, "turn_lists")
    heads = lists.where(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("_head"), F.slice("turns", 1, most - 1).alias("_opening"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    own = lists.withColumn("_head", F.col("conv_id") - F.col("conv_id") % group)
    opening = F.slice(F.coalesce("_opening", F.slice("turns", 1, 0)), F.lit(1), h)
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return own.join(heads, "_head", "left").select("conv_id", F.concat(opening, rest).alias("turns"))


def _chained(lists: DataFrame) -> DataFrame:
    """conv_id, path (the keys of all its prefixes, one behind the other) and sizes of the turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = []
            for digests in batch.column(1):
                key, keys = b"", []
                for digest in digests.values.to_pylist() if len(digests) else ():
                    key = blake2b(key + digest, digest_size=KEY).digest()
                    keys.append(key)
                paths.append(b"".join(keys))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(paths, pa.binary()), batch.column(2)], names=["conv_id", "path", "sizes"])

    plain = lists.select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.size").alias("sizes"))
    return plain.mapInArrow(run, "conv_id long, path binary, sizes array<long>")


def _key_at(depth: Column | int) -> Column:
    """The key of the prefix of so many turns; the root has the empty key."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.when(depth > 0, F.substring("path", (depth - 1) * KEY + 1, F.lit(KEY))).otherwise(F.lit(ROOT))


def _alone_from(paths: DataFrame) -> DataFrame:
    """key, bound: paths that share no prefix of ``bound`` turns with another path."""
    tests = F.transform(
        F.sequence(F.lit(0), F.floor(F.log2(F.col("depth") / FIRST_TEST)).cast("int")),
        lambda i: (F.lit(FIRST_TEST) * F.pow(F.lit(2), i)).cast("int"))
    tested = paths.where(F.col("depth") >= FIRST_TEST).select(
        "key", "path", "depth", F.explode(tests).alias("bound")).where("bound <= depth")
    tested = tested.select("key", "bound", _key_at(F.col("bound")).alias("prefix"))
    alone = tested.groupBy("prefix").agg(
        F.count("*").alias("paths"), F.first("key").alias("key"), F.first("bound").alias("bound")).where("paths = 1")
    return alone.groupBy("key").agg(F.min("bound").alias("bound"))


_NODE = ("depth int, key binary, parent binary, conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long")


def _own_tails(paths: DataFrame) -> DataFrame:
    """The nodes from ``bound`` down of paths that are alone there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                conv_id, n, bound = (batch.column(i)[row].as_py() for i in (0, 1, 2))
                path = batch.column(3)[row].as_py()
                sizes = batch.column(4)[row].values.to_numpy()
                depth = np.arange(bound, len(sizes) + 1)
                keys = [path[(d - 1) * KEY:d * KEY] for d in range(bound - 1, len(sizes) + 1)]
                saved = (n - 1) * sizes[bound - 1:][::-1].cumsum()[::-1]
                same = np.ones(len(depth), np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(depth, pa.int32()), pa.array(keys[1:], pa.binary()), pa.array(keys[:-1], pa.binary()),
                    pa.array(same * conv_id), pa.array(same * n), pa.array((depth < len(sizes)).astype(np.int64)),
                    pa.array(same), pa.array(saved)],
                    names=["depth", "key", "parent", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"])

    return paths.select("conv_id", "n_convs", "bound", "path", "sizes").mapInArrow(run, _NODE)


def _stripped(child: DataFrame, depth: Column) -> DataFrame:
    """What a node at ``depth`` hands to its parent: a path without its last turn."""
    return child.select(
        (depth - 1).cast("int").alias("depth"), "conv_id", "n_convs", F.lit(1).cast("long").alias("children"),
        F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"),
        F.substring("path", F.lit(1), (depth - 1) * KEY).alias("path"),
        F.slice("sizes", F.lit(1), depth - 1).alias("sizes"))


def _level(arrived: DataFrame, depth: int) -> DataFrame:
    """The nodes of one depth, with their paths, from all that arrives there."""
    last = F.coalesce(F.get("sizes", F.lit(depth - 1)), F.lit(0)) if depth else F.lit(0)
    nodes = arrived.groupBy(_key_at(depth).alias("key")).agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("children").alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"),
        F.first("path").alias("path"), F.first("sizes").alias("sizes"))
    return nodes.select(
        F.lit(depth).alias("depth"), "key", _key_at(max(depth - 1, 0)).alias("parent"), "conv_id", "n_convs",
        "n_children", F.when(F.col("n_children") == 0, 1).otherwise(F.col("leaves")).cast("long").alias("n_leaves"),
        (F.col("saved") + (F.col("n_convs") - 1) * last).alias("saved_tokens"), "path", "sizes")


def _peel(paths: DataFrame) -> DataFrame:
    """All nodes of the trie over distinct ``paths`` (key, conv_id, n_convs, depth, path, sizes)."""
    spark = paths.sparkSession
    paths = stage(paths.join(_alone_from(paths), "key", "left"), "trie_paths")
    alone = paths.where(F.col("bound").isNotNull())
    own = stage(_own_tails(alone), "trie_tails")
    bound = F.col("bound")
    tail_size = F.aggregate(F.slice("sizes", bound, F.size("sizes") - bound + 1), F.lit(0).cast("long"),
                            lambda total, size: total + size)
    ends = alone.withColumn("n_leaves", F.lit(1).cast("long")).withColumn(
        "saved_tokens", (F.col("n_convs") - 1) * tail_size)
    none = F.lit(0).cast("long")
    whole = paths.where(bound.isNull()).select(
        "depth", "conv_id", "n_convs", none.alias("children"), none.alias("leaves"), none.alias("saved"),
        "path", "sizes")
    at = fresh_path(spark, "trie_arrivals")
    arrivals = whole.unionByName(_stripped(ends, bound))
    arrivals.write.partitionBy("depth").parquet(at)
    arrivals = spark.read.schema(arrivals.schema).parquet(at)
    deepest = arrivals.agg(F.max("depth")).first()[0]
    levels, above = [], None
    for depth in range(deepest, -1, -1):
        here = arrivals.where(F.col("depth") == depth)
        level = _level(here if above is None else here.unionByName(above), depth)
        path = fresh_path(spark, "trie_level")
        level.write.parquet(path)
        levels.append(path)
        above = _stripped(spark.read.schema(level.schema).parquet(path), F.lit(depth))
    columns = [c.split()[0] for c in _NODE.split(", ")]
    return spark.read.schema(level.schema).parquet(*levels).select(columns).unionByName(own)


def _member_hashes(members: DataFrame) -> DataFrame:
    """key, ends_sha256: the hash over the ascending ids, comma-joined, of the members (key, conv_id).

    Rows are dealt by range of key and id, so the members of one node lie in many tasks, each of which
    writes its ids as rows of ``CHUNK`` bytes.  SHA-256 itself can only run from front to back: the
    chunks of a node pass through one task in order, which keeps nothing but the state of the hash.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids, size = None, 0, [], 0
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key or size > CHUNK:
                    if ids:
                        yield chunk(key, first, ids)
                    key, first, ids, size = k, c, [], 0
                ids.append(b"%d" % c)
                size += len(ids[-1]) + 1
        if ids:
            yield chunk(key, first, ids)

    def chunk(key: bytes, first: int, ids: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([key], pa.binary()), pa.array([first]), pa.array([b",".join(ids)], pa.binary()),
        ], names=["key", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for k, ids in zip(batch.column(0), batch.column(1), strict=True):
                k = k.as_py()
                if k != key:
                    if state is not None:
                        done.append((key, state.hexdigest()))
                    key, state = k, sha256(ids.as_buffer())
                else:
                    state.update(b",")
                    state.update(ids.as_buffer())
            yield result(done)
        if state is not None:
            yield result([(key, state.hexdigest())])

    def result(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([k for k, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string()),
        ], names=["key", "ends_sha256"])

    ordered = members.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    chunks = ordered.mapInArrow(write, "key binary, first long, ids binary")
    together = chunks.repartition("key").sortWithinPartitions("key", "first")
    return together.select("key", "ids").mapInArrow(digest, "key binary, ends_sha256 string")


def prefix_trie(lists: DataFrame) -> DataFrame:
    """One row per node of the trie over ``lists`` (conv_id, turns as :func:`turn_lists` makes them).

    Columns: conv_id (the smallest member: a conversation that starts with the node), depth (turns; the
    root has 0), parent_conv_id (the smallest member of the parent, NULL for the root), n_convs (members),
    n_children, n_leaves (childless nodes in the subtree, itself included), saved_tokens (over the subtree,
    bytes of the last text times members but one) and ends_sha256 (of the ascending ids of the members that
    end here, comma-joined).  A conversation without turns ends at the root.  Equal conversations end
    at one node.  No conversations give no rows, not even a root.
    """
    chained = stage(_chained(lists).withColumn("depth", F.size("sizes")).withColumn(
        "key", _key_at(F.col("depth"))), "trie_members")
    if not chained.take(1):
        return lists.sparkSession.createDataFrame([], (
            "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
            "saved_tokens long, ends_sha256 string"))
    paths = chained.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("depth").alias("depth"),
        F.first("path").alias("path"), F.first("sizes").alias("sizes"))
    nodes = _peel(paths)
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    # The parent's side has each key once; children of one parent may be many, which the skew join splits.
    up = nodes.where("depth > 0").join(parents, "parent").unionByName(
        nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    hashes = _member_hashes(chained.select("key", "conv_id"))
    return up.join(hashes, "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(ROOT), 256)).alias("ends_sha256"))
