"""Near-duplicate documents: minhash tables with tensored banding, then an exact check.

Word shingles of a text are hashed; a text's candidates are the texts that share a table key with
it.  A key of a banded minhash index takes several minhashes, and many tables are needed, so minhashes
dominate.  Here two small collections of c tuples of t minhashes each are computed
and every pair of a tuple of the first and one of the second makes a table key: c**2 tables
from 2 * c * t minhashes (Christiani 2017; Dahlgaard, Knudsen and Thorup 2017).  A
pair of similarity s is missed with probability at most 2 * (1 - s**t)**c for tuples of t.  Tuples are as long
as ``COLLECTION`` of them keep that below ``MISS`` at the threshold: 3 for 0.85, 2 for 0.8 (1.5e-4 and 7.3e-5).
Single minhashes take larger collections for low thresholds.  Most keys occur once; these are counted out on
their own before any row of a document is dealt by key.

Texts with equal shingle sets are one node.  A table bucket is not expanded into its pairs: its most
connected member is checked against all others and taken out; buckets whose members are by then in
one component are done, the others go through the same step again.  What still is in doubt after a few
steps (many variants of a text that are not alike enough themselves) goes through an exact set-similarity
join: shingles ordered by frequency, prefix, length and positional filter.  Every pair that shares a
bucket is so either checked, already connected, or ruled out.  Checks are on whole shingle sets.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom.llm.common import Memo, bound_batches, each_text, if_small, is_empty, mix64, odd_numbers
from timeloom.llm.components import connected
from timeloom.plans.session import release, stage

SHINGLE = 5
LONGEST_TUPLE, COLLECTION = 3, 10
#: Probability that a pair at the threshold shares no table key, at most.
MISS = 1.5e-4
#: Steps in which buckets lose their most connected member before the exact join.
STAR_STEPS = 3
_PLACE = odd_numbers(107, SHINGLE)
_FOLD = odd_numbers(109, LONGEST_TUPLE)


def shape(percent: int) -> tuple[int, int]:
    """Minhashes of a tuple and tuples of each collection for a threshold in per cent."""
    if not 0 < percent <= 100:
        raise ValueError(f"percent must be above 0 and at most 100: {percent}")
    for t in range(LONGEST_TUPLE, 0, -1):
        apart = 1 - (percent / 100) ** t
        if 2 * apart ** COLLECTION <= MISS:
            return t, COLLECTION
    return 1, math.ceil(math.log(MISS / 2) / math.log(apart))


#: Words whose hashes a worker remembers.
MOST_WORDS = 100_000


@lru_cache
def _hashing(t: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors and masks of the minhashes, and masks of the tables."""
    return odd_numbers(101, 2 * size * t), odd_numbers(103, 2 * size * t), odd_numbers(113, size * size)


def shingle_set(text: bytes, memo: Memo) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a short text is one shingle of all words.

    ASCII letters are lower-cased; words are cut at ASCII white space.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    memo.trim()
    ids = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    total = np.full(n, size, np.uint64)
    for i in range(size):
        total += mix64(ids[i:i + n] + _PLACE[i]) * _PLACE[i]
    return np.unique(mix64(total))


def table_keys(shingles: np.ndarray, t: int = LONGEST_TUPLE, size: int = COLLECTION) -> np.ndarray:
    """The size**2 table keys of a set."""
    factors, masks, tables = _hashing(t, size)
    least = np.full(len(factors), np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 4096):
        x = (shingles[at:at + 4096, None] ^ masks) * factors
        least = np.minimum(least, (x ^ x >> np.uint64(29)).min(axis=0))
    tuples = (mix64(least.reshape(2, size, t)) * _FOLD[:t]).sum(axis=2)
    pairs = mix64(tuples[0])[:, None] + mix64(tuples[1] * _FOLD[0])[None, :]
    return mix64(pairs.reshape(-1) ^ tables).view(np.int64)


def _word_hash() -> Memo:
    return Memo(xxhash.xxh64_intdigest, most=MOST_WORDS)


def signatures(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, key (a hash of the text), n_shingles, a 128-bit digest of the set, and its table keys."""
    t, size = shape(percent)
    bound_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _word_hash()
        for batch, texts in each_text(batches):
            sizes, digests, keys = [], [], []
            for text in texts:
                found = shingle_set(text, memo)
                sizes.append(len(found))
                digests.append(blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                keys.append(table_keys(found, t, size) if len(found) else np.empty(0, np.int64))
            offsets = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys))),
            ], names=["doc_id", "key", "n_shingles", "digest", "keys"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"),
                         _text_key("text").alias("key"))
    return source.mapInArrow(run, "doc_id long, key long, n_shingles long, digest binary, keys array<long>")


def _text_key(text: str) -> Column:
    """A hash of a text; a missing one has none."""
    return F.when(F.col(text).isNotNull(), F.xxhash64(text))


def _alike(n: str, m: str, percent: int):
    """Sizes that do not rule the similarity out."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _check(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are similar enough, as edges."""
    pairs = stage(pairs, "pairs")
    nodes = stage(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "pair_nodes")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _word_hash()
        for batch, texts in each_text(batches):
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([shingle_set(t, memo).tobytes() for t in texts], pa.binary()),
            ], names=["node", "shingles"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x = np.frombuffer(x.as_buffer(), np.uint64)
                y = np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").alias("text"))
    found = texts.join(if_small(nodes), "node").mapInArrow(sets, "node long, shingles binary")
    found = stage(found, "pair_sets")
    joined = pairs.join(found.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").join(
        found.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    edges = stage(joined.select("a", "b", "x", "y").mapInArrow(check, "a long, b long"), "links")
    release(pairs, nodes, found)
    return edges


def _pairs(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def linked(nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame | None:
    """node, component of the ``nodes`` (node, n, keys) that are linked with others; None if no two share a key."""
    rows = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = stage(rows.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "shared_keys")
    shared_rows = stage(rows.join(if_small(shared), "key"), "buckets")
    weight = shared_rows.groupBy("node").agg(F.sum("members").alias("weight"))
    rows = stage(shared_rows.drop("members").join(weight, "node"), "buckets")
    release(shared, shared_rows)
    components = None
    for _ in range(STAR_STEPS):
        if is_empty(rows):
            return components
        best = F.max(F.struct("weight", -F.col("node"), "n")).alias("best")
        heads = rows.groupBy("key").agg(best).select(
            "key", (-F.col("best")["col2"]).alias("head"), F.col("best")["n"].alias("head_n"))
        others = rows.join(heads, "key").where("node != head")
        pairs = others.where(_alike("n", "head_n", percent)).select(*_pairs("node", "head"))
        found = _check(pairs.distinct(), docs, percent)
        components = _joined_by(components, found)
        left = _undecided(others.drop("head", "head_n"), components)
        release(rows)
        rows = left
    if is_empty(rows):
        return components
    pairs = _exact_pairs(rows.select("node", "n", "component").distinct(), docs, percent)
    return _joined_by(components, _check(pairs, docs, percent))


def _joined_by(components: DataFrame | None, edges: DataFrame) -> DataFrame:
    """The components with more edges; those found before stand for their edges."""
    if components is not None:
        edges = edges.union(components.select("node", "component"))
    return connected(edges)


def _exact_pairs(nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs of ``nodes`` (node, n, component) of two components that may be similar enough.

    Two such sets share a shingle among the n - ceil(percent * n / 100) + 1 rarest of either, and from the
    first shared one on both have enough shingles left for the overlap that the similarity takes.
    """
    nodes = stage(nodes, "doubtful")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _word_hash()
        for batch, texts in each_text(batches):
            for i, text in enumerate(texts):
                found = shingle_set(text, memo).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), batch.column(0)[i].as_py())), pa.array(found)],
                    names=["node", "key"])

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").alias("text"))
    shingles = texts.join(if_small(nodes.select("node")), "node").mapInArrow(sets, "node long, key long")
    shingles = stage(shingles.distinct(), "doubtful_shingles")
    counts = shingles.groupBy("key").agg(F.count("*").alias("texts"))
    ordered = shingles.join(counts, "key").groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("texts", "key"))).alias("order"))
    prefix = F.slice("order", F.lit(1), (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int"))
    posted = ordered.join(nodes, "node").select(
        "node", "n", "component", F.posexplode(prefix).alias("at", "s")).where("s.texts > 1")
    rows = posted.select("node", "n", "component", "at", F.col("s.key").alias("key"))
    mixed = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")
                                    ).where("low != high").select("key")
    rows = stage(rows.join(mixed, "key"), "doubtful_prefixes")
    release(nodes, shingles)

    def may(x: str, y: str) -> Column:
        left = F.least(F.col(f"{x}.n") - F.col(f"{x}.at"), F.col(f"{y}.n") - F.col(f"{y}.at"))
        enough = left * (100 + percent) >= (F.col(f"{x}.n") + F.col(f"{y}.n")) * percent
        return ((F.col(f"{x}.key") == F.col(f"{y}.key")) & enough & _alike(f"{x}.n", f"{y}.n", percent)
                & (F.col(f"{x}.component") != F.col(f"{y}.component")))

    # First against the best place of each component and size: most texts have no partner at all.
    best = rows.groupBy("key", "component", "n").agg(F.min("at").alias("at"))
    rows = stage(rows.alias("x").join(best.alias("y"), may("x", "y"), "left_semi"), "doubtful_prefixes")
    both = rows.alias("x").join(rows.alias("y"), may("x", "y") & (F.col("x.node") < F.col("y.node")))
    return both.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _undecided(rows: DataFrame, components: DataFrame) -> DataFrame:
    """The buckets whose members are not all in one component yet."""
    rows = rows.drop("component").join(components, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    mixed = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")
                                    ).where("low != high").select("key")
    return stage(rows.join(mixed, "key"), "buckets")


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Every row's size of its shingle set and the smallest doc_id it is linked with.

    Columns: doc_id, n_shingles, component_id, kept.  Two documents are linked when their sets share at
    least ``percent`` per cent of their union; links chain.  A text without words (missing, empty, white
    space) has no shingles and no links.  A row without doc_id has no links and component_id NULL, and is
    kept.  Rows that share a doc_id each come back; with different texts they are told apart by text.
    Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    return _judged(docs, percent).select("doc_id", "n_shingles", "component_id", "kept")


def _judged(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, key, n_shingles, component_id, kept, component (its number; NULL without words)."""
    made = stage(signatures(docs, percent), "signatures")
    sets = made.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    several = stage(sets.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where(
        "low != high").select("doc_id"), "ids_of_several_texts")
    told_apart = not is_empty(several)
    if told_apart:
        # An id with several sets does not name one; such a set is found by id and text, and numbered by its digest.
        marked = sets.join(if_small(several.withColumn("shared", F.lit(True))), "doc_id", "left").withColumn(
            "shared", F.coalesce("shared", F.lit(False)))
        classes = marked.groupBy("digest").agg(
            F.min(F.struct("shared", "doc_id", "key")).alias("head"), F.min("doc_id").alias("least_id"),
            F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
        classes = stage(classes.withColumn("node", F.when(F.col("head.shared"), F.xxhash64("digest")).otherwise(
            F.col("head.doc_id"))), "classes")
        # Rows of a shared id that stand for no class have no number.
        named = classes.where("head.shared").select("head.doc_id", "head.key", "node")
        texts = texts.withColumn("key", _text_key("text")).join(
            if_small(several.withColumn("shared", F.lit(True))), "doc_id", "left").join(
            if_small(named), ["doc_id", "key"], "left").select(
            F.when(F.col("shared"), F.col("node")).otherwise(F.col("doc_id")).alias("doc_id"), "text")
    else:
        classes = sets.groupBy("digest").agg(
            F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
        classes = classes.withColumn("least_id", F.col("node"))
    components = linked(classes.select("node", "n", "keys"), texts, percent)
    known = classes.select("digest", "node", "least_id")
    if components is not None:
        known = known.join(components, "node", "left").select(
            "digest", "least_id", F.coalesce("component", "node").alias("component"))
    else:
        known = known.withColumnRenamed("node", "component")
    if told_apart:
        ids = known.groupBy("component").agg(F.min("least_id").alias("component_id"))
        known = known.drop("least_id").join(ids, "component")
    else:
        known = known.drop("least_id").withColumn("component_id", F.col("component"))
    out = made.drop("keys").join(known, "digest", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "key", "n_shingles", own.alias("component_id"), "component").withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The documents without those linked to one of a smaller id, with all their columns.

    Of rows with one id and texts that are linked one stays; texts that are not linked all stay.
    """
    again = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1")
    if is_empty(again):
        gone = stage(near_duplicates(docs, percent).where(~F.col("kept")).select("doc_id").distinct(), "gone")
        return docs.join(if_small(gone), "doc_id", "left_anti").select(*docs.columns)
    judged = stage(_judged(docs, percent).where(F.col("doc_id").isNotNull()).select(
        "doc_id", "key", "kept", F.coalesce("component", "key").alias("component")), "judged")
    stay = judged.where("kept").groupBy("doc_id", "component").agg(F.min("key").alias("key"))
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("s.doc_id")) & _text_key("d.text").eqNullSafe(F.col("s.key"))
    known = docs.where(F.col("doc_id").isNotNull())
    # One row of each id and text, by names that no column has.
    key = f"_{uuid.uuid4().hex}"
    left = known.alias("d").join(stage(stay, "stay").alias("s"), same, "left_semi")
    left = left.withColumn(key, _text_key("text")).dropDuplicates(["doc_id", key]).drop(key)
    return left.union(docs.where(F.col("doc_id").isNull()))
