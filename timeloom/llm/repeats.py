"""Repeated passages: longest-previous-factor tests in suffix order, spread over many tasks.

A byte string of ``WINDOW`` bytes that occurs twice has, at both places, the same anchor: the smallest
hash among the strings of ``ANCHOR`` bytes in it (a minimizer).  So it is enough to compare places that
share an anchor.  Anchors that occur once in all texts are left out; around the others the bytes that a
window with this anchor can cover (at most 2 * WINDOW - ANCHOR) meet in one task by the anchor's hash.

There the suffixes of these contexts are put in suffix order, from the last column to the first by
stable radix passes, which gives the suffix array of every column in turn.  A suffix has an earlier
match of WINDOW bytes, i.e. its longest previous factor is that long, just if a smaller position stands
before or after it in suffix order with all neighbours between sharing WINDOW bytes; in such a run this
holds for all positions but the smallest.  So a run gives the later copies, or all copies.

Places with the same bytes around them are told by a hash of these bytes: all but the first have an
earlier match for every window, and only the first is compared with others, so copies of a passage cost a
count each.  An anchor with very many different surroundings is not gathered in one task.  Its windows are
split by where the anchor stands in them: windows of a range of offsets share a longer core, by whose hash
they are counted anew, until few different surroundings share a core.  Texts that are equal as a whole are
compared once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom.llm.common import bound_batches, each_text, if_small, is_empty, mix64, text_bytes
from timeloom.plans.session import stage

WINDOW, ANCHOR = 200, 64
#: Bytes of a text that are hashed at a time; portions overlap by a window.
PORTION = 1 << 20
#: Different surroundings of an anchor that may meet in a task; ranges are cut in this many parts beyond.
GROUP, FAN = 4000, 3
#: Contexts that are sorted at a time.
BATCH = 8192
_BYTE = np.random.default_rng(17).integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        most = 1 << max(12, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(most, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def _sums(text: np.ndarray) -> np.ndarray:
    """Running sums of weighted bytes; differences give the hash of any string."""
    n = text.shape[-1]
    up, _ = _power(n + 1)
    sums = np.zeros((*text.shape[:-1], n + 1), np.uint64)
    np.cumsum(_BYTE[text] * up[:n], axis=-1, out=sums[..., 1:])
    return sums


def string_hashes(text: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every string of ``size`` bytes; rows of a matrix are hashed each."""
    return _hashes(_sums(text), size)


def _hashes(sums: np.ndarray, size: int) -> np.ndarray:
    n = sums.shape[-1] - 1
    _, down = _power(n + 1)
    return mix64((sums[..., size:] - sums[..., :n - size + 1]) * down[:n - size + 1])


def sliding(x: np.ndarray, size: int, of: np.ufunc, fill: int) -> np.ndarray:
    """``of`` over all runs of ``size`` values: running values from both ends of blocks."""
    n = len(x)
    blocks = np.concatenate([x, np.full(-n % size, fill, x.dtype)]).reshape(-1, size)
    ahead = of.accumulate(blocks, axis=1).reshape(-1)
    back = of.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return of(back[:n - size + 1], ahead[size - 1:n])


def anchors(text: bytes, window: int = WINDOW, size: int = ANCHOR
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of all windows of a text, and hashes of what is around.

    The last also covers how far the text reaches on either side.
    """
    out: list[tuple[np.ndarray, ...]] = []
    reach = window - size
    span = reach + 1
    top = np.iinfo(np.uint64).max
    for first in range(0, max(1, len(text) - window + 1), PORTION):
        # The windows that start in this portion, with what is around their anchors.
        low, high = max(0, first - reach), min(len(text), first + PORTION + window + reach + window)
        part = np.frombuffer(text, np.uint8, high - low, low)
        sums = _sums(part)
        own = slice(first - low, min(len(text), first + PORTION + window - 1) - low)
        if own.stop - own.start < window:
            break
        h = _hashes(sums[own.start:own.stop + 1], size)
        least = sliding(h, span, np.minimum, top)
        edge = np.zeros(span - 1, np.uint64)
        at = np.flatnonzero(sliding(np.concatenate([edge, least, edge]), span, np.maximum, 0) == h)
        place = at + own.start
        start, end = np.maximum(place - reach, 0), np.minimum(place + window, len(part))
        _, down = _power(len(part) + 1)
        around = (sums[end] - sums[start]) * down[start]
        shape = ((place - start) * (2 * window) + (end - place)).astype(np.uint64)
        out.append((place + low, h[at], mix64(around ^ mix64(shape))))
    if not out:
        return np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
    positions, hashes, around = (np.concatenate(x) for x in zip(*out, strict=True))
    where, which = np.unique(positions, return_index=True)
    return where.astype(np.int32), hashes[which].view(np.int64), around[which].view(np.int64)


def _scan(docs: DataFrame) -> DataFrame:
    """One row per text: node (its number), doc_id, key, n_bytes, digest, anchors and surroundings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in each_text(batches):
            sizes, digests, where, which, around = [], [], [], [], []
            for text in texts:
                sizes.append(len(text))
                digests.append(blake2b(text, digest_size=16).digest())
                for column, values in zip((where, which, around), anchors(text), strict=True):
                    column.append(values)
            offsets = pa.array(np.cumsum([0, *map(len, where)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(sizes, pa.int64()),
                pa.array(digests, pa.binary()),
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(where))),
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(which))),
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(around))),
            ], names=["doc_id", "key", "n_bytes", "digest", "positions", "hashes", "spans"])

    found = keyed(docs).mapInArrow(run, "doc_id long, key long, n_bytes long, digest binary, "
                                        "positions array<int>, hashes array<long>, spans array<long>")
    return stage(found.withColumn("node", F.monotonically_increasing_id()), "repeat_anchors")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, text; the first two find a text again."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"),
                       text.alias("text"))


def _with_text(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, doc_id, text of the given nodes (node, doc_id, key, again), one row each.

    ``again`` marks nodes whose id and text stand on several rows.
    """
    same = F.col("n.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("n.key") == F.col("d.key"))
    found = keyed(docs).alias("d").join(if_small(nodes).alias("n"), same)
    once = found.where(~F.col("n.again")).select("n.node", "n.doc_id", "d.text")
    if is_empty(nodes.where("again")):
        return once
    several = found.where("n.again").select("n.node", "n.doc_id", "d.text").dropDuplicates(["node"])
    return once.union(several)


_CONTEXT = "anchor long, low int, high int, node long, doc_id long, pos int, left int, context binary"


def _contexts(nodes: DataFrame, shared: DataFrame, docs: DataFrame) -> DataFrame:
    """The bytes around the given places of anchors."""
    places = shared.groupBy("node").agg(F.collect_list(F.struct("pos", "hash")).alias("places"))
    reach = WINDOW - ANCHOR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in each_text(batches):
            nodes, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            offsets = batch.column(3).offsets.to_numpy()
            flat = batch.column(3).values
            where = flat.field("pos").to_numpy(zero_copy_only=False)
            which = flat.field("hash").to_numpy(zero_copy_only=False)
            for i, text in enumerate(texts):
                here = slice(offsets[i], offsets[i + 1])
                at = where[here].tolist()
                if not at:
                    continue
                n = len(at)
                cut = [text[max(0, p - reach):p + WINDOW] for p in at]
                yield pa.RecordBatch.from_arrays([
                    pa.array(which[here]), pa.array(np.zeros(n, np.int32)),
                    pa.array(np.full(n, reach + 1, np.int32)), pa.array([nodes[i]] * n, pa.int64()),
                    pa.array([ids[i]] * n, pa.int64()), pa.array(at, pa.int32()),
                    pa.array([min(reach, p) for p in at], pa.int32()), pa.array(cut, pa.binary()),
                ], names=["anchor", "low", "high", "node", "doc_id", "pos", "left", "context"])

    chosen = stage(places.join(nodes, "node"), "repeat_places")
    texts = _with_text(chosen.select("node", "doc_id", "key", "again"), docs)
    joined = texts.join(chosen.select("node", "places"), "node")
    return joined.select("node", "doc_id", "text", "places").mapInArrow(run, _CONTEXT)


def _narrow(rows: DataFrame) -> DataFrame:
    """Split the offsets of crowded places: one row per place and part, with its core's hash.

    ``span`` is the hash of all the bytes that the part's windows can cover inside the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in batch.schema.names} | {"span": []}
            for row in batch.to_pylist():
                context, left = row["context"], row["left"]
                low, high = row["low"], row["high"]
                step = -(-(high - low) // FAN)
                for a in range(low, high, step):
                    b = min(high, a + step)
                    start, end = left - a, left - (b - 1) + WINDOW
                    if start < 0 or end > len(context):
                        continue  # not even the core is inside the text
                    core = context[start:end]
                    first = max(0, left - (b - 1))
                    wide = context[first:left - a + WINDOW]
                    row |= {"low": a, "high": b, "anchor": _digest(core, a),
                            "span": _digest(wide, left - first)}
                    for name, values in out.items():
                        values.append(row[name])
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(out.values(), [*batch.schema.types, pa.int64()],
                                                strict=True)], names=list(out))

    return rows.mapInArrow(run, f"{_CONTEXT}, span long")


def _digest(data: bytes, salt: int) -> int:
    return int.from_bytes(blake2b(data, digest_size=8, salt=salt.to_bytes(8, "little", signed=True)
                                  ).digest(), "little", signed=True)


def resolve(rows: dict[str, np.ndarray], contexts: list[bytes], keep_first: bool
            ) -> list[tuple[int, int, int]]:
    """(row, start, end) of the bytes of repeated windows, relative to the text.

    ``rows`` has low, high, pos, left and rank (the order of places) of contexts; all places that can
    share a window are among them.
    """
    n, reach = len(contexts), WINDOW - ANCHOR
    width = reach + WINDOW
    size = np.array([len(c) for c in contexts])
    left = rows["left"]
    # Columns of the anchor's start coincide; bytes outside a text are zero and never in a window.
    table = np.zeros((n, width), np.uint8)
    inside = np.arange(width)[None, :] - (reach - left)[:, None]
    fits = (inside >= 0) & (inside < size[:, None])
    table[fits] = np.frombuffer(b"".join(contexts), np.uint8)
    hashes = string_hashes(table, WINDOW)
    columns = np.ascontiguousarray(table.T)
    repeated = np.zeros((n, reach + 1), bool)
    order = np.arange(n)
    rank = rows["rank"]
    for c in range(width - 1, -1, -1):
        order = order[np.argsort(columns[c][order], kind="stable")]
        if c > reach:
            continue
        offset = reach - c
        valid = ((rows["low"] <= offset) & (offset < rows["high"]) & (left >= offset)
                 & (left - offset + WINDOW <= size))
        here = order[valid[order]]  # a place may stand here once for every range of offsets
        h = hashes[here, c]
        same = np.zeros(len(h), bool)
        same[1:] = h[1:] == h[:-1]
        if not same.any():
            continue
        starts = np.flatnonzero(~same)
        run = np.cumsum(~same) - 1
        if keep_first:
            ranks = rank[here]
            hit = ranks > np.minimum.reduceat(ranks, starts)[run]
        else:
            hit = np.diff(np.append(starts, len(h)))[run] > 1
        repeated[here, c] = hit
    edge = np.zeros((n, 1), bool)
    steps = np.diff(np.concatenate([edge, repeated, edge], axis=1).astype(np.int8), axis=1)
    row, first = np.nonzero(steps == 1)
    _, after = np.nonzero(steps == -1)
    start = rows["pos"][row] - reach + first
    return list(zip(row.tolist(), start.tolist(), (start + (after - first) - 1 + WINDOW).tolist(),
                    strict=True))


def _resolve_groups(rows: DataFrame, keep_first: bool) -> DataFrame:
    """Repeated bytes among places that share an anchor: node, start, end."""

    def solve(part: pa.Table) -> pa.RecordBatch:
        cells = {k: part.column(k).to_numpy() for k in ("low", "high", "pos", "left", "node")}
        ids = np.array([d if d is not None else np.iinfo(np.int64).max
                        for d in part.column("doc_id").to_pylist()], np.int64)
        cells["rank"] = np.empty(len(ids), np.int64)
        cells["rank"][np.lexsort((cells["pos"], cells["node"], ids))] = np.arange(len(ids))
        found = resolve(cells, part.column("context").to_pylist(), keep_first)
        row, start, end = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (
            np.empty(0, np.int64),) * 3
        return pa.RecordBatch.from_arrays(
            [pa.array(cells["node"][row]), pa.array(start), pa.array(end)], names=["node", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= BATCH:
                part = pa.Table.from_batches(held)
                keys = part.column("anchor").to_numpy()
                last = int(np.searchsorted(keys == keys[-1], True))  # the last group may go on
                if last:
                    yield solve(part.slice(0, last))
                    held = part.slice(last).to_batches()
        if held:
            part = pa.Table.from_batches(held)
            if len(part):
                yield solve(part)

    # One row per place: places of one anchor meet, at most GROUP of them.
    met = rows.repartition("anchor").sortWithinPartitions("anchor")
    return met.mapInArrow(run, "node long, start long, end long")


def _first() -> Column:
    """The place that comes first: by doc_id (a missing one last), text, position."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node", "pos")).alias("first")


def _crowded(rows: DataFrame, keep_first: bool) -> list[DataFrame]:
    """Repeated bytes among contexts whose anchor has more than GROUP different surroundings."""
    found = []
    names = ["anchor", "low", "high", "node", "doc_id", "pos", "left", "context"]
    part = ["anchor", "low", "high"]
    while not is_empty(rows):
        parts = stage(_narrow(rows), "repeat_parts")
        classes = parts.groupBy(*part, "span").agg(F.count("*").alias("places"), _first())
        groups = classes.groupBy(*part).agg(F.sum("places").alias("total"), F.count("*").alias("spans")
                                            ).where("total > 1")
        classes = stage(classes.join(groups, part), "repeat_classes")
        joined = stage(parts.join(classes.drop("total"), [*part, "span"]), "repeat_groups")
        own = (F.col("first.node") == F.col("node")) & (F.col("first.pos") == F.col("pos"))
        done = joined.where(F.col("places") > 1)
        start = F.col("pos") - F.least(F.col("left"), F.col("high") - 1)
        end = F.least(F.col("pos") - F.col("low") + WINDOW,
                      F.col("pos") - F.col("left") + F.octet_length("context"))
        found.append((done.where(~own) if keep_first else done).select(
            "node", start.cast("long").alias("start"), end.cast("long").alias("end")))
        heads = joined.where(own & (F.col("spans") > 1))
        found.append(_resolve_groups(heads.where(F.col("spans") <= GROUP).select(*names), keep_first))
        rows = heads.where(F.col("spans") > GROUP).select(*names)
    return found


def repeated_spans(docs: DataFrame, keep_first: bool = False) -> DataFrame:
    """The repeated bytes of texts that have any: doc_id, key, spans (start, end), n_bytes.

    A byte is repeated if a string of WINDOW bytes over it also starts anywhere else in the given texts,
    the same text included; strings are judged on the input.  With ``keep_first`` the first place of
    each string (by doc_id, then position) does not count, so later copies go and one stays; texts that
    overlap themselves (``aaaa``) then keep their beginning only.  ``key`` is the hash that
    ``keyed`` gives a text.  Rows with equal id and text are one row here (with ``keep_first`` they are one
    document, else they repeat each other).  A missing text is empty; a missing id is the last in order.
    """
    bound_batches(docs)
    made = _scan(docs)
    narrow = made.select("node", "doc_id", "key", "digest", "n_bytes").where(F.col("n_bytes") >= WINDOW)
    same = narrow.groupBy("digest").agg(
        F.count("*").alias("copies"), F.countDistinct("doc_id", "key").alias("others"),
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("head")).where("copies > 1")
    copies = stage(narrow.join(same.select("digest", "others", F.col("head.node").alias("head")), "digest"),
                   "repeat_copies")
    later = copies.where("node != head").select("node")
    single = made.join(if_small(later), "node", "left_anti")
    places = single.select("node", "doc_id", "n_bytes", F.explode(
        F.arrays_zip("positions", "hashes", "spans")).alias("at")).select(
        "node", "doc_id", "n_bytes", F.col("at.positions").alias("pos"), F.col("at.hashes").alias("hash"),
        F.col("at.spans").alias("span"))
    classes = places.groupBy("hash", "span").agg(F.count("*").alias("places"), _first())
    classes = stage(classes, "repeat_classes")
    # Anchors with several surroundings: the first place of each is compared.
    several = classes.groupBy("hash").agg(F.count("*").alias("spans")).where("spans > 1")
    heads = classes.join(several, "hash").select("hash", "spans", "first.node", "first.pos")
    heads = stage(heads, "repeat_heads")
    crowded = stage(heads.where(F.col("spans") > GROUP).select(F.col("hash").alias("anchor")).distinct(),
                    "crowded")
    again = copies.groupBy("doc_id", "key").agg(F.count("*").alias("rows"), F.min("head").alias("head")).where("rows > 1")
    again = again.select(F.col("head").alias("node"), F.lit(True).alias("twice")).distinct()
    nodes = made.select("node", "doc_id", "key").join(if_small(stage(again, "repeat_rows")), "node", "left").select(
        "node", "doc_id", "key", F.coalesce("twice", F.lit(False)).alias("again"))
    contexts = stage(_contexts(nodes, heads.select("node", "pos", "hash"), docs), "repeat_contexts")
    few = if_small(crowded)
    found = [_resolve_groups(contexts.join(few, "anchor", "left_anti"), keep_first)]
    if not is_empty(crowded):
        found += _crowded(contexts.join(few, "anchor", "left_semi"), keep_first)
    # Equal surroundings: every window is repeated, and all places but the first have an earlier one.
    equal = places.join(classes.where("places > 1").select("hash", "span", "first"), ["hash", "span"])
    if keep_first:
        equal = equal.where(~((F.col("first.node") == F.col("node")) & (F.col("first.pos") == F.col("pos"))))
    found.append(equal.select(
        "node", F.greatest(F.col("pos") - (WINDOW - ANCHOR), F.lit(0)).cast("long").alias("start"),
        F.least(F.col("pos") + WINDOW, F.col("n_bytes")).cast("long").alias("end")))
    spans = found[0]
    for more in found[1:]:
        spans = spans.union(more)
    merged = _merged(spans.groupBy("node").agg(F.collect_set(F.struct("start", "end")).alias("spans")))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    gone = copies.where("node != head") if keep_first else copies
    gone = gone.select("doc_id", "key", "n_bytes", whole.alias("spans"))
    if keep_first:
        # Equal rows (id and text) are the head itself; they keep what the head keeps.
        heads = copies.where("node = head").select("doc_id", "key").distinct()
        again = F.col("g.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("g.key") == F.col("h.key"))
        gone = gone.alias("g").join(heads.alias("h"), again, "left_anti")
        rest = merged.join(single.select("node", "doc_id", "key", "n_bytes"), "node")
    else:
        rest = merged.join(single.select("node", "doc_id", "key", "n_bytes"), "node").join(
            copies.select("node"), "node", "left_anti")
    out = gone.union(rest.select("doc_id", "key", "n_bytes", "spans"))
    return stage(out.dropDuplicates(["doc_id", "key"]), "repeat_spans")


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes in any of the spans."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _merged(rows: DataFrame) -> DataFrame:
    """node, spans with each list of spans as its maximal runs."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [[{"start": a, "end": b} for a, b in merge_spans([(s["start"], s["end"]) for s in x.as_py()])]
                    for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, kind)], names=["node", "spans"])

    return rows.mapInArrow(run, "node long, spans array<struct<start: long, end: long>>")


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at:start])
        at = end
    return b"".join([*kept, text[at:]])


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans shrunk to character bounds, so that what stays is valid UTF-8."""
    out = []
    for start, end in spans:
        while start < end and text[start] & 0xC0 == 0x80:
            start += 1
        while end > start and end < len(text) and text[end] & 0xC0 == 0x80:
            end -= 1
        if start < end:
            out.append((start, end))
    return out


def _joined(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Every row of ``docs`` with its spans or none."""
    same = F.col("s.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("s.key") == F.col("d.key"))
    small = spans.agg(F.sum(F.size("spans"))).first()[0] or 0
    side = if_small(spans.select("doc_id", "key", "spans")) if small <= 1_000_000 else spans
    return keyed(docs).alias("d").join(side.alias("s"), same, "left").select("d.doc_id", "d.text", "s.spans")


def digest_without(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of what stays, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in each_text(batches):
            rows: list[tuple] = []
            for text, found in zip(texts, batch.column(2), strict=True):
                cut = merge_spans([(s["start"], s["end"]) for s in found.as_py() or ()])
                rows.append((len(text), sum(b - a for a, b in cut), len(cut),
                             sha256(without(text, cut)).hexdigest()))
            sizes, removed, n, kept = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                pa.array(n, pa.int64()), pa.array(kept, pa.string()),
            ], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _joined(docs, spans).mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def drop_later_copies(docs: DataFrame) -> DataFrame:
    """The documents with later copies of passages cut out of their texts, all columns kept.

    ``text`` and, where there is one, ``n_chars`` change; cuts are shrunk to whole characters.  A text
    without repeats, a missing one included, stays as it is.
    """
    spans = repeated_spans(docs, keep_first=True)
    if is_empty(spans):
        return docs

    @F.arrow_udf("string")
    def cut(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for i, spans in enumerate(found):
            text = text_bytes(texts, i)
            runs = merge_spans([(s["start"], s["end"]) for s in spans.as_py() or ()])
            out.append(without(text, whole_characters(text, runs)))
        return pa.array(out, pa.binary()).cast(pa.string())

    key = F.xxhash64(F.coalesce(F.col("d.text"), F.lit("")))
    same = F.col("s.doc_id").eqNullSafe(F.col("d.doc_id").cast("long")) & (F.col("s.key") == key)
    small = spans.agg(F.sum(F.size("spans"))).first()[0] or 0
    side = if_small(spans.select("doc_id", "key", "spans")) if small <= 1_000_000 else spans
    joined = docs.alias("d").join(side.alias("s"), same, "left")
    # Only texts with something to cut go to Python; a row that is not hit has an empty result there.
    hit = F.col("s.spans").isNotNull() & F.col("d.text").isNotNull()
    text = F.when(hit, cut(F.when(hit, F.col("d.text")), F.col("s.spans"))).otherwise(F.col("d.text"))
    cut_name, hit_name = (f"_{uuid.uuid4().hex}" for _ in range(2))
    out = joined.select(*[F.col(f"d.`{c}`") for c in docs.columns], text.alias(cut_name),
                        F.col("s.spans").isNotNull().alias(hit_name))
    columns = []
    for name in docs.columns:
        if name == "text":
            columns.append(F.col(cut_name).alias("text"))
        elif name == "n_chars":
            kind = docs.schema[name].dataType
            columns.append(F.when(F.col(hit_name), F.length(cut_name)).otherwise(F.col(name))
                           .cast(kind).alias(name))
        else:
            columns.append(F.col(f"`{name}`"))
    return out.select(*columns)
