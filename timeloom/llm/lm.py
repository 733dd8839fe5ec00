"""A hashed maximum-entropy language model with a class-factored softmax.

The probability of a word is that of its class given what stands before it, times that of the word in its
class.  Classes are the end of a text, the most frequent words one by one, and groups of the others by a hash
of their first letters.  The class is a softmax over weights of hashed features: the word before, the two
before together, the words two and three before (skips), and a constant.  The word in its class has its smoothed
share of the class's training tokens; words not met share the mass of one rare word, so the probabilities of
all words of a class sum to 1.

Texts are held in blocks of some megabytes, each with a dictionary of its distinct words, so that a corpus-wide
count or class of a word travels once per block instead of once per token:

* counts: the words of the blocks with their counts, summed over all blocks, and joined back to them;
* training: rounds of distributed stochastic gradient steps over all training blocks; each task starts from the
  model of the round before and the tasks' models are averaged, weighted by their tokens, per range of
  features;
* scoring: blocks meet the counts of their words and are scored in numpy batches.

The model has a fixed size (``FEATURES`` x ``CLASSES``), the counts grow with the corpus and stay in
tables.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom.llm.common import crc_of_id, each_text, mix64
from timeloom.plans.session import stage

FEATURES, CLASSES, HEAD = 1 << 14, 48, 23  # features: at most 1 << 16
#: Text bytes of a block, tokens of a step, features of a range, training rounds.
BLOCK_BYTES, STEP, RANGE, ROUNDS = 8 << 20, 2048, 1 << 9, 4
RATE = 0.5
#: Members of a feature in a step from which on they are summed by themselves.
LARGE = 16
END, START = 0, 1  # numbers of the end of a text and of what stands before its first word


class _Numbers(dict):
    """Numbers of words in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 2
        return number


def _blocks(docs: DataFrame, train: Column) -> DataFrame:
    """Texts in blocks: doc_ids, training flags, lengths, tokens by block number, words, training counts."""

    def build(ids: list, flags: list, texts: list[bytes]) -> dict:
        number = _Numbers()
        out = []
        for text in texts:
            words = text.lower().split()
            out.append(np.fromiter(map(number.__getitem__, words), "<i4", len(words)))
            out.append(np.full(1, END, "<i4"))
        lengths = [len(found) + 1 for found in out[::2]]
        tokens = np.concatenate(out)
        learned = tokens[np.repeat(np.array(flags, bool), lengths)]
        counts = np.bincount(learned, minlength=len(number) + 2)
        return {"ids": ids, "flags": flags, "lengths": lengths, "tokens": pa.compress(tokens.tobytes(), codec="zstd", asbytes=True),
                "words": list(number), "crcs": np.fromiter(map(zlib.crc32, number), "<u4", len(number)).tobytes(),
                "groups": bytes(map(word_group, number)), "counts": counts[2:], "ends": int(counts[END])}

    names = {"ids": pa.list_(pa.int64()), "flags": pa.list_(pa.bool_()), "lengths": pa.list_(pa.int32()),
             "tokens": pa.binary(), "words": pa.list_(pa.binary()), "crcs": pa.binary(), "groups": pa.binary(),
             "counts": pa.list_(pa.int64()),
             "ends": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit() -> pa.RecordBatch:
            row = build(*held)
            return pa.RecordBatch.from_arrays([pa.array([row[n]], t) for n, t in names.items()], names=list(names))

        held: tuple[list, list, list] = ([], [], [])
        size = 0
        for batch, texts in each_text(batches):
            for doc_id, flag, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), texts,
                                          strict=True):
                if held[0] and size + len(text) > BLOCK_BYTES:
                    yield emit()
                    held, size = ([], [], []), 0
                for column, value in zip(held, (doc_id, flag, text), strict=True):
                    column.append(value)
                size += len(text)
        if held[0]:
            yield emit()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"),
                         train.alias("train"))
    made = source.mapInArrow(run, "ids array<long>, flags array<boolean>, lengths array<int>, tokens binary, "
                                  "words array<binary>, crcs binary, groups binary, counts array<long>, ends long")
    return stage(made.withColumn("block", F.monotonically_increasing_id()), "lm_blocks")


def word_group(word: bytes) -> int:
    """The class of a word that has none of its own: by its first letters."""
    return 1 + HEAD + zlib.crc32(word[:2]) % (CLASSES - 1 - HEAD)


class Positions:
    """What a block's words are to the model: classes and hashes by number.

    Class 0 is the end; the most frequent words have their own (``own`` has their places among the words,
    from 1, or 0); others go by their groups.
    """

    def __init__(self, crcs: bytes, groups: bytes, own: list[int]):
        crcs = np.frombuffer(crcs, "<u4")
        n = len(crcs) + 2
        self.classes = np.zeros(n, np.int64)
        self.classes[2:] = np.frombuffer(groups, np.uint8)
        for number, place in enumerate(own, 1):
            if place:
                self.classes[place + 1] = number
        hashes = np.empty(n, np.uint64)
        hashes[:2] = END, START
        hashes[2:] = crcs
        hashes[2:] += np.uint64(2)
        self.hashes = mix64(hashes)

    def features(self, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(tokens, 4) hashed features of what stands before each token of the texts."""
        h = self.hashes[tokens]
        start = self.hashes[START]
        place = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        before = []
        for back in (1, 2, 3):
            moved = np.full(len(h), start)
            moved[back:] = h[:-back] if back < len(h) else h[:0]
            before.append(np.where(place >= back, moved, start))
        one, two, three = before
        salts = np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        columns = (one + salts[0], one * np.uint64(3) + two + salts[1], two + salts[2], three + salts[3])
        return np.stack([mix64(c) & np.uint64(FEATURES - 1) for c in columns], axis=1).view(np.int64)


class Softmax:
    """Class probabilities from four features and a constant."""

    def __init__(self, weights: np.ndarray, constant: np.ndarray):
        self.weights, self.constant = weights, constant

    def _sums(self, features: np.ndarray) -> np.ndarray:
        """Sums of weights, at most 0."""
        z = self.weights.take(features[:, 0], axis=0)
        for j in range(1, features.shape[1]):
            z += self.weights.take(features[:, j], axis=0)
        z += self.constant
        z -= z.max(axis=1, keepdims=True)
        return z

    def logs(self, features: np.ndarray, classes: np.ndarray | None = None) -> np.ndarray:
        """Log probabilities of all classes, or of the given class of each row."""
        z = self._sums(features)
        if classes is None:
            return z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        own = z[np.arange(len(z)), classes]
        return own - np.log(np.exp(z, out=z).sum(axis=1))

    def odds(self, features: np.ndarray) -> np.ndarray:
        """Probabilities of all classes."""
        z = self._sums(features)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        return z


def _sum_groups(rows: np.ndarray, members: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups by falling size, and the sum of each one's rows.

    ``members`` holds the row numbers group after group, ``first`` where each group starts.  Most
    groups are small: their k-th members are added to all sums at once.
    """
    size = np.diff(np.append(first, len(members)))
    by = np.argsort(-size, kind="stable")
    size, first = size[by], first[by]
    total = rows.take(members[first], axis=0)
    for k in range(1, LARGE):
        more = int(np.searchsorted(-size, -k, "left"))  # groups of more than k members
        total[:more] += rows.take(members[first[:more] + k], axis=0)
    for i in range(int(np.searchsorted(-size, -LARGE, "left"))):
        total[i] += rows.take(members[first[i] + LARGE:first[i] + size[i]], axis=0).sum(axis=0)
    return by, total


def _train(model: Softmax, features: np.ndarray, classes: np.ndarray, seen: np.ndarray, rate: float) -> None:
    """AdaGrad steps over the tokens in order; ``seen`` keeps the squared gradients per feature."""
    for at in range(0, len(classes), STEP):
        f, c = features[at:at + STEP], classes[at:at + STEP]
        slope = model.odds(f)
        slope[np.arange(len(c)), c] -= 1
        flat = f.T.reshape(-1).astype(np.uint16)  # short keys have the fast stable sort
        order = np.argsort(flat, kind="stable")
        ids = flat[order]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        by, total = _sum_groups(slope, order % len(c), first)
        ids = ids[first[by]].astype(np.int64)
        seen[ids] += np.einsum("ij,ij->i", total, total) / CLASSES
        total *= (-rate / np.sqrt(seen[ids] + 1.0)).astype(np.float32)[:, None]
        total += model.weights.take(ids, axis=0)
        model.weights[ids] = total
        model.constant -= rate * slope.mean(axis=0)


def _cells(batch: pa.RecordBatch) -> Iterator[dict]:
    """The blocks of a batch; the counts of words stay Arrow arrays."""
    for i in range(len(batch)):
        cells = {name: column[i] for name, column in zip(batch.schema.names, batch.columns, strict=True)}
        yield {name: cell.values if name == "known" else cell.as_py() for name, cell in cells.items()}


def _docs_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array(row["lengths"], np.int64)
    tokens = pa.decompress(row["tokens"], 4 * int(lengths.sum()), "zstd", asbytes=True)
    return np.frombuffer(tokens, "<i4"), lengths, np.array(row["flags"], bool)


def _positions_of(row: dict) -> Positions:
    return Positions(row["crcs"], row["groups"], row["own"])


def _own(head: list[bytes]) -> Column:
    """Where the most frequent words stand among a block's words: from 1, or 0."""
    return F.array(*[F.array_position("words", F.lit(w)) for w in head]).cast("array<long>")


def _round(blocks: DataFrame, model: Softmax, head: list[bytes], rate: float) -> Softmax:
    """One pass over the given blocks: tasks train on their own, their models are averaged."""
    held = blocks.sparkSession.sparkContext.broadcast((model.weights, model.constant))
    ranges = FEATURES // RANGE
    schema = "part int, tokens long, weights binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, constant = held.value
        own = Softmax(weights.copy(), constant.copy())
        seen, n = np.zeros(FEATURES, np.float32), 0
        for batch in batches:
            for row in _cells(batch):
                tokens, lengths, flags = _docs_of(row)
                if not flags.any():
                    continue
                positions = _positions_of(row)
                use = np.repeat(flags, lengths)
                features = positions.features(tokens, lengths)[use]
                _train(own, features, positions.classes[tokens][use], seen, rate)
                n += int(use.sum())
        if n:
            parts = [*own.weights.reshape(ranges, -1), own.constant]
            yield pa.RecordBatch.from_arrays([
                pa.array(range(ranges + 1), pa.int32()), pa.array([n] * (ranges + 1), pa.int64()),
                pa.array([p.astype("<f2" if j < ranges else "<f4").tobytes() for j, p in enumerate(parts)],
                         pa.binary()),
            ], names=["part", "tokens", "weights"])

    def average(rows: pd.DataFrame) -> pd.DataFrame:
        part = int(rows["part"].iloc[0])
        kind = "<f2" if part < ranges else "<f4"
        total, n = 0.0, 0
        for weights, tokens in zip(rows["weights"], rows["tokens"], strict=True):
            total = total + np.frombuffer(weights, kind).astype(np.float64) * tokens
            n += tokens
        return pd.DataFrame({"part": [part], "tokens": [n],
                             "weights": [(total / n).astype("<f4").tobytes()]})

    columns = blocks.select("flags", "lengths", "tokens", "crcs", "groups", _own(head).alias("own"))
    done = columns.mapInArrow(run, schema).groupBy("part").applyInPandas(average, schema).collect()
    held.unpersist()
    if not done:
        return model
    new = Softmax(model.weights.copy(), model.constant.copy())
    for row in done:
        values = np.frombuffer(row["weights"], "<f4")
        if row["part"] < ranges:
            new.weights[row["part"] * RANGE:(row["part"] + 1) * RANGE] = values.reshape(RANGE, CLASSES)
        else:
            new.constant[:] = values
    return new


def score_texts(docs: DataFrame, train: Column) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score of every text.

    ``train`` says which rows to learn from.  Tokens are the words of the text (ASCII letters lower-cased, cut at
    ASCII white space) and one end, so a missing or empty text has one token.  Scores are log10
    probabilities: ``base_score`` of single words, ``score`` of the model.  Repeated rows and missing ids are
    scored as they are; further columns are ignored.  Without training texts the model is uniform over classes.
    """
    blocks = _blocks(docs, train)
    counted = blocks.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).select(
        F.col("w.words").alias("word"), F.col("w.counts").alias("n")).where("n > 0")
    vocabulary = stage(counted.groupBy("word").agg(F.sum("n").alias("n")), "lm_vocabulary")
    ends = blocks.agg(F.sum("ends")).first()[0] or 0
    top = vocabulary.orderBy(F.desc("n"), "word").limit(HEAD).collect()
    head = [bytes(r["word"]) for r in top]
    n, v = vocabulary.agg(F.sum("n"), F.count("*")).first()
    n, v = (n or 0) + ends, v + (1 if ends else 0)

    model = Softmax(np.zeros((FEATURES, CLASSES), np.float32), np.zeros(CLASSES, np.float32))
    tail = CLASSES - 1 - HEAD
    # The class of a word as Positions has it; sizes of the classes: at most CLASSES rows.
    group = F.lit(1 + HEAD) + F.crc32(F.substring("word", 1, 2)) % tail
    for number, word in enumerate(head, 1):
        group = F.when(F.col("word") == F.lit(word), number).otherwise(group)
    sizes = vocabulary.groupBy(group.cast("int").alias("class")).agg(
        F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    in_class = np.zeros((CLASSES, 2))
    for row in sizes:
        in_class[row["class"]] = row["n"], row["v"]
    in_class[END] = ends, min(ends, 1)
    if n:
        model.constant[:] = np.log((in_class[:, 0] + 0.5) / (n + 0.5 * CLASSES))
        turn = F.pmod(F.xxhash64("block"), F.lit(ROUNDS))
        for step in range(ROUNDS):
            model = _round(blocks.where(turn == step), model, head, RATE / (1 + step))

    posted = blocks.select("block", F.posexplode("words").alias("at", "word"))
    known = posted.join(vocabulary, "word").groupBy("block").agg(
        F.collect_list(F.struct("at", "n")).alias("known"))
    joined = blocks.select("block", "ids", "flags", "lengths", "tokens", "crcs", "groups", _own(head).alias("own")
                           ).join(known, "block", "left")
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.constant, in_class))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, constant, size = held.value
        own = Softmax(weights, constant)
        total = np.log10(n + 0.5 * (v + 1))
        for batch in batches:
            for row in _cells(batch):
                known = row["known"]
                tokens, lengths, _ = _docs_of(row)
                positions = _positions_of(row)
                counts = np.zeros(len(positions.classes))
                counts[END] = ends
                if known is not None:
                    counts[known.field("at").to_numpy(zero_copy_only=False) + 2] = known.field("n").to_numpy(
                        zero_copy_only=False)
                classes = positions.classes
                base = np.log10(counts + 0.5) - total
                within = np.log10(counts + 0.5) - np.log10(size[classes, 0] + 0.5 * (size[classes, 1] + 1))
                within[END] = 0.0
                of_class = np.empty(len(tokens))
                features = positions.features(tokens, lengths)
                for at in range(0, len(tokens), 4 * STEP):
                    here = slice(at, at + 4 * STEP)
                    of_class[here] = own.logs(features[here], classes[tokens[here]])
                starts = np.cumsum(lengths) - lengths
                add = lambda x: np.add.reduceat(x, starts)
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["ids"], pa.int64()), pa.array(row["flags"], pa.bool_()),
                    pa.array(lengths), pa.array(add((counts[tokens] > 0).astype(np.int64))),
                    pa.array(add(base[tokens])),
                    pa.array(add(within[tokens] + of_class / np.log(10))),
                ], names=["doc_id", "train", "n_tokens", "n_known", "base_score", "score"])

    out = joined.mapInArrow(score, "doc_id long, train boolean, n_tokens long, n_known long, "
                                   "base_score double, score double")
    return out.withColumn("train_tokens", F.lit(n).cast("long"))


def in_training(folds: int = 5, held_out: int = 1) -> Column:
    return crc_of_id() % folds != held_out
