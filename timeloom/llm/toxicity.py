"""A linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the character n-grams of the words of a text (lower-cased, with a mark at either end),
hashed; a feature is present or not.  Each is scaled by the log ratio of its smoothed document counts
in the two classes (Wang and Manning 2012), the strongest are kept, and a logistic regression with
an L1 penalty is fitted to them.  It is fitted on a bounded sample of the labelled rows
(``max_rows``, drawn by a hash of the id); all texts are scored, whole.

Since n-grams stay inside words, a worker keeps for each word it has met the few of its features
that have a weight, so scoring costs a look-up per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom.llm.common import crc_of_id, each_text, if_small, mix64, odd_numbers, text_bytes
from timeloom.llm.tokens import in_portions
from timeloom.plans.session import stage

SIZES, HASH_BITS = (3, 4, 5), 18
SHARDS, CHUNKS = 16, 64
#: Words whose features a worker remembers.
MOST_WORDS = 100_000
#: Entries that the solver looks at together.
PIECE = 1 << 18
_CODE = odd_numbers(127, max(SIZES))


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of characters of lower-cased words, and how many each word has."""
    texts = [f"\x02{w.decode()}\x03" for w in words]
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(t) for t in texts])
    hashes, owners = [], []
    for n in SIZES:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        total = np.full(m, n, np.uint64)
        for j in range(n):
            total += codes[j:m + j] * _CODE[j]
        inside = owner[:m] == owner[n - 1:]
        hashes.append(mix64(total[inside]) & np.uint64((1 << HASH_BITS) - 1))
        owners.append(owner[:m][inside])
    if not hashes:
        return np.empty(0, np.int64), np.zeros(len(words), np.int64)
    order = np.argsort(np.concatenate(owners), kind="stable")
    counts = np.bincount(np.concatenate(owners), minlength=len(words))
    return np.concatenate(hashes)[order].astype(np.int64), counts


class WordFeatures(dict):
    """Remembers the features of words that a table keeps (feature -> number, -1: none)."""

    def __init__(self, keep: np.ndarray | None = None, most: int = MOST_WORDS):
        super().__init__()
        self.keep, self.most = keep, most

    def learn(self, words: set[bytes]) -> None:
        if len(self) > self.most:
            self.clear()
        new = [w for w in words if w not in self]
        if not new:
            return
        found, counts = word_features(new)
        if self.keep is not None:
            number = self.keep[found]
            kept = number >= 0
            counts = np.bincount(np.repeat(np.arange(len(new)), counts)[kept], minlength=len(new))
            found = number[kept]
        ends = np.cumsum(counts)
        self.update(dict.fromkeys(new, ()))
        for i in np.flatnonzero(counts).tolist():
            self[new[i]] = found[ends[i] - counts[i]:ends[i]].tolist()

    def of_texts(self, texts: list[bytes]) -> Iterator[set[int]]:
        """The features present in each text."""
        cut = [set(t.lower().split()) for t in texts]
        self.learn(set().union(*cut))
        for words in cut:
            yield set().union(*filter(None, map(self.__getitem__, words)))


@dataclass(frozen=True)
class Model:
    """Weights by hashed feature (ratio times coefficient) and the intercept."""

    weights: dict[int, float]
    intercept: float

    def scores(self, texts: list[bytes], memo: WordFeatures) -> list[float]:
        """Probabilities of label 1; ``memo`` keeps the features with a weight."""
        out = []
        for found in memo.of_texts(texts):
            margin = self.intercept + sum(self.weights[f] for f in sorted(found))
            out.append(float(1 / (1 + np.exp(-np.clip(margin, -500, 500)))))
        return out

    def memo(self) -> WordFeatures:
        keep = np.full(1 << HASH_BITS, -1)
        active = list(self.weights)
        keep[active] = active
        return WordFeatures(keep)


def score_column(model: Model, text: str = "text") -> Column:
    """A column with the score of every text; a missing text is empty."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo = model.memo()
        for column in batches:
            texts = (text_bytes(column, i) for i in range(len(column)))
            yield pa.array([s for part in in_portions(texts) for s in model.scores(part, memo)], pa.float64())

    return score(F.col(text))


def sample_of_labelled(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """Texts and labels of at most about ``max_rows`` labelled documents, by a hash of the id.

    Ids labelled both 0 and 1 count as 1; rows without id or label are left out.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    known = stage(known, "known_labels")
    share = min(1.0, max_rows / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    # At most max_rows rows of 12 bytes, up to the evenness of the hash; counted all the same.
    return texts.join(if_small(drawn, 2 * max_rows), "doc_id").select("text", "label").repartition(SHARDS)


def document_counts(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For each hashed feature the number of sampled texts of either class that have it."""
    step = (1 << HASH_BITS) // CHUNKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordFeatures(most=50_000)
        counts = np.zeros((CHUNKS, step, 2), np.uint32)
        flat = counts.reshape(-1, 2)
        for batch, texts in each_text(batches):
            labels = iter(batch.column(1).to_pylist())
            for portion in in_portions(texts, 1 << 18):
                for found in memo.of_texts(portion):
                    flat[np.fromiter(found, np.int64, len(found)), next(labels)] += 1
        yield pa.RecordBatch.from_arrays([
            pa.array(range(CHUNKS), pa.int32()), pa.array([c.tobytes() for c in counts], pa.binary()),
        ], names=["chunk", "counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(r, np.uint32).astype(np.uint64) for r in rows["counts"])
        return pd.DataFrame({"chunk": rows["chunk"][:1], "counts": [total.tobytes()]})

    schema = "chunk int, counts binary"
    found = sample.mapInArrow(count, schema).groupBy("chunk").applyInPandas(add, schema).collect()
    out = np.zeros((CHUNKS, step, 2))
    for row in found:
        out[row["chunk"]] = np.frombuffer(row["counts"], np.uint64).reshape(step, 2)
    return out.reshape(-1, 2)[:, 0], out.reshape(-1, 2)[:, 1]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = 20_000,
        max_features: int = 8192, smoothing: float = 1.0, penalty: float = 2e-4) -> Model:
    """Fit on the documents that ``labels`` (doc_id, label) marks 0 or 1.

    Without rows of both classes the model gives every text the smoothed share of label 1.
    """
    sample = stage(sample_of_labelled(docs, labels, label, max_rows), "toxicity_sample")
    rows = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    none, some = rows.get(0, 0), rows.get(1, 0)
    prior = float(np.log((some + 0.5) / (none + 0.5)))
    if not none or not some:
        return Model({}, prior)
    clean, marked = document_counts(sample)
    p, q = marked + smoothing, clean + smoothing
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    strength = np.abs(ratio) * np.sqrt(clean + marked) * (clean + marked >= 3)
    kept = np.sort(np.argsort(-strength, kind="stable")[:max_features])
    kept = kept[strength[kept] > 0]
    place = np.full(1 << HASH_BITS, -1)
    place[kept] = np.arange(len(kept))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordFeatures(place)
        for batch, texts in each_text(batches):
            present = [np.array(sorted(found), np.uint16).tobytes()
                       for portion in in_portions(texts) for found in memo.of_texts(portion)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(present, pa.binary())],
                                             names=["label", "features"])

    # At most max_rows rows of at most max_features numbers of two bytes.
    drawn = sorted(sample.mapInArrow(project, "label int, features binary").collect())
    y = np.array([r["label"] for r in drawn], float)
    columns = np.frombuffer(b"".join(r["features"] for r in drawn), np.uint16)
    lengths = np.array([len(r["features"]) // 2 for r in drawn])
    del drawn
    coefficients, intercept = _logistic(columns, lengths, y, ratio[kept], prior, penalty)
    weights = {int(f): float(w) for f, w in zip(kept, coefficients * ratio[kept], strict=True) if w}
    return Model(weights, intercept)


def _logistic(column: np.ndarray, lengths: np.ndarray, y: np.ndarray, scale: np.ndarray, start: float,
              penalty: float, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient for the mean logistic loss plus ``penalty`` times |w|.

    Row by row ``column`` has the numbers of the features present, ``lengths`` how many.  They are gone
    through in pieces of about ``PIECE`` entries, so the work arrays stay small beside them.
    """
    ends = np.cumsum(lengths)
    n, k = len(y), len(scale)
    cuts, at = [0], 0
    while at < n:
        at = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")))
        cuts.append(min(at, n))
    pieces = [(slice(i, j), column[ends[i] - lengths[i]:ends[j - 1]]) for i, j in zip(cuts, cuts[1:], strict=False)]

    def forward(w):
        scaled, out = scale * w, np.zeros(n)
        for rows, part in pieces:
            some = np.flatnonzero(lengths[rows])
            starts = np.cumsum(lengths[rows])[some] - lengths[rows][some]
            if len(some):
                out[rows][some] = np.add.reduceat(scaled[part], starts)
        return out

    def backward(r):
        out = np.zeros(k)
        for rows, part in pieces:
            out += np.bincount(part, np.repeat(r[rows], lengths[rows]), k)
        return out * scale

    direction = np.ones(k)
    for _ in range(12):  # the largest curvature
        direction = backward(forward(direction))
        norm = np.sqrt(direction @ direction)
        if not norm:
            return np.zeros(k), start
        direction /= norm
    step = 1 / (0.25 * (norm * 1.05 / n + 1))
    w, b, v, c, t = np.zeros(k), start, np.zeros(k), start, 1.0
    for _ in range(rounds):
        residual = (1 / (1 + np.exp(-np.clip(forward(v) + c, -500, 500))) - y) / n
        moved = v - step * backward(residual)
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        new_b = c - step * residual.sum()
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / new_t * (new - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new, new_b, new_t
    return w, float(b)


def training_labels(labels: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """The labelled rows outside the held-out fold."""
    return labels.where(crc_of_id() % folds != held_out)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    model = fit(docs, training_labels(labels))
    return docs.where(score_column(model) < threshold)
