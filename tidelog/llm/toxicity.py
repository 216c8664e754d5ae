"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct unigrams (whole words and their first bytes, which inflections share), bigrams and one-word
skip-grams of the whole text, hashed to 2**BITS coordinates. A document's logit is the bias plus the sum of its
features' weights. FTRL-proximal keeps a learning rate per coordinate and an L1 threshold below which a weight is
exactly zero; coordinates seen in fewer than MIN_DOCS sample documents are left out. A second pass without the
threshold, over the surviving coordinates only, undoes the shrinking of their weights. The model is a short list of
(coordinate, weight) that is broadcast; its length is bounded by 2**BITS.

The classifier is fitted on at most `sample` labelled rows, chosen by a hash of their ids, and on at most COORDINATES
features of theirs, whatever the texts' lengths: features are made on the executors, and the online learner, one task,
takes documents in the order of the hash while their features fit. Scores cover every row and whole texts.

Edge cases: null and empty texts have no features and get the score of the bias; rows with null ids are scored, and
held out; repeated rows are scored alike; without labelled rows every score is 0.5; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .base import lean, materialize, scratch, slices, small_batches

BITS = 22
SAMPLE = 16_000
#: Features of sample documents that the learner holds, 4 bytes each.
COORDINATES = 40_000_000
EPOCHS, AGAIN = 4, 12
MIN_DOCS = 5
STEMS = (4, 5, 6)
ALPHA, BETA, L1, L2 = 1.0, 1.0, 12.0, 0.0

U = np.uint64


def features(data: np.ndarray, offs: np.ndarray, bits: int = BITS):
    """For each document its distinct feature coordinates."""
    w, _, _, first, *stems = tk.words(data, offs, tk.PUNCT, STEMS)
    mask = U((1 << bits) - 1)
    uni = (tk.mix(w) & mask).astype(np.int32)
    bi = (tk.ngram_hash(w, 2) & mask).astype(np.int32)
    skip = (tk.mix(w[:-2] * U(3) + tk.mix(w[2:] ^ U(0x5B1F))) & mask).astype(np.int32) if len(w) > 2 else np.zeros(0, np.int32)
    stems = [(tk.mix(x + U(k + 1)) & mask).astype(np.int32) for k, x in enumerate(stems)]
    for d in range(len(offs) - 1):
        a, b = int(first[d]), int(first[d + 1])
        yield uni[a:b], *[x[a:b] for x in stems], bi[a:max(a, b - 1)], skip[a:max(a, b - 2)]


class Ftrl:
    """FTRL-proximal state over 2**bits coordinates, the last of which is the bias."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def model(self) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates with a weight, and their weights."""
        at = np.flatnonzero(self.n)
        w = self.weights(at)
        return at[w != 0], w[w != 0]

    def learn(self, at: np.ndarray, label: int) -> float:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        return p


def learn_all(seen: list[tuple[int, np.ndarray]], bits: int = BITS, epochs: int = EPOCHS, again: int = AGAIN, min_docs: int = MIN_DOCS) -> Ftrl:
    """Learn from (label, distinct coordinates with the bias) of sample documents, in the order given.

    `seen` and its arrays are thinned out in place: the sample's features are held once.
    """

    def thin(chosen: np.ndarray) -> None:
        for k, (label, at) in enumerate(seen):
            own = at[chosen[at]]
            at[: len(own)] = own
            seen[k] = (label, at[: len(own)])

    docs = np.zeros((1 << bits) + 1, np.int32)
    for _, at in seen:
        docs[at] += 1
    common = docs >= min_docs
    common[1 << bits] = True
    thin(common)
    del docs, common
    model = Ftrl(bits)
    for _ in range(epochs):
        for label, at in seen:
            model.learn(at, label)
    chosen = np.zeros((1 << bits) + 1, bool)
    chosen[model.model()[0]] = True
    chosen[1 << bits] = True
    thin(chosen)
    model = Ftrl(bits, l1=0.0)
    for _ in range(again):
        for label, at in seen:
            model.learn(at, label)
    return model


def fit(labelled: DataFrame, bits: int = BITS, epochs: int = EPOCHS, coordinates: int = COORDINATES) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, weights) learned from (doc_id, text, label) rows, the first of them that have `coordinates` features."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, data, offs in slices(b.column(3)):
                rows = [np.unique(np.concatenate(x)) for x in features(data, offs, bits)]
                n = len(rows)
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(at, n) for c in range(3)), pa.array(rows, pa.list_(pa.int32()))], ["h", "t", "label", "at"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, full = [], 0, False
        room = np.empty(coordinates + 1, np.int32)  # touched as far as it is filled
        for b in batches:
            for label, x in zip(b.column("label").to_pylist(), b.column("at")):
                n = len(x) + 1
                full = full or held + n > len(room)
                if not full:
                    room[held : held + n - 1], room[held + n - 1] = x.values.to_numpy(), 1 << bits
                    seen.append((label, room[held : held + n]))
                    held += n
        at, w = learn_all(seen, bits, epochs).model()
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w)], ["at", "w"])

    small_batches(labelled.sparkSession)
    chosen = labelled.select(F.xxhash64("doc_id", F.lit("fit")).alias("h"), F.xxhash64("text").alias("t"), F.col("label").cast("int").alias("label"), "text")
    feats = materialize(chosen.mapInArrow(lean(extract), "h long, t long, label int, at array<int>"), "features")
    # hashes are spread evenly: of a sample that is too large, little more than what fits reaches the learner's task
    total = feats.agg(F.sum(F.size("at") + 1)).first()[0] or 1
    if total > coordinates:
        feats = feats.where(F.col("h") <= int(min(1.0, 1.1 * coordinates / total) * 2**64) - 2**63 - 1)
    rows = feats.repartition(1).sortWithinPartitions("h", "t", "label").mapInArrow(lean(learn), "at long, w double").toArrow()
    return rows.column("at").to_numpy(), rows.column("w").to_numpy()


def choose(labelled: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, label): the `sample` labelled rows whose ids hash lowest."""
    h = F.xxhash64("doc_id", F.lit("choose"))
    return labelled.where("label in (0, 1) and doc_id is not null").select("doc_id", "label").orderBy(h, "doc_id", "label").limit(sample)


def held_out(doc_id: str):
    """Whether a row is kept from training: crc32 of the id as text, modulo 3, is 1 (rows without an id as well)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(True))


@scratch
def train(docs: DataFrame, labels: DataFrame, bits: int = BITS, sample: int = SAMPLE, coordinates: int = COORDINATES) -> tuple[np.ndarray, np.ndarray]:
    """A model from documents (doc_id, text) and labels (doc_id, toxic), held-out rows left aside."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where(~held_out("doc_id"))
    picked = materialize(choose(own, sample), "chosen")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return fit(src.join(F.broadcast(picked), "doc_id"), bits, coordinates=coordinates)  # `sample` rows of 12 bytes


def scorer(spark: SparkSession, model: tuple[np.ndarray, np.ndarray], bits: int = BITS) -> Callable[[Column], Column]:
    """The score of a text column; only that column travels to Python."""
    at, w = model
    compact = spark.sparkContext.broadcast((at.astype(np.int32), w.astype(np.float64)))
    small_batches(spark)
    made: list[np.ndarray] = []  # by the worker, once

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(np.zeros((1 << bits) + 1))
            made[0][compact.value[0]] = compact.value[1]
        table = made[0]
        bias, out = table[1 << bits], []
        for _, data, offs in slices(texts):
            for parts in features(data, offs, bits):
                # zero weights need no deduplication: only the few coordinates of the model count
                f = np.concatenate(parts)
                f = f[table[f] != 0]
                out.append(1 / (1 + np.exp(-np.clip(bias + table[np.unique(f)].sum(), -35, 35))))
        return pa.array(out, pa.float64())

    return lambda text: run(F.coalesce(text.cast("string"), F.lit("")))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], bits: int = BITS) -> DataFrame:
    """doc_id, score of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), scorer(docs.sparkSession, model, bits)(F.col("text")).alias("score"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
