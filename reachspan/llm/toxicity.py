"""Toxicity by logistic regression, learned online by FTRL-proximal over hashed word n-grams and skip-grams.

A document's features are the presence of its words, pairs of neighbouring words and pairs with one word between, each hashed to one of
`COORDINATES`.  Learning keeps two numbers a coordinate, from which follow its own rate and its weight; the L1 term leaves most weights at
zero, so the model that scoring broadcasts is a short list of coordinates and weights.

Scale: the model is fitted on at most `MAX_FIT_ROWS` labelled documents, whose ids are a broadcast; their features are streamed in a fixed order through one task
that holds the two numbers a coordinate and one document, whatever the sample's texts.  Scoring is one pass over all documents without a
shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._spark import map_batches, small_batches

BITS = 22
COORDINATES = 1 << BITS
#: Labelled documents to learn from, at most: those with the smallest hashes of ids.
MAX_FIT_ROWS = 20_000
EPOCHS = 4
RATE, SMOOTHING, L1, L2 = 1.0, 1.0, 8.0, 0.1
#: Weight of a toxic example, of which there are fewer.
POSITIVE = 3.0
TOXIC = 0.7
_LOW = np.uint64(COORDINATES - 1)


def features(block: X.Block) -> tuple[np.ndarray, np.ndarray]:
    """row and coordinate of every word, pair and skip-pair of a block's texts, repeats included."""
    words = block.words(X.ALNUM, lower=True)
    own, rows, at = [X.salted(words.hashes, 1)], [words.row_of()], np.arange(len(words))
    for gap in (1, 2):
        start = np.flatnonzero(at + gap < words.row_end())
        own.append(X.mix(X.salted(words.hashes[start], 1 + gap) + words.hashes[start + gap]))
        rows.append(rows[0][start])
    return np.concatenate(rows), (np.concatenate(own) & _LOW).astype(np.int64)


@dataclass
class Model:
    """Coordinates (sorted) with weights that are not zero, and the bias."""

    coordinates: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, block: X.Block) -> np.ndarray:
        """Chances of label 1.  A text without words has that of the bias."""
        row, own = features(block)
        dense = np.zeros(COORDINATES, np.float32)
        dense[self.coordinates] = self.weights
        told = np.flatnonzero(dense[own])
        key = np.unique(row[told] << BITS | own[told])
        margin = self.bias + np.bincount(key >> BITS, weights=dense[key & int(_LOW)], minlength=len(block))
        return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


class Learner:
    """FTRL-proximal: z and n of every coordinate; the last one is the bias, without L1."""

    def __init__(self):
        self.z, self.n = np.zeros(COORDINATES + 1), np.zeros(COORDINATES + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        least = np.where(at == COORDINATES, 0.0, L1)
        return np.where(np.abs(z) <= least, 0.0, -(z - np.sign(z) * least) / ((SMOOTHING + np.sqrt(self.n[at])) / RATE + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        """One document, of distinct coordinates."""
        at = np.append(at, COORDINATES)
        w = self.weights(at)
        gradient = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label) * (POSITIVE if label else 1.0)
        n = self.n[at]
        self.z[at] += gradient - (np.sqrt(n + gradient * gradient) - np.sqrt(n)) / RATE * w
        self.n[at] = n + gradient * gradient


def may_learn(doc_id) -> F.Column:
    """Whether a label may be learned from: its id's crc32 leaves another remainder than 1; rows without id may not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, rows: int = MAX_FIT_ROWS) -> Model:
    """Learns from at most `rows` labelled documents that `may_learn` allows.

    Rows without id or label are left out; of several labels of one id the largest counts; repeated documents are examples each.  Without labelled
    rows every score is a half.
    """
    small_batches(documents.sparkSession)
    ids = labels.where("doc_id is not null and toxic is not null").where(may_learn("doc_id")).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("label"))
    order = F.xxhash64("doc_id", F.lit(12))
    sample = ids.orderBy(order, "doc_id").limit(rows).select(F.col("doc_id").alias("_id"), "label")
    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))

    def extracted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for block in X.blocks(batch.column("text")):
            row, own = features(block)
            key = np.unique(row << BITS | own)
            at = np.searchsorted(key >> BITS, np.arange(len(block) + 1))
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array((key & int(_LOW)).astype(np.int32)))
            part = batch.slice(block.first, len(block))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label").cast(pa.int32()), lists], names=["doc_id", "label", "at"])

    examples = map_batches(chosen, extracted, "doc_id long, label int, at array<int>")
    # another order in every round
    rounds = examples.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(EPOCHS)))).withColumn("order", F.xxhash64("doc_id", "round"))
    found = rounds.repartition(1).sortWithinPartitions("round", "order", "doc_id", "at").select("label", "at").mapInArrow(_learned, "coordinate long, weight double").collect()
    told = {r.coordinate: r.weight for r in found}
    bias = told.pop(COORDINATES, 0.0)
    at = np.array(sorted(told), np.int64)
    return Model(at, np.array([told[c] for c in at.tolist()], np.float32), bias)


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    learner = Learner()
    for batch in batches:
        for label, at in zip(batch.column("label").to_pylist(), batch.column("at"), strict=True):
            learner.learn(at.values.to_numpy().astype(np.int64), int(label > 0))
    at = np.flatnonzero(learner.z)
    weight = learner.weights(at)
    at, weight = at[weight != 0], weight[weight != 0]
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(weight)], names=["coordinate", "weight"])


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of each document; only the text counts.

    Null and empty texts score as the bias; rows without id are not held out.  Repeated rows score each, alike.
    """

    def scored(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for block in X.blocks(batch.column("text")):
            part = batch.slice(block.first, len(block))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(model.scores(block), pa.float64())], names=["doc_id", "held_out", "score"])

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    small_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    return map_batches(rows, scored, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= TOXIC).cast("int"))
