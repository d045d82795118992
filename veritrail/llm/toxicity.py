"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, pairs of adjacent words and pairs with one word
between, hashed to ``2**DIM_BITS``; words are runs of ASCII letters, digits and
all that is not ASCII. A feature is there or not, so a long text does not dilute
it. FTRL (McMahan et al. 2013) gives each weight its own rate, and its L1 term
leaves most of them at 0: what tasks get is a short list of weights, bounded by
``2**DIM_BITS`` at any size of the input.

The model is fitted on a bounded sample of labelled rows: those with the smallest
hashes of doc_id, ``TRAIN_ROWS`` or about as many. All else covers every row.

Null and empty texts have no features and get the score of the bias alone. Null
labels are not learned from; of several labels of a doc_id the largest counts. Rows that
repeat a doc_id are learned and scored each by itself; a null doc_id is scored only.
Long texts are scored whole. Without labels every score is 0.5. Other columns of the
inputs are not looked at, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import tidy
from .words import ALNUM, batches, grams, hashes, mix, rows_of

DIM_BITS = 20
#: Bound of the sample that the model is fitted on.
TRAIN_ROWS = 16_000
#: L1 above EPOCHS: what only one document holds cannot move a weight from 0, so single texts are not learned by heart.
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 16.0, 1.0, 10
THRESHOLD = 0.7


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all rows with repetitions, and the row of each."""
    words, at = hashes(data, bounds, ALNUM)
    found, rows = [words], [rows_of(at)]
    for offsets in ((0, 1), (0, 2)):
        x, cut = grams(words, at, offsets)
        with np.errstate(over="ignore"):
            found.append(mix(x + np.uint64(offsets[-1])))  # a pair side by side is another feature than one with a word between
        rows.append(rows_of(cut))
    return (np.concatenate(found) >> np.uint64(64 - DIM_BITS)).astype(np.int64), np.concatenate(rows)


class Ftrl:
    """Per-coordinate FTRL-proximal on sets of binary features; the last coordinate is the bias, which is not regularised."""

    def __init__(self, dim: int):
        self.z, self.n = np.zeros(dim + 1), np.zeros(dim + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(np.asarray(at) == len(self.z) - 1, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Feature numbers, their weights and the bias. ``docs``: doc_id, text; ``labels``: doc_id, label (0 or 1)."""
    labels = labels.where("label IS NOT NULL").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    n = labels.count()
    if n > TRAIN_ROWS:
        labels = labels.where(order < int((1 << 30) * TRAIN_ROWS / n))
        docs = docs.where(order < int((1 << 30) * TRAIN_ROWS / n))
    rows = docs.select("doc_id", "text").join(labels, "doc_id")

    def extract(it):
        for batch in it:
            for a, b, data, bounds in batches(batch, "text"):
                at, row = features(data, bounds)
                key = np.unique(row << DIM_BITS | at)
                cut = np.searchsorted(key, np.arange(b - a + 1) << DIM_BITS)
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array((key & ((1 << DIM_BITS) - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in (0, 2)), lists], ["doc_id", "label", "features"])

    sets = rows.select("doc_id", "text", "label").mapInArrow(tidy(extract), "doc_id long, label int, features array<int>")

    def fit(it):
        held = [(y, np.append(x.values.to_numpy(), 1 << DIM_BITS)) for batch in it for y, x in zip(batch.column(1).to_pylist(), batch.column(2), strict=True) if y is not None]
        model = Ftrl(1 << DIM_BITS)
        for _ in range(EPOCHS):
            for y, x in held:
                model.learn(x, y)
        w = model.weights(np.arange((1 << DIM_BITS) + 1))
        some = np.append(np.flatnonzero(w[:-1]), 1 << DIM_BITS)
        yield pa.RecordBatch.from_pydict({"feature": some, "weight": w[some]})

    got = sets.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "features").mapInArrow(fit, "feature long, weight double").toPandas().sort_values("feature")
    if not len(got):
        return np.zeros(0, np.int64), np.zeros(0), 0.0
    return got.feature.to_numpy()[:-1], got.weight.to_numpy()[:-1], float(got.weight.iloc[-1])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], doc_id: str = "doc_id", text: str = "text", carry: str | None = None) -> DataFrame:
    """doc_id and the probability of label 1 of each row. ``carry``: a column that goes along."""
    at, weight, bias = model
    more = [T.StructField(carry, docs.schema[carry].dataType)] if carry else []
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), *(F.col(carry).alias("carry") for _ in more))

    def run(it):
        dense = np.zeros(1 << DIM_BITS)
        dense[at] = weight
        for batch in it:
            for a, b, data, bounds in batches(batch, "text"):
                x, row = features(data, bounds)
                hit = dense[x] != 0
                key = np.unique(row[hit] << DIM_BITS | x[hit])
                total = np.bincount(key >> DIM_BITS, dense[key & ((1 << DIM_BITS) - 1)], b - a) + bias
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35)))), *(c.slice(a, b - a) for c in batch.columns[2:])], ["doc_id", "score", *(f.name for f in more)])

    return docs.mapInArrow(tidy(run), T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()), *more]))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 1 when divided by 3. Rows without an id are never learned from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, carry: str | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted of each row, learning from the labels that are not held out. ``carry``: a column that goes along."""
    known = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("label"))
    model = train(docs.select("doc_id", "text").where(~held_out(F.col("doc_id"))), known)
    out = score(docs, model, carry=carry)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *([carry] if carry else []))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
