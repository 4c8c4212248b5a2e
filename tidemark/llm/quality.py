"""Quality classifier: supervised subword embeddings.

A text is a bag of hashed features: every word, the character n-grams of 3 to 5 letters of every word
with its edges, a mark for a word that repeats the one before it, and one end mark. Each feature has a
learned vector; their average passes through a softmax layer. Both are trained with plain stochastic
gradient descent in numpy on a bounded sample of labelled rows.

The output layer is linear, so after training a feature's vector and the layer fold into one number,
and a text's score is an average of such numbers: one pass over its characters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.grams import Slice, bucket, packed, slices, unpacked
from tidemark.llm.tables import held_out, map_texts, sweep

BITS = 17
SIZES = (3, 4, 5)
END, REPEAT = 0, 1  # reserved features
SAMPLE_PER_CLASS = 2500  # bound of the training sample: so many labelled rows of either class
DIM, EPOCHS, RATE = 8, 6, 2.0


@dataclass
class Model:
    """Folded model: logit of label 1 = mean over features of ``weights`` + ``prior``."""

    weights: np.ndarray
    prior: float


def _features(s: Slice) -> list[tuple[np.ndarray, np.ndarray]]:
    """(feature, position) of every n-gram, word and repeat mark of a slice."""
    out = []
    for size in SIZES:
        b, valid = s.grams(size, BITS)
        at = np.nonzero(valid)[0]
        out.append((b[at], at))
    begin, h = s.words()
    out.append((bucket(h, BITS), begin))
    piece = np.searchsorted(s.starts, begin, "right")
    again = begin[1:][(h[1:] == h[:-1]) & (piece[1:] == piece[:-1])]
    out.append((np.full(len(again), REPEAT), again))
    return out


def logits(texts: list[str], model: Model) -> np.ndarray:
    total, count = np.full(len(texts), model.weights[END], np.float64), np.ones(len(texts))
    for s in slices(texts):
        value, one = np.zeros(len(s.codes)), np.zeros(len(s.codes))
        for feature, at in _features(s):
            value[at] += model.weights[feature]  # positions are distinct within one kind of feature
            one[at] += 1
        np.add.at(total, s.rows, s.total(value))
        np.add.at(count, s.rows, s.total(one))
    return total / count + model.prior


def counted(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct features of each text with their counts."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for s in slices(texts):
        for feature, at in _features(s):
            owner = np.searchsorted(s.starts, at, "right") - 1
            edges = np.searchsorted(owner, np.arange(len(s.starts) + 1))
            for j, row in enumerate(s.rows):
                found[row].append(feature[edges[j]:edges[j + 1]])
    return [np.unique(np.concatenate([np.array([END]), *f]), return_counts=True) for f in found]


def sgd(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> np.ndarray:
    """Train and fold: one weight per feature, the share of each in the logit of label 1."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    layer = np.zeros((2, DIM), np.float32)
    shares = [(c / c.sum()).astype(np.float32) for _, c in examples]
    steps, done = EPOCHS * len(examples), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(examples)):
            rate = RATE * (1 - done / steps)
            feature, share = examples[i][0], shares[i]
            hidden = share @ vectors[feature]
            z = layer @ hidden
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ layer
            layer -= rate * np.outer(p, hidden)
            vectors[feature] -= (rate * share)[:, None] * back * len(feature) ** 0.5  # averaging shrinks each feature's share
            done += 1
    return vectors @ (layer[1] - layer[0])


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Fit on at most ``per_class`` labelled, not held out rows of either class, chosen by a hash of the id.

    The class balance is that of all eligible labels. Repeated labels of one id are averaged, nulls are no
    labels. Without labels of both kinds the score only follows the balance (0.5 without any label).
    """
    known = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
             .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label")))
    balance = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    n0, n1 = balance.get(0, 0), balance.get(1, 0)
    if not n0 or not n1:
        return Model(np.zeros(1 << BITS), float(np.log((n1 + 1) / (n0 + 1))))
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = counted([t or "" for t in batch.column(2).to_pylist()])
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *packed(rows)], ["doc_id", "label", "f", "c"])

    # the sample has a fixed bound, so it may be broadcast whatever the input's size
    sample = docs.select(F.col("doc_id").cast("bigint"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    rows = unpacked(map_texts(sample, run, "doc_id bigint, label int, f binary, c binary").toArrow())
    if len({r["label"] for r in rows}) < 2:
        return Model(np.zeros(1 << BITS), float(np.log(n1 / n0)))
    y = np.array([r["label"] for r in rows])
    weights = sgd([(r["f"], r["c"]) for r in rows], y)
    rows.clear()
    sweep(docs.sparkSession)
    return Model(weights.astype(np.float64), float(np.log(n1 / n0) - np.log((y == 1).sum() / (y == 0).sum())))


def scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score of label 1, predicted (score >= threshold).

    Null texts count as empty; an empty text has the end mark alone, so it has a score as well.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        z = logits([t or "" for t in batch.column(2).to_pylist()], sent.value)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))],
                                          ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint"), held_out().alias("held_out"), "text")
    return (map_texts(rows, run, "doc_id bigint, held_out boolean, score double")
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def kept(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, in the columns of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(1 / (1 + np.exp(-np.clip(logits([t or "" for t in text], sent.value), -500, 500))))

    return docs.where(score("text") >= threshold)
