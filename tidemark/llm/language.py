"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Terms are hashed n-grams of 1 to 3 lower-cased code points. A term's frequency is its share of the text,
its inverse document frequency counts every text that may be learned from. The regression is trained with
the follow-the-regularised-leader (proximal) method with elastic-net penalties, on a bounded sample, and
its confidence is then calibrated with a temperature fitted on rows that the training left aside.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.grams import Slice, packed, slices, unpacked
from tidemark.llm.tables import held_out, map_texts

BITS = 16
SIZES = (1, 2, 3)
SAMPLE_PER_LANGUAGE = 1500  # bound of the training sample ...
LANGUAGES = 500             # ... with this many languages at most, the most frequent
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.5, 2
SCALE = 30.0                # shares are small numbers; one fixed factor brings them near one
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray        # term -> inverse document frequency times weight of each language
    bias: np.ndarray
    temperature: float


def _terms(s: Slice) -> Iterator[np.ndarray]:
    """Bucket of the n-gram at each position, -1 where there is none."""
    for size in SIZES:
        b, valid = s.grams(size, BITS)
        b[~valid] = -1
        yield b


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(texts that hold each term, number of texts) over all rows; one small vector per task is sent on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            texts = [(t or "").lower() for t in batch.column(0).to_pylist()]
            n += len(texts)
            open_row, open_seen = -1, None  # a long text goes on in the next slice
            for s in slices(texts):
                first = s.rows[0]
                seen = np.zeros((s.rows[-1] - first + 1, 1 << BITS), bool)
                if open_row == first:
                    seen[0] = open_seen
                    total -= seen[0]
                lengths = np.diff(np.append(s.starts, len(s.codes) - 1))
                owner = np.repeat(s.rows - first, lengths)
                for b in _terms(s):
                    at = b >= 0
                    seen[owner[:len(b)][at], b[at]] = True
                total += seen.sum(axis=0)
                open_row, open_seen = s.rows[-1], seen[-1].copy()
        term = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(term, -1)), pa.array(np.append(total[term], n))], ["term", "n"])

    rows = docs.select("text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(1 << BITS, np.int64)
    for term, n in rows:  # at most one row per bucket
        if term >= 0:
            found[term] = n
    return found, next((n for term, n in rows if term < 0), 0)


def counted(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct terms of each text with their counts."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for s in slices([t.lower() for t in texts]):
        edges = np.append(s.starts, len(s.codes) - 1)
        for b in _terms(s):
            for row, a, z in zip(s.rows, edges[:-1], edges[1:]):
                part = b[a:z]
                found[row].append(part[part >= 0])
    return [np.unique(np.concatenate([np.zeros(0, np.int64), *f]), return_counts=True) for f in found]


def ftrl(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Weights (term x class) and bias; examples are (terms, values). Each coordinate keeps its own sums z and n."""
    rng = np.random.default_rng(seed)
    z, n = np.zeros(((1 << BITS) + 1, classes)), np.zeros(((1 << BITS) + 1, classes))
    last = 1 << BITS  # the bias

    def weights(at):
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(EPOCHS):
        for i in rng.permutation(len(examples)):
            at, x = np.append(examples[i][0], last), np.append(examples[i][1], 1.0)
            w = weights(at)
            p = softmax((x @ w)[None])[0]
            p[labels[i]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(slice(None))
    return w[:-1], w[-1]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def temperature(z: np.ndarray, labels: np.ndarray) -> float:
    """Divisor of the logits with the least log loss on the given rows, from a fine geometric range."""
    if not len(z):
        return 1.0
    tried = np.geomspace(0.05, 20, 200)
    loss = [-np.log(softmax(z / t)[np.arange(len(z)), labels] + 1e-12).mean() for t in tried]
    return float(tried[int(np.argmin(loss))])


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, max_languages: int = LANGUAGES) -> Model:
    """Learn from text and language of rows that are not held out and have a language.

    Document frequencies cover all of them; the regression sees at most ``per_language`` rows of each of
    the ``max_languages`` most frequent languages, chosen by a hash of the id.
    """
    known = docs.where(F.col("lang").isNotNull() & ~held_out()).select(F.col("doc_id").cast("bigint"), "lang", "text")
    sizes = {r[0]: r[1] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((1 << BITS, 1)), np.zeros(1), 1.0)
    found, n = document_frequency(known)
    idf = np.where(found > 0, np.log((n + 1) / (found + 1)) + 1, 0.0)

    # a share of each language's hash range that holds twice the rows wanted, then the least hashes of these:
    # so no language, however frequent, brings all its rows to one task
    share = F.element_at(F.create_map(*[F.lit(v) for lang in langs for v in (lang, min(1.0, 2 * per_language / sizes[lang]))]), F.col("lang"))
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = (known.where(F.col("lang").isin(langs)).select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
              .where(F.pmod(F.col("h"), F.lit(1 << 20)) < share * (1 << 20))
              .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_language)
              .select("doc_id", "lang", (F.pmod(F.xxhash64("h"), F.lit(5)) == 0).alias("aside")).dropDuplicates(["doc_id", "lang"]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = counted([t or "" for t in batch.column(3).to_pylist()])
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:3], *packed(rows)], ["doc_id", "lang", "aside", "f", "c"])

    # the sample has a fixed bound, so it may be broadcast whatever the input's size
    sample = known.join(F.broadcast(chosen), ["doc_id", "lang"]).select("doc_id", "lang", "aside", "text")
    rows = unpacked(map_texts(sample, run, "doc_id bigint, lang string, aside boolean, f binary, c binary").toArrow())
    rows = [r for r in rows if len(r["f"])]
    y = np.array([langs.index(r["lang"]) for r in rows], int)
    x = [(r["f"], r["c"] / r["c"].sum() * idf[r["f"]] * SCALE) for r in rows]
    aside = np.array([r["aside"] for r in rows], bool)
    if aside.all():
        aside[:] = False
    w, bias = ftrl([v for v, a in zip(x, aside) if not a], y[~aside], len(langs))
    z = np.array([v @ w[f] + bias for (f, v), a in zip(x, aside) if a]).reshape(-1, len(langs))
    return Model(langs, idf[:, None] * w * SCALE, bias, temperature(z, y[aside]))


def probabilities(texts: list[str], model: Model) -> np.ndarray:
    """Calibrated probabilities of the languages: each text's logits are a mean over its terms' table rows."""
    total, count = np.zeros((len(texts), len(model.langs))), np.zeros(len(texts))
    for s in slices([t.lower() for t in texts]):
        value = np.zeros((len(s.codes), len(model.langs)))
        one = np.zeros(len(s.codes))
        for b in _terms(s):
            at = np.nonzero(b >= 0)[0]
            value[at] += model.table[b[at]]
            one[at] += 1
        np.add.at(total, s.rows, s.total(value))
        np.add.at(count, s.rows, s.total(one))
    return softmax((total / np.maximum(count, 1)[:, None] + model.bias) / model.temperature)


def languages(docs: DataFrame, **bounds: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    A text that is null or has no letter is ``und`` with score 0, as is every text when no language could
    be learned. Language, source and id are never read for a prediction.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, **bounds))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = sent.value
        texts = [t or "" for t in batch.column(2).to_pylist()]
        told = [bool(model.langs) and LETTER.search(t) is not None for t in texts]
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if any(told):
            p = probabilities(texts, model)
            best = p.argmax(axis=1)
            for i in np.nonzero(told)[0]:
                lang[i], score[i] = model.langs[best[i]], float(p[i, best[i]])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang), pa.array(score)],
                                          ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint"), held_out().alias("held_out"), "text")
    return map_texts(rows, run, "doc_id bigint, held_out boolean, lang_pred string, score double")
