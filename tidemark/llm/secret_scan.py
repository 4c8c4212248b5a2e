"""Secret scan: candidate strings by pattern, false positives removed by a random forest.

A candidate is the password of a link, the body of a private key, a long run of letters, digits and the marks of common encodings, without the name that an equals sign
puts before it, or a value of any length that is assigned to a credential's name. Its features are its length, the transitions between kinds of characters, how much of it a dictionary of common words covers,
words of the path it comes from, and the words and marks beside it. The forest is trained in numpy on
a bounded sample of labelled findings.

Findings may be labelled by hand (``findings``: doc_id, start, end, is_secret). Where none are given, labels come
from contexts that leave no doubt: values assigned to names of credentials, values of a Bearer header and tokens with
issuers' known prefixes are secrets, whatever the forest says of them. Candidates beside a credential's name without
such a context have no label; all others are not secrets.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import cut, map_texts
from tidemark.llm.transducer import Vocabulary

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=\-]{16,}")
BEFORE_VALUE = re.compile(r".*=(?!=|$)")  # names up to the last equals sign inside a run; padding at its end stays
ASSIGNS = (r"(?:token|secret|pass(?:wor)?d|passwd|passphrase|pwd|auth(?!or(?!iz))\w*|credential\w*|(?:api|private|access|secret)[_-]?key)"
           r"\s{0,8}[\"']?\s{0,8}(?::=|=>|[:=])\s{0,8}(?:(?:bearer|basic|token)\s{1,8})?")
ASSIGNED = re.compile(ASSIGNS + r"[\"'`]?$", re.I)
NAMED = re.compile(ASSIGNS + r"(?!\$[{(]|\{\{|<|%\()(?:([\"'`])(?P<quoted>(?:(?!\1)[^\n]){4,})\1|(?P<bare>(?:(?!&\w+=)[^\s\"'`,;<>()\[\]{}]){4,}))", re.I)
BEARER = re.compile(r"\bbearer\s{1,8}$", re.I)
BORNE = re.compile(r"\bbearer\s{1,8}(?P<bare>[A-Za-z0-9+/_=.~\-]{8,})", re.I)
WEB_TOKEN = re.compile(r"\b(?P<bare>eyJ[A-Za-z0-9_\-]+(?:\.[A-Za-z0-9_\-]+){1,2})")
LINK = re.compile(r"://[^\s:/@\"']{0,64}:(?![$<{%*])(?P<bare>[^\s/@\"']{3,})(?=@)")
IN_LINK = re.compile(r"://[^\s:/@\"']{0,64}:$")
PRIVATE = r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY[A-Z ]{0,10}-----"
PEM = re.compile(PRIVATE + r"(?:\\[nr]|\s)*(?P<bare>(?:[\w\-]+: [^\n]*\n\s*)*[A-Za-z0-9+/=](?:(?:[A-Za-z0-9+/=\s]|\\[nr])*[A-Za-z0-9+/=])?)")
BEGUN = re.compile(PRIVATE)
#: what a text must hold, lower-cased, for each pattern to match; the last two of the first are letters that fold to s and k
MARKS = ((NAMED, (b"token", b"secret", b"pass", b"pwd", b"auth", b"credential", b"key", "\u017f".encode(), "\u212a".encode())),
         (BORNE, (b"bearer",)), (WEB_TOKEN, (b"eyj",)), (LINK, (b"://",)), (PEM, (b"private key",)))
ISSUED = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk-|AIza|eyJ)")  # fixed values: prefixes that issuers publish
NAMES = ("token", "secret", "passw", "pwd", "key", "auth", "cred", "bearer", "private", "access")
DECOYS = ("test", "example", "sample", "mock", "fake", "dummy", "doc", "license")
SAMPLE_PER_CLASS = 3000  # bound of the training sample: so many findings of either kind
TREES, DEPTH, LEAF = 30, 8, 3
BESIDE = 48              # characters read on either side
MASK = "[SECRET]"


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Spans of candidates, in order: values of credentials' names, passwords in links, bodies of private keys, and runs
    that hold a digit or change between upper and lower case more than three times. Spans that overlap are one.
    The costly patterns are tried on texts that hold their marks only, which changes no result."""
    low = text.encode("utf-8", "surrogatepass").lower()
    spans = [m.span("quoted" if m.lastgroup == "quoted" else "bare")
             for p, marks in MARKS if any(mark in low for mark in marks) for m in p.finditer(text)]
    for m in CANDIDATE.finditer(text):
        named = BEFORE_VALUE.match(text, *m.span())
        start = named.end() if named else m.start()
        run = text[start:m.end()]
        if len(run) >= 16 and (any("0" <= c <= "9" for c in run) or sum(a.islower() != b.islower() for a, b in zip(run, run[1:])) > 3):
            spans.append((start, m.end()))
    at = None
    for a, b in sorted(spans):
        if at and a < at[1]:
            at = at[0], max(b, at[1])
            continue
        if at:
            yield at
        at = a, b
    if at:
        yield at


def certain(text: str, start: int, end: int) -> bool | None:
    """Label from context alone; None where the context leaves a doubt."""
    run, before = text[start:end], text[max(0, start - BESIDE):start]
    digit = any("0" <= c <= "9" for c in run)
    if BEGUN.search(text, max(0, start - 2 * BESIDE), end) or text[end:end + 1] == "@" and IN_LINK.search(text[max(0, start - 2 * BESIDE):start]):
        return True
    if ISSUED.search(run) and len(run) >= 16 or BEARER.search(before) and digit:
        return True
    if ASSIGNED.search(before) and not re.search(r"\s", run) and (before[-1] in "\"'`" or digit and any(c.isalpha() for c in run) or CANDIDATE.fullmatch(run)):
        return True
    return None if any(w in (before + run).lower() for w in NAMES) else False


@lru_cache(maxsize=2)
def dictionary(path: str) -> frozenset[str]:
    """Common words of four letters or more: the whole words among a vocabulary's tokens."""
    return frozenset(t[1:].decode().lower() for t in Vocabulary(path).ids if len(t) > 4 and t[:1] == b" " and t[1:].isalpha())


def coverage(run: str, words: frozenset[str]) -> float:
    """Share of the run that dictionary words cover, longest first from the left."""
    low, at, covered = run.lower(), 0, 0
    while at < len(low):
        n = next((n for n in range(min(12, len(low) - at), 3, -1) if low[at:at + n] in words), 0)
        covered += n
        at += n or 1
    return covered / len(run)


def features(text: str, start: int, end: int, path: str, words: frozenset[str]) -> list[float]:
    run = text[start:end]
    n = len(run)
    kinds = [0 if "0" <= c <= "9" else 1 if c.islower() else 2 if c.isupper() else 3 for c in run]
    moves = Counter(zip(kinds, kinds[1:]))
    counts = Counter(run)
    before, after = text[max(0, start - BESIDE):start], text[end:end + BESIDE]
    near = " ".join(before.lower().split()[-3:])
    opened, closed = before[-1:], after[:1]
    return [n, math.log(n), len(counts) / n, -sum(c / n * math.log2(c / n) for c in counts.values()),
            *(kinds.count(k) / n for k in range(4)), *(moves[a, b] / (n - 1) for a in range(4) for b in range(4)),
            all(c in "0123456789abcdefABCDEF" for c in run), coverage(run, words),
            *(w in near for w in NAMES), *(w in path.lower() for w in DECOYS), path.count("/"), path.count("."),
            opened in "\"'`" and opened != "", closed in "\"'`" and closed != "", bool(re.search(r"[:=]\s*[\"']?$", before)),
            "@" in before[-2:] + after[:2], opened in "./" and opened != "", len(before.split()), len(after.split()),
            any(w in near + after.lower() for w in DECOYS)]


@dataclass
class Forest:
    """Trees as arrays of nodes; a leaf has feature -1. Without trees every candidate has the share ``base``."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    base: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not self.trees or not len(x):
            return np.full(len(x), self.base)
        total = np.zeros(len(x))
        for feature, limit, left, right, share in self.trees:
            node = np.zeros(len(x), np.int64)
            while True:
                inner = feature[node] >= 0
                if not inner.any():
                    break
                goes = x[np.arange(len(x)), np.maximum(feature[node], 0)] <= limit[node]
                node = np.where(inner, np.where(goes, left[node], right[node]), node)
            total += share[node]
        return total / len(self.trees)


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple:
    """One tree: at each node the best Gini split among a random choice of features."""
    nodes: list[list[float]] = []
    width = max(1, int(math.sqrt(x.shape[1])) * 2)

    def split(rows: np.ndarray, depth: int) -> int:
        me = len(nodes)
        share = float(y[rows].mean())
        nodes.append([-1, 0.0, 0, 0, share])
        if depth == DEPTH or len(rows) < 2 * LEAF or share in (0.0, 1.0):
            return me
        best = (share * (1 - share) * len(rows) - 1e-9, -1, 0.0)
        for f in rng.choice(x.shape[1], width, replace=False):
            order = np.argsort(x[rows, f], kind="stable")
            v, c = x[rows, f][order], np.cumsum(y[rows][order])
            n = np.arange(1, len(v))
            fit = np.nonzero((v[1:] > v[:-1]) & (n >= LEAF) & (len(v) - n >= LEAF))[0]
            if not len(fit):
                continue
            a, b = c[fit] / n[fit], (c[-1] - c[fit]) / (len(v) - n[fit])
            cost = a * (1 - a) * n[fit] + b * (1 - b) * (len(v) - n[fit])
            k = int(np.argmin(cost))
            if cost[k] < best[0]:
                best = (float(cost[k]), int(f), float((v[fit[k]] + v[fit[k] + 1]) / 2))
        if best[1] >= 0:
            goes = x[rows, best[1]] <= best[2]
            left, right = split(rows[goes], depth + 1), split(rows[~goes], depth + 1)
            nodes[me][:4] = [best[1], best[2], left, right]
        return me

    split(rng.integers(0, len(x), len(x)), 0)
    t = np.array(nodes)
    return t[:, 0].astype(int), t[:, 1], t[:, 2].astype(int), t[:, 3].astype(int), t[:, 4]


def fit_forest(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Forest:
    if not len(y) or y.min() == y.max():
        return Forest([], float(y[0]) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    return Forest([grow(x, y, rng) for _ in range(TREES)], float(y.mean()))


def _path(docs: DataFrame):
    return F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")


def labelled(docs: DataFrame, vocabulary: str, findings: DataFrame | None = None) -> DataFrame:
    """(label, h, x): every labelled candidate with its features, and a hash that orders the sample."""
    rows = docs.select(F.col("doc_id").cast("bigint"), "text", _path(docs).alias("path"))
    if findings is not None:
        told = findings.where("doc_id is not null and is_secret is not null").groupBy("doc_id").agg(F.collect_list(F.struct(
            F.col("start").cast("int"), F.col("end").cast("int"), F.col("is_secret").cast("int"))).alias("told"))
        rows = rows.join(told, "doc_id")
    else:
        rows = rows.withColumn("told", F.lit(None).cast("array<struct<start:int,end:int,is_secret:int>>"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, out = dictionary(vocabulary), []
        for text, path, told in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
            text = text or ""
            spans = [(a, b, certain(text, a, b)) for a, b in candidates(text)] if told is None else [tuple(t.values()) for t in told]
            out += [(int(label), np.array(features(text, a, b, path, words), "<f4").tobytes())
                    for a, b, label in spans if label is not None and 0 <= a < b - 1 < len(text)]
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], ["label", "x"])

    return map_texts(rows, run, "label int, x binary").withColumn("h", F.xxhash64("x"))


def train(docs: DataFrame, vocabulary: str, findings: DataFrame | None = None, per_class: int = SAMPLE_PER_CLASS) -> Forest:
    """Fit on at most ``per_class`` findings of either kind; equal findings count once."""
    seen = cut(labelled(docs, vocabulary, findings).groupBy("x", "h").agg(F.max("label").alias("label")))  # the texts are read once
    rows = []
    for label in (0, 1):
        rows += seen.where(F.col("label") == label).orderBy("h", "x").limit(per_class).select("label", "x").collect()
    if not rows:
        return Forest([], 0.0)
    return fit_forest(np.stack([np.frombuffer(r.x, "<f4") for r in rows]).astype(float), np.array([r.label for r in rows]))


def scan_text(text: str, path: str, forest: Forest, words: frozenset[str], threshold: float, sure: bool) -> tuple[list[tuple[int, int]], int, float]:
    """(spans of secrets, number of candidates, highest probability); with ``sure``, contexts without doubt have probability 1."""
    spans = list(candidates(text))
    if not spans:
        return [], 0, 0.0
    p = forest.predict(np.array([features(text, a, b, path, words) for a, b in spans], "<f4").astype(float))
    if sure:
        p = np.where([certain(text, a, b) is True for a, b in spans], 1.0, p)
    return [s for s, q in zip(spans, p) if q >= threshold], len(spans), float(p.max())


def redact(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in spans:
        out += [text[at:a], MASK]
        at = b
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, vocabulary: str, findings: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_candidates, secrets (spans in code points), score (highest probability,
    0 without candidates) and redacted (the text with secrets masked; null for a null text)."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, vocabulary, findings))
    sure = findings is None
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, rows = dictionary(vocabulary), []
        for t, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            spans, n, score = scan_text(t or "", p, sent.value, words, threshold, sure)
            rows.append((n, [{"start": a, "end": b} for a, b in spans], score, None if t is None else redact(t, spans)))
        n, spans, score, text = zip(*rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(spans, spans_type), pa.array(score, pa.float64()),
                                           pa.array(text, pa.string())], ["doc_id", "n_candidates", "secrets", "score", "redacted"])

    rows = docs.select(F.col("doc_id").cast("bigint"), "text", _path(docs).alias("path"))
    return map_texts(rows, run, "doc_id bigint, n_candidates bigint, secrets array<struct<start:int,end:int>>, score double, redacted string")


def masked(docs: DataFrame, vocabulary: str, findings: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """``docs`` with the secrets in its texts masked, in the columns of ``docs``; null texts stay null."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, vocabulary, findings))

    sure = findings is None

    @F.pandas_udf("string")
    def mask(text: pd.Series, path: pd.Series) -> pd.Series:
        words = dictionary(vocabulary)
        return pd.Series([t if t is None else redact(t, scan_text(t, p, sent.value, words, threshold, sure)[0]) for t, p in zip(text, path)], dtype=object)

    return docs.withColumn("text", mask("text", _path(docs)))
