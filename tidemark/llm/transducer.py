"""Token counts from compiled finite-state machines.

Two deterministic transducers follow each other. The first (``pretokens``) finds the pieces into which
byte-level BPE splits a text. The second reads the bytes of a piece, and each of its transitions is
annotated with the number of tokens that the byte adds to the count so far: a negative number where it
lets earlier tokens merge. Its states are compiled when first reached and kept.

A state holds what the rest of a piece can depend on: for every earlier position from which the bytes up
to here may still grow into a token, these bytes, the last token before them and the count there. The
encoding of any prefix ends with exactly one token that fits the token before it, where two tokens fit
if byte-pair merging their joined bytes gives back just these two. So the next state is unique.
Whether two tokens fit is read off their merge trees: while the joined bytes merge, each part along the
seam exists from its own merge until its parent's, and the tokens fit unless some pair of such parts
has a merge that comes before both parents (of equal merges the leftmost comes first).
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.pretokens import split_pieces
from tidemark.llm.tables import bounded, map_texts

CACHED_PIECES, CACHED_STEPS = 600_000, 400_000  # memory bounds of a worker; when full, a cache starts anew


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: printable Latin-1 for itself, the rest from U+0100 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens and merges of a byte-level BPE file, on bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {tuple(bytes(alphabet[c] for c in half) for half in m): r for r, m in enumerate(pairs)}

    def merge(self, piece: bytes) -> list[bytes]:
        """Plain byte-pair merging, lowest rank first."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), len(self.rank)))
            pair = (parts[best], parts[best + 1])
            if pair not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts


class PieceCounter:
    """The second transducer, compiled on demand; also remembers the counts of pieces."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.halves = {a + b: (a, b) for (a, b) in reversed(self.vocabulary.rank)}  # the first merge that makes a token
        self.openings = {t[:n] for t in self.vocabulary.ids for n in range(1, len(t))}
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.seams: dict[tuple[bytes, int], list[tuple[bytes, int]]] = {}  # at most two for each token
        self.whole = {t for t in self.vocabulary.ids if self.vocabulary.merge(t) == [t]}
        self.reset()
        self.counts: dict[str, int] = {}

    def reset(self) -> None:
        start = ((b"", None, 0),)
        self.states, self.numbers, self.steps = [start], {start: 0}, {}

    def fit(self, left: bytes | None, right: bytes) -> bool:
        if left is None:
            return right in self.whole
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) > CACHED_STEPS:
                self.fits.clear()
            known = self.fits[left, right] = right in self.whole and not self.joins(left, right)
        return known

    def joins(self, left: bytes, right: bytes) -> bool:
        """Whether some merge crosses the seam of two tokens before both are complete."""
        none, rank = len(self.vocabulary.rank), self.vocabulary.rank.get
        behind = self.seam(right, 0)
        return any(r < end and r <= other for part, end in self.seam(left, 1) for first, other in behind
                   if (r := rank((part, first), none)) < none)

    def seam(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """Parts of a token that lie at its left (0) or right (1) end, each with the rank of the merge that ends it."""
        known = self.seams.get((token, side))
        if known is None:
            known, part, end = [], token, len(self.vocabulary.rank)
            while True:
                known.append((part, end))
                halves = self.halves.get(part)
                if halves is None:
                    break
                part, end = halves[side], self.vocabulary.rank[halves]
            self.seams[token, side] = known
        return known

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition of a state on a byte: (next state, tokens added)."""
        alive, token, added = [], b"", 0
        x = bytes((byte,))
        for opened, before, count in self.states[state]:
            grown = opened + x
            if len(grown) > len(token) and grown in self.vocabulary.ids and self.fit(before, grown):
                token, added = grown, count + 1
            if grown in self.openings:
                alive.append((grown, before, count))
        nxt = (*((o, b, c - added) for o, b, c in alive), (b"", token, 0))
        number = self.numbers.get(nxt)
        if number is None:
            number = self.numbers[nxt] = len(self.states)
            self.states.append(nxt)
        self.steps[state << 8 | byte] = number, added
        return number, added

    def count(self, piece: bytes) -> int:
        if len(self.steps) > CACHED_STEPS:
            self.reset()
        state = total = 0
        steps = self.steps
        for byte in piece:
            step = steps.get(state << 8 | byte)
            if step is None:
                step = self.compile(state, byte)
            state = step[0]
            total += step[1]
        return total

    def of(self, pieces: list[str]) -> np.ndarray:
        """Token count of each piece."""
        if len(self.counts) > CACHED_PIECES:
            self.counts.clear()
        counts = self.counts
        for p in set(pieces).difference(counts):
            counts[p] = self.count(p.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(counts.__getitem__, pieces), np.int64, len(pieces))


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def token_counts(texts: list[str], path: str) -> np.ndarray:
    """Tokens of each whole text; a special token's string counts as that one token, as the library has it."""
    machine = counter(path)
    total = np.zeros(len(texts), np.int64)
    parts, owner = [], []
    for i, text in enumerate(texts):
        pieces = [text]
        for special in machine.vocabulary.special:
            if special in text:
                cut = [p.split(special) for p in pieces]
                total[i] += sum(len(c) - 1 for c in cut)
                pieces = [p for c in cut for p in c]
        parts += pieces
        owner += [i] * len(pieces)
    for a, b in bounded(parts):
        pieces, each = split_pieces(parts[a:b])
        sums = np.concatenate(([0], np.cumsum(machine.of(pieces))))
        edges = np.concatenate(([0], np.cumsum(each)))
        np.add.at(total, owner[a:b], sums[edges[1:]] - sums[edges[:-1]])
    return total


def counted(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit. A null text is empty: no bytes, no tokens."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = token_counts([t or "" for t in batch.column(2).to_pylist()], path)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "text")
    return (map_texts(rows, run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
            .withColumn("over_limit", F.col("n_tokens") > limit))
