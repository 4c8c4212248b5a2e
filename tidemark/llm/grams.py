"""Hashed character n-grams and words of many texts at once, as arrays over code points."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 400_000  # code points handled at once; longer texts come in several pieces
MIX = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0x100000001B3)


@dataclass
class Slice:
    """Pieces of texts in one array of code points, each led by a blank; ``rows`` names each piece's text."""

    codes: np.ndarray
    starts: np.ndarray
    rows: np.ndarray

    def __post_init__(self):
        c = self.codes
        self.blank = (c == 32) | ((c >= 9) & (c <= 13))
        self.codes = np.where(self.blank, np.uint32(32), c)

    def total(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value per position (the last blank excluded) over each piece."""
        return np.add.reduceat(values[:len(self.codes) - 1], self.starts)

    def grams(self, size: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of the n-gram at each position and whether it is one: no blank inside, at most at its ends."""
        n = len(self.codes) - 1
        h = np.zeros(n, np.uint64)
        valid = np.ones(n, bool)
        for k in range(size):
            part = self.codes[k:k + n].astype(np.uint64)
            h[:len(part)] = h[:len(part)] * STEP + part + np.uint64(1)
            valid[n + 1 - k:] = False
            if 0 < k < size - 1:
                valid[:len(part)] &= ~self.blank[k:k + n]
        return bucket(h + np.uint64(size), bits), valid

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Start position and 64-bit hash of every word."""
        inside = ~self.blank
        edge = np.diff(inside.astype(np.int8))
        begin, end = np.nonzero(edge == 1)[0] + 1, np.nonzero(edge == -1)[0] + 1
        powers = np.cumprod(np.full(len(self.codes), STEP, np.uint64))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((self.codes.astype(np.uint64) + np.uint64(1)) * powers)))
        back = np.cumprod(np.full(len(self.codes), np.uint64(pow(int(STEP), -1, 1 << 64)), np.uint64))
        return begin, (sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64)


def bucket(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * MIX
    return ((h ^ (h >> np.uint64(32))) * MIX >> np.uint64(64 - bits)).astype(np.int64)


def pieces(text: str) -> Iterator[str]:
    """The whole text in parts of bounded length, cut at a blank; without one, inside the word."""
    at = 0
    while len(text) - at > SLICE:
        cut = max(text.rfind(" ", at, at + SLICE), text.rfind("\n", at, at + SLICE))
        cut = cut if cut > at else at + SLICE
        yield text[at:cut]
        at = cut
    yield text[at:]


def slices(texts: list[str]) -> Iterator[Slice]:
    """All texts as slices of bounded size, in order; a text's pieces follow each other."""
    parts: list[str] = []
    rows: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        for part in pieces(text):
            if parts and size + len(part) > SLICE:
                yield _slice(parts, rows)
                parts, rows, size = [], [], 0
            parts.append(part)
            rows.append(i)
            size += len(part) + 1
    if parts:
        yield _slice(parts, rows)


def _slice(parts: list[str], rows: list[int]) -> Slice:
    codes = np.frombuffer(("\n" + "\n".join(parts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]])
    return Slice(codes, starts, np.array(rows))


def packed(rows: list[tuple[np.ndarray, np.ndarray]]) -> list[pa.Array]:
    """Features and counts of each text as two columns of bytes, which stay small on the driver."""
    return [pa.array([r[i].astype(np.int32).tobytes() for r in rows], pa.binary()) for i in (0, 1)]


def unpacked(table: pa.Table) -> list[dict]:
    """The rows of a table with columns doc_id, f and c (see ``packed``), in an order that only its content sets."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["doc_id"], r["f"], r["c"]))
    return [{**r, "f": np.frombuffer(r["f"], np.int32), "c": np.frombuffer(r["c"], np.int32)} for r in rows]
