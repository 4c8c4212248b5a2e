"""The splitter of byte-level BPE as a deterministic transducer over character classes.

It reads one character at a time and tells, one character late, whether a piece began there: a run of
blanks gives its last one to what follows, and an apostrophe may open a contraction, so a character's
part is settled by the one after it. Texts are cut into chunks of equal length. For a chunk whose
start is unknown the machine runs from every state at once; the resulting state maps are composed by a
parallel prefix scan, which gives every chunk its start; then all chunks run together.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import regex
from tokenizers.pre_tokenizers import ByteLevel

CHUNK = 256
LETTER, SHORT, R, V, E, DOUBLE, NUMBER, OTHER, QUOTE, SPACE, BLANK, STOP = range(12)
STATES = ("begin", "letter", "letter!", "number", "number!", "other", "other!", "quote!", "quote r", "quote v", "quote l", "closed",
          "space!", "blank!", "space?", "blank?")  # ! the last character began a piece, ? the next one will tell


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point, by the tokenizer library's edition of Unicode."""
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, value in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\p{White_Space}", BLANK)):
        everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        found = "".join(regex.findall(pattern + "+", everything))
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = value
    # code points newer than Python's own tables: the library's splitter says how it reads them
    split = ByteLevel(add_prefix_space=False).pre_tokenize_str
    for cp in np.nonzero((out == LETTER) | (out == NUMBER))[0].tolist():
        if unicodedata.category(chr(cp)) == "Cn":
            out[cp] = LETTER if len(split(f"a{chr(cp)}")) == 1 else NUMBER if len(split(f"1{chr(cp)}")) == 1 else OTHER
    for letters, value in (("stmd", SHORT), ("r", R), ("v", V), ("e", E), ("l", DOUBLE), ("'", QUOTE), (" ", SPACE)):
        out[[ord(x) for x in letters]] = value
    return out


@lru_cache(maxsize=1)
def machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether the character before began a piece), both by class * 16 + state."""
    n = len(STATES)
    follow, began = np.zeros((12, n), np.uint8), np.zeros((12, n), bool)
    for s, name in enumerate(STATES):
        for c in range(12):
            blank, word = c in (SPACE, BLANK), c <= DOUBLE
            base = name.rstrip("!?")
            if name.endswith("!"):
                began[c, s] = True
            elif name.endswith("?"):
                began[c, s] = not blank and c != STOP
            completes = (base == "quote r" and c == E) or (base == "quote v" and c == E) or (base == "quote l" and c == DOUBLE)
            if base.startswith("quote "):
                began[c, s] = not completes
                base = "closed" if completes else "letter"
            kind = "letter" if word else {NUMBER: "number", OTHER: "other", QUOTE: "other"}.get(c, "")
            if c == STOP:
                to = "begin"
            elif blank:
                to = ("space" if c == SPACE else "blank") + ("?" if base in ("space", "blank") else "!")
            elif base == "space":
                to = kind
            elif completes:
                to = "closed"
            elif base == "quote" and word and c in (SHORT, R, V, DOUBLE):
                to = {SHORT: "closed", R: "quote r", V: "quote v", DOUBLE: "quote l"}[c]
            elif base == kind or (base == "quote" and kind == "other"):
                to = kind
            else:
                to = "quote!" if c == QUOTE else kind + "!"
            follow[c, s] = STATES.index(to)
    return follow.ravel(), began.ravel()


def compose(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan of state maps (row = chunk): row k becomes the map of chunks 0..k, in log steps."""
    step = 1
    while step < len(maps):
        maps = np.concatenate((maps[:step], np.take_along_axis(maps[step:], maps[:-step], axis=1)))
        step *= 2
    return maps


def chunk_maps(chunks: np.ndarray) -> np.ndarray:
    """End state of every chunk (column) for each start state; once all starts agree, one run is enough."""
    follow, _ = machine()
    maps = np.broadcast_to(np.arange(len(STATES), dtype=np.uint8), (chunks.shape[1], len(STATES))).copy()
    for j in range(len(chunks)):
        if (maps == maps[:, :1]).all():
            one = maps[:, 0]
            for k in range(j, len(chunks)):
                one = follow[chunks[k] * 16 + one]
            return np.broadcast_to(one[:, None], maps.shape)
        maps = follow[chunks[j][:, None] * 16 + maps]
    return maps


def piece_starts(kinds: np.ndarray) -> np.ndarray:
    """For class codes (texts ended by STOP) whether a piece begins at each character; STOP begins one as well."""
    n = len(kinds)
    padded = np.full(-(-(n + 1) // CHUNK) * CHUNK, STOP, np.uint8)
    padded[:n] = kinds
    chunks = np.ascontiguousarray(padded.reshape(-1, CHUNK).T)
    state = np.zeros(chunks.shape[1], np.uint8)
    state[1:] = compose(chunk_maps(chunks))[:-1, 0]
    follow, began = machine()
    told = np.empty(chunks.shape, bool)
    for j in range(CHUNK):
        at = chunks[j] * 16 + state
        told[j] = began[at]
        state = follow[at]
    flags = told.T.ravel()[1:n + 1].copy()  # told one character late
    flags[kinds == STOP] = True
    return flags


def split_pieces(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """All pieces of the texts in order, and how many each text has."""
    joined = "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    stops = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
    kinds = classes()[codes]
    kinds[stops] = STOP
    starts = np.nonzero(piece_starts(kinds))[0]
    ends = np.append(starts[1:], len(codes))
    real = kinds[starts] != STOP
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts[real], stops))))
    return [joined[a:b] for a, b in zip(starts[real].tolist(), ends[real].tolist())], counts
