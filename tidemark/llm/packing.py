"""Token ids as packed training rows.

Texts become token ids; texts longer than a row are split into row-long segments and a rest, losslessly.
Segments are packed best-fit decreasing: longest first, each into the fullest row that still takes it. A
segment tree over the capacities 0..length finds that row in log(length) steps, however many rows are open.
Every batch of texts is packed by itself, so nothing is shuffled and the work is spread like the input.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import bounded
from tidemark.llm.transducer import Vocabulary

ROW = 2048           # tokens of a row
TEXTS = 16_000_000   # characters packed together


class Capacities:
    """Segment tree over capacities: which rows have exactly so much room left."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        node = room + self.size
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (row, room) with the least room of at least ``need``."""
        count, node = self.count, need + self.size
        if not count[node]:
            while True:  # up, until a right neighbour holds a row
                if not node & 1 and count[node + 1]:
                    node += 1
                    break
                node >>= 1
                if node <= 1:
                    return None
            while node < self.size:  # down, to the least capacity there
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.size
        while node:
            count[node] -= 1
            node >>= 1
        return self.rows[room].pop(), room


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Segments of each row; equal sizes go in their given order, and no segment may exceed ``length``."""
    tree, rows = Capacities(length), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take(sizes[i])
        if found is None:
            found = len(rows), length
            rows.append([])
        row, room = found
        rows[row].append(i)
        if room > sizes[i]:
            tree.add(row, room - sizes[i])
    return rows


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    vocabulary = Vocabulary(path)
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=vocabulary.ids, special_tokens=vocabulary.special)


def number_type(largest: int) -> str:
    """Little-endian unsigned numbers that hold ``largest``: of 16 bits, or of 32 where these do not do."""
    return "<u2" if largest < 1 << 16 else "<u4"


def pack_texts(ids: list[int | None], texts: list[str], path: str, length: int, first_row: int) -> pa.RecordBatch:
    """The packed rows of some texts; special tokens' strings are ordinary text here."""
    kind = number_type(max(encoding(path).max_token_value, length))
    tokens = [np.asarray(encoding(path).encode_to_numpy(t, disallowed_special=(), allowed_special=set()), kind) if t else np.zeros(0, kind) for t in texts]
    segments = [(d, at, t[at:at + length]) for d, t in zip(ids, tokens) for at in range(0, len(t), length)]
    rows = best_fit_decreasing([len(s) for _, _, s in segments], length)
    columns: list[list] = [[] for _ in range(7)]
    for r, members in enumerate(rows):
        parts = [segments[i] for i in members]
        ends = np.cumsum([0] + [len(s) for _, _, s in parts])
        matrix, places = np.zeros(length, kind), np.zeros(length, kind)
        matrix[:ends[-1]] = np.concatenate([s for _, _, s in parts])
        places[:ends[-1]] = np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends))
        for c, value in zip(columns, (first_row + r, int(ends[-1]), matrix.tobytes(), places.tobytes(), ends.tolist(),
                                      [d for d, _, _ in parts], [at for _, at, _ in parts])):
            c.append(value)
    types = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], NAMES)


NAMES = ["row_id", "n_tokens", "input_ids", "position_ids", "cu_seqlens", "doc_ids", "doc_offsets"]
SCHEMA = ("row_id bigint, n_tokens int, input_ids binary, position_ids binary, cu_seqlens array<int>, "
          "doc_ids array<bigint>, doc_offsets array<int>")


def packed(docs: DataFrame, path: str, length: int = ROW) -> DataFrame:
    """Packed rows: row_id, n_tokens, input_ids and position_ids (``length`` little-endian numbers
    each, zero after n_tokens, of 16 bits or, for a larger vocabulary or length, of 32), cu_seqlens (where segments end, from 0), and for every segment the id of its
    document and its first token's place there (doc_ids, doc_offsets), from which texts are put together again.

    Positions start anew with each segment. Null and empty texts have no tokens and so no segment. A row's id holds the number of its input partition in the upper bits.
    """
    def run(batches):
        part, row = None, 0
        for batch in batches:
            if part is None and batch.num_rows:
                part = batch.column(2)[0].as_py()
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in bounded(texts, TEXTS):
                out = pack_texts(ids[a:b], texts[a:b], path, length, (part << 33) + row)
                row += out.num_rows
                yield out

    return docs.select(F.col("doc_id").cast("bigint"), "text", F.spark_partition_id().alias("part")).mapInArrow(run, SCHEMA)


def matrices(rows: list, length: int = ROW) -> tuple[np.ndarray, np.ndarray]:
    """(ids, positions) of collected rows as matrices with one line for each row."""
    kind = number_type(1 << 16 if rows and len(rows[0]["input_ids"]) > 2 * length else 0)
    return tuple(np.frombuffer(b"".join(r[c] for r in rows), kind).reshape(-1, length) for c in ("input_ids", "position_ids"))


def write(rows: DataFrame, path: str) -> None:
    """Write packed rows as Parquet; each file is a run of whole rows."""
    rows.write.mode("errorifexists").parquet(path)
