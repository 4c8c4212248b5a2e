"""Byte-level BPE by a table of distinct words.

Texts are split into words (pieces). A block - a bounded run of texts - keeps its texts as positions in
its own list of distinct words, and sends only this list on, dealt over buckets by a hash of the word.
A bucket meets all blocks' copies of its words, encodes each distinct word once, and returns the ids in
list order; the ids join their block by its name and reach every position through the list. Decoding
joins ids to the vocabulary's pieces, whose table is bounded by the vocabulary.

A word that fills a third of the corpus is one entry per block, so no bucket grows with its frequency.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.pretokens import split_pieces
from tidemark.llm.tables import bounded
from tidemark.llm.transducer import Vocabulary

BLOCK = 4_000_000  # characters of a block


class Codec:
    """Encoder of single words and table of pieces, both from one vocabulary file."""

    def __init__(self, path: str):
        vocabulary = Vocabulary(path)
        self.special = vocabulary.special
        # ranks by merge order are what byte-pair merging needs; the file numbers its tokens in that order
        made = [a + b for a, b in vocabulary.rank]
        assert all(vocabulary.ids[x] < vocabulary.ids[y] for x, y in zip(made, made[1:])), "token ids must follow the merges"
        self.encoding = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=vocabulary.ids, special_tokens={})
        self.pieces = {i: t for t, i in vocabulary.ids.items()} | {i: t.encode() for t, i in self.special.items()}

    def encode(self, word: str) -> list[int]:
        return [self.special[word]] if word in self.special else self.encoding.encode_ordinary(word)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def words_of(texts: list[str], special: dict[str, int]) -> tuple[list[str], np.ndarray]:
    """Words of the texts in order and how many each has; a special token's string is a word of its own."""
    if not any(s in t for s in special for t in texts):
        return split_pieces(texts)
    parts, owner = [], []
    for i, text in enumerate(texts):
        found = [text]
        for s in special:
            found = [q for p in found for q in (apart(p, s) if p not in special else [p])]
        parts += found
        owner += [i] * len(found)
    words, each = split_pieces(["" if p in special else p for p in parts])
    out, counts, at = [], np.zeros(len(texts), np.int64), 0
    for p, n, i in zip(parts, each.tolist(), owner):
        new = [p] if p in special else words[at:at + n]
        at += n
        counts[i] += len(new)
        out += new
    return out, counts


def apart(text: str, special: str) -> list[str]:
    """The text split at a special token's string, which stays as a part of its own."""
    cut = text.split(special)
    return [q for k, p in enumerate(cut) for q in ((special, p) if k else (p,))]


def blocks(batch: pa.RecordBatch, special: dict[str, int], buckets: int, size: int) -> Iterator[tuple]:
    """(name, ids of the rows, words per row, words' numbers, distinct words, bucket edges) of each block."""
    texts = [t or "" for t in batch.column(1).to_pylist()]
    ids = batch.column(0).to_pylist()
    for a, b in bounded(texts, size):
        words, counts = words_of(texts[a:b], special)
        numbers: dict[str, int] = {}
        put = numbers.setdefault
        index = np.fromiter((put(w, len(numbers)) for w in words), np.uint32, len(words))
        distinct = [w.encode("utf-8", "surrogatepass") for w in numbers]
        bucket = np.fromiter((xxhash.xxh32_intdigest(w) % buckets for w in distinct), np.int64, len(distinct))
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        name = xxhash.xxh64_digest(repr(ids[a:b]).encode())
        name += xxhash.xxh64_digest(b"".join(distinct) + counts.tobytes() + index.tobytes())
        yield name, ids[a:b], counts, place[index], [distinct[i] for i in order], np.searchsorted(bucket[order], np.arange(buckets + 1))


def encoded(docs: DataFrame, path: str, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (little-endian unsigned 32-bit numbers) and decoded text.

    A null text is empty and has no ids. Special tokens' strings count as these tokens. ``block`` is a block's size in
    characters: smaller ones need less memory and send more words.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def word_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for name, _, _, _, words, edges in blocks(batch, codec(path).special, buckets, block):
                used = np.nonzero(np.diff(edges))[0]
                lists = []
                for k in used:
                    part = words[edges[k]:edges[k + 1]]
                    sizes = np.fromiter(map(len, part), "<u4", len(part))
                    lists.append(squeeze.compress(np.uint32(len(part)).tobytes() + sizes.tobytes() + b"".join(part)))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.binary()), pa.array(used, pa.int32()), pa.array(lists, pa.binary())],
                                                 ["block", "bucket", "words"])

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ids of every list, each distinct word of the bucket being encoded once."""
        squeeze, open_up = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        table: dict[bytes, bytes] = {}
        encode = codec(path).encode
        for batch in batches:
            for name, bucket, packed in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw = open_up.decompress(packed)
                n = int(np.frombuffer(raw, "<u4", 1)[0])
                ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64) + 4 + 4 * n
                found, at = [], 4 + 4 * n
                for end in ends.tolist():
                    word = raw[at:end]
                    at = end
                    ids = table.get(word)
                    if ids is None:
                        ids = table[word] = np.array(encode(word.decode("utf-8", "surrogatepass")), "<u4").tobytes()
                    found.append(ids)
                sizes = np.fromiter(map(len, found), "<u4", n) // 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name], pa.binary()), pa.array([bucket], pa.int32()),
                     pa.array([squeeze.compress(np.uint32(n).tobytes() + sizes.astype("<u4").tobytes() + b"".join(found))], pa.binary())], ["block", "bucket", "ids"])

    def texts_by_number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for name, ids, counts, index, words, _ in blocks(batch, codec(path).special, buckets, block):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name], pa.binary()), pa.array([ids], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())),
                     pa.array([squeeze.compress(index.astype("<u4").tobytes())], pa.binary()), pa.array([len(words)], pa.int64())],
                    ["block", "doc_ids", "counts", "numbers", "n_words"])

    lists = rows.mapInArrow(word_lists, "block binary, bucket int, words binary").repartitionById(buckets, F.col("bucket"))
    answers = (lists.mapInArrow(encode_words, "block binary, bucket int, ids binary").groupBy("block")
               .agg(F.collect_list(F.struct("bucket", "ids")).alias("answers")))  # as many as buckets, of a bounded block
    held = rows.mapInArrow(texts_by_number, "block binary, doc_ids array<bigint>, counts array<bigint>, numbers binary, n_words bigint")
    joined = held.join(answers, "block", "left").select("doc_ids", "counts", "numbers", "n_words", "answers.bucket", "answers.ids")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_up = zstandard.ZstdDecompressor()
        pieces = codec(path).pieces
        for batch in batches:
            for r in range(batch.num_rows):
                doc_ids, counts, numbers, n_words, bucket, packed = (batch.column(i)[r].as_py() for i in range(6))
                by_bucket = dict(zip(bucket or [], packed or []))
                sizes, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
                for k in sorted(by_bucket):
                    raw = open_up.decompress(by_bucket[k])
                    n = int(np.frombuffer(raw, "<u4", 1)[0])
                    sizes.append(np.frombuffer(raw, "<u4", n, 4).astype(np.int64))
                    ids.append(np.frombuffer(raw, "<u4", -1, 4 + 4 * n))
                size, table = np.concatenate(sizes), np.concatenate(ids)
                if len(size) != n_words:
                    raise ValueError("the two readings of the input made different blocks")
                start = np.cumsum(size) - size
                at = np.frombuffer(open_up.decompress(numbers), "<u4")
                out_ids, out_text = [], []
                edges = np.concatenate(([0], np.cumsum(counts)))
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    w = at[a:b]
                    n = size[w]
                    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    mine = table[np.repeat(start[w], n) + inner]
                    out_ids.append(mine.astype("<u4").tobytes())
                    out_text.append(b"".join([pieces[i] for i in mine.tolist()]).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(out_ids, pa.binary()), pa.array(out_text, pa.string())],
                                                 ["doc_id", "ids", "decoded"])

    return joined.mapInArrow(assemble, "doc_id bigint, ids binary, decoded string")


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
