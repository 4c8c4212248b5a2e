"""Substring de-duplication: exact repeats of word windows, found by super-k-mer partitioning.

A window is ``window`` consecutive words; its minimiser is the least hash among its word triples.
Consecutive windows that share the minimiser travel as one packed string (a super-k-mer) to the bucket
that the minimiser names, so equal windows always meet and a word is sent about three times, not
``window`` times. A bucket sorts its windows and so finds, exactly, which of them start earlier elsewhere.

Repeats inside one batch are settled before anything is sent: only the first of equal windows travels,
so a passage that a third of all texts share reaches its bucket once per batch. Hashes only sort;
equality is always decided on the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import bounded, order_id, raw_texts, text_key

WINDOW, TRIPLE = 20, 3
BUCKET_BYTES = 64 << 20  # stored input bytes for each bucket
SLICE_BYTES = 6 << 20    # text handled at once before sending
PARTS = 16               # a bucket is settled in so many parts, by the minimiser's first bits, to bound memory
BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(int(BASE), -1, 1 << 64))


def word_ids(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """Number of each word in ``known``, which grows by the new ones; equal numbers mean equal words."""
    number = known.setdefault
    return np.fromiter((number(w, len(known)) for w in words), np.int32, len(words))


def word_hashes(known: dict[bytes, int]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, 1) for w in known), np.uint64, len(known))


class Rolling:
    """Hash of any run of words from two prefix sums; equal runs have equal hashes wherever they stand."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, BASE, np.uint64))))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * power[:n])))
        self.back = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, BACK, np.uint64))))

    def at(self, starts: np.ndarray, size: int) -> np.ndarray:
        h = (self.sums[starts + size] - self.sums[starts]) * self.back[starts]
        h = (h ^ (h >> np.uint64(32))) * BASE
        return h ^ (h >> np.uint64(29))


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values, by doubling."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def same_words(ids: np.ndarray, a: np.ndarray, b: np.ndarray, window: int) -> np.ndarray:
    equal = np.ones(len(a), bool)
    for k in range(window):
        equal &= ids[a + k] == ids[b + k]
    return equal


def earlier_windows(ids: np.ndarray, starts: np.ndarray, hashes: np.ndarray, rank: np.ndarray, window: int) -> np.ndarray:
    """For each window (start in ``ids``) the index of the least-ranked window with the same words."""
    order = np.lexsort((rank, hashes))
    sorted_hashes = hashes[order]
    head = np.concatenate((np.ones(1, bool), sorted_hashes[1:] != sorted_hashes[:-1])) if len(order) else np.zeros(0, bool)
    first = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    out = np.empty(len(order), np.int64)
    out[order] = first
    rest = np.nonzero(out != np.arange(len(order)))[0]
    odd = rest[~same_words(ids, starts[rest], starts[out[rest]], window)]
    if len(odd):  # different words under one hash: settle these groups by their words
        groups = np.nonzero(np.isin(hashes, hashes[odd]))[0]
        seen: dict[bytes, int] = {}
        for i in groups[np.argsort(rank[groups], kind="stable")]:
            out[i] = seen.setdefault(ids[starts[i]:starts[i] + window].tobytes(), int(i))
    return out


def intervals(starts: np.ndarray, window: int) -> bytes:
    """Sorted window starts as (first word, end) pairs of the runs they cover."""
    cut = np.nonzero(np.diff(starts) > window)[0] + 1
    first = starts[np.concatenate(([0], cut))]
    last = starts[np.concatenate((cut - 1, [len(starts) - 1]))]
    return np.stack((first, last + window), axis=1).astype("<i4").tobytes()


def marks(oid: np.ndarray, key: np.ndarray, start: np.ndarray, window: int) -> list[tuple[int, int, bytes]]:
    """One row per document with the word runs that its repeated windows cover."""
    if not len(oid):
        return []
    order = np.lexsort((start, key, oid))
    oid, key, start = oid[order], key[order], start[order]
    cut = np.nonzero((oid[1:] != oid[:-1]) | (key[1:] != key[:-1]))[0] + 1
    edges = np.concatenate(([0], cut, [len(oid)]))
    return [(int(oid[a]), int(key[a]), intervals(start[a:b], window)) for a, b in zip(edges[:-1], edges[1:])]


def pack_batch(oids: np.ndarray, keys: np.ndarray, texts: list[bytes], buckets: int, window: int) -> Iterator[tuple]:
    """Rows (bucket, oid, key, spans, strings): spans of locally repeated windows, or packed super-k-mers."""
    seen: dict[tuple[int, int], int] = {}
    for i in np.lexsort((keys, oids)):
        seen.setdefault((int(oids[i]), int(keys[i])), int(i))  # rows that repeat id and text are one
    rows = np.fromiter(seen.values(), np.int64, len(seen))
    known: dict[bytes, int] = {}
    split = [texts[i].split() for i in rows]
    words = [w for s in split for w in s]
    lengths = np.fromiter((len(s) for s in split), np.int64, len(split))
    ids = word_ids(words, known)
    if not len(ids):
        return
    owner = np.repeat(np.arange(len(rows)), lengths)
    base = np.concatenate(([0], np.cumsum(lengths)))
    n = len(ids)
    starts = np.arange(n)[np.arange(n) + window <= base[owner + 1]]
    if not len(starts):
        return
    rolling = Rolling(word_hashes(known)[ids])
    first = earlier_windows(ids, starts, rolling.at(starts, window), starts, window)
    own = first == np.arange(len(starts))
    again = starts[~own]
    for oid, key, spans in marks(oids[rows][owner[again]], keys[rows][owner[again]], again - base[owner[again]], window):
        yield (oid * 1_000_003 + key) % buckets, oid, key, spans, None  # both, since copies share their text key

    least = sliding_minimum(rolling.at(np.arange(n - TRIPLE + 1), TRIPLE), window - TRIPLE + 1)[starts]
    sent, least = starts[own], least[own]
    if not len(sent):
        return
    new = np.concatenate(([True], (sent[1:] != sent[:-1] + 1) | (least[1:] != least[:-1]) | (owner[sent[1:]] != owner[sent[:-1]])))
    a = np.nonzero(new)[0]
    b = np.concatenate((a[1:], [len(sent)])) - 1
    bucket = (least[a] % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((least[a], bucket))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, n))
    left, right = (ends[sent[a]] - np.fromiter((len(words[i]) + 1 for i in sent[a].tolist()), np.int64, len(a))), ends[sent[b] + window - 1] - 1
    rows_of = owner[sent[a]]
    meta = np.stack((oids[rows][rows_of], keys[rows][rows_of], sent[a] - base[rows_of], (least[a] >> np.uint64(60)).astype(np.int64)), axis=1)
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    squeeze = zstandard.ZstdCompressor(level=3)
    for k in np.nonzero(np.diff(edges))[0]:
        part = order[edges[k]:edges[k + 1]]
        strings = b"\n".join([joined[x:y] for x, y in zip(left[part].tolist(), right[part].tolist())])
        yield int(k), None, None, squeeze.compress(meta[part].astype("<i8").tobytes()), squeeze.compress(strings)


def deal(meta: bytes, strings: bytes, parts: list[list[tuple[np.ndarray, bytes]]]) -> None:
    """Open packed super-k-mers and append them to the parts of their minimisers (they come in that order)."""
    open_up = zstandard.ZstdDecompressor()
    rows = np.frombuffer(open_up.decompress(meta), "<i8").reshape(-1, 4)
    text = open_up.decompress(strings) + b"\n"
    ends = np.concatenate(([0], np.nonzero(np.frombuffer(text, np.uint8) == 10)[0] + 1))
    edges = np.searchsorted(rows[:, 3], np.arange(PARTS + 1))
    for k in np.nonzero(np.diff(edges))[0]:
        parts[k].append((rows[edges[k]:edges[k + 1], :3], text[ends[edges[k]]:ends[edges[k + 1]]]))


def settle_part(part: list[tuple[np.ndarray, bytes]], window: int) -> list[tuple[int, int, bytes]]:
    """Marks of all windows of a part that start earlier elsewhere."""
    known: dict[bytes, int] = {}
    metas, ids, sizes = [], [], []
    for meta, text in part:
        metas.append(meta)
        ids.append(word_ids(text.split(), known))
        raw = np.frombuffer(text, np.uint8)
        lines = np.cumsum((raw == 32) | (raw == 10))[raw == 10]
        sizes.append(np.diff(lines, prepend=0))
    meta, words, size = np.concatenate(metas), np.concatenate(ids), np.concatenate(sizes)
    count = size - window + 1
    which = np.repeat(np.arange(len(size)), count)
    inner = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    starts = (np.cumsum(size) - size)[which] + inner
    place = np.empty(len(size), np.int64)
    place[np.lexsort((meta[:, 2], meta[:, 1], meta[:, 0]))] = np.arange(len(size))
    hashes = Rolling(word_hashes(known)[words]).at(starts, window)
    first = earlier_windows(words, starts, hashes, place[which] * (1 << 32) + inner, window)
    position = meta[which, 2] + inner
    same = (meta[which, 0] == meta[which[first], 0]) & (meta[which, 1] == meta[which[first], 1]) & (position == position[first])
    again = np.nonzero(~same)[0]  # a copy of the very row that holds the first window is no later start
    return marks(meta[which[again], 0], meta[which[again], 1], position[again], window)


def repeated_spans(docs: DataFrame, window: int = WINDOW, buckets: int | None = None) -> DataFrame:
    """(oid, key, spans): for every document with repeated windows, the word runs to remove, as pairs of
    32-bit numbers in a list of byte strings. Earlier means smaller id, then text key, then position.

    ``buckets``: by default one for each 64 MB of stored input, and no fewer than the shuffle partitions."""
    if buckets is None:
        stored = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        stored = 0 if stored > 1 << 60 else stored  # the planner's way to say that it does not know
        buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), stored // BUCKET_BYTES)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = raw_texts(batch.column(2))
            for a, b in bounded(texts, SLICE_BYTES):
                rows = pack_batch(batch.column(0).to_numpy()[a:b], batch.column(1).to_numpy()[a:b], texts[a:b], buckets, window)
                columns = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, packed_types)], packed_names)

    packed_names = ["bucket", "oid", "key", "data", "strings"]
    packed_types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[tuple[np.ndarray, bytes]]] = [[] for _ in range(PARTS)]
        for batch in batches:
            oid, key, data, strings = (batch.column(i).to_pylist() for i in range(1, 5))
            for d, s in zip(data, strings):
                if s is not None:
                    deal(d, s, parts)
            yield as_marks([(o, k, d) for o, k, d, s in zip(oid, key, data, strings) if s is None])
        for k in range(PARTS):
            if parts[k]:
                yield as_marks(settle_part(parts[k], window))
            parts[k] = []

    def as_marks(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())],
                                          ["oid", "key", "spans"])

    sent = (docs.select(order_id().alias("oid"), text_key().alias("key"), "text")
            .mapInArrow(pack, "bucket int, oid bigint, key bigint, data binary, strings binary"))
    found = sent.repartitionById(buckets, F.col("bucket")).mapInArrow(settle, "oid bigint, key bigint, spans binary")
    return found.groupBy("oid", "key").agg(F.collect_list("spans").alias("spans"))


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept (the words left, joined by one space).

    Null and blank texts have no words and an empty ``kept``. Texts shorter than a window keep all words.
    Rows that repeat id and text are one document and get equal results; rows that repeat an id with
    other texts are further documents, in the order of their text keys.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), order_id().alias("oid"), text_key().alias("key"), "text")
    joined = rows.join(repeated_spans(docs, window), ["oid", "key"], "left").select("doc_id", "text", "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(raw_texts(batch.column(1)), batch.column(2).to_pylist()):
                words = text.split()
                gone = 0
                if spans:
                    step = np.zeros(len(words) + 1, np.int64)
                    pairs = np.frombuffer(b"".join(spans), "<i4").reshape(-1, 2)
                    np.add.at(step, pairs[:, 0], 1)
                    np.add.at(step, pairs[:, 1], -1)
                    keep = np.cumsum(step[:-1]) == 0
                    gone = len(words) - int(keep.sum())
                    words = [words[i] for i in np.nonzero(keep)[0].tolist()]
                n_words.append(len(words) + gone)
                n_removed.append(gone)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                                              pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(remove, "doc_id bigint, n_words bigint, n_removed bigint, kept string")
