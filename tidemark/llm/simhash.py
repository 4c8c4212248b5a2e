"""SimHash fingerprints and their links, found with covering bit masks.

A fingerprint bit is the majority of that bit over the hashes of a text's shingles. Two fingerprints
within ``radius`` bits are found by covering hashing: bit positions get non-zero vectors of
``radius + 1`` bits, and the mask of a vector v keeps the positions whose vector has an odd product
with v. At most ``radius`` positions differ, their vectors cannot span the whole space, so some v is
orthogonal to all of them and its mask hides every difference: each pair within the radius collides
in at least one of the ``2 ** (radius + 1) - 1`` tables, always.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.tables import cut, map_texts, order_id, raw_texts, sweep, text_key, written

SMALL_BUCKET = 32  # buckets up to this size compare their members; larger ones meet at shared neighbours


def shingle_fingerprint(words: list[bytes], size: int, seed: int = 42) -> int:
    """Majority bits over the XXH64 of every shingle, repeats included; no words give zero."""
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words)))
    starts = np.concatenate(([0], ends[:-1])).tolist()
    ends = (ends - 1).tolist()
    digest, tail = xxhash.xxh64_digest, ends[size - 1:] or ends[-1:]
    hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(starts, tail)])
    return majority(np.frombuffer(hashes, np.uint8).reshape(-1, 8))


def majority(hashes: np.ndarray) -> int:
    """(n, 8) big-endian hash bytes -> bits set in over half of them, as a signed 64-bit number."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # long texts in slices, for bounded memory
        counts += np.unpackbits(hashes[i:i + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big", signed=True)


def ascii_words(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased; other letters stay as they are."""
    return text.lower().split()


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) for every row; null and blank texts have fingerprint zero."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [shingle_fingerprint(ascii_words(t), shingle, seed) for t in raw_texts(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return map_texts(docs.select(F.col("doc_id").cast("bigint"), "text"), run, "doc_id bigint, fp bigint")


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """Masks (signed) such that any two numbers within ``radius`` bits agree on all bits of one mask."""
    vectors = list(range(1, 2 ** (radius + 1)))
    dealt = [vectors[i % len(vectors)] for i in range(bits)]
    random.Random(radius).shuffle(dealt)
    masks = [sum(1 << i for i, m in enumerate(dealt) if bin(m & v).count("1") % 2) for v in vectors]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def apart(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(a.bitwiseXOR(b))


def close_pairs(nodes: DataFrame, count: int = 1, radius: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of ids of ``nodes`` (id, fps) with one of ``count`` fingerprints within ``radius`` bits.

    Only a hash of the bucket and the id are shuffled; buckets with a single member go before anything else.
    Small buckets give all their pairs within the radius. In a large bucket every member names the values
    within ``radius // 2`` bits of it in the hidden positions, and members that name the same value -
    which are within ``radius`` of each other - are paired with the least of them: as many rows as
    members times a constant, never all pairs. Every two nodes within the radius are joined by the pairs,
    directly or over the least member that both are paired with. The radius must be even for this.
    """
    if radius % 2:
        raise ValueError("radius must be even")
    masks = covering_masks(radius)
    tables = [(i, m) for i in range(count) for m in masks]
    keys = F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.xxhash64(F.lit(o), F.col("fps")[i].bitwiseAND(F.lit(m))).alias("k"))
                               for o, (i, m) in enumerate(tables)]))
    buckets = nodes.select("id", keys.alias("s")).select("id", "s.o", "s.k")
    sizes = buckets.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    which = (F.col("o") / len(masks)).cast("int")
    members = cut(buckets.join(sizes, "k").join(nodes.select("id", "fps"), "id")
                  .select("k", "n", "o", "id", which.alias("i"), F.get("fps", which).alias("fp")))

    small = (members.where(F.col("n") <= SMALL_BUCKET).groupBy("k").agg(F.collect_list(F.struct("id", "fp")).alias("all"))
             .select("all", F.explode("all").alias("x")))
    other = F.filter("all", lambda y: (y["id"] > F.col("x.id")) & (apart(y["fp"], F.col("x.fp")) <= radius))
    small = small.select(F.col("x.id").alias("a"), F.explode(other).alias("y")).select("a", F.col("y.id").alias("b"))

    large = neighbour_pairs(members.where(F.col("n") > SMALL_BUCKET), masks, radius)
    return small.unionByName(large).distinct()


def neighbour_pairs(members: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """Pairs that join all members of large buckets within the radius, by the values between them."""
    hidden = F.element_at(F.array(*[F.lit(~m) for m in masks]), F.col("o") % len(masks) + 1)
    around = members.select("id", "i", F.col("fp").alias("z"), hidden.alias("free"))
    for _ in range(radius // 2):
        steps = F.filter(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), i)),
                         lambda bit: F.col("free").bitwiseAND(bit) != 0)
        steps = F.concat(F.array(F.lit(0).cast("bigint")), steps)
        around = around.select("id", "i", "free", F.explode(F.transform(steps, lambda s: F.col("z").bitwiseXOR(s))).alias("z"))
    around = around.select("i", "z", "id").distinct()
    least = around.groupBy("i", "z").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1").select("i", "z", "a")
    return around.join(least, ["i", "z"]).select("a", F.col("id").alias("b")).where("a != b")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id (smallest id reachable over links).

    Equal fingerprints are one node, so a group of copies of any size costs one node. Null ids come back
    null and take part as the smallest id.
    """
    return group_fingerprints(cut(fingerprints(docs, shingle)), radius)


def group_fingerprints(rows: DataFrame, radius: int) -> DataFrame:
    nodes = cut(rows.groupBy("fp").agg(F.min(order_id()).alias("first")))
    labels = components(close_pairs(nodes.select(F.col("fp").alias("id"), F.array("fp").alias("fps")), 1, radius), "a", "b")
    joined = cut(nodes.join(labels, F.col("fp") == F.col("node"), "left")
                 .select("fp", "first", F.coalesce("component", "fp").alias("c")))
    smallest = joined.groupBy("c").agg(F.min("first").alias("component_id"))
    classes = cut(joined.join(smallest, "c").select(F.col("fp").alias("f"), "component_id"))
    return rows.join(classes, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")


def hex16(fp: str = "fp") -> Column:
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


# near copies -----------------------------------------------------------------------------------------

SAMPLED = 64        # of so many texts one is counted for the order of shingles, which decides time and never results ...
FREQUENT = 200_000  # ... and at most so many frequent shingles are known to it
SEEN = 200_000    # texts that a task knows to have sent
HUBS = 4            # orders of members by which large buckets choose their hubs
SKETCH = 512        # bits of a parity sketch, and the fewest of a fine one, which has two or more for each shingle ...
FINEST = 1 << 17    # ... and at most so many
EARLIER = 16        # so many buckets before one are known to a member, so that a pair is named once and not in every bucket of both
FILTER = 1 << 23    # bits of the filter of nodes whose texts are wanted; fewer let more texts through, results stay the same
PLAIN = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text: bytes) -> list[bytes]:
    """Runs of letters, digits and other non-ASCII characters, A-Z lower-cased: case and punctuation do not count."""
    return PLAIN.findall(text.lower())


def each_hash(words: list[bytes], size: int) -> np.ndarray:
    """Hashes of the shingles, repeats included; fewer words are one shingle, none have none."""
    n = max(1, len(words) - size + 1) if words else 0
    return np.frombuffer(b"".join([xxhash.xxh64_digest(b" ".join(words[i:i + size])) for i in range(n)]), "<i8")


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(each_hash(words, size))


def frequent_shingles(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of shingles that a sample of the texts repeats."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_hashes(plain_words(t), shingle) for t in raw_texts(batch.column(0))]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets))], ["h"])

    sample = rows.where(F.pmod("node", F.lit(SAMPLED)) == 0).select("text")
    found = (map_texts(sample, run, "h bigint").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
             .orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow())
    hashes, counts = (found.column(c).to_numpy() for c in ("h", "n"))
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def prefix(shingles: np.ndarray, least: float, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles, rare ones before frequent ones: a set at least so alike shares one of them. Empty sets share a zero."""
    n = len(shingles)
    if not n:
        return np.zeros(1, "<i8")
    hashes, counts = frequent
    weight = np.zeros(n, np.int64)
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, shingles), len(hashes) - 1)
        weight = np.where(hashes[at] == shingles, counts[at], 0)
    return shingles[np.lexsort((shingles, weight))][:n - math.ceil(least * n - 1e-9) + 1]


def leads(size: Column, pos: Column, least: float) -> Column:
    """Whether a place of a prefix is among those that must hold the first common shingle when the other set is no smaller."""
    return pos < F.greatest(F.lit(1), size - F.ceil(2 * least / (1 + least) * size - 1e-9) + 1)


def can_be_alike(size: Column, pos: Column, size2: Column, pos2: Column, least: float) -> Column:
    """At the first shingle that two sets share, no more of a set can be common than what follows it in the order of the prefixes."""
    return F.least(size - pos, size2 - pos2) >= least / (1 + least) * (size + size2) - 1e-9


def lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values)))


def prefix_rows(texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """(h, node, size, pos): the prefixes of texts (node, text). A task sends a text that it meets again only once."""
    sent = texts.sparkSession.sparkContext.broadcast(frequent_shingles(texts, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes, sizes, found = [], [], []
            for node, t in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
                if node in seen:
                    continue
                seen.add(node)
                s = shingle_hashes(plain_words(t), shingle)
                nodes.append(node)
                sizes.append(len(s))
                found.append(prefix(s, least, sent.value))
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), lists(found)], ["node", "size", "p"])
            if len(seen) > SEEN:
                seen.clear()

    return texts.select("node", "text").mapInArrow(run, "node bigint, size int, p array<bigint>").select("node", "size", F.posexplode("p").alias("pos", "h"))


def small_pairs(members: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b), a < b, of members of small buckets that can be alike."""
    each = members.groupBy("h").agg(F.collect_list(F.struct("node", "size", "pos", "lead")).alias("all"))
    each = each.select("all", F.explode(F.filter("all", lambda x: x["lead"])).alias("x"))
    other = F.filter("all", lambda y: (y["node"] != F.col("x.node")) & (y["size"] >= F.col("x.size")) & can_be_alike(
        F.col("x.size"), F.col("x.pos"), y["size"], y["pos"], least))
    pairs = each.select(F.col("x.node").alias("node"), F.explode(other).alias("y"))
    return pairs.select(F.least("node", "y.node").alias("a"), F.greatest("node", "y.node").alias("b")).distinct()


def meeting(left: DataFrame, right: DataFrame, least: float, allowed: Column) -> DataFrame:
    """Pairs (a, b), a < b, of members (h, node, size, pos) of the same bucket that can be alike."""
    return meetings(left, right, least, allowed).distinct()


def meetings(left: DataFrame, right: DataFrame, least: float, allowed: Column) -> DataFrame:
    """The pairs of ``meeting``, one for each bucket in which they meet."""
    right = right.select("h", *[F.col(c).alias(f"{c}2") for c in right.columns if c != "h"])
    pairs = left.join(right, "h").where(allowed & can_be_alike(F.col("size"), F.col("pos"), F.col("size2"), F.col("pos2"), least))
    return pairs.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"))


def earlier_buckets(members: DataFrame) -> DataFrame:
    """``members`` (h, node, pos, ...) with the buckets ``before`` each of a node's buckets, the nearest ``EARLIER``."""
    here = Window.partitionBy("node").orderBy("pos").rowsBetween(-EARLIER, -1)
    return members.withColumn("before", F.collect_list("h").over(here))


def first_meetings(grouped: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of members (h, node, size, pos, lead, c, sketch, before) of two groups ``c`` that can be alike, few of them more than once.

    The shingles of all prefixes have one order, and what lets a pair meet in one bucket does so in all earlier ones that it shares.
    So a bucket need not name a pair that shares one of the buckets before it.
    """
    return meetings(grouped.where("lead"), grouped.drop("lead"), least,
                    (F.col("size") <= F.col("size2")) & (F.col("node") != F.col("node2")) & (F.col("c") != F.col("c2"))
                    & may_be_alike(F.col("size"), F.col("sketch"), F.col("size2"), F.col("sketch2"), least)
                    & ~F.arrays_overlap("before", "before2"))


def parity_sketch(shingles: np.ndarray, bins: int = SKETCH) -> np.ndarray:
    """For each of ``bins`` bins of shingles (a power of two), whether it holds an odd number of them."""
    counts = np.bincount(shingles & (bins - 1), minlength=bins)
    return np.packbits((counts & 1).astype(np.uint8)).view("<i8")


def fine_sketch(shingles: np.ndarray) -> bytes:
    """Parity sketch with bins enough for the set, so that it does not fill up as sets grow."""
    return parity_sketch(shingles, min(FINEST, max(SKETCH, 1 << (2 * len(shingles)).bit_length()))).tobytes()


def bins_apart(a: bytes, b: bytes) -> int:
    """Bins in which two fine sketches differ; the longer one is folded, which gives the sketch with fewer bins."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def signatures(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, size, fp, sketch, fine) for the texts (node, text): number of different shingles, SimHash fingerprint, parity sketches.

    Bins in which two sketches differ hold at least one shingle that only one of the sets has (``may_be_alike``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            if len(seen) > SEEN:
                seen.clear()
            nodes, sizes, fps, sketches, fine = [], [], [], [], []
            for node, t in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
                if node not in seen:
                    seen.add(node)
                    hashes = each_hash(plain_words(t), shingle)
                    shingles = np.unique(hashes)
                    nodes.append(node)
                    sizes.append(len(shingles))
                    fps.append(majority(hashes.view(np.uint8).reshape(-1, 8)))
                    sketches.append(parity_sketch(shingles))
                    fine.append(fine_sketch(shingles))
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(fps, pa.int64()), lists(sketches),
                                                  pa.array(fine, pa.binary())], ["node", "size", "fp", "sketch", "fine"])

    each = texts.select("node", "text").mapInArrow(run, "node bigint, size int, fp bigint, sketch array<bigint>, fine binary")
    return each.groupBy("node").agg(*[F.first(c).alias(c) for c in ("size", "fp", "sketch", "fine")])


def parity_sketches(texts: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, sketch) for the texts (node, text) of ``nodes``."""
    wanted = texts.join(nodes.select("node").distinct(), "node", "left_semi")
    return signatures(wanted, shingle).select("node", "sketch")


def simhash_pairs(known: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b), a < b, of nodes of ``known`` (node, fp) that covering masks bring together: their fingerprints are within the radius.

    Nodes of one fingerprint meet its least node, which stands for them in the tables of the masks.
    """
    heads = cut(known.groupBy("fp").agg(F.min("node").alias("head")))
    same = known.join(heads, "fp").where("node != head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    close = close_pairs(heads.select(F.col("fp").alias("id"), F.array("fp").alias("fps")), 1, radius)
    close = close.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b")
    return same.union(close.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def may_be_alike(size: Column, sketch: Column, size2: Column, sketch2: Column, least: float) -> Column:
    """Whether two parity sketches differ in no more bins than sets at least so alike differ in shingles. It rules out no such pair."""
    differ = sum((apart(F.get(sketch, F.lit(i)), F.get(sketch2, F.lit(i))) for i in range(SKETCH // 64)), F.lit(0))
    return differ <= (1 - least) / (1 + least) * (size + size2) + 1e-9


def possible(pairs: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of ``known`` (node, size, sketch, fine, c) that are not in one group ``c`` and whose sketches leave room for the similarity."""
    marks = known.select("node", "size", "fine")
    for side, end in (("a", ""), ("b", "2")):
        pairs = pairs.join(known.select(F.col("node").alias(side), *[F.col(c).alias(c + end) for c in ("size", "sketch", "c")]), side)
    pairs = pairs.where((F.col("c") != F.col("c2")) & may_be_alike(*[F.col(c) for c in ("size", "sketch", "size2", "sketch2")], least)).select("a", "b")
    return finely_possible(pairs, marks, least)


def finely_possible(pairs: DataFrame, marks: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of ``marks`` (node, size, fine) whose fine sketches leave room for the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = (1 - least) / (1 + least)
        for batch in batches:
            sizes, x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()
            keep = [bins_apart(s, t) <= share * n + 1e-9 for n, s, t in zip(sizes, x, y)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    for side, end in (("a", ""), ("b", "2")):
        pairs = pairs.join(marks.select(F.col("node").alias(side), F.col("size").alias("size" + end), F.col("fine").alias("fine" + end)), side)
    return pairs.select("a", "b", (F.col("size") + F.col("size2")).alias("n"), "fine", "fine2").mapInArrow(run, "a bigint, b bigint")


def perhaps_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The texts (node, text) whose node is in ``nodes``, and few others: a join with ``nodes`` then need not deal out all texts."""
    bit = F.pmod("node", F.lit(FILTER)) + 1
    maps = (nodes.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("at"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).toArrow())
    held = np.zeros((max(1, FILTER >> 15), 4096), np.uint8)
    for at, bits in zip(maps.column("at").to_pylist(), maps.column("bits").to_pylist()):
        held[at - 1] = np.frombuffer(bits, np.uint8)
    sent = texts.sparkSession.sparkContext.broadcast(held.reshape(-1))

    @F.pandas_udf("boolean")
    def wanted(node: pd.Series) -> pd.Series:
        bit = node.to_numpy() & (FILTER - 1)
        return pd.Series((sent.value[bit >> 3] >> (bit & 7)) & 1 == 1)

    return texts.where(wanted("node"))


def alike(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs (a, b) whose texts have shingle sets at least so alike. ``texts`` (node, text) may repeat a node.

    Texts travel, not sets: packed text is a third of the hashes of its shingles. Each side is joined on its own.
    """
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = cut(wanted)
    needed = written(perhaps_of(texts, wanted).join(wanted, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), "compared-texts")
    sweep(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[int, np.ndarray] = {}
            keep = []
            a, b = (batch.column(i).to_pylist() for i in (0, 1))
            sides = raw_texts(batch.column(2)), raw_texts(batch.column(3))
            for i in range(batch.num_rows):
                sets = []
                if len(known) > 2000:
                    known.clear()
                for node, t in ((a[i], sides[0][i]), (b[i], sides[1][i])):
                    if node not in known:
                        known[node] = shingle_hashes(plain_words(t), shingle)
                    sets.append(known[node])
                common = len(np.intersect1d(*sets, assume_unique=True))
                union = len(sets[0]) + len(sets[1]) - common
                keep.append(union == 0 or common >= least * union)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    both = pairs.join(needed.select(F.col("node").alias("a"), F.col("text").alias("s")), "a")
    both = both.join(needed.select(F.col("node").alias("b"), F.col("text").alias("r")), "b")
    return both.select("a", "b", "s", "r").mapInArrow(run, "a bigint, b bigint")


def nodes_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, known): ``docs`` as (node, text), and (oid, key, node, n), the distinct documents with their number of rows.

    A node is a text, named by its 64-bit key. Different texts with one key - a second hash tells them apart; some are
    to be expected among 10 ** 10 texts - are named by the second hash instead.
    """
    second = F.xxhash64(F.lit(1), F.coalesce("text", F.lit("")))
    rows = docs.select(order_id().alias("oid"), text_key().alias("key"), second.alias("key2"), "text")
    known = cut(rows.groupBy("oid", "key", "key2").agg(F.count("*").alias("n")))
    odd = cut(known.groupBy("key").agg(F.min("key2").alias("low"), F.max("key2").alias("high")).where("low != high").select(F.col("key").alias("odd")))
    if odd.isEmpty():
        return rows.select(F.col("key").alias("node"), "text"), known.select("oid", "key", F.col("key").alias("node"), "n")
    node = F.when(F.col("odd").isNull(), F.col("key")).otherwise(F.col("key2")).alias("node")
    rows, known = (t.join(odd, F.col("key") == F.col("odd"), "left") for t in (rows, known))
    return rows.select(node, "text"), known.select("oid", "key", node, "n")


def grouped_by(known: DataFrame, labels: DataFrame) -> DataFrame:
    """``known`` (node, ...) with the group ``c`` of each node by ``labels`` (node, component); others are a group of their own."""
    return known.join(labels.select(F.col("node").alias("k"), "component"), F.col("node") == F.col("k"), "left").select(
        *known.columns, F.coalesce("component", "node").alias("c"))


def near_copies(docs: DataFrame, shingle: int = 5, least: float = 0.8, radius: int = 2) -> DataFrame:
    """(oid, key, n, first_oid, first_key): for every document that is an exact or near copy, its group's first.

    A document is a distinct pair of order id and text key, ``n`` its number of rows. Groups are components over links
    between texts whose word shingles have a Jaccard similarity of at least ``least``; none is missed. First SimHash
    fingerprints within ``radius`` bits, found by covering masks, name candidates (``simhash_pairs``); those that pass the
    check on the whole texts make groups. Similar texts can be further apart than the radius, so all links between
    these groups are found exactly: texts of two groups that share a shingle of their prefixes (``prefix``), and of the smaller one it
    is among the leading places (``leads``), are checked on the whole texts. Members of a large bucket meet its hub first; then all those
    meet that are not yet in one group, each pair in the first bucket of both: the shingles of all prefixes have one order, and
    what holds for a pair in a later bucket holds in an earlier one. No pair is checked whose parity sketches leave no room for the similarity,
    so a large group of copies costs no pair per two members, and texts of one
    template that differ in a ninth of their shingles or more have no leading place in a bucket of the template.
    A group's first is the least id (then text key). Blank texts are copies of each other.
    """
    rows, known = nodes_of(docs)
    marks = written(signatures(rows, shingle), "signatures")
    alone = marks.withColumn("c", F.col("node"))
    close = written(possible(simhash_pairs(marks, radius), alone, least), "pairs")
    labels = components(alike(close, rows, shingle, least), "a", "b")
    sweep(docs.sparkSession)
    each = prefix_rows(rows, shingle, least).repartition("h").distinct()
    here = Window.partitionBy("h")
    each = each.withColumn("lead", leads(F.col("size"), F.col("pos"), least))
    each = each.withColumns({"n": F.count("*").over(here), "leading": F.max("lead").over(here)})
    members = written(each.where("n > 1 and leading").drop("leading"), "prefix-members")
    sweep(docs.sparkSession)
    large = members.where(F.col("n") > SMALL_BUCKET)
    hub = F.min_by(F.struct("node", "size", "pos"), F.xxhash64("node", F.pmod("h", F.lit(HUBS)))).alias("hub")
    hubs = large.groupBy("h").agg(hub).select("h", "hub.*")
    met = (small_pairs(members.where(F.col("n") <= SMALL_BUCKET), least)
           .union(meeting(large.select("h", "node", "size", "pos"), hubs, least, F.col("node") != F.col("node2"))).distinct())
    met = written(possible(met, grouped_by(marks, labels), least).join(close, ["a", "b"], "left_anti"), "pairs")
    labels = components(alike(met, rows, shingle, least).union(labels.select("node", "component")), "a", "b")
    sweep(docs.sparkSession)
    if not large.isEmpty():
        grouped = grouped_by(large.select("h", "node", "size", "pos", "lead"), labels)
        mixed = grouped.groupBy("h").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low != high").select("h")
        grouped = cut(earlier_buckets(grouped.join(mixed, "h")).join(marks.select("node", "sketch"), "node"))
        rest = first_meetings(grouped, least).distinct()
        rest = written(finely_possible(rest.join(close.union(met), ["a", "b"], "left_anti"), marks, least), "pairs")
        sweep(docs.sparkSession)
        if not rest.isEmpty():
            labels = components(alike(rest, rows, shingle, least).union(labels.select("node", "component")), "a", "b")
    sweep(docs.sparkSession)
    grouped = cut(grouped_by(known, labels).select("oid", "key", "n", "c"))
    head = grouped.groupBy("c").agg(F.min(F.struct("oid", "key")).alias("head"))
    return (grouped.join(head, "c").select("oid", "key", "n", F.col("head.oid").alias("first_oid"), F.col("head.key").alias("first_key"))
            .where("n > 1 or oid != first_oid or key != first_key"))
