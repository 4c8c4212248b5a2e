"""How far the sources of each language differ in their use of terms, from bitmaps of terms by count.

Term counts are summed over all documents by language, source and term. The terms a language keeps get a block by
hash, and a word and bit inside the block; a group's terms with one count in one 64-bit word are one row, (word,
count, bits), so a word of a group is as many bitsets as it has counts. For two groups the AND of two bitsets has as
many bits as terms with that pair of counts; times the difference of the two smoothed shares it is their part of the
sum. Count zero is the complement of the group's other bitsets in the word.

Words of bits are dealt to chunks, so all of a language's pairs are summed in each chunk over a part of its terms:
a language with most of the documents is spread like any other. Sources come in tiles, which bounds a chunk's table of sums.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import cut, written

#: each byte of UTF-8 as it is in a term: ASCII letters in lower case, bytes beyond ASCII, blanks for all else
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))
DOCS = 36  # a task's counters hold documents above this bit and occurrences below it
DOCUMENT = 1 << DOCS
LISTED = 20_000  # terms a row
SCALE = 1_000_000_000
SMOOTH = 5
HELD = 400_000  # entries of a task's counters before they are sent on
PER_BLOCK = 48  # terms a block holds on average; a word has 64 bits and a block as many words as it needs
CHUNKS = 64     # parts of a language's blocks
TILE = 256      # sources of one language handled at once
CELLS = 1 << 21  # ANDs made at once


def term_counts(docs: DataFrame, most: int = HELD) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group and documents (rows) that hold it.

    Null lang, source and text read as ''. Counters are sent on when they are large, so their memory has a bound.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held = defaultdict(dict), 0  # group -> term -> documents << DOCS | occurrences
        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                group = counts[lang, source]
                known, held = group.get, held - len(group)
                for term, n in Counter(text.translate(LETTERS).split()).items():
                    group[term] = known(term, 0) + n + DOCUMENT
                held += len(group)
                if held > most:
                    yield from sent(counts)
                    counts.clear()
                    held = 0
        yield from sent(counts)

    columns = [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]
    rows = docs.select(*columns, F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(
        run, "lang string, source string, term array<string>, n array<bigint>")
    each = rows.select("lang", "source", F.inline(F.arrays_zip("term", "n")))
    both = F.col("n").bitwiseAND(F.lit(DOCUMENT - 1)), F.shiftright("n", DOCS)
    return each.groupBy("lang", "source", "term").agg(F.sum(both[0]).alias("n"), F.sum(both[1]).alias("docs"))


def sent(counts: dict) -> Iterator[pa.RecordBatch]:
    """Counters as rows of bounded lists."""
    for (lang, source), group in counts.items():
        terms, n = list(group), np.fromiter(group.values(), np.int64, len(group))
        for a in range(0, len(terms), LISTED):
            some = pa.array(terms[a:a + LISTED], pa.binary()).cast(pa.string())
            ends = pa.array([0, len(some)], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([source]), pa.ListArray.from_arrays(ends, some),
                                              pa.ListArray.from_arrays(ends, pa.array(n[a:a + LISTED]))], ["lang", "source", "term", "n"])


def share(count: str | Column, total: str | Column, kept: str | Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * kept)), exact; null if no term is kept."""
    count, total, kept = (F.col(x) if isinstance(x, str) else x for x in (count, total, kept))
    above = F.lit(SCALE).cast("decimal(10,0)") * (count + SMOOTH).cast("decimal(20,0)")
    below = (total + SMOOTH * kept).cast("decimal(20,0)")
    return F.when(kept > 0, F.call_function("div", above, below) + 1)


class Audit:
    """Counts of a corpus, its groups and kept terms; the parts are made from these tables, each checkpointed once."""

    def __init__(self, docs: DataFrame, least_docs: int = 30, held: int = HELD):
        """Empty tables give empty results. Each row is a document, repeated ones too; other columns are not looked at."""
        counts = cut(term_counts(docs, held))
        terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
        terms = cut(terms.select("lang", "term", "all"))
        langs = written(docs.select(F.coalesce("lang", F.lit("")).alias("lang")).distinct()
                    .join(terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all").alias("lang_total")), "lang", "left")
                    .select("lang", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("lang_total", F.lit(0)).alias("lang_total")), "langs")
        cells = cut(counts.select("lang", "source", "term", "n").join(terms, ["lang", "term"]))
        totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
        groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang")
        self.groups = written(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), "kept", "lang_total"), "groups")
        self.terms, self.langs, self.cells = terms, langs, cells

        # each kept term's block, word and bit; blocks are small, so numbering them needs no long sort
        block = F.pmod(F.xxhash64("term"), F.ceil(F.col("kept") / PER_BLOCK)).alias("block")
        at = F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1
        places = terms.join(langs, "lang").select("lang", "term", "kept", block).repartition("lang", "block").withColumn("at", at)
        self.places = cut(places.select("lang", "term", "block", F.floor(F.col("at") / 64).cast("int").alias("word"), (F.col("at") % 64).alias("bit"),
                                        F.pmod("block", chunks("kept")).cast("int").alias("chunk")))

    def level_bits(self) -> DataFrame:
        """(lang, source, chunk, block, word, n, bits): the terms of one count of a group in one word."""
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))
        return (self.cells.join(self.places, ["lang", "term"]).select("lang", "source", "chunk", "block", "word", "n", bit.alias("b"))
                .groupBy("lang", "source", "chunk", "block", "word", "n").agg(F.bit_or("b").alias("bits")))

    def pairs(self) -> DataFrame:
        """(lang, a, b, value), a < b: the sum of |p - q| over all kept terms of the language (0 if none), for its groups p and q.

        Each chunk gets the language's groups first, with the chunk's number of terms, then its words of bits, and
        returns one sum for each pair. Sources come in tiles; each row goes to all meetings of its tile with a tile.
        """
        tiles = F.greatest(F.lit(1), F.ceil(F.col("sources") / TILE)).cast("int")
        count = self.groups.groupBy("lang").agg(F.count("*").alias("sources"))
        groups = self.groups.join(count, "lang").select("lang", "source", "total", "kept", tiles.alias("tiles"), F.pmod(F.xxhash64("source"), tiles).cast("int").alias("tile"))
        groups = written(groups, "tiled-groups")
        meets = F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least("tile", t).alias("t1"), F.greatest("tile", t).alias("t2")))).alias("m")
        sizes = self.places.groupBy("lang", "chunk").agg(F.count("*").alias("bits"))
        heads = groups.select("*", F.explode(F.sequence(F.lit(0), chunks("kept") - 1)).alias("chunk")).join(sizes, ["lang", "chunk"], "left")
        heads = heads.select("*", meets).select(
            "lang", "m.t1", "m.t2", "chunk", F.lit(-1).cast("bigint").alias("block"), F.lit(0).alias("word"), "source", "tile",
            share(F.lit(0), "total", "kept").alias("p"), "bits")
        bits = self.level_bits().join(groups, ["lang", "source"])
        bits = bits.select("*", meets).select("lang", "m.t1", "m.t2", "chunk", "block", "word", "source", "tile", share("n", "total", "kept").alias("p"), "bits")
        keys = ["lang", "t1", "t2", "chunk"]
        rows = heads.unionByName(bits).repartition(*keys).sortWithinPartitions(*keys, "block", "word", "source")
        sums = rows.mapInArrow(summed, "lang string, a string, b string, value bigint")
        return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))

    def pair_part(self) -> DataFrame:
        both = self.pairs()
        both = both.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(
            both.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        return both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))

    def term_part(self, top: int = 50) -> DataFrame:
        """Terms that a group uses more than its language does, the first ``top`` of each group."""
        rows = self.cells.join(self.groups, ["lang", "source"])
        rows = rows.select("lang", "source", F.col("term").alias("item"), (share("n", "total", "kept") - share("all", "lang_total", "kept")).alias("value"))
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        ranked = rows.where("value > 0").withColumn("rank", rank).where(F.col("rank") <= top)
        return ranked.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


def chunks(kept: str) -> Column:
    return F.least(F.lit(CHUNKS), F.greatest(F.lit(1), F.ceil(F.col(kept) / PER_BLOCK))).cast("int")


class Chunk:
    """Sums of all pairs of groups over one chunk's terms."""

    def __init__(self, key: tuple, rows: list[dict]):
        self.lang, self.one_tile = key[0], key[1] == key[2]
        self.names = np.array([r["source"] for r in rows], object)
        self.tiles = np.array([r["tile"] for r in rows])
        self.zero = np.array([r["p"] or 0 for r in rows], np.int64)
        self.index = {s: i for i, s in enumerate(self.names)}
        self.unseen = rows[0]["bits"] or 0
        self.total = np.zeros((len(rows), len(rows)), np.int64)

    def add(self, rows: list[dict]) -> None:
        group = np.array([self.index[r["source"]] for r in rows])
        bits = np.array([r["bits"] for r in rows], np.int64).view(np.uint64)
        self.unseen -= int(np.bitwise_count(np.bitwise_or.reduce(bits)))
        add_word(self.total, self.zero, group, np.array([r["p"] for r in rows], np.int64), bits)

    def sent(self) -> pa.RecordBatch:
        total = self.total + self.unseen * np.abs(self.zero[:, None] - self.zero[None, :])  # terms that none of these groups has
        i, j = np.nonzero(self.names[:, None] < self.names[None, :])
        if not self.one_tile:  # pairs inside a tile belong to that tile's own meeting
            across = self.tiles[i] != self.tiles[j]
            i, j = i[across], j[across]
        return pa.RecordBatch.from_arrays([pa.array([self.lang] * len(i), pa.string()), pa.array(self.names[i], pa.string()),
                                           pa.array(self.names[j], pa.string()), pa.array(total[i, j], pa.int64())], ["lang", "a", "b", "value"])


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of all pairs of each chunk, whose rows come in order: groups first, then word after word."""
    chunk = None
    for key, rows in grouped(batches, ["lang", "t1", "t2", "chunk", "block", "word"]):
        if key[4] >= 0:
            chunk.add(rows)
            continue
        if chunk is not None:
            yield chunk.sent()
        chunk = Chunk(key, rows)
    if chunk is not None:
        yield chunk.sent()


def grouped(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows with equal keys; a run has at most one tile pair's groups or their bitsets of one word."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            k = tuple(row[n] for n in names)
            if k != key:
                if rows:
                    yield key, rows
                key, rows = k, []
            rows.append(row)
    if rows:
        yield key, rows


def add_word(total: np.ndarray, zero: np.ndarray, group: np.ndarray, p: np.ndarray, bits: np.ndarray) -> None:
    """Add one word's part of every pair's sum to ``total`` (groups x groups): popcount of each AND times |p - q|.

    ``group``, ``p`` and ``bits`` are the bitsets of the counts above zero, ``zero`` each group's share at count zero.
    """
    used = np.zeros(len(zero), np.uint64)
    np.bitwise_or.at(used, group, bits)
    word = np.bitwise_or.reduce(bits)
    group = np.concatenate((group, np.arange(len(zero))))
    p = np.concatenate((p, zero))
    bits = np.concatenate((bits, word & ~used))
    order = np.argsort(group, kind="stable")
    group, p, bits = group[order], p[order], bits[order]
    starts = np.searchsorted(group, np.arange(len(zero)))
    step = max(1, CELLS // len(group))
    for a in range(0, len(group), step):
        some = slice(a, a + step)
        joint = np.bitwise_count(bits[some, None] & bits[None, :]).astype(np.int64) * np.abs(p[some, None] - p[None, :])
        np.add.at(total, group[some], np.add.reduceat(joint, starts, axis=1))


def audit(docs: DataFrame, least_docs: int = 30, top: int = 50, held: int = HELD) -> DataFrame:
    """(lang, source, part, item, value, rank): part 'pair' has each other source of the language, part 'term' a group's own terms."""
    found = Audit(docs, least_docs, held)
    return found.pair_part().unionByName(found.term_part(top))


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
o AS (SELECT lang, source, row, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
langs AS (SELECT g.lang, count(kept.term) AS v, CAST(coalesce(sum(kept.n), 0) AS HUGEINT) AS total FROM (SELECT DISTINCT lang FROM d) AS g LEFT JOIN kept ON g.lang = kept.lang GROUP BY g.lang),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN kept ON o.lang = kept.lang AND o.term = kept.term GROUP BY lang, source, term),
groups AS (SELECT g.lang, g.source, CAST(coalesce(sum(c.n), 0) AS HUGEINT) AS total FROM (SELECT DISTINCT lang, source FROM d) AS g
           LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY g.lang, g.source),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
             1 + (1000000000 * CAST(coalesce(c.n, 0) + 5 AS HUGEINT)) // (g.total + 5 * l.v) AS p,
             1 + (1000000000 * CAST(kept.n + 5 AS HUGEINT)) // (l.total + 5 * l.v) AS q
      FROM groups AS g JOIN langs AS l ON g.lang = l.lang JOIN kept ON g.lang = kept.lang
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value FROM groups AS a JOIN groups AS b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN p AS x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p AS y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
          GROUP BY a.lang, a.source, b.source),
r AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) AS x WHERE part = 'pair' OR rank <= 50
"""
