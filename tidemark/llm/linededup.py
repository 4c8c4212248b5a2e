"""Line dedup with DataFrame functions only: the first document that holds a line keeps it, later ones lose it.

Hashes of the lines, never the lines, are laid out in ranges of the hash and sorted by document and position, so a
running first value tells where each line occurs first. What comes back is a compressed bitmap for each document, not
text: 64-bit words of the lines that go; words of which every line stays are left out.

A line that very many documents share would fill a range by itself. Such hashes are found in a sample - this decides
the way taken and never the result - and settled by an aggregate of one row a hash instead; there are at most
``SHARE`` times the number of partitions of them, which bounds their broadcast.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import cut, order_id, text_key

SAMPLED = 64  # one of so many lines counts for finding hot hashes
AT_LEAST = 32  # sampled lines that make a hash hot at least
SHARE = 4  # a hash is hot if it has a ``SHARE``-th of a partition's even part
BLANK = " \t\n\x0b\x0c\r"


def lines(text: str | Column = "text") -> Column:
    """The lines of a text, split at \\n; null and empty have one empty line."""
    return F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(BLANK))
    ascii_only = F.octet_length(bare) == F.char_length(bare)  # lower() would also change letters beyond ASCII
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def line_hashes(docs: DataFrame, shortest: int) -> DataFrame:
    """(h, g, oid, key, pos): two hashes of each line whose key has ``shortest`` code points or more."""
    def hashed(line: Column, pos: Column) -> Column:
        k = line_key(line)
        return F.when(F.char_length(k) >= shortest, F.struct(F.xxhash64(k).alias("h"), F.xxhash64(F.lit(1), k).alias("g"), pos.cast("int").alias("pos")))

    each = F.explode(F.filter(F.transform(lines(), hashed), lambda s: s.isNotNull())).alias("s")
    return docs.select(order_id().alias("oid"), text_key().alias("key"), each).select("s.h", "s.g", "oid", "key", "s.pos")


def later_lines(found: DataFrame) -> DataFrame:
    """(oid, key, pos) of each line that a document with a smaller id holds too."""
    spark = found.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sample = found.where(F.pmod(F.xxhash64("oid", "pos"), F.lit(SAMPLED)) == 0)
    counts = sample.groupBy("h", "g").agg(F.count("*").alias("n"))
    even = sample.agg((F.count("*") / (SHARE * parts)).alias("even"))  # one row
    hot = counts.where(F.col("n") >= AT_LEAST).join(F.broadcast(even), F.col("n") >= F.col("even")).select("h", "g", F.lit(True).alias("hot"))
    hot = cut(hot)  # at most SHARE * parts rows
    marked = found.join(F.broadcast(hot), ["h", "g"], "left")

    shared = marked.where("hot")
    first = shared.groupBy("h", "g").agg(F.min("oid").alias("first"))
    crowded = shared.join(F.broadcast(first), ["h", "g"]).where("oid > first")

    laid = marked.where("hot is null").select("h", "g", "oid", "key", "pos").repartitionByRange(parts, "h")
    order = Window.partitionBy("h", "g").orderBy("oid", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    streamed = laid.withColumn("first", F.first("oid").over(order)).where("oid > first")
    return streamed.select("oid", "key", "pos").unionByName(crowded.select("oid", "key", "pos"))


def drop_bitmaps(docs: DataFrame, shortest: int = 10) -> DataFrame:
    """(oid, key, n_dropped, words): for each document that loses lines, its bitmap of them.

    ``oid`` and ``key`` are order id and text key, ``words`` is array<struct<word, bits>>, sorted, of the 64-bit words
    that are not zero: bit b of word w stands for line 64 * w + b, from 0. Rows with one id are one document; a null
    id stands before all others. Keys shorter than ``shortest`` code points never go. No lines, no rows.
    """
    found = cut(line_hashes(docs, shortest))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("pos") % 64)
    words = (later_lines(found).select("oid", "key", F.floor(F.col("pos") / 64).cast("int").alias("word"), bit.alias("bit"))
             .groupBy("oid", "key", "word").agg(F.bit_or("bit").alias("bits")))
    return words.groupBy("oid", "key").agg(F.sum(F.bit_count("bits")).cast("bigint").alias("n_dropped"),
                                           F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))


def set_positions(words: str) -> Column:
    """Sorted positions of the set bits of a bitmap."""
    def of(w: Column) -> Column:
        bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("getbit", w["bits"], b) == 1)
        return F.transform(bits, lambda b: w["word"] * 64 + b)

    return F.flatten(F.transform(F.col(words), of))


def kept_text(all_lines: str, gone: str) -> Column:
    """The lines but those at the sorted positions ``gone``, joined by \\n; the parts between two of them are sliced, so time is linear."""
    n, k = F.size(all_lines), F.size(gone)
    part = F.transform(F.sequence(F.lit(0), k), lambda i: F.slice(
        F.col(all_lines), F.coalesce(F.get(F.col(gone), i - 1), F.lit(-1)) + 2,
        F.coalesce(F.get(F.col(gone), i), n) - F.coalesce(F.get(F.col(gone), i - 1), F.lit(-1)) - 1))
    return F.array_join(F.flatten(part), "\n")


def deduplicated(docs: DataFrame, shortest: int = 10) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, words (see ``drop_bitmaps``; null if nothing goes) and kept, the text that stays.

    Null and empty texts have one empty line, which stays. Rows that repeat an id are one document and keep what it is
    first to hold, each of them. An empty table gives an empty table; other columns of ``docs`` are not looked at.
    """
    bitmaps = drop_bitmaps(docs, shortest).select(F.col("oid").alias("o"), F.col("key").alias("k"), "n_dropped", "words")
    rows = docs.select(F.col("doc_id").cast("bigint"), order_id().alias("oid"), text_key().alias("key"), "text")
    joined = rows.join(bitmaps, (F.col("oid") == F.col("o")) & (F.col("key") == F.col("k")), "left")
    joined = joined.select("doc_id", "n_dropped", "words", F.coalesce("text", F.lit("")).alias("text"),
                           F.when(F.col("words").isNotNull(), lines()).alias("all"), set_positions("words").alias("gone"))
    n_lines = F.char_length("text") - F.char_length(F.translate("text", "\n", "")) + 1
    return joined.select("doc_id", n_lines.cast("bigint").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"), "words",
                         F.when(F.col("words").isNull(), F.col("text")).otherwise(kept_text("all", "gone")).alias("kept"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT k.doc_id, k.pos, k.line, f.first IS NOT NULL AND k.doc_id > f.first AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
