"""Benchmark decontamination by winnowing, with DataFrame functions only.

A fingerprint is the least hash of the word k-grams in a sliding window. With k-grams of ``GRAM`` words
and windows of ``SPAN - GRAM + 1`` of them, any shared run of ``SPAN`` words gives both sides the same
fingerprint, so the join of fingerprints misses no shared window. Each match is then extended: the
windows around it are compared word by word with the benchmark's windows.

Items shorter than a window are one window of their own length; for these the fingerprints are all
runs of that length (at most ``SPAN - 1`` lengths exist).
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import cut, order_id, sweep, text_key, written

SPAN, GRAM = 10, 5
SEPARATORS = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"


def words(text: str = "text") -> Column:
    """Runs of letters, digits and non-ASCII characters, A-Z lower-cased; null has none."""
    t = F.coalesce(F.col(text), F.lit(""))
    # lower() would also change letters beyond ASCII, so only texts without any may take that faster way
    low = F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, string.ascii_uppercase, string.ascii_lowercase))
    return F.regexp_extract_all(low, F.lit(SEPARATORS), F.lit(1))


def upto(first: Column, last: Column) -> Column:
    """first..last, empty if last < first."""
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def gram_hash(w: str, size: int, at: Column) -> Column:
    return F.xxhash64(*[F.get(F.col(w), at + j) for j in range(size)])


def gram_hashes(w: str, size: int) -> Column:
    """Hash of the run of ``size`` words at each position (from 0)."""
    return F.transform(upto(F.lit(0), F.size(w) - size), lambda i: gram_hash(w, size, i))


def winnowed(hashes: str) -> Column:
    """Least hash of each window of consecutive k-grams, each value once."""
    width = SPAN - GRAM + 1
    return F.array_distinct(F.transform(upto(F.lit(1), F.size(hashes) - width + 1), lambda i: F.array_min(F.slice(F.col(hashes), i, width))))


def tagged(length: int, values: Column) -> Column:
    return F.transform(values, lambda h: F.struct(F.lit(length).alias("len"), h.alias("h")))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, len, window, h): every window of each item, once per item; items without words have none. Null ids stay null.

    ``len`` is 0 for a full window, whose ``h`` is its fingerprint, else the item's number of words.
    """
    items = benchmark.select(F.col("item_id").cast("string"), words().alias("w")).where(F.size("w") > 0)
    full = items.where(F.size("w") >= SPAN).withColumn("g", gram_hashes("w", GRAM))
    each = F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - SPAN + 1), lambda i: F.struct(
        F.array_join(F.slice("w", i, SPAN), " ").alias("window"), F.array_min(F.slice("g", i, SPAN - GRAM + 1)).alias("h"))))
    long = full.select("item_id", each.alias("s")).select("item_id", F.lit(0).alias("len"), "s.window", "s.h")
    short = items.where(F.size("w") < SPAN)
    short = short.select("item_id", F.size("w").alias("len"), F.array_join("w", " ").alias("window"),
                         F.coalesce(*[F.when(F.size("w") == n, gram_hash("w", n, F.lit(0))) for n in range(1, SPAN)]).alias("h"))
    return long.unionByName(short).distinct()


def candidate_windows(tag: int) -> Column:
    """Windows around the positions whose hash is among the row's matches ``m`` of this tag."""
    size, length = (GRAM, SPAN) if tag == 0 else (tag, tag)
    values = F.transform(F.filter("m", lambda s: s["len"] == tag), lambda s: s["h"])
    hits = F.filter(upto(F.lit(0), F.size("w") - size), lambda i: F.array_contains(values, gram_hash("w", size, i)))
    starts = F.array_distinct(F.flatten(F.transform(hits, lambda p: upto(
        F.greatest(F.lit(0), p - (length - size)), F.least(p, F.size("w") - length)))))
    return F.transform(starts, lambda s: F.struct(
        F.lit(tag).alias("len"), s.alias("start"), F.lit(length).alias("n"), F.array_join(F.slice("w", s + 1, length), " ").alias("window")))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the
    helper columns oid, key (order id, text key).

    A word is hit if it lies in any occurrence of a benchmark window. Null and blank texts have no words.
    Rows that repeat both id and text get equal results; null ids are allowed. Benchmark items with a null id give hits
    and contamination like others; only ``n_items`` and ``items_sha256`` leave them out.
    """
    known = written(benchmark_windows(benchmark), "benchmark-windows")
    lengths = sorted(r[0] for r in known.select("len").distinct().collect())  # at most SPAN values
    fingerprints = known.select("len", "h").distinct()

    rows = docs.select(F.col("doc_id").cast("bigint"), order_id().alias("oid"), text_key().alias("key"), words().alias("w"))
    wanted = [tagged(0, winnowed("g"))] if 0 in lengths else []
    wanted += [tagged(n, F.array_distinct(gram_hashes("w", n))) for n in lengths if n]
    # one more entry carries the row itself; it joins nothing, and its own key spreads it evenly
    itself = F.array(F.struct(F.lit(-1).alias("len"), F.col("key").alias("h")))
    found = (rows.withColumn("g", gram_hashes("w", GRAM))
             .select("doc_id", "oid", "key", F.size("w").alias("n_words"), F.explode(F.concat(itself, *wanted)).alias("f"))
             .select("doc_id", "oid", "key", "n_words", "f.len", "f.h")
             .join(fingerprints.withColumn("there", F.lit(True)), ["len", "h"], "left")
             .where("len = -1 or there").drop("there"))
    found = cut(found)

    matches = found.where("len >= 0").groupBy("oid", "key").agg(F.collect_set(F.struct("len", "h")).alias("m"))
    near = written(matches, "benchmark-matches")
    sweep(docs.sparkSession)
    at = docs.select(order_id().alias("oid"), text_key().alias("key"), "text").join(near, ["oid", "key"])
    at = at.select("oid", "key", "m", words().alias("w"))
    candidates = [candidate_windows(n) for n in lengths]
    if not candidates:
        candidates = [F.array().cast("array<struct<len:int,start:int,n:int,window:string>>")]
    windows = (at.select("oid", "key", F.explode(F.concat(*candidates)).alias("c")).select("oid", "key", "c.*")
               .join(known.select("len", "window").distinct(), ["len", "window"]))
    windows = cut(windows.select("oid", "key", "len", "window", "start", "n").distinct())
    sweep(docs.sparkSession)

    hit = (windows.select("oid", "key", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("p")).distinct()
           .groupBy("oid", "key").agg(F.count("*").alias("n_hit")))
    items = (windows.select("oid", "key", "len", "window").distinct().join(known.select("len", "window", "item_id"), ["len", "window"])
             .groupBy("oid", "key").agg(F.sort_array(F.collect_set("item_id")).alias("items")))
    leaks = hit.join(items, ["oid", "key"])
    return (found.where("len = -1").select("doc_id", "oid", "key", "n_words").join(leaks, ["oid", "key"], "left")
            .select("doc_id", F.col("n_words").cast("bigint").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
                    F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
                    F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
                    (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), "oid", "key"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) AS b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS win
       FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM i) AS x),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM w, sizes WHERE len(w) >= n) AS x),
m AS (SELECT dw.doc_id, dw.s, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) AS x GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) AS x GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(g.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(g.items, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h ON w.doc_id = h.doc_id LEFT JOIN g ON w.doc_id = g.doc_id
"""
