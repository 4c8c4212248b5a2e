"""Document fingerprints by spot signatures, with DataFrame functions only.

Common words of four languages and the most frequent words of the corpus are anchors. A spot signature is an
anchor with the chain of up to ``CHAIN`` content words that follow it before the next anchor. Content words
after a full chain, and at the start of a text, form chains without an anchor, so every content word lies in
a signature. Boilerplate between the sentences of natural text has
few anchors and so little weight. A text's fingerprint is the set of its signatures, as sorted 32-bit
hashes; likeness is the Jaccard similarity of two sets.

Sets can only be alike to a degree t if the smaller has at least t times the larger one's size. So
``matches`` partitions sets by their length such that only neighbouring partitions meet, joins on the
rarest signatures that a match cannot avoid, and checks what is left.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import LOWEST_ID, cut, order_id, text_key

CHAIN = 3
FREQUENT, COMMON = 128, 0.01  # so many words of the corpus become anchors at most, each in this share of its documents or more
# fixed values: frequent function words of English, German, French and Spanish
ANCHORS = ("a an and are as at be by for from has he in is it of on or that the this to was were which with "
           "das dem den der des die ein eine einen einer er es im ist mit nicht sich sie und von war zu zum "
           "au aux ce dans de du elle en est et il la le les ne par pas pour qui que sa se son sur un une "
           "al como con del el ella los las lo mas no para pero por sin su sus y").split()


def plain(text: str | Column) -> Column:
    """Lower-cased runs of letters and digits between single blanks, with a blank at either end."""
    t = F.col(text) if isinstance(text, str) else text
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(t, F.lit(""))), r"[^\p{L}\p{N}]+", " "), F.lit(" "))


def corpus_anchors(docs: DataFrame) -> list[str]:
    """The fixed anchors and the corpus's words of highest document frequency, over all rows."""
    n = docs.count()
    words = docs.select(F.explode(F.array_distinct(F.split(plain("text"), " +"))).alias("w")).where("w <> ''")
    found = words.groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= max(2, COMMON * n)).orderBy(F.desc("n"), "w").limit(FREQUENT)
    return sorted({*ANCHORS, *(r.w for r in found.collect())})


def spots(text: str | Column, anchors: Iterable[str] = ANCHORS) -> Column:
    """Spot signatures of a text as strings, in order; null and texts without content words have none."""
    by_letter: dict[str, list[str]] = {}
    for w in sorted(set(anchors)):
        by_letter.setdefault(w[0], []).append(w[1:])
    among = "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_letter.items())
    # chains end before the next anchor, so matches never overlap; without an anchor they go on where the last chain ended
    return F.regexp_extract_all(plain(text), F.lit(rf"((?:(?<= )(?:{among}))?(?: +(?!(?:{among}) )[^ ]+){{1,{CHAIN}}})"), F.lit(1))


def signature_set(text: str | Column, anchors: Iterable[str] = ANCHORS) -> Column:
    """Sorted distinct 32-bit hashes of the spot signatures."""
    return F.array_sort(F.array_distinct(F.transform(spots(text, anchors), lambda s: F.xxhash64(s).bitwiseAND(F.lit(0xFFFFFFFF)))))


def fingerprint(signatures: str) -> Column:
    """The set as text: eight hexadecimal digits for each signature, in order."""
    return F.array_join(F.transform(F.col(signatures), lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "")


def likeness(a: str, b: str, least: float = 0.0) -> Column:
    """Jaccard similarity; two empty sets are alike. Null where the sizes alone rule out ``least``."""
    x, y = F.size(a), F.size(b)
    common = F.size(F.array_intersect(a, b))
    value = F.when((x == 0) & (y == 0), F.lit(1.0)).otherwise(common / (x + y - common))
    return F.when(F.least(x, y) >= least * F.greatest(x, y), value) if least else value


def next_documents(docs: DataFrame) -> DataFrame:
    """(oid, key, n_chars, next_oid, next_key): the next document by descending id; after the last, the first.

    Rows that repeat id and text are one document; among equal ids the text key decides. Ids are dealt into
    ranges, the next is found inside each range, and only the ranges' first documents meet in one place.
    """
    n = F.char_length(F.coalesce(F.col("text"), F.lit("")))
    known = docs.select(order_id().alias("oid"), text_key().alias("key"), n.alias("n_chars")).distinct()
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = cut(known.repartitionByRange(ranges, F.desc("oid"), F.asc("key")).withColumn("part", F.spark_partition_id()))
    order = [F.desc("oid"), F.asc("key")]
    inside = Window.partitionBy("part").orderBy(*order)
    rows = known.withColumns({"next_oid": F.lead("oid").over(inside), "next_key": F.lead("key").over(inside)})
    heads = known.groupBy("part").agg(F.min_by(F.struct("oid", "key"), F.struct(-F.col("oid").cast("decimal(20,0)"), F.col("key"))).alias("head"))
    chain = Window.orderBy("part")  # one row per range
    follow = heads.select("part", F.coalesce(F.lead("head").over(chain), F.first("head").over(chain)).alias("follow"))
    return (rows.join(follow, "part").withColumns({
        "next_key": F.when(F.col("next_oid").isNull(), F.col("follow.key")).otherwise(F.col("next_key")),
        "next_oid": F.coalesce("next_oid", "follow.oid")}).drop("part", "follow"))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited text, and the signature sets of the text
    (sigs), the edited text (edited_sigs) and the next document (next_sigs).

    The edited text has its last third (rounded down, in code points) replaced by as many first code points
    of the next document, or all of them. A null text is empty; a single document is its own next.
    """
    anchors = corpus_anchors(docs)
    follow = cut(next_documents(docs))
    # both uses of the texts need the same columns, so that they are shuffled once and read twice
    texts = docs.select(order_id().alias("oid"), text_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    wanted = follow.select(F.col("next_oid").alias("oid"), F.col("next_key").alias("key"), F.col("oid").alias("for_oid"), F.col("key").alias("for_key"),
                           F.floor(F.col("n_chars") / 3).cast("int").alias("m"))
    # rows that repeat id and text give the same answer; one of them is enough
    given = (texts.join(wanted, ["oid", "key"])
             .select(F.col("for_oid").alias("oid"), F.col("for_key").alias("key"), F.substring("text", F.lit(1), F.col("m")).alias("lent"),
                     signature_set("text", anchors).alias("next_sigs")).dropDuplicates(["oid", "key"]))
    rows = texts.join(given, ["oid", "key"]).withColumn("n_chars", F.char_length("text"))
    kept = F.col("n_chars") - F.floor(F.col("n_chars") / 3)
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), kept.cast("int")), F.col("lent")))
    doc_id = F.when(F.col("oid") != LOWEST_ID, F.col("oid")).alias("doc_id")
    return rows.select(doc_id, F.col("n_chars").cast("bigint").alias("n_chars"), "edited", signature_set("text", anchors).alias("sigs"),
                       signature_set("edited", anchors).alias("edited_sigs"), "next_sigs")


def digest(docs: DataFrame) -> DataFrame:
    rows = edited_pairs(docs)
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint("sigs").alias("fingerprint"),
                       fingerprint("edited_sigs").alias("edited_fingerprint"), likeness("sigs", "edited_sigs").alias("near_edited"),
                       likeness("sigs", "next_sigs").alias("near_next"))


def matches(queries: DataFrame, docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(query_id, set_id, near): for each query the distinct signature sets of ``docs`` at least so alike.

    ``set_id`` is the least id that has the set; ``members`` gives the others. Texts without signatures
    match nothing. Copies are one set, so a large group of copies costs no more than one text.
    """
    sets = docs.select(order_id().alias("id"), signature_set("text").alias("s")).where(F.size("s") > 0).groupBy("s").agg(F.min("id").alias("set_id"))
    asked = queries.select(order_id().alias("query_id"), signature_set("text").alias("s")).where(F.size("s") > 0)
    sets = cut(sets)
    common = sets.select(F.explode("s").alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    band = F.floor(F.log(F.size("s")) / math.log(1 / least))

    def prefixes(df: DataFrame, name: str) -> DataFrame:
        """The rarest signatures of each set: a set as alike as asked for shares one of these."""
        each = df.select(name, F.size("s").alias("size"), band.alias("band"), F.explode("s").alias("h")).join(common, "h", "left")
        rank = F.row_number().over(Window.partitionBy(name).orderBy(F.coalesce("n", F.lit(0)), "h"))
        return each.withColumn("rank", rank).where(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * least) + 1).select(name, "h", "band")

    ours = prefixes(sets, "set_id")
    theirs = prefixes(asked.groupBy("query_id").agg(F.min_by("s", F.xxhash64("s")).alias("s")), "query_id")
    theirs = theirs.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    pairs = theirs.join(ours, ["h", "band"]).select("query_id", "set_id").distinct()
    asked = asked.groupBy("query_id").agg(F.min_by("s", F.xxhash64("s")).alias("q"))
    near = pairs.join(asked, "query_id").join(sets, "set_id").select("query_id", "set_id", likeness("q", "s", least).alias("near"))
    return near.where(F.col("near") >= least)


def members(docs: DataFrame) -> DataFrame:
    """(doc_id, set_id): the least id with the same signature set; texts without signatures have their own id."""
    rows = docs.select(F.col("doc_id").cast("bigint"), order_id().alias("id"), signature_set("text").alias("s"))
    key = F.when(F.size("s") > 0, F.xxhash64("s")).otherwise(F.col("id"))
    rows = rows.select("doc_id", "id", key.alias("k"), (F.size("s") == 0).alias("none"))
    least = rows.groupBy("k", "none").agg(F.min("id").alias("set_id"))
    return rows.join(least, ["k", "none"]).select("doc_id", "set_id")
