"""News lists and sentiment tables.

A symbol may own a third of all articles: roll-ups are partial sums, top lists are pruned
map-side by the window group limit, and de-duplication is an aggregate, not a sort.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import clamp, number_or_null

NEWS_LIMIT = 30
ROW_SCHEMA = "array<string>"
REPLY_SCHEMA = "title string, sentiment string, confidence string, reason string"


def feed_rows(feed: DataFrame, source: str, priority: int, title: Column, description: Column, url: Column, published: Column) -> DataFrame:
    """One feed in the common schema, titles and descriptions whole."""
    return feed.select("symbol", title.alias("title"), description.alias("description"),
                       url.alias("url"), published.alias("published_at"), F.lit(source).alias("source"), F.lit(priority).alias("source_priority"))


def union_feeds(feeds: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), feeds)


def dedupe_by_url(news: DataFrame, position: Column) -> DataFrame:
    """First source in priority order keeps a URL, the least position within a source; blank URLs are dropped."""
    url = F.trim("url")
    cols = [c for c in news.columns if c not in ("symbol", "url")]
    return (news.withColumn("url", url).filter(F.length("url") > 0)
            .groupBy("symbol", "url").agg(F.min_by(F.struct(*cols), F.struct("source_priority", position)).alias("n")).select("symbol", "url", "n.*"))


def newest_news(news: DataFrame, published: Column, position: Column, tie: list[Column], limit: int = NEWS_LIMIT) -> DataFrame:
    """The newest articles per symbol after de-duplication, undated ones last."""
    w = Window.partitionBy("symbol").orderBy(published.desc_nulls_last(), *tie)
    return dedupe_by_url(news, position).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def parse_time(text: Column) -> Column:
    """ISO time text (``Z`` or an offset, or neither) as UTC timestamp; unparsable gives NULL."""
    return F.try_to_timestamp(F.trim(text))


def sentiment_rollup(rows: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Counts, score, mean confidence and class per key; unknown labels count as neutral."""
    label = F.lower(F.trim(F.coalesce(F.col("sentiment"), F.lit(""))))
    n = F.count("*")
    pos, neg = F.count_if(label == "positive"), F.count_if(label == "negative")
    out = rows.groupBy(*keys).agg(
        n.alias("total"), pos.alias("positive"), neg.alias("negative"), (n - pos - neg).alias("neutral"),
        F.round(F.coalesce(F.avg(number_or_null(F.col("confidence").cast("string"))), F.lit(0.0)), 4).alias("avg_confidence"),
        F.round((pos - neg) / n, 4).alias("score"))
    return out.withColumn("overall", F.when(F.col("score") > 0.1, "positive").when(F.col("score") < -0.1, "negative").otherwise("neutral"))


def latest_with_ties(summaries: DataFrame, key: str = "symbol", time: str = "created_at") -> DataFrame:
    """All rows at the newest time of each key; a group maximum joined back, so ties never sit in one task."""
    newest = summaries.groupBy(key).agg(F.max(time).alias(time))
    return summaries.join(newest, [key, time], "left_semi")


def latest_single(summaries: DataFrame, tie: str, key: str = "symbol", time: str = "created_at") -> DataFrame:
    """Exactly one newest row per key."""
    rest = [c for c in summaries.columns if c != key]
    return summaries.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(time, tie)).alias("r")).select(key, "r.*")


def title_key(title: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", " ")))


def attach_articles(verdicts: DataFrame, articles: DataFrame, position: str) -> DataFrame:
    """Each verdict with its source article by normalised title; the latest of equal titles wins.

    Titles may be whole texts, so two 64-bit hashes of the title are the key and no text is shuffled for it.
    """
    key = title_key(F.col("title"))
    hashes = {"k1": F.xxhash64(key), "k2": F.xxhash64(F.reverse(key), F.length(key))}
    named = articles.filter(F.length(key) > 0).withColumns(hashes)
    one = named.groupBy("symbol", "k1", "k2").agg(F.max_by(F.struct("url", position), position).alias("a")).select("symbol", "k1", "k2", "a.*")
    return verdicts.withColumns(hashes).join(one, ["symbol", "k1", "k2"], "left").drop("k1", "k2")


def parse_replies(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Rows from model replies: optional code fence removed, JSON array of objects only.

    Anything else yields no rows; items that are no objects are dropped; missing fields default.
    """
    text = F.trim(reply)
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i)^```(?:json)?\s*", ""), r"\s*```\s*$", ""))
    items = F.from_json(F.when(bare.startswith("["), bare), ROW_SCHEMA)
    rows = replies.withColumn("item", F.explode(items)).filter(F.col("item").startswith("{"))
    obj = F.from_json("item", REPLY_SCHEMA)
    conf = clamp(number_or_null(F.col("o.confidence")), 0.0, 1.0)
    return rows.withColumn("o", obj).withColumns({
        "title": F.coalesce("o.title", F.lit("")),
        "sentiment": F.coalesce(F.when(F.length("o.sentiment") > 0, F.col("o.sentiment")), F.lit("neutral")),
        "confidence": F.coalesce(conf, F.lit(0.0)), "reason": F.coalesce("o.reason", F.lit(""))}).drop("o", "item", reply)


def recent_screens(history: DataFrame, as_of, days: int = 30) -> DataFrame:
    return history.filter(F.col("created_at") >= F.date_sub(F.lit(as_of).cast("date"), days))


def screen_summary(history: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Counts per preset over all results of the last days, with totals."""
    recent = recent_screens(history, as_of, days)
    total = recent.agg(F.count("*").alias("total"), F.count_distinct("symbol").alias("n_symbols"))
    return recent.groupBy("preset").agg(F.count("*").alias("n")).join(F.broadcast(total))  # one row


def screen_symbols(history: DataFrame, as_of, days: int = 30) -> DataFrame:
    """The symbols behind the summary, with their number of results and the newest."""
    return recent_screens(history, as_of, days).groupBy("symbol").agg(F.count("*").alias("n"), F.max("created_at").alias("newest"))
