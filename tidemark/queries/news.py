"""Queries over news, sentiment, alerts, quotes and result history."""

from pyspark.sql import functions as F

from tidemark.operators import alerts as al
from tidemark.operators import indicators as ind
from tidemark.operators import news as nw
from tidemark.operators import reports as rp
from tidemark.operators.panel import weekly_bars
from tidemark.queries.oracle_ctes import CTES
from tidemark.queries.registry import query
from tidemark.sources import sinks
from tidemark.sources.adapters import AS_OF

CTES["feeds"] = """
SELECT 'ALL' AS symbol, html AS title, html AS description, url, 'posts' AS source, 2 AS source_priority FROM pages
UNION ALL SELECT 'ALL', html, html, url, 'wire', 1 FROM pages WHERE page_id % 5 = 0"""


@query("SRC7_news_union", "symbol:s title:s n_description:i url:s source:s source_priority:i", """
SELECT symbol, title, length(description) AS n_description, url, source, source_priority FROM feeds""")
def _(t):
    pages = t.table("pages").withColumn("symbol", F.lit("ALL"))
    html, url, when = F.col("html"), F.col("url"), F.lit(None).cast("string")
    feeds = nw.union_feeds([nw.feed_rows(pages, "posts", 2, html, html, url, when),
                            nw.feed_rows(pages.filter(F.col("page_id") % 5 == 0), "wire", 1, html, html, url, when)])
    return feeds.withColumn("n_description", F.length("description"))


@query("U1_feed_dedupe", "symbol:s url:s source_priority:i", "SELECT symbol, trim(url) AS url, min(source_priority) AS source_priority FROM news WHERE length(trim(url)) > 0 GROUP BY 1, 2")
def _(t):
    return nw.dedupe_by_url(t.news(), F.col("page_id"))


@query("K3_newest_news", "symbol:s url:s age_days:i rank:i", """
WITH u AS (SELECT symbol, trim(url) AS url, min_by(age_days, source_priority*1000000 + page_id) AS age_days FROM news WHERE length(trim(url)) > 0 GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY CASE WHEN age_days = 7 THEN NULL ELSE age_days END ASC NULLS LAST, url) AS rank FROM u QUALIFY rank <= 30""")
def _(t):
    # the same page is listed by both feeds, so the earlier source decides; age 7 stands for an unparsable date
    text = F.when(F.col("age_days") == 7, "soon").otherwise(F.concat(F.date_format(F.date_sub(F.lit(AS_OF), F.col("age_days").cast("int")), "yyyy-MM-dd"), F.lit("T00:00:00Z")))
    news = t.news().withColumn("published_at", text)
    return nw.newest_news(news, nw.parse_time(F.col("published_at")), F.col("page_id"), [F.col("url")])


@query("A15_sentiment_rollup", "symbol:s total:i positive:i negative:i neutral:i avg_confidence:5 score:5 overall:s", """
WITH a AS (SELECT symbol, count(*) AS total, count_if(sentiment = 'positive') AS positive, count_if(sentiment = 'negative') AS negative, round(avg(confidence), 4) AS avg_confidence FROM sentiment_results GROUP BY 1),
b AS (SELECT *, total - positive - negative AS neutral, round((positive - negative)*1.0/total, 4) AS score FROM a)
SELECT *, CASE WHEN score > 0.1 THEN 'positive' WHEN score < -0.1 THEN 'negative' ELSE 'neutral' END AS overall FROM b""")
def _(t):
    return nw.sentiment_rollup(t.sentiment_results())


CTES["summaries"] = """
SELECT symbol, doc_id % 37 AS created_at, doc_id AS id, sentiment, confidence FROM sentiment_results"""


def summaries(t):
    return t.sentiment_results().select("symbol", (F.col("doc_id") % 37).alias("created_at"), F.col("doc_id").alias("id"), "sentiment", "confidence")


@query("J7_latest_with_ties", "symbol:s created_at:i id:i sentiment:s", """
SELECT s.symbol, s.created_at, s.id, s.sentiment FROM summaries s JOIN (SELECT symbol, max(created_at) AS m FROM summaries GROUP BY 1) x ON x.symbol = s.symbol AND x.m = s.created_at""")
def _(t):
    return nw.latest_with_ties(summaries(t))


@query("K5_latest_single", "symbol:s created_at:i id:i sentiment:s", """
SELECT symbol, created_at, id, sentiment FROM summaries QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY created_at DESC, id DESC) = 1""")
def _(t):
    return nw.latest_single(summaries(t), "id")


@query("J8_verdict_to_article", "symbol:s doc_id:i position:i", """
WITH a AS (SELECT source AS symbol, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS k, max(doc_id) AS position FROM documents GROUP BY 1, 2 HAVING length(k) > 0)
SELECT v.symbol, v.doc_id, a.position FROM (SELECT d.source AS symbol, d.doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS k FROM documents d JOIN labels l ON l.doc_id = d.doc_id) v
LEFT JOIN a ON a.symbol = v.symbol AND a.k = v.k""")
def _(t):
    docs = t.table("documents").select(F.col("source").alias("symbol"), "doc_id", F.col("text").alias("title"))
    verdicts = docs.join(t.table("labels").select("doc_id"), "doc_id")
    articles = docs.select("symbol", "title", F.lit("-").alias("url"), F.col("doc_id").alias("position"))
    return nw.attach_articles(verdicts, articles, "position")


def replies(t):
    """A fenced JSON reply per labelled document: one proper row with the whole text, one row with
    gaps and one stray item. Toxic documents got an answer that is no JSON list."""
    docs = t.table("documents").select("doc_id", F.col("source").alias("symbol"), F.col("text").alias("title")).join(t.table("labels"), "doc_id")
    row = F.struct("title", F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("sentiment"), F.lit(0.75).alias("confidence"),
                   F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("reason"))
    gap = F.struct("title", F.lit("high").alias("confidence"))
    text = F.concat(F.lit("```json\n["), F.to_json(row), F.lit(", 17, "), F.to_json(gap), F.lit("]\n```"))
    return docs.select("symbol", "doc_id", F.when(F.col("toxic") == 1, F.concat(F.lit("sorry: "), text)).otherwise(text).alias("reply"))


@query("JS1_parse_replies", "symbol:s doc_id:i title:s sentiment:s confidence:6 reason:s", """
WITH d AS (SELECT source AS symbol, d.doc_id, text AS title, quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE toxic <> 1)
SELECT symbol, doc_id, title, CASE quality WHEN 1 THEN 'positive' ELSE 'negative' END AS sentiment, 0.75 AS confidence, 'doc ' || doc_id AS reason FROM d
UNION ALL SELECT symbol, doc_id, title, 'neutral', 0, '' FROM d""")
def _(t):
    return nw.parse_replies(replies(t))


# --- result history ------------------------------------------------------------------------

CTES["history"] = """
SELECT c_mktsegment AS preset, 'S' || (c_nationkey % 12) AS symbol, DATE '2001-11-05' - CAST(c_custkey % 60 AS INTEGER) AS created_at, c_custkey AS id FROM customer"""


def history(t):
    return t.table("customer").select(
        F.col("c_mktsegment").alias("preset"), F.concat(F.lit("S"), (F.col("c_nationkey") % 12).cast("string")).alias("symbol"),
        F.date_sub(F.lit(AS_OF), (F.col("c_custkey") % 60).cast("int")).alias("created_at"), F.col("c_custkey").alias("id"))


@query("SNK4_screen_history", "symbol:s preset:s created_at:d", """
SELECT symbol, preset, created_at FROM history WHERE symbol = 'S3' ORDER BY created_at DESC, symbol, preset LIMIT 50""")
def _(t):
    return sinks.screen_history(history(t), "s3 ")


@query("A17_screen_summary", "preset:s n:i total:i n_symbols:i", """
WITH r AS (SELECT * FROM history WHERE created_at >= DATE '2001-11-05' - 30)
SELECT preset, count(*) AS n, (SELECT count(*) FROM r) AS total, (SELECT count(DISTINCT symbol) FROM r) AS n_symbols FROM r GROUP BY 1""")
def _(t):
    return nw.screen_summary(history(t), AS_OF)


@query("A17_screen_symbols", "symbol:s n:i newest:d", """
SELECT symbol, count(*) AS n, max(created_at) AS newest FROM history WHERE created_at >= DATE '2001-11-05' - 30 GROUP BY 1""")
def _(t):
    return nw.screen_symbols(history(t), AS_OF)


# --- alerts and quotes ---------------------------------------------------------------------

CTES["shifted"] = "SELECT symbol, price*CASE symbol WHEN 'LARGE' THEN 1.05 WHEN 'SMALL' THEN 0.9 WHEN 'MEDIUM' THEN 1.01 ELSE 1 END AS price FROM latest"


def moved_prices(t):
    """Latest prices after a move of some symbols, so that alerts fire or come near."""
    s = F.col("symbol")
    return t.latest().withColumn("price", F.col("price") * F.when(s == "LARGE", 1.05).when(s == "SMALL", 0.9).when(s == "MEDIUM", 1.01).otherwise(1.0))


@query("SRC5_alert_documents", "alert_id:s ticker:s alert_type:s price:4", "SELECT alert_id, ticker, alert_type, target AS price FROM alerts")
def _(t):
    row = F.struct(F.col("alert_id").alias("id"), "ticker", "alert_type", "price", "triggered")
    docs = t.alerts().groupBy("ticker").agg(F.to_json(F.struct(F.collect_list(row).alias("alerts"))).alias("value"))  # two alerts per symbol
    broken = docs.withColumn("value", F.regexp_replace("value", r"\}$", ""))  # documents that end too soon stand beside the good ones
    return al.parse_alert_documents(docs.unionByName(broken)).withColumnRenamed("id", "alert_id")


@query("P9_alert_trigger", "alert_id:s fired:b triggered_price:4", """
SELECT alert_id, coalesce(CASE alert_type WHEN 'above' THEN s.price >= target ELSE s.price <= target END, false) AS fired,
 CASE WHEN CASE alert_type WHEN 'above' THEN s.price >= target ELSE s.price <= target END THEN s.price END AS triggered_price FROM alerts a LEFT JOIN shifted s ON s.symbol = a.ticker""")
def _(t):
    return al.check_alerts(t.alerts(), moved_prices(t), AS_OF)


@query("P10_alert_distance", "alert_id:s distance_pct:5 near:b", """
SELECT alert_id, d AS distance_pct, coalesce(d BETWEEN 0 AND 2, false) AS near FROM (
 SELECT alert_id, CASE alert_type WHEN 'above' THEN (target - s.price)/target*100 ELSE (s.price - target)/target*100 END AS d FROM alerts a LEFT JOIN shifted s ON s.symbol = a.ticker)""")
def _(t):
    return al.alert_distances(t.alerts(), moved_prices(t))


@query("A23_alert_status", "pending:i triggered:i", """
SELECT count_if(NOT f) AS pending, count_if(f) AS triggered FROM (SELECT coalesce(CASE alert_type WHEN 'above' THEN s.price >= target ELSE s.price <= target END, false) AS f FROM alerts a LEFT JOIN shifted s ON s.symbol = a.ticker)""")
def _(t):
    return rp.alert_status(al.check_alerts(t.alerts(), moved_prices(t), AS_OF))


@query("SNK2_alert_upsert", "ticker:s alert_type:s price:4 triggered:b", """
WITH c AS (SELECT a.alert_id, a.ticker, a.alert_type, a.target, coalesce(CASE alert_type WHEN 'above' THEN s.price >= target ELSE s.price <= target END, false) AS f FROM alerts a LEFT JOIN shifted s ON s.symbol = a.ticker),
n AS (SELECT symbol AS ticker, price*1.1 AS np FROM latest)
SELECT c.ticker, c.alert_type, CASE WHEN NOT f AND alert_type = 'above' THEN np ELSE target END AS price, f AS triggered FROM c JOIN n ON n.ticker = c.ticker
UNION ALL SELECT c.ticker, c.alert_type, np, false FROM c JOIN n ON n.ticker = c.ticker WHERE f AND alert_type = 'above'""")
def _(t):
    now = al.check_alerts(t.alerts(), moved_prices(t), AS_OF).select("alert_id", "ticker", "alert_type", "price", "triggered")
    new = t.latest().select(F.concat(F.lit("new-"), "symbol").alias("alert_id"), F.lower("symbol").alias("ticker"), F.lit("Above ").alias("alert_type"), (F.col("price") * 1.1).alias("price"))
    return sinks.upsert_alerts(now, new)


@query("SRC9_quote_fallback", "symbol:s price:4 source_priority:i", """
SELECT symbol, min_by(price, source_priority) AS price, min(source_priority) AS source_priority FROM quotes WHERE price > 0 GROUP BY 1""")
def _(t):
    return al.latest_with_fallback(t.prices().select("symbol"), t.quotes())


@query("SRC10_fx_rate", "rate:6 is_live:b", """
SELECT max_by(r, date) AS rate, true AS is_live FROM (SELECT date, avg(fx_rate_thb) AS r FROM transactions GROUP BY 1)""")
def _(t):
    day = t.transactions().groupBy("date").agg(F.avg("fx_rate_thb").alias("r"))
    src = F.explode(F.array(F.struct(F.lit(1).alias("p"), (F.col("r") * 100).alias("rate")), F.struct(F.lit(2).alias("p"), F.col("r").alias("rate"))))
    return al.resolve_fx(day.select(F.col("date").alias("ts"), src.alias("s")).select("ts", F.col("s.p").alias("source_priority"), "s.rate"))


@query("SRC6_fundamentals", "symbol:s price:4 beta:4 dividend_yield:6 nav:4", """
SELECT f.symbol, CASE WHEN f.symbol = 'SMALL' THEN l.price*0.99 WHEN f.symbol = 'LARGE' THEN l.price*0.98 ELSE l.price END AS price, CASE WHEN beta = 0 THEN 1.1 ELSE beta END AS beta,
 coalesce(dividend_yield, 0) AS dividend_yield, l.price*0.98 AS nav FROM fundamentals f JOIN latest l ON l.symbol = f.symbol""")
def _(t):
    s, p = F.col("symbol"), F.col("price")
    raw = t.fundamentals().join(t.latest(), "symbol").select(
        "symbol", F.when(s.isin("SMALL", "LARGE"), 0.0).otherwise(p).alias("currentPrice"),
        F.when(s != "LARGE", p * 0.99).alias("regularMarketPrice"), (p * 0.98).alias("navPrice"), F.col("beta").alias("beta3Year"),
        F.lit(1.1).alias("beta"), F.col("dividend_yield").alias("dividendYield"), F.lit(None).cast("double").alias("totalAssets"))
    return al.fundamentals_view(raw)


@query("J4_signal_bars", "symbol:s bar_dt:d high:4 low:4", """
WITH wk AS (SELECT symbol, CAST(dt + CAST((12 - dayofweek(dt)) % 7 AS INTEGER) AS DATE) AS bar_dt, max(high) AS high, min(low) AS low FROM bars GROUP BY 1, 2),
early AS (SELECT * FROM wk), lastw AS (SELECT symbol, max_by(bar_dt, bar_dt) AS bar_dt, max_by(high, bar_dt) AS high, max_by(low, bar_dt) AS low FROM early GROUP BY 1),
s AS (SELECT symbol, dt FROM feat WHERE rsi < 30 OR rsi > 70)
SELECT DISTINCT s.symbol, coalesce(e.bar_dt, l.bar_dt) AS bar_dt, coalesce(e.high, l.high) AS high, coalesce(e.low, l.low) AS low FROM s ASOF LEFT JOIN early e ON e.symbol = s.symbol AND s.dt <= e.bar_dt JOIN lastw l ON l.symbol = s.symbol""")
def _(t):
    rsi = F.col("rsi")
    signals = ind.with_rsi(ind.number_rows(t.prices())).filter((rsi < 30) | (rsi > 70)).select("symbol", "dt")
    bars = weekly_bars(t.bars()).select("symbol", F.col("period").alias("bar_dt"), "high", "low")
    return al.bars_for_signals(bars, signals)
