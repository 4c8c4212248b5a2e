"""Price alerts, quotes with fallback, exchange rate and fundamentals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import signals as sig
from tidemark.functions.numeric import first_truthy, number_or_null

ALERT_SCHEMA = ("alerts array<struct<id:string,ticker:string,alert_type:string,price:double,note:string,"
                "triggered:boolean,created_at:string,triggered_at:string,triggered_price:double>>")
FX_LOW, FX_HIGH, FX_DEFAULT = 20.0, 50.0, 33.5


def parse_alert_documents(docs: DataFrame, column: str = "value") -> DataFrame:
    """Alert rows from JSON documents ``{"alerts": [...]}``; a malformed document has no alerts."""
    doc = F.from_json(column, ALERT_SCHEMA)
    return docs.select(F.explode(doc["alerts"]).alias("a")).select("a.*")


def check_alerts(alerts: DataFrame, prices: DataFrame, as_of) -> DataFrame:
    """Pending alerts with their trigger decision; a spent alert keeps its first trigger."""
    rows = alerts.join(prices.select(F.col("symbol").alias("ticker"), F.col("price").alias("now")), "ticker", "left")
    hit = ~F.col("triggered") & sig.price_alert_hit(F.col("alert_type"), F.col("now"), F.col("price"))
    return rows.withColumn("fired", hit).withColumns({
        "triggered_at": F.when(F.col("fired"), F.lit(as_of).cast("date")).otherwise(F.col("triggered_at")),
        "triggered_price": F.when(F.col("fired"), F.col("now")).otherwise(F.col("triggered_price")),
        "triggered": F.col("triggered") | F.col("fired")})


def alert_distances(alerts: DataFrame, prices: DataFrame, near_pct: float = 2.0) -> DataFrame:
    """Distance of each pending alert to its trigger in percent; no price gives NULL and not near."""
    rows = alerts.filter(~F.col("triggered")).join(prices.select(F.col("symbol").alias("ticker"), F.col("price").alias("now")), "ticker", "left")
    target = F.when(F.col("price") > 0, F.col("price"))
    rows = rows.withColumn("distance_pct", sig.alert_distance_pct(F.col("alert_type"), F.col("now"), target))
    return rows.withColumn("near", F.coalesce(F.col("distance_pct").between(0, near_pct), F.lit(False)))


def latest_with_fallback(wanted: DataFrame, quotes: DataFrame) -> DataFrame:
    """Best quote per wanted symbol: lowest source priority with a positive price, newest first.

    Symbols without any usable quote are absent; unusable quotes never count as zero.
    """
    q = quotes.withColumn("price", number_or_null(F.col("price"))).filter(F.col("price") > 0)
    q = q.withColumn("symbol", F.upper(F.trim("symbol")))
    rank = F.struct("source_priority", (-F.unix_date("ts")).alias("age"))
    best = q.groupBy("symbol").agg(F.min_by(F.struct("price", "source_priority"), rank).alias("b"))
    return wanted.select(F.upper(F.trim("symbol")).alias("symbol")).distinct().join(best, "symbol").select("symbol", "b.*")


def resolve_fx(candidates: DataFrame, default: float = FX_DEFAULT) -> DataFrame:
    """Newest rate of the first source whose newest rate is plausible, else the default (not live)."""
    newest = candidates.groupBy("source_priority").agg(F.max_by("rate", "ts").alias("rate"))
    ok = newest.filter(F.col("rate").between(FX_LOW, FX_HIGH))
    return ok.agg(F.min_by("rate", "source_priority").alias("live")).select(
        F.coalesce("live", F.lit(float(default))).alias("rate"), F.col("live").isNotNull().alias("is_live"))


def fundamentals_view(raw: DataFrame) -> DataFrame:
    """Statement-style fields with 0 default, and aliases tried in order (zero counts as missing)."""
    c = F.col
    return raw.select(
        "symbol", first_truthy(c("currentPrice"), c("regularMarketPrice"), c("navPrice")).alias("price"),
        first_truthy(c("beta3Year"), c("beta")).alias("beta"), first_truthy(c("dividendYield"), default=0).alias("dividend_yield"),
        first_truthy(c("totalAssets"), default=0).alias("total_assets"), first_truthy(c("navPrice"), default=0).alias("nav"))


def bars_for_signals(bars: DataFrame, signals: DataFrame) -> DataFrame:
    """Chart bar of each signal: first bar on or after it, the last bar when there is none; one mark per bar."""
    from tidemark.operators.asof import asof_lookup

    hit = asof_lookup(signals, bars, "dt", "bar_dt", ["high", "low"], by=["symbol"], direction="forward")
    last = bars.groupBy("symbol").agg(F.max_by(F.struct("bar_dt", "high", "low"), "bar_dt").alias("z"))
    rows = hit.join(last, "symbol").select(
        "symbol", F.coalesce("matched_on", "z.bar_dt").alias("bar_dt"),
        F.when(F.col("matched_on").isNotNull(), F.col("high")).otherwise(F.col("z.high")).alias("high"),
        F.when(F.col("matched_on").isNotNull(), F.col("low")).otherwise(F.col("z.low")).alias("low"))
    return rows.dropDuplicates(["symbol", "bar_dt"])
