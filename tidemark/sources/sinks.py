"""Writers. Each prepares its rows as a DataFrame; files are appended or written to a new version."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ledger import broker_fee


def check_ledger_rows(new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split new ledger rows into accepted (with fee) and rejected.

    Purchases need a ticker and positive shares, price, rate and amount; dividends need a
    ticker and a positive net amount and rate and store no shares, price or fee.
    """
    is_div = F.col("tx_type") == "dividend"
    positive = lambda *cols: F.least(*[F.coalesce(F.col(c), F.lit(0.0)) for c in cols]) > 0
    named = F.coalesce(F.length(F.trim("ticker")) > 0, F.lit(False))
    good = named & F.when(is_div, positive("amount_usd", "fx_rate_thb")).otherwise(
        positive("shares", "price_usd", "fx_rate_thb", "amount_thb"))
    zero = F.lit(0.0)
    accepted = new.filter(good).withColumns({
        "ticker": F.upper(F.trim("ticker")),
        "shares": F.when(is_div, zero).otherwise(F.col("shares")),
        "price_usd": F.when(is_div, zero).otherwise(F.col("price_usd")),
        "amount_thb": F.when(is_div, F.col("amount_usd") * F.col("fx_rate_thb")).otherwise(F.col("amount_thb")),
        "fee_thb": F.when(is_div, zero).otherwise(broker_fee(F.col("shares") * F.col("price_usd"), F.col("fx_rate_thb")))})
    return accepted, new.filter(~good)


def append_ledger(new: DataFrame, path: str, rejects_path: str | None = None) -> None:
    accepted, rejected = check_ledger_rows(new)
    accepted.write.mode("append").parquet(path)
    if rejects_path:
        rejected.write.mode("append").parquet(rejects_path)


def upsert_alerts(alerts: DataFrame, new: DataFrame) -> DataFrame:
    """Alert table after an upsert: one pending alert per (ticker, kind) takes the new target.

    When several pending alerts share the key the first (smallest id) is updated. Spent alerts
    and other pending ones pass through; a key without pending alert becomes a new row. Offers
    with an empty ticker, unknown kind or non-positive target are ignored.
    """
    key = ["ticker", "alert_type"]
    good = (F.length("ticker") > 0) & F.col("alert_type").isin("above", "below") & (F.col("price") > 0)
    offer = (new.select(F.upper(F.trim("ticker")).alias("ticker"), F.lower(F.trim("alert_type")).alias("alert_type"),
                        "price", F.col("alert_id").alias("new_id")).filter(good)
             .groupBy(*key).agg(F.max_by("price", "new_id").alias("new_price"), F.max("new_id").alias("new_id")))
    pending = alerts.filter(~F.col("triggered"))
    first = pending.groupBy(*key).agg(F.min("alert_id").alias("alert_id"))
    touched = first.join(offer, key).select("alert_id", "new_price")
    updated = alerts.join(touched, "alert_id", "left").withColumn(
        "price", F.coalesce("new_price", "price")).drop("new_price")
    added = offer.join(first, key, "left_anti").select(
        F.col("new_id").alias("alert_id"), *key, F.col("new_price").alias("price"), F.lit(False).alias("triggered"))
    return updated.unionByName(added, allowMissingColumns=True)


def without_keys(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is not listed."""
    return table.join(keys.select(*on).distinct(), on, "left_anti")


def delete_by_key(table: DataFrame, keys: DataFrame, on: list[str], new_version: str) -> int:
    """Write the table without the listed keys to a new version; returns how many keys matched."""
    without_keys(table, keys, on).write.mode("errorifexists").parquet(new_version)
    return keys.select(*on).distinct().join(table.select(*on).distinct(), on, "left_semi").count()


def save_screen_results(results: DataFrame, created_at, path: str) -> None:
    results.withColumn("created_at", F.lit(created_at).cast("timestamp")).write.mode("append").parquet(path)


def screen_history(history: DataFrame, symbol: str | None = None, limit: int = 50) -> DataFrame:
    """Newest results first; the limit is the page size of the history list."""
    rows = history if symbol is None else history.filter(F.col("symbol") == symbol.strip().upper())
    return rows.orderBy(F.desc("created_at"), "symbol", "preset").limit(limit)


def snapshot_rows(snapshots: DataFrame) -> DataFrame:
    """Net-worth snapshots with totals from their nested asset and liability lists, lists as JSON text."""
    total = lambda c: F.aggregate(c, F.lit(0.0).cast("double"), lambda a, x: a + x["value_thb"])
    out = snapshots.withColumns({"total_assets_thb": total("assets"), "total_liabilities_thb": total("liabilities")})
    return out.withColumns({
        "net_worth_thb": F.col("total_assets_thb") - F.col("total_liabilities_thb"),
        "assets_json": F.to_json("assets"), "liabilities_json": F.to_json("liabilities")})
