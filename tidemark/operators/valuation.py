"""Discounted cash-flow proxy per symbol, from price history and fundamentals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import clamp, dbl, first_truthy
from tidemark.functions.signals import valuation_verdict
from tidemark.operators.risk import annual_return_stats

# Fixed values of the model.
RISK_FREE, EQUITY_PREMIUM = 0.043, 0.065
GROWTH_LOW, GROWTH_HIGH, TERMINAL = 0.04, 0.12, 0.03
FAST_YEARS = 5


def dcf_flows(prices: DataFrame, fundamentals: DataFrame, years: int = 10) -> DataFrame:
    """One row per symbol and projected year; flows are rounded to cents before they are used.

    Symbols whose price/earnings ratio is missing or not positive are not available.
    """
    last = prices.filter(F.col("close").isNotNull()).groupBy("symbol").agg(F.max_by("close", "dt").alias("price"))
    growth = annual_return_stats(prices).select("symbol", "last3_return")
    beta = first_truthy(F.col("beta"), default=1.0)
    rows = (fundamentals.filter(F.col("trailing_pe") > 0).join(last, "symbol").join(growth, "symbol", "left")
            .withColumns({"beta": beta, "growth": clamp(F.coalesce("last3_return", F.lit(0.0)), GROWTH_LOW, GROWTH_HIGH)})
            .withColumn("wacc", F.col("beta") * EQUITY_PREMIUM + RISK_FREE))
    rows = rows.withColumn("terminal", F.when(F.col("wacc") - TERMINAL < 0.005, F.greatest(dbl(0.01), F.col("wacc") - 0.01))
                           .otherwise(dbl(TERMINAL)))
    base = F.col("price") / F.col("trailing_pe") + F.coalesce("dividend_rate", F.lit(0.0))
    year = F.col("year").cast("double")
    flow = base * F.pow(1 + F.col("growth"), F.least(year, dbl(FAST_YEARS))) * F.pow(
        1 + F.col("terminal"), F.greatest(year - FAST_YEARS, dbl(0)))
    out = rows.withColumn("year", F.explode(F.sequence(F.lit(1), F.lit(years)))).withColumn("flow", flow)
    return out.withColumns({"cash_flow": F.round("flow", 2), "present_value": F.round(F.col("flow") / F.pow(1 + F.col("wacc"), year), 2)})


def dcf_valuation(prices: DataFrame, fundamentals: DataFrame, years: int = 10) -> DataFrame:
    """Intrinsic value, margin of safety and verdict per symbol."""
    flows = dcf_flows(prices, fundamentals, years)
    # one symbol has exactly ``years`` rows
    agg = flows.groupBy("symbol", "price", "beta", "growth", "wacc", "terminal").agg(
        F.sum("present_value").alias("pv"), F.max_by("cash_flow", "year").alias("last_flow"),
        F.sort_array(F.collect_list(F.struct("year", "cash_flow", "present_value"))).alias("cash_flows"))
    tail = F.col("last_flow") * (1 + F.col("terminal")) / (F.col("wacc") - F.col("terminal")) / F.pow(1 + F.col("wacc"), F.lit(years))
    raw = F.col("pv") + tail
    out = agg.withColumn("intrinsic", F.when(raw > 0, raw).otherwise(F.col("price")))
    out = out.withColumn("margin", F.when(F.col("intrinsic") != 0, (F.col("intrinsic") - F.col("price")) / F.col("intrinsic") * 100).otherwise(0.0))
    return out.withColumn("verdict", valuation_verdict(F.col("margin")))


def score_and_value(scores: DataFrame, dcf: DataFrame, order: DataFrame) -> DataFrame:
    """Scores with valuation columns beside them, listed symbols first in their given order."""
    cols = ["symbol", "price", "intrinsic", "margin", "verdict"]
    left = scores.select("symbol", "total_pct", "label", "data_ok")
    rows = left.join(dcf.select(*cols), "symbol", "left").join(order.select("symbol", F.col("ord").alias("pos")), "symbol", "left")
    return rows.withColumn("dcf_available", F.col("verdict").isNotNull())
