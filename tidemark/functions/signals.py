"""Classification rules, each defined once and used by every job that needs it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.numeric import clamp, dbl

# Thresholds and labels that results must share.
RSI_LOW, RSI_HIGH = 30.0, 70.0
UP_SIGNALS = ("bullish", "accumulate")
DOWN_SIGNALS = ("downtrend", "downtrend_watch")
TREND_MAX, TIMING_MAX, MOMENTUM_MAX, DIVIDEND_MAX = 40, 30, 20, 10
TILT_LOW, TILT_HIGH = 0.6, 1.4


def rsi_zone(rsi: Column) -> Column:
    return (F.when(rsi.isNull(), "no_data")
            .when(rsi < RSI_LOW, "oversold")
            .when(rsi > RSI_HIGH, "overbought")
            .otherwise("neutral"))


def dca_signal(price: Column, ma50: Column, ma200: Column, rsi: Column) -> Column:
    up = price >= ma200
    return (F.when(price.isNull() | ma200.isNull() | rsi.isNull(), "no_data")
            .when(rsi > RSI_HIGH, "overbought_caution")
            .when((rsi < RSI_LOW) & up, "accumulate")
            .when(rsi < RSI_LOW, "downtrend_watch")
            .when(up & F.coalesce(price >= ma50, F.lit(False)), "bullish")
            .when(up, "neutral")
            .otherwise("downtrend"))


def technical_label(signal: Column) -> Column:
    return (F.when(signal.isin(*UP_SIGNALS), "bullish")
            .when(signal.isin(*DOWN_SIGNALS), "bearish")
            .otherwise("neutral"))


def overall_signal(signal: Column, golden: Column, death: Column, rsi: Column) -> Column:
    calm = F.coalesce(rsi < 65, F.lit(False))
    return (F.when(signal == "no_data", "no_data")
            .when(signal.isin(*UP_SIGNALS) & golden & calm, "strong_buy")
            .when(signal.isin(*UP_SIGNALS), "buy")
            .when((signal == "downtrend") & death, "sell")
            .otherwise("hold"))


def zone_text(price: Column, ma50: Column, ma200: Column, rsi: Column) -> Column:
    """Three-part text zone; NULL until both averages and the RSI exist."""
    parts = F.concat_ws(
        " | ",
        F.when(ma50 > ma200, "Bullish").otherwise("Bearish"),
        F.when(price >= ma200, "Above MA200").otherwise("Below MA200"),
        F.concat(F.lit("RSI: "), F.initcap(rsi_zone(rsi))),
    )
    return F.when(ma50.isNotNull() & ma200.isNotNull() & rsi.isNotNull(), parts)


def confluence(daily: Column, weekly: Column) -> Column:
    return (F.when((daily == "no_data") | (weekly == "no_data"), "no_data")
            .when(daily.isin(*UP_SIGNALS) & weekly.isin(*UP_SIGNALS), "both_up")
            .when(daily.isin(*DOWN_SIGNALS) & weekly.isin(*DOWN_SIGNALS), "both_down")
            .when(daily == weekly, "equal")
            .otherwise("mixed"))


def volatility_regime(vix: Column) -> Column:
    return F.when(vix < 20, "calm").when(vix <= 30, "caution").when(vix > 30, "high")


def volatility_warning(vix: Column) -> Column:
    return F.coalesce(vix > 25, F.lit(False))


def technical_alert(rsi: Column, price: Column, prev: Column, ma200: Column) -> Column:
    return (F.when(rsi < RSI_LOW, "oversold")
            .when(rsi > RSI_HIGH, "overbought")
            .when((prev <= ma200) & (ma200 < price), "crossed_above")
            .when((prev >= ma200) & (ma200 > price), "crossed_below")
            .otherwise("none"))


def price_alert_hit(kind: Column, price: Column, target: Column) -> Column:
    """True when the alert fires; a missing price or one that is not a number never fires."""
    number = ~F.isnan(price) & ~F.isnan(target)  # NaN is greater than all numbers in Spark
    return F.coalesce(
        F.when(kind == "above", number & (price >= target)).when(kind == "below", number & (price <= target)),
        F.lit(False),
    )


def alert_distance_pct(kind: Column, price: Column, target: Column) -> Column:
    return (F.when(kind == "below", (price - target) / target * 100)
            .when(kind == "above", (target - price) / target * 100))


def channel_zone(sigmas: Column) -> Column:
    return (F.when(sigmas >= 1.5, "upper").when(sigmas <= -1.5, "lower")
            .when(sigmas.isNotNull(), "middle"))


def valuation_verdict(margin: Column) -> Column:
    return (F.when(margin > 30, "Strong Buy").when(margin > 15, "Buy")
            .when(margin > 0, "Fair Value").when(margin > -15, "Overvalued")
            .when(margin.isNotNull(), "Avoid"))


def score_label(pct: Column) -> Column:
    return (F.when(pct >= 70, "Strong Buy").when(pct >= 55, "Buy").when(pct >= 40, "Neutral")
            .when(pct >= 25, "Caution").when(pct.isNotNull(), "Avoid"))


def trend_points(price: Column, ma50: Column, ma200: Column) -> Column:
    over50 = price >= ma50
    return (F.when((price >= ma200) & over50, 40).when(price >= ma200, 30)
            .when(over50, 10).otherwise(0))


def timing_points(price: Column, ma200: Column, rsi: Column) -> Column:
    return (F.when((rsi < RSI_LOW) & (price >= ma200), 30)
            .when(rsi < RSI_LOW, 10)
            .when(rsi > RSI_HIGH, 0)
            .when(rsi < 50, 20)
            .otherwise(10))


def momentum_points(month_pct: Column, quarter_pct: Column) -> Column:
    gain = lambda c: F.when(c > 0, 10).otherwise(0)
    return gain(month_pct) + gain(quarter_pct)


def dividend_points(dividend_yield: Column) -> Column:
    return (F.when(dividend_yield > 0.04, 10).when(dividend_yield > 0.02, 5)
            .when(dividend_yield > 0, 2).otherwise(0))


def repaired_yield(raw: Column) -> Column:
    """Yield as a fraction: negatives are missing, values above one are percentages."""
    return F.when(raw > 1, raw / 100.0).when(raw >= 0, raw)


def score_tilt(pct: Column) -> Column:
    return dbl(TILT_LOW) + dbl(TILT_HIGH - TILT_LOW) * clamp(pct, 0, 100) / 100.0


def macro_regime(rate_trend: Column, vix: Column, cpi_trend: Column, usd_trend: Column) -> Column:
    """Struct of three codes: market mood, inflation and dollar."""
    mood = (F.when((rate_trend == "up") & (vix < 20), "rates_up_calm")
            .when((rate_trend == "down") & (vix < 20), "rates_down_calm")
            .when(vix >= 25, "high_volatility")
            .otherwise("mixed"))
    inflation = (F.when(cpi_trend == "down", "easing").when(cpi_trend == "up", "rising")
                 .otherwise("flat"))
    dollar = F.when(usd_trend == "up", "strong").otherwise("soft")
    return F.struct(mood.alias("mood"), inflation.alias("inflation"), dollar.alias("dollar"))
