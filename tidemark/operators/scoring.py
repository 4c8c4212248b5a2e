"""Symbol scores, alert levels and rule screens on top of the feature table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import signals as sig
from tidemark.functions.numeric import dbl
from tidemark.operators import indicators as ind
from tidemark.operators.panel import by_day

# Rule sets (field, operator, value, description) with their joining logic.
PRESETS = {
    "oversold_momentum": ("AND", [("rsi", "lt", 35.0, "RSI < 35 (oversold)"),
                                  ("macd_cross", "cross_up", None, "MACD bullish crossover"),
                                  ("price_vs_ma200", "gt", None, "Price above MA200")]),
    "golden_cross_alert": ("AND", [("golden_cross", "cross_up", 3.0, "Golden Cross within 3 days")]),
    "bb_breakout_watch": ("AND", [("bb_squeeze", "squeeze", None, "Bollinger Band squeeze"),
                                  ("volume_spike", "spike", 2.0, "Volume > 2x MA20")]),
    "dividend_dip": ("AND", [("price_drop_pct", "drop_pct", 5.0, "Price dropped 5%+ in 10 days")]),
    "overbought_warning": ("AND", [("rsi", "gt", 70.0, "RSI > 70 (overbought)"),
                                   ("macd_cross", "cross_down", None, "MACD bearish crossover")]),
}


def score_columns(dividend: Column | None) -> dict[str, Column]:
    """Component points on a feature row; ``dividend`` NULL (or absent) lowers the maximum to 90."""
    price, m50, m200, rsi = (F.col(c) for c in ("close", "ma50", "ma200", "rsi"))
    has_div = F.lit(False) if dividend is None else dividend.isNotNull()
    zero = F.lit(0)
    return {
        "trend_score": sig.trend_points(price, m50, m200),
        "timing_score": sig.timing_points(price, m200, rsi),
        "momentum_score": sig.momentum_points(F.coalesce("mom_1m", F.lit(0.0)), F.coalesce("mom_3m", F.lit(0.0))),
        "dividend_score": zero if dividend is None else F.when(has_div, sig.dividend_points(dividend)).otherwise(zero),
        "max_score": F.when(has_div, sig.TREND_MAX + sig.TIMING_MAX + sig.MOMENTUM_MAX + sig.DIVIDEND_MAX)
        .otherwise(sig.TREND_MAX + sig.TIMING_MAX + sig.MOMENTUM_MAX)}


def with_scores(feats: DataFrame, dividend: Column | None = None) -> DataFrame:
    """Score every feature row (as of its own day); rows with fewer than 200 days have NULL scores."""
    ok = (F.col("rn") >= 199) & F.col("ma200").isNotNull() & F.col("rsi").isNotNull()
    df = feats.withColumn("data_ok", ok)
    df = df.withColumns({n: F.when(F.col("data_ok"), c) for n, c in score_columns(dividend).items()})
    total = F.col("trend_score") + F.col("timing_score") + F.col("momentum_score") + F.col("dividend_score")
    df = df.withColumn("total_score", total)
    return df.withColumn("total_pct", F.round(F.col("total_score") * 100.0 / F.col("max_score"), 1))


def symbol_scores(prices: DataFrame, fundamentals: DataFrame | None = None) -> DataFrame:
    """Score of each symbol on its newest day; ``data_ok`` false and an error code on short history."""
    last = ind.last_row(ind.features(prices))
    if fundamentals is not None:
        yields = fundamentals.select("symbol", sig.repaired_yield(F.col("dividend_yield")).alias("div_yield"))
        scored = with_scores(last.join(yields, "symbol", "left"), F.col("div_yield"))
    else:
        scored = with_scores(last)
    return scored.withColumns({
        "label": F.coalesce(sig.score_label(F.col("total_pct")), F.lit("NO DATA")),
        "error": F.when(~F.col("data_ok"), "short_history")})


def alert_levels(feats: DataFrame) -> DataFrame:
    """Buy level below and warning level above the last price, with the reason for each.

    Levels are taken at two decimals, as quoted. The buy level is the highest of support, MA200
    and MA50 that lies clearly below the price, else five percent under it.
    """
    last = ind.last_row(feats).filter(F.col("ma200").isNotNull() & F.col("rsi").isNotNull())
    q = lambda c: F.round(c, 2)
    df = last.select("symbol", q("close").alias("price"), q("support").alias("support"), q("ma200").alias("ma200"),
                     q("ma50").alias("ma50"), q("resistance").alias("resistance"))
    below = lambda c: F.when(F.col(c) < F.col("price") * 0.995, F.col(c))
    best = F.greatest(below("support"), below("ma200"), below("ma50"))
    above = F.col("resistance") > F.col("price") * 1.005
    return df.withColumn("best", best).select(
        "symbol", "price", F.coalesce("best", F.col("price") * 0.95).alias("buy_alert"),
        F.when(F.col("best").isNull(), "minus_5_pct").when(F.col("best") == below("support"), "support_60d")
        .when(F.col("best") == below("ma200"), "ma200").otherwise("ma50").alias("buy_reason"),
        F.when(above, F.col("resistance")).otherwise(F.col("price") * 1.05).alias("warning_alert"),
        F.when(above, "resistance_60d").otherwise("plus_5_pct").alias("warning_reason"))


def screen_row(bars: DataFrame) -> DataFrame:
    """Newest row per symbol with every quantity a screening rule can ask for."""
    df = ind.features(bars)
    w = by_day()
    hist_prev = F.lag("macd_hist").over(w)
    f, s = F.col("ma50"), F.col("ma200")
    df = df.withColumns({
        "macd_cross": F.when((hist_prev < 0) & (F.col("macd_hist") > 0), "cross_up")
        .when((hist_prev > 0) & (F.col("macd_hist") < 0), "cross_down"),
        "up": ind.cross_up(f, s, w, "strict"), "down": ind.cross_down(f, s, w, "strict"),
        "avg_bw": ind.full(F.col("bandwidth"), 50), "then": F.lag("close", 9).over(w)})
    # row numbers of the newest crosses let one pass serve any look-back in a rule
    df = df.withColumns({
        "last_up": F.max(F.when(F.col("up"), F.col("rn"))).over(w),
        "last_down": F.max(F.when(F.col("down"), F.col("rn"))).over(w)})
    return ind.last_row(df).withColumn("drop_pct", (F.col("then") - F.col("close")) / F.col("then") * 100)


def rule_rows(bars: DataFrame, presets: DataFrame) -> DataFrame:
    """Evaluate every rule of every preset on every symbol: ``passed`` NULL means not computable."""
    row, no = screen_row(bars), F.lit(False)
    given = F.when(F.col("value") != 0, F.col("value"))
    look = F.coalesce(given, dbl(3.0)).cast("int")
    op, field = F.col("operator"), F.col("field")
    recent = lambda c: F.coalesce(F.col("rn") - F.col(c) < look, no)
    enough = F.col("n_rows") >= look + 1
    ma200 = F.col("ma200")
    passed = (
        F.when((field == "rsi") & (op == "lt"), F.col("rsi") < F.col("value"))
        .when((field == "rsi") & (op == "gt"), F.col("rsi") > F.col("value"))
        .when(field == "rsi", F.when(F.col("rsi").isNotNull(), no))
        .when(field == "macd_cross", F.coalesce(F.col("macd_cross") == op, no))
        .when((field == "price_vs_ma200") & (op == "gt"), F.col("close") > ma200)
        .when((field == "price_vs_ma200") & (op == "lt"), F.col("close") < ma200)
        .when(field == "price_vs_ma200", F.when(ma200.isNotNull(), no))
        .when(field == "golden_cross", F.when(enough, recent("last_up")))
        .when(field == "death_cross", F.when(enough, recent("last_down")))
        .when(field == "bb_squeeze", F.coalesce(F.col("bandwidth") < F.col("avg_bw") * 0.5, no))
        .when(field == "volume_spike", F.coalesce(F.col("volume") > F.col("volume_ma20") * F.coalesce(given, dbl(2.0)), no))
        .when(field == "price_drop_pct", F.when(F.col("n_rows") >= 10, F.coalesce(F.col("drop_pct") >= F.coalesce(given, dbl(5.0)), no)))
        .otherwise(no))
    every = F.explode(F.array_sort(F.col("all_rules")))
    packed = presets.agg(F.collect_list(F.struct("preset", "logic", "rule_no", "field", "operator", "value", "description")).alias("all_rules"))
    # the packed rule table is a single row, so this adds a constant column
    return (row.join(F.broadcast(packed)).withColumn("r", every).select("*", "r.*").drop("r", "all_rules")
            .select("symbol", "close", "rsi", "preset", "logic", "rule_no", "description", passed.alias("passed")))


def screen(bars: DataFrame, presets: DataFrame) -> DataFrame:
    """Symbols that pass each preset, with matched descriptions and strength.

    A rule that cannot be computed takes the symbol out of that preset, even under OR.
    """
    per = rule_rows(bars, presets).groupBy("symbol", "preset", "logic").agg(
        F.count_if(F.col("passed").isNull()).alias("failed"), F.count_if(F.col("passed")).alias("matched"),
        F.count("*").alias("total"), F.first("close").alias("price"), F.first("rsi").alias("rsi"),
        F.array_sort(F.collect_list(F.when(F.col("passed"), F.struct("rule_no", "description")))).alias("hits"))
    hit = F.when(F.col("logic") == "AND", F.col("matched") == F.col("total")).otherwise(F.col("matched") > 0)
    base = F.col("matched") / F.col("total") * 7
    bonus = F.when(F.col("rsi") < 35, 1.5).when(F.col("rsi") > 65, 1.0).otherwise(0.0)
    return per.filter((F.col("failed") == 0) & hit).select(
        "symbol", "preset", "price", "matched", F.col("hits.description").alias("matched_rules"),
        F.least(F.round(base + bonus, 1), F.lit(10.0)).alias("strength"))


def preset_table(spark, presets: dict = PRESETS) -> DataFrame:
    rows = [(name, logic, i, f, op, v, d) for name, (logic, rules) in presets.items()
            for i, (f, op, v, d) in enumerate(rules)]
    return spark.createDataFrame(
        rows, "preset string, logic string, rule_no int, field string, operator string, value double, description string")
