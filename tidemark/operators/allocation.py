"""Splitting a budget: weights, gaps, whole units by largest remainder, and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import signals as sig
from tidemark.functions.numeric import dbl, ratio

UNIT = 100  # whole currency units per lot
DRIFT_LIMIT = 0.05
FEE_RATE = 0.0015


def largest_remainder(rows: DataFrame, exact: Column, total_units: Column, ties: list[Column],
                      keys: tuple[str, ...] = ("portfolio_id",)) -> DataFrame:
    """Add ``units``: floor of each exact share, leftovers to the largest remainders."""
    group = Window.partitionBy(*keys)
    rows = rows.withColumn("_exact", exact)
    rows = rows.withColumn("_floor", F.floor("_exact"))
    rows = rows.withColumn("_left", total_units - F.sum("_floor").over(group))
    order = group.orderBy((F.col("_exact") - F.col("_floor")).desc(), *ties)
    extra = F.when(F.row_number().over(order) <= F.col("_left"), 1).otherwise(0)
    return rows.withColumn("units", F.col("_floor") + extra).drop("_exact", "_floor", "_left")


def target_weights(asked: DataFrame, custom: DataFrame, preset: DataFrame) -> DataFrame:
    """Weight per asked symbol: own setting, else preset, else an equal share of what is left.

    ``asked(portfolio_id, symbol)``, ``custom(portfolio_id, symbol, weight)``, ``preset(portfolio_id, symbol, weight)``.
    """
    own = custom.filter(F.col("weight") > 0).select("portfolio_id", "symbol", F.col("weight").alias("own"))
    base = preset.select("portfolio_id", "symbol", F.col("weight").alias("base"))
    raw = (asked.join(own, ["portfolio_id", "symbol"], "left").join(base, ["portfolio_id", "symbol"], "left")
           .withColumn("raw", F.coalesce("own", "base", F.lit(0.0))))
    pf = Window.partitionBy("portfolio_id")
    raw = raw.withColumns({"n": F.count("*").over(pf), "assigned": F.sum("raw").over(pf),
                           "n_unset": F.count_if(F.col("raw") <= 0).over(pf)})
    left = F.greatest(F.lit(0.0), 1.0 - F.col("assigned"))
    share = F.when(left > 0, left / F.col("n_unset")).otherwise(1.0 / F.col("n"))
    filled = raw.withColumn("filled", F.when(F.col("raw") <= 0, share).otherwise(F.col("raw")))
    return filled.select("portfolio_id", "symbol", (F.col("filled") / F.sum("filled").over(pf)).alias("weight"))


def allocate_budget(scores: DataFrame, targets: DataFrame, budget: float) -> DataFrame:
    """Monthly plan per portfolio: target weight times score tilt, in whole lots.

    Symbols without usable data or without a target take no part; their share goes to the rest.
    """
    usable = scores.filter(F.col("data_ok") & (F.col("total_pct") >= 0)).select("symbol", "total_pct")
    rows = targets.filter(F.col("weight") > 0).join(usable, "symbol").withColumn(
        "w", F.col("weight") * sig.score_tilt(F.col("total_pct")))
    lots = int(budget // UNIT)
    share = F.col("w") / F.sum("w").over(Window.partitionBy("portfolio_id")) * lots
    plan = largest_remainder(rows, share, F.lit(lots), [F.col("total_pct").desc(), F.col("ord")])
    amount = F.col("units") * UNIT
    return plan.filter(F.col("units") > 0).select(
        "portfolio_id", "symbol", amount.alias("amount"), (amount / dbl(budget) * 100).alias("percent"),
        (F.col("weight") * 100).alias("target_percent"), sig.score_tilt(F.col("total_pct")).alias("tilt"),
        sig.score_label(F.col("total_pct")).alias("label"), F.col("total_pct").alias("score"))


def plan_rollup(plan: DataFrame, scores: DataFrame, budget: float) -> DataFrame:
    """Allocated and left-over money per portfolio, with the number of symbols left out for want of data."""
    missing = scores.agg(F.count_if(~F.col("data_ok")).alias("n_no_data"))
    total = plan.groupBy("portfolio_id").agg(F.sum("amount").alias("allocated"))
    return total.join(F.broadcast(missing)).withColumn(  # one row
        "unallocated", F.greatest(F.lit(0.0), dbl(budget) - F.col("allocated")))


def symbols_without_data(scores: DataFrame) -> DataFrame:
    return scores.filter(~F.col("data_ok")).select("symbol")


def new_money_plan(holdings: DataFrame, targets: DataFrame | dict[str, float], budget: float) -> DataFrame:
    """Spread new money over the symbols furthest below target; nothing is sold.

    ``holdings(portfolio_id, symbol, value)``; ``targets(portfolio_id, symbol, weight, ord)`` or one mix for all.
    Portfolios without a positive holding get no plan.
    """
    pf = Window.partitionBy("portfolio_id")
    rows = union_of_symbols(holdings.filter(F.col("value") > 0), targets).withColumn("total_now", F.sum("value").over(pf))
    rows = rows.filter((F.col("weight") > 0) & (F.col("total_now") > 0)).withColumn("weight", F.col("weight") / F.sum("weight").over(pf))
    after = F.col("total_now") + budget
    rows = rows.withColumn("gap", F.greatest(F.lit(0.0), F.col("weight") * after - F.col("value")))
    rows = rows.withColumn("gaps", F.sum("gap").over(pf))
    money = F.when(F.col("gaps") >= budget, dbl(budget) * F.col("gap") / F.col("gaps")).otherwise(
        F.col("gap") + (dbl(budget) - F.col("gaps")) * F.col("weight"))
    lots = int(budget // UNIT)
    plan = largest_remainder(rows, money / dbl(budget) * lots, F.lit(lots), [F.col("ord")])
    amount = F.col("units") * UNIT
    return plan.filter(F.col("units") > 0).select(
        "portfolio_id", "symbol", amount.alias("amount"), (F.col("value") / F.col("total_now") * 100).alias("current_pct"),
        (F.col("weight") * 100).alias("target_pct"), ((F.col("value") + amount) / after * 100).alias("projected_pct"))


def assign_mix(portfolios: DataFrame, mix: dict[str, float]) -> DataFrame:
    """Give every portfolio one fixed mix, as rows (an explode of a constant list)."""
    rows = F.explode(F.array(*[
        F.struct(F.lit(s).alias("symbol"), dbl(w).alias("weight"), F.lit(i).alias("ord"))
        for i, (s, w) in enumerate(mix.items())])).alias("m")
    return portfolios.select("portfolio_id", rows).select("portfolio_id", "m.*")


def beside_mix(holdings: DataFrame, mix: dict[str, float]) -> DataFrame:
    """Holdings (one row per portfolio and symbol) with the symbols of one mix added to every portfolio, as ``weight`` and ``ord``.

    The first row of a portfolio brings the mix along, so neither the portfolios are listed by a second reading nor is
    anything joined: one shuffle by portfolio serves this and all that follows per portfolio.
    """
    fields = [f for f in holdings.schema if f.name not in ("portfolio_id", "weight", "ord")]
    null = lambda kind: F.lit(None).cast(kind)
    own = F.struct(*[F.col(f.name) for f in fields], null("double").alias("weight"), null("int").alias("ord"))
    wanted = [F.struct(*[F.lit(s).cast(f.dataType).alias("symbol") if f.name == "symbol" else null(f.dataType).alias(f.name) for f in fields],
                       dbl(w).alias("weight"), F.lit(i).alias("ord")) for i, (s, w) in enumerate(mix.items())]
    first = F.row_number().over(Window.partitionBy("portfolio_id").orderBy("symbol")) == 1
    rows = holdings.withColumn("_first", first).select(
        "portfolio_id", F.explode(F.when(F.col("_first"), F.array(own, *wanted)).otherwise(F.array(own))).alias("r"))
    return rows.select("portfolio_id", "r.*").groupBy("portfolio_id", "symbol").agg(
        *[F.max(c).alias(c) for c in [f.name for f in fields if f.name != "symbol"] + ["weight", "ord"]])


def union_of_symbols(holdings: DataFrame, targets: DataFrame | dict[str, float]) -> DataFrame:
    """Actual and target side by side; a symbol missing on one side counts 0 there.

    ``targets`` are rows per portfolio, or one mix (symbol -> weight) for every portfolio with holdings.
    """
    both = beside_mix(holdings, targets) if isinstance(targets, dict) else holdings.join(targets, ["portfolio_id", "symbol"], "full_outer")
    return both.withColumns({"value": F.coalesce("value", F.lit(0.0)), "target": F.col("weight"),
                             "weight": F.coalesce("weight", F.lit(0.0))})


def drift_rows(holdings: DataFrame, targets: DataFrame | dict[str, float]) -> DataFrame:
    """One row per portfolio and symbol with the current weight next to the target weight.

    ``holdings(portfolio_id, symbol, shares, price)``; a holding without price has value 0 here,
    as the drift contract asks, and is counted in ``unpriced``.
    """
    valued = holdings.withColumns({
        "unpriced_row": F.when(F.col("price").isNull(), 1).otherwise(0),
        "value": F.col("shares") * F.coalesce("price", F.lit(0.0))})
    pf = Window.partitionBy("portfolio_id")
    rows = union_of_symbols(valued, targets)
    return rows.withColumns({
        "total": F.sum("value").over(pf), "unpriced": F.sum(F.coalesce("unpriced_row", F.lit(0))).over(pf),
    }).withColumn("current", ratio(F.col("value"), F.when(F.col("total") > 0, F.col("total"))))


def max_drift(holdings: DataFrame, targets: DataFrame | dict[str, float]) -> DataFrame:
    """Largest distance from target per portfolio (1 when nothing has value)."""
    rows = drift_rows(holdings, targets)
    return rows.groupBy("portfolio_id").agg(
        F.coalesce(F.max(F.when(F.col("target").isNotNull(), F.abs(F.col("current") - F.col("target")))),
                   F.lit(1.0)).alias("max_drift"),
        F.max("unpriced").alias("unpriced"))


def rebalance_plan(holdings: DataFrame, targets: DataFrame | dict[str, float], prices: DataFrame, budget_usd: float, fx: float,
                   limit: float = DRIFT_LIMIT) -> DataFrame:
    """Buy, sell or hold per target symbol for portfolios whose largest drift reaches the limit."""
    pf = Window.partitionBy("portfolio_id")
    rows = drift_rows(holdings, targets).withColumn("max_drift", F.coalesce(F.max(F.when(
        F.col("target").isNotNull(), F.abs(F.col("current") - F.col("target")))).over(pf), F.lit(1.0)))
    rows = (rows.filter((F.col("max_drift") >= limit) & F.col("target").isNotNull())
            .drop("price").join(prices.filter(F.col("price") > 0), "symbol"))
    delta = F.col("target") * (F.col("total") + budget_usd) - F.col("value")
    hold = F.abs("delta") < 0.01
    usd = F.when(hold, 0.0).otherwise(F.abs("delta"))
    return rows.withColumn("delta", delta).select(
        "portfolio_id", "symbol", "max_drift",
        F.when(hold, "hold").when(F.col("delta") > 0, "buy").otherwise("sell").alias("action"),
        (usd / F.col("price")).alias("shares"), usd.alias("usd_amount"), (usd * fx).alias("thb_amount"),
        (usd * FEE_RATE * fx).alias("fee_thb"))


def price_level_drift(prices: DataFrame, targets: DataFrame, threshold: float = DRIFT_LIMIT) -> DataFrame:
    """Weights of one share each by price level against the target mix."""
    pf = Window.partitionBy("portfolio_id")
    rows = targets.join(prices, "symbol").withColumns({
        "target": F.col("weight") / F.sum("weight").over(pf), "current": F.col("price") / F.sum("price").over(pf)})
    rows = rows.withColumn("drift", F.abs(F.col("current") - F.col("target")))
    return rows.withColumn("need_rebalance", F.col("drift") > threshold)


def drift_advisory(holdings: DataFrame, targets: DataFrame | dict[str, float], points: float = 5.0) -> DataFrame:
    """Priced holdings at least ``points`` percentage points off target."""
    pf = Window.partitionBy("portfolio_id")
    rows = holdings.filter(F.col("price").isNotNull()).withColumn("value", F.col("shares") * F.col("price"))
    rows = union_of_symbols(rows, targets).withColumn("total", F.sum("value").over(pf))
    rows = rows.filter((F.col("total") > 0) & F.col("price").isNotNull())
    rows = rows.withColumn("drift_pct", (F.col("value") / F.col("total") - F.col("weight")) * 100)
    return rows.filter(F.abs("drift_pct") >= points)


def order_list(plan: DataFrame, prices: DataFrame, fx: float) -> DataFrame:
    """Plan rows as orders: money, estimated shares (NULL without price) and fee."""
    usd = F.col("amount") / dbl(fx)
    return plan.join(prices, "symbol", "left").withColumns({
        "usd": usd, "est_shares": ratio(usd, F.col("price")), "fee_thb": F.col("amount") * FEE_RATE})


def monthly_costs(budgets: DataFrame, spread_pct: float = 0.25) -> DataFrame:
    """Fee and exchange spread of one purchase; a budget of zero or less costs nothing."""
    paid = F.greatest(F.col("budget"), F.lit(0.0))
    total = paid * (FEE_RATE + spread_pct / 100.0)
    return budgets.withColumns({
        "fee_thb": paid * FEE_RATE, "spread_thb": paid * (spread_pct / 100.0), "total_thb": total,
        "total_pct": F.when(paid > 0, total / paid * 100).otherwise(0.0)})
