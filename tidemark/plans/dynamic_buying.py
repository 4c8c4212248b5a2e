"""Monthly buying with weights that change over time, and the comparisons built on it.

Every indicator is causal, so features are computed once per symbol and day and a decision
reads the last row strictly before its buy day. All windows, arms and months run in one plan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import clamp, ratio
from tidemark.functions.signals import score_tilt
from tidemark.operators import indicators as ind
from tidemark.operators.scoring import with_scores

# Fixed values of the candidate tilts.
EDGE_LOW, EDGE_HIGH = 0.8, 1.2
MIN_UNDERWATER, MIN_VOL, MIN_STRENGTH, MIN_STRETCH = 252, 64, 127, 452
STRETCH_ROWS, STRETCH_MIN = 504, 252
CANDIDATES = ("underwater", "inverse_vol", "rel_strength", "stretch", "uw_x_ivol")
MONTHS = 12


def mapped_mix(weights: DataFrame, spans: dict[str, str], proxies: DataFrame) -> DataFrame:
    """Weights per test span with stand-ins for symbols too young: ``(win, start, symbol, weight)``.

    ``spans`` names each test span's first buy day; ``proxies(win, symbol, proxy)``.
    """
    every = F.explode(F.array(*[
        F.struct(F.lit(n).alias("win"), F.lit(d).cast("date").alias("start")) for n, d in spans.items()])).alias("s")
    rows = weights.filter(F.col("weight") > 0).select(every, "symbol", "weight").select("s.*", "symbol", "weight")
    named = rows.join(proxies, ["win", "symbol"], "left")
    return named.select("win", "start", F.coalesce("proxy", "symbol").alias("symbol"), "weight")


def require_prices(mix: DataFrame, panel: DataFrame) -> None:
    """Raise when a mapped symbol has no price at all."""
    lost = mix.select("symbol").distinct().join(panel.select("symbol").distinct(), "symbol", "left_anti")
    n, first = lost.agg(F.count("*"), F.min("symbol")).first()
    if n:
        raise ValueError(f"no price column for {n} symbols, the first is {first}")


def buy_rows(rows: DataFrame, mix: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keep the first day of each month on which all symbols of a mix trade, with their weights.

    A month whose first such day lies before the span's start is warm-up and buys nothing.
    """
    sized = mix.withColumn("n_symbols", F.count("*").over(Window.partitionBy(*keys)))
    rows = rows.join(sized, "symbol")
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy(*keys, "dt"))).filter(F.col("n") == F.col("n_symbols"))
    month = Window.partitionBy(*keys, F.trunc("dt", "month"))
    rows = rows.withColumn("buy_dt", F.min("dt").over(month))
    return rows.filter((F.col("dt") == F.col("buy_dt")) & (F.col("dt") >= F.col("start"))).drop("n", "n_symbols", "buy_dt")


def decision_features(panel: DataFrame) -> DataFrame:
    """Everything a weight policy may look at, per symbol and day."""
    df = with_scores(ind.features(panel))
    rows = lambda n: Window.partitionBy("symbol").orderBy("dt").rowsBetween(-(n - 1), 0)
    w = Window.partitionBy("symbol").orderBy("dt")
    return df.withColumns({
        "n_hist": F.col("rn") + 1,
        "vol63": F.stddev_samp("ret").over(rows(63)),
        "strength": ratio(F.col("close") / F.lag("close", 126).over(w) - 1, F.stddev_samp("ret").over(rows(126))),
        "depth": 1 - F.col("close") / F.col("peak"), "stretch_ratio": F.col("close") / F.col("ma200")})


FEATURES = ["rn", "n_hist", "data_ok", "total_pct", "vol63", "strength", "depth", "stretch_ratio"]


def stretch_percentile(decisions: DataFrame, feats: DataFrame) -> DataFrame:
    """Share of the last 504 price/average ratios at or below the current one, per decision row.

    Each decision meets only the two 504-row blocks its window can touch.
    """
    block = lambda c: F.floor(c / STRETCH_ROWS)
    at = decisions.select("symbol", "rn", "stretch_ratio").distinct().withColumn(
        "block", F.explode(F.array(block(F.col("rn")), block(F.col("rn")) - 1)))
    past = feats.filter(F.col("stretch_ratio").isNotNull()).select(
        "symbol", F.col("rn").alias("past_rn"), F.col("stretch_ratio").alias("past"), block(F.col("rn")).alias("block"))
    near = at.join(past, ["symbol", "block"]).filter(
        (F.col("past_rn") <= F.col("rn")) & (F.col("past_rn") > F.col("rn") - STRETCH_ROWS))
    return near.groupBy("symbol", "rn").agg(
        F.count("*").alias("n_ratio"), F.avg(F.when(F.col("past") <= F.col("stretch_ratio"), 1.0).otherwise(0.0)).alias("pctl"))


def edge(col: Column) -> Column:
    return clamp(col, EDGE_LOW, EDGE_HIGH)


def with_tilts(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Tilt columns per decision row; too little history always gives 1."""
    one = F.lit(1.0)
    day = Window.partitionBy(*keys, "dt")
    rows = rows.withColumns({
        "vol_ok": F.when((F.col("n_hist") >= MIN_VOL) & (F.col("vol63") > 0), F.col("vol63")),
        "str_ok": F.when(F.col("n_hist") >= MIN_STRENGTH, F.col("strength"))})
    rows = rows.withColumns({
        "n_vol": F.count("vol_ok").over(day), "n_str": F.count("str_ok").over(day),
        "med_vol": F.median("vol_ok").over(day), "avg_str": F.avg("str_ok").over(day), "sd_str": F.stddev_pop("str_ok").over(day)})
    uw = F.when(F.col("n_hist") >= MIN_UNDERWATER, edge(1 + clamp(F.col("depth"), 0.0, 0.20)))
    iv = F.when((F.col("n_vol") >= 2) & F.col("vol_ok").isNotNull(), edge(F.col("med_vol") / F.col("vol_ok")))
    rs = F.when((F.col("n_str") >= 3) & (F.col("sd_str") > 0) & F.col("str_ok").isNotNull(),
                edge(1 + (F.col("str_ok") - F.col("avg_str")) / F.col("sd_str") * 0.1333))
    st = F.when((F.col("n_hist") >= MIN_STRETCH) & (F.col("n_ratio") >= STRETCH_MIN), edge(1.2 - F.col("pctl") * 0.4))
    rows = rows.withColumns({"underwater": F.coalesce(uw, one), "inverse_vol": F.coalesce(iv, one),
                             "rel_strength": F.coalesce(rs, one), "stretch": F.coalesce(st, one)})
    return rows.withColumns({
        "uw_x_ivol": edge(F.col("underwater") * F.col("inverse_vol")),
        "neutral": ~F.coalesce(F.col("data_ok"), F.lit(False)), "plain": one,
        "tilt": F.when(F.coalesce(F.col("data_ok"), F.lit(False)), score_tilt(F.col("total_pct"))).otherwise(one)})


def decisions(panel: DataFrame, mix: DataFrame, keys: tuple[str, ...] = ("win",)) -> DataFrame:
    """Buy rows with the tilts known strictly before each buy day.

    A symbol trades on its buy day, so the last row before it is simply the symbol's previous
    row: the features are shifted down by one and no join back to the history is needed.
    """
    feats = decision_features(panel)
    w = Window.partitionBy("symbol").orderBy("dt")
    shifted = feats.select("symbol", "dt", "close", F.lag(F.struct(*FEATURES)).over(w).alias("known"))
    rows = buy_rows(shifted, mix, keys).select("*", "known.*").drop("known")
    rows = rows.join(stretch_percentile(rows, feats), ["symbol", "rn"], "left")
    return with_tilts(rows, keys)


def purchases(rows: DataFrame, arms: tuple[str, ...], amount: float, keys: tuple[str, ...] = ("win",)) -> DataFrame:
    """Shares bought per key, arm, symbol and buy day: each month's money, split by tilted weights."""
    arm = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(a).alias("t")) for a in arms])).alias("a")
    long = rows.select(*keys, "symbol", "dt", "close", "weight", arm).select("*", "a.*").drop("a")
    raw = F.col("weight") * F.col("t")
    day = Window.partitionBy(*keys, "arm", "dt")
    return long.withColumn("bought", raw / F.sum(raw).over(day) * amount / F.col("close"))


def final_shares(bought: DataFrame, keys: tuple[str, ...] = ("win",)) -> DataFrame:
    """What a plan holds at its end: shares per symbol, and the first and last day that the plan used."""
    held = bought.groupBy(*keys, "arm", "symbol").agg(
        F.sum("bought").alias("shares"), F.min("dt").alias("start_used"), F.max("dt").alias("end_used"))
    plan = Window.partitionBy(*keys, "arm")  # at most one row per symbol
    return held.withColumns({"start_used": F.min("start_used").over(plan), "end_used": F.max("end_used").over(plan)})


def simulate(rows: DataFrame, arms: tuple[str, ...], amount: float, keys: tuple[str, ...] = ("win",)) -> DataFrame:
    """Months per key and arm: invested money, value and time-weighted monthly return."""
    line = Window.partitionBy(*keys, "arm", "symbol").orderBy("dt")
    long = purchases(rows, arms, amount, keys)
    long = long.withColumn("shares", F.sum("bought").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    long = long.withColumn("before", F.coalesce(F.lag("shares").over(line), F.lit(0.0)))
    months = long.groupBy(*keys, "arm", "dt").agg(
        F.sum(F.col("shares") * F.col("close")).alias("value"), F.sum(F.col("before") * F.col("close")).alias("value_before"))
    seq = Window.partitionBy(*keys, "arm").orderBy("dt")
    return months.withColumns({
        "invested": F.row_number().over(seq) * amount,
        "twr": F.col("value_before") / F.lag("value").over(seq) - 1})


def arm_metrics(months: DataFrame, keys: tuple[str, ...] = ("win",)) -> DataFrame:
    """Result per arm, two decimals: growth and risk from time-weighted months, no risk-free rate."""
    seq = Window.partitionBy(*keys, "arm").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    rows = months.withColumn("growth", F.product(F.coalesce("twr", F.lit(0.0)) + 1).over(seq))
    rows = rows.withColumn("dd", F.col("growth") / F.max("growth").over(seq) - 1)
    agg = rows.groupBy(*keys, "arm").agg(
        F.count("*").alias("n_months"), F.max("invested").alias("invested"), F.max_by("value", "dt").alias("final"),
        F.count("twr").alias("n_ret"), F.max_by("growth", "dt").alias("growth"), F.avg("twr").alias("mean"),
        F.stddev_samp("twr").alias("sd"), F.min("dd").alias("dd"))
    has = F.col("n_ret") > 0
    r2 = lambda c: F.round(c, 2)
    return agg.select(
        *keys, "arm", "n_months", r2("invested").alias("total_invested"), r2("final").alias("final_value"),
        r2((F.col("final") / F.col("invested") - 1) * 100).alias("pl_pct"),
        r2(F.when(has & (F.col("growth") > 0), (F.pow("growth", MONTHS / F.col("n_ret")) - 1) * 100)).alias("cagr_pct"),
        r2(F.when(F.col("n_ret") > 1, F.col("sd") * math.sqrt(MONTHS) * 100)).alias("vol_pct"),
        r2(F.when((F.col("n_ret") > 1) & (F.col("sd") > 0), F.col("mean") / F.col("sd") * math.sqrt(MONTHS))).alias("sharpe"),
        r2(F.when(has, F.col("dd") * 100)).alias("max_drawdown_pct"))


def neutral_counts(rows: DataFrame, keys: tuple[str, ...] = ("win",)) -> DataFrame:
    """Months with a neutral tilt per symbol, for want of history."""
    return rows.groupBy(*keys, "symbol").agg(F.count_if(F.col("neutral")).alias("months_neutral"), F.count("*").alias("n_months"))


def verdicts(metrics: DataFrame, arms: tuple[str, ...], keys: tuple[str, ...] = ("win",)) -> DataFrame:
    """Does an arm beat ``plain``: higher (rounded) value and at least its Sharpe ratio.

    ``passes`` is the gate: the arm wins in every test span.
    """
    span = Window.partitionBy(*keys)
    base = lambda c: F.max(F.when(F.col("arm") == "plain", F.col(c))).over(span)
    rows = metrics.withColumns({"v0": base("final_value"), "s0": base("sharpe")}).filter(F.col("arm").isin(*arms))
    rows = rows.withColumns({"by_value": F.col("final_value") > F.col("v0"),
                             "by_sharpe": F.coalesce(F.col("sharpe") >= F.col("s0"), F.lit(False))})
    rows = rows.select(*keys, "arm", "by_value", "by_sharpe", (F.col("by_value") & F.col("by_sharpe")).alias("overall"))
    return rows.withColumn("passes", F.bool_and("overall").over(Window.partitionBy("arm")))


def ab_backtest(panel: DataFrame, mix: DataFrame, benchmark_mix: DataFrame, amount: float) -> tuple[DataFrame, DataFrame]:
    """Arms plain, tilt and benchmark per window, and the verdict on the tilt.

    The benchmark arm has its own buy calendar: only its own symbol must trade.
    """
    arms = simulate(decisions(panel, mix), ("plain", "tilt"), amount)
    alone = buy_rows(panel.select("symbol", "dt", "close"), benchmark_mix, ("win",)).withColumn("benchmark", F.lit(1.0))
    months = arms.unionByName(simulate(alone, ("benchmark",), amount))
    metrics = arm_metrics(months)
    return metrics, verdicts(metrics, ("tilt",))


def edge_lab(panel: DataFrame, mix: DataFrame, amount: float) -> tuple[DataFrame, DataFrame]:
    """All candidate tilts: metrics, and the verdict per span with the gate over all spans."""
    metrics = arm_metrics(simulate(decisions(panel, mix), ("plain", "tilt", *CANDIDATES), amount))
    return metrics, verdicts(metrics, CANDIDATES)
