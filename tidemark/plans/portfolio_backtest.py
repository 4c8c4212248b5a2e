"""Fixed-weight backtests: daily rebalanced curves, comparison with a benchmark, monthly buying."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.panel import common_history, forward_fill, month_start, resample_first
from tidemark.operators.risk import RISK_FREE, TRADING_DAYS, drawdown_episodes, recovery_stats, underwater

KEYS = ("portfolio_id",)


def value_curve(returns: DataFrame, capital: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Running product of one plus the return, times the starting capital.

    ``log_growth`` is its logarithm without the capital; it stays finite where the product leaves the range of doubles.
    """
    w = Window.partitionBy(*keys).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    grown = F.col("ret") + 1
    return returns.withColumns({"value": F.product(grown).over(w) * capital, "log_growth": F.sum(F.log(grown)).over(w)})


def portfolio_curve(panel: DataFrame, weights: DataFrame, capital: float = 10000.0, start=None) -> DataFrame:
    """Daily rebalanced portfolio from the first day on which every weighted symbol has a price.

    Steps are taken per symbol before the fan-out to portfolios; a portfolio's first day has none.
    """
    filled = forward_fill(panel)
    if start is not None:
        filled = filled.filter(F.col("dt") >= F.lit(start).cast("date"))
    step = F.col("close") / F.lag("close").over(Window.partitionBy("symbol").orderBy("dt")) - 1
    rows = common_history(filled.withColumn("r", step), weights, keep=("r",), least_days=2)
    first = F.min("dt").over(Window.partitionBy("portfolio_id"))
    daily = rows.groupBy("portfolio_id", "dt").agg(F.sum(F.col("r") * F.col("weight")).alias("ret"))
    ret = F.when(F.col("dt") == first, 0.0).otherwise(F.coalesce("ret", F.lit(0.0)))
    return value_curve(daily.withColumn("ret", ret), capital)


def curve_metrics(curves: DataFrame, log_growth: str = "log_growth", ret: str = "ret", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Total and yearly return with their logarithms, maximum drawdown and Sharpe ratio; the first zero return counts."""
    w = Window.partitionBy(*keys).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    rows = curves.withColumn("_uw", F.exp(F.col(log_growth) - F.max(log_growth).over(w)) - 1)
    agg = rows.groupBy(*keys).agg(
        (F.max_by(log_growth, "dt") - F.min_by(log_growth, "dt")).alias("log_growth"),
        F.greatest(F.date_diff(F.max("dt"), F.min("dt")), F.lit(1)).alias("days"), F.min("_uw").alias("dd"),
        F.avg(ret).alias("mean"), (F.stddev_samp(ret) * math.sqrt(TRADING_DAYS)).alias("vol"))
    return agg.select(
        *keys, "log_growth", (F.col("log_growth") * 365.25 / F.col("days")).alias("annual_log_growth"),
        ((F.exp("log_growth") - 1) * 100).alias("total_return_pct"),
        ((F.exp(F.col("log_growth") * 365.25 / F.col("days")) - 1) * 100).alias("annual_return_pct"),
        (F.col("dd") * 100).alias("max_drawdown_pct"),
        F.when(F.col("vol") > 0, (F.col("mean") * TRADING_DAYS - RISK_FREE) / F.col("vol")).otherwise(0.0).alias("sharpe"))


def curve_against_benchmark(panel: DataFrame, weights: DataFrame, benchmark: DataFrame, capital: float, start) -> DataFrame:
    """Portfolio and benchmark values on the days both have one."""
    mine = portfolio_curve(panel, weights, capital, start)
    alone = benchmark.filter(F.col("dt") >= F.lit(start).cast("date")).withColumn("one", F.lit(1))
    w = Window.partitionBy("one").orderBy("dt")
    rets = alone.withColumn("ret", F.coalesce(F.col("close") / F.lag("close").over(w) - 1, F.lit(0.0)))
    other = value_curve(rets, capital, ("one",)).select(
        "dt", F.col("value").alias("benchmark_value"), F.col("ret").alias("benchmark_ret"), F.col("log_growth").alias("benchmark_log_growth"))
    return mine.join(other, "dt")


def backtest_metrics(panel: DataFrame, weights: DataFrame, benchmark: DataFrame, capital: float, start) -> DataFrame:
    both = curve_against_benchmark(panel, weights, benchmark, capital, start)
    side = F.explode(F.array(
        F.struct(F.lit("portfolio").alias("curve"), F.col("log_growth").alias("v"), F.col("ret").alias("r")),
        F.struct(F.lit("benchmark").alias("curve"), F.col("benchmark_log_growth").alias("v"), F.col("benchmark_ret").alias("r"))))
    rows = both.select("portfolio_id", "dt", side.alias("s")).select("portfolio_id", "dt", "s.curve", F.col("s.v").alias("log_growth"), F.col("s.r").alias("ret"))
    return curve_metrics(rows, keys=("portfolio_id", "curve"))


def checked_weights(weights: DataFrame) -> DataFrame:
    """Weights normalised per portfolio; a negative one is an error here, not a dropped row."""
    weight = F.when(F.col("weight") < 0, F.raise_error(F.lit("weights must not be negative"))).otherwise(F.col("weight"))
    pf = Window.partitionBy("portfolio_id")
    return weights.withColumn("weight", weight).withColumn("weight", F.col("weight") / F.sum("weight").over(pf))


def monthly_buying(panel: DataFrame, weights: DataFrame, amount: float, start=None) -> DataFrame:
    """Fixed-weight monthly purchases at the month's first value; months with a gap are left out."""
    filled = forward_fill(panel if start is None else panel.filter(F.col("dt") >= F.lit(start).cast("date")))
    months = resample_first(filled, month_start)
    mix = checked_weights(weights)
    pf = Window.partitionBy("portfolio_id")
    rows = months.join(mix.withColumn("n_symbols", F.count("*").over(pf)), "symbol")
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("portfolio_id", "period"))).filter(F.col("n") == F.col("n_symbols"))
    held = Window.partitionBy("portfolio_id", "symbol").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("shares", F.sum(F.col("weight") * amount / F.col("close")).over(held))
    out = rows.groupBy("portfolio_id", "period").agg(F.sum(F.col("shares") * F.col("close")).alias("value"))
    n = F.row_number().over(Window.partitionBy("portfolio_id").orderBy("period"))
    out = out.withColumn("invested", n * amount)
    return out.withColumns({"profit": F.col("value") - F.col("invested"),
                            "profit_pct": (F.col("value") - F.col("invested")) / F.col("invested") * 100})


def stress_context(panel: DataFrame, held: DataFrame, min_depth: float = 0.10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Value of today's shares through history: curve with drawdown, episodes, recovery statistics.

    ``held(portfolio_id, symbol, shares)``, priced holdings only.
    """
    mix = held.filter(F.col("shares") > 0).withColumnRenamed("shares", "weight")
    w = Window.partitionBy("portfolio_id")
    total = mix.withColumn("size", F.sum("weight").over(w)).select("portfolio_id", "size").distinct()
    rows = common_history(panel, mix).groupBy("portfolio_id", "dt").agg(F.sum(F.col("close") * F.col("weight")).alias("unit"))
    curve = rows.join(total, "portfolio_id").select("portfolio_id", "dt", (F.col("unit") * F.col("size")).alias("close"))
    episodes = drawdown_episodes(curve, min_depth, KEYS)
    return underwater(curve, *KEYS), episodes, recovery_stats(episodes, KEYS)
