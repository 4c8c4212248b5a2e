"""Risk and return statistics over long price panels."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import ratio
from tidemark.operators.panel import (by_day, common_history, daily_returns, month_end, period_returns,
                                      resample_last, so_far, underwater, year_end)

TRADING_DAYS = 252
RISK_FREE = 0.02  # one rate for every Sharpe ratio against cash
CORR_BLOCK = 256  # symbols per side of one correlation tile


def risk_table(prices: DataFrame, risk_free: float = RISK_FREE, days: int = TRADING_DAYS) -> DataFrame:
    """Volatility, Sharpe ratio and maximum drawdown per symbol: one window pass, one aggregate."""
    prev = F.lag("close").over(by_day())
    rows = underwater(prices.filter(F.col("close").isNotNull())).withColumn("ret", ratio(F.col("close"), prev) - 1)
    vol = F.stddev_samp("ret") * math.sqrt(days)
    return rows.groupBy("symbol").agg(
        F.count("ret").alias("n_returns"), (F.avg("ret") * days).alias("mean_return"),
        vol.alias("volatility"), F.min("underwater").alias("max_drawdown"),
    ).withColumn("sharpe", ratio(F.col("mean_return") - risk_free, F.col("volatility")))


def correlation_pairs(prices: DataFrame, block: int = CORR_BLOCK) -> DataFrame:
    """Pearson correlation of daily returns for each symbol pair, on the days both have one.

    Symbols are hashed into tiles of about ``block`` symbols, and into so many at least that the tile pairs give
    every shuffle partition work; each tile pair is one group of two blocks of symbols by the days covered,
    and its sums are matrix products. No row is emitted per pair and day.
    """
    rets = daily_returns(prices)
    least = math.ceil(math.sqrt(2 * int(prices.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    n_blocks = rets.select(F.ceil(F.count_distinct("symbol") / block).alias("n")).scalar()
    tiled = rets.withColumn("n_blocks", F.greatest(n_blocks, F.lit(least)).cast("int")).withColumn(
        "tile", F.pmod(F.xxhash64("symbol"), F.col("n_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    keyed = tiled.withColumn("other", other).select(
        F.least("tile", "other").alias("ti"), F.greatest("tile", "other").alias("tj"),
        "tile", "symbol", "dt", "ret")

    def tile_pair(pdf: pd.DataFrame) -> pd.DataFrame:
        ti, tj = int(pdf["ti"].iloc[0]), int(pdf["tj"].iloc[0])
        wide = pdf.pivot(index="dt", columns="symbol", values="ret")
        tile_of = pdf.drop_duplicates("symbol").set_index("symbol")["tile"]
        left = [s for s in wide.columns if tile_of[s] == ti]
        right = [s for s in wide.columns if tile_of[s] == tj]
        x, y = wide[left].to_numpy(float), wide[right].to_numpy(float)
        mx, my = ~np.isnan(x), ~np.isnan(y)
        x, y = np.where(mx, x, 0.0), np.where(my, y, 0.0)
        n = mx.T.astype(float) @ my
        sx, sy = x.T @ my, mx.T @ y
        with np.errstate(divide="ignore", invalid="ignore"):
            cov = x.T @ y - sx * sy / n
            vx, vy = (x * x).T @ my - sx * sx / n, mx.T @ (y * y) - sy * sy / n
            corr = cov / np.sqrt(vx * vy)
        i, j = np.meshgrid(np.array(left, object), np.array(right, object), indexing="ij")
        i, j, n, corr = i.ravel(), j.ravel(), n.ravel(), corr.ravel()
        low, high = np.where(i < j, i, j), np.where(i < j, j, i)
        keep = (low != high) if ti != tj else (i < j)
        out = pd.DataFrame({"symbol_a": low, "symbol_b": high, "n_days": n.astype("int64"), "corr": corr})[keep]
        out["corr"] = out["corr"].where(np.isfinite(out["corr"]) & (out["n_days"] > 1), None)
        return out

    return keyed.groupBy("ti", "tj").applyInPandas(
        tile_pair, "symbol_a string, symbol_b string, n_days bigint, corr double")


def correlation_extremes(pairs: DataFrame) -> DataFrame:
    pair = F.concat_ws("/", "symbol_a", "symbol_b")
    # equal values resolve to the first pair in name order
    first = F.struct(F.col("corr"), pair.alias("pair"))
    low, high = F.min(first), F.min(F.struct((-F.col("corr")).alias("neg"), pair.alias("pair")))
    known = pairs.filter(F.col("corr").isNotNull())
    return known.agg(low.alias("lo"), high.alias("hi")).select(
        F.col("hi.pair").alias("highest_pair"), (-F.col("hi.neg")).alias("highest_corr"),
        F.col("lo.pair").alias("lowest_pair"), F.col("lo.corr").alias("lowest_corr"))


def overlap_pairs(pairs: DataFrame, high: float = 0.85, low: float = 0.30) -> DataFrame:
    return pairs.withColumn("overlap", F.when(F.col("corr") >= high, "high").when(F.col("corr") <= low, "low")
                            ).filter(F.col("overlap").isNotNull())


def monthly_seasonality(prices: DataFrame) -> DataFrame:
    """Return statistics per calendar month; all twelve months, absent ones NULL."""
    months = resample_last(prices, month_end)
    prev = F.lag("close").over(Window.partitionBy("symbol").orderBy("period"))
    rets = months.select("symbol", F.month("period").alias("month"), (F.col("close") / prev - 1).alias("r")
                         ).filter(F.col("r").isNotNull())
    stats = rets.groupBy("symbol", "month").agg(
        (F.median("r") * 100).alias("median_pct"), (F.avg("r") * 100).alias("mean_pct"),
        (F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0)) * 100).alias("positive_rate_pct"),
        F.count("*").alias("n_samples"))
    every = rets.select("symbol").distinct().withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    return every.join(stats, ["symbol", "month"], "left")


def portfolio_mu_sigma(prices: DataFrame, weights: DataFrame, days: int = TRADING_DAYS) -> DataFrame:
    """Yearly mean and deviation per portfolio on days where all its symbols have a return.

    ``usable`` is false where the deviation is missing or not positive.
    """
    rets = daily_returns(prices).withColumnRenamed("ret", "close")
    day = (common_history(rets, weights).groupBy("portfolio_id", "dt")
           .agg(F.sum(F.col("close") * F.col("weight")).alias("r")))
    out = day.groupBy("portfolio_id").agg(
        F.count("*").alias("n_days"), (F.avg("r") * days).alias("mu"),
        (F.stddev_samp("r") * math.sqrt(days)).alias("sigma"))
    return out.withColumn("usable", F.coalesce(F.col("sigma") > 0, F.lit(False)))


def owner_returns(prices: DataFrame, weights: DataFrame, days: int = TRADING_DAYS) -> DataFrame:
    """Yearly mean return per portfolio on days where all its symbols have a return (as ``portfolio_mu_sigma``).

    The mean is linear in the weights, so symbols' means are taken once per distinct set of symbols and day
    rows never fan out to portfolios. Portfolios without any common day are absent.
    """
    mix = weights.filter(F.col("weight") > 0).select("portfolio_id", "symbol", "weight")
    sets = mix.groupBy("portfolio_id").agg(F.array_sort(F.collect_set("symbol")).alias("set"))  # a portfolio's own symbols
    rows = (sets.select("set").distinct().select("set", F.explode("set").alias("symbol"))
            .join(daily_returns(prices).select("symbol", "dt", "ret"), "symbol"))
    common = rows.withColumn("n", F.count("*").over(Window.partitionBy("set", "dt"))).filter(F.col("n") == F.size("set"))
    means = common.groupBy("set", "symbol").agg(F.avg("ret").alias("mean"))
    return (mix.join(sets, "portfolio_id").join(means, ["set", "symbol"]).groupBy("portfolio_id")
            .agg((F.sum(F.col("weight") * F.col("mean")) / F.sum("weight") * days).alias("mu")))


def annual_return_stats(prices: DataFrame) -> DataFrame:
    """Mean and sample deviation of year-end to year-end returns, and the mean of the last three."""
    years = resample_last(prices, year_end)
    w = Window.partitionBy("symbol").orderBy("period")
    rets = years.withColumn("r", F.col("close") / F.lag("close").over(w) - 1).filter(F.col("r").isNotNull())
    rets = rets.withColumn("back", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("period"))))
    return rets.groupBy("symbol").agg(
        F.count("*").alias("n_years"), F.avg("r").alias("avg_return"), F.stddev_samp("r").alias("return_std"),
        F.avg(F.when(F.col("back") <= 3, F.col("r"))).alias("last3_return"))


def basket_summary(panel: DataFrame) -> DataFrame:
    """Equal-start basket return since the first day every symbol has a (carried) price,
    and the best and worst symbols by one-year return."""
    first_all = (panel.filter(F.col("close").isNotNull()).groupBy("symbol").agg(F.min("dt").alias("f"))
                 .agg(F.max("f").alias("f")).scalar())
    ends = panel.filter(F.col("close").isNotNull()).withColumn("base_dt", first_all).groupBy("symbol").agg(
        F.max_by("close", "dt").alias("latest"),
        F.max_by("close", F.when(F.col("dt") <= F.col("base_dt"), F.col("dt"))).alias("base"))
    year = period_returns(panel).filter((F.col("period") == "1Y") & F.col("ret_pct").isNotNull())
    best = F.min(F.struct((-F.col("ret_pct")).alias("neg"), "symbol"))
    worst = F.min(F.struct(F.col("ret_pct"), F.col("symbol")))
    extremes = year.agg(best.alias("b"), worst.alias("w"))
    total = ends.agg(((F.avg(F.col("latest") / F.col("base")) - 1) * 100).alias("basket_return_pct"))
    # both sides are single-row aggregates
    return total.join(extremes).select(
        "basket_return_pct", F.col("b.symbol").alias("best_symbol"), (-F.col("b.neg")).alias("best_pct"),
        F.col("w.symbol").alias("worst_symbol"), F.col("w.ret_pct").alias("worst_pct"))


def drawdown_episodes(curves: DataFrame, min_depth: float = 0.10, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Runs below the running high, at least ``min_depth`` deep: peak, trough and recovery days.

    The peak is the row just before a run, the recovery the row just after (NULL while open).
    """
    w = Window.partitionBy(*keys).orderBy("dt")
    rows = underwater(curves.filter(F.col("close").isNotNull()), *keys).withColumns({
        "below": F.col("underwater") < 0, "prev_dt": F.lag("dt").over(w), "next_dt": F.lead("dt").over(w)})
    rows = rows.withColumn("run", F.sum(F.when(
        F.col("below") & ~F.coalesce(F.lag("below").over(w), F.lit(False)), 1).otherwise(0)).over(so_far(*keys)))
    runs = rows.filter("below").groupBy(*keys, "run").agg(
        F.min("underwater").alias("depth"), F.coalesce(F.min_by("prev_dt", "dt"), F.min("dt")).alias("peak_date"),
        F.min_by("dt", F.struct("underwater", "dt")).alias("trough_date"),
        F.max_by("next_dt", "dt").alias("recovery_date")).filter(F.col("depth") <= -abs(min_depth))
    months = lambda d: F.date_diff(d, "peak_date") / 30.44
    return runs.select(
        *keys, "peak_date", "trough_date", "recovery_date", (F.col("depth") * 100).alias("depth_pct"),
        months("trough_date").alias("months_to_trough"), months("recovery_date").alias("months_to_recover"))


def recovery_stats(episodes: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Recovered episodes: how many, median months from peak, deepest one recovered.

    Months and depths are taken at one decimal, as the episodes are shown.
    """
    done = F.col("recovery_date").isNotNull()
    return episodes.groupBy(*keys).agg(
        F.count_if(done).alias("n_recovered"), F.count_if(~done).alias("n_open"),
        F.median(F.round("months_to_recover", 1)).alias("median_months"),
        F.min(F.when(done, F.round("depth_pct", 1))).alias("deepest_recovered_pct"))


def trend_channel(prices: DataFrame, min_points: int = 504) -> DataFrame:
    """Log-linear trend per symbol: growth, residual deviation and how far the last close is off.

    Symbols with too few rows, a price that is not positive, or no residual spread come back
    with ``error`` set and NULL numbers.
    """
    w = by_day()
    rows = prices.filter(F.col("close").isNotNull()).select(
        "symbol", "dt", "close", (F.row_number().over(w) - 1).cast("double").alias("x"),
        F.when(F.col("close") > 0, F.ln("close")).alias("y"))
    fit = rows.groupBy("symbol").agg(
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
        F.count("*").alias("n_rows"), F.count_if(F.col("close") <= 0).alias("n_bad"), F.max("x").alias("last_x"))
    resid = rows.join(fit, "symbol").withColumn(
        "resid", F.col("y") - (F.col("slope") * F.col("x") + F.col("intercept")))
    out = resid.groupBy("symbol").agg(
        F.first("slope").alias("slope"), F.first("n_rows").alias("n_rows"), F.first("n_bad").alias("n_bad"),
        F.stddev_samp("resid").alias("sigma"), F.max_by("resid", "x").alias("last_resid"),
        F.max(F.when(F.col("x") == F.col("last_x"), F.exp(F.col("slope") * F.col("x") + F.col("intercept")))).alias("trend"))
    error = (F.when(F.col("n_rows") < min_points, "short_history").when(F.col("n_bad") > 0, "non_positive_price")
             .when(~F.coalesce(F.col("sigma") > 0, F.lit(False)), "no_spread"))
    ok = lambda c: F.when(error.isNull(), c)
    return out.select(
        "symbol", "n_rows", error.alias("error"), ok(F.col("sigma")).alias("sigma_log"),
        ok(F.col("last_resid") / F.col("sigma")).alias("current_sigma"),
        ok((F.exp(F.col("slope") * TRADING_DAYS) - 1) * 100).alias("annual_growth_pct"), ok(F.col("trend")).alias("trend"),
        ok(F.col("trend") * F.exp(F.col("sigma"))).alias("upper_1"), ok(F.col("trend") * F.exp(-F.col("sigma"))).alias("lower_1"),
        ok(F.col("trend") * F.exp(2 * F.col("sigma"))).alias("upper_2"), ok(F.col("trend") * F.exp(-2 * F.col("sigma"))).alias("lower_2"))


def uptrend_runs(feats: DataFrame) -> DataFrame:
    """Start and end of each unbroken run of days with the close at or above its 200-day average."""
    w = by_day()
    rows = feats.filter(F.col("ma200").isNotNull()).select("symbol", "dt", (F.col("close") >= F.col("ma200")).alias("up"))
    rows = rows.withColumn("run", F.sum(F.when(
        F.col("up") & ~F.coalesce(F.lag("up").over(w), F.lit(False)), 1).otherwise(0)).over(so_far()))
    return rows.filter("up").groupBy("symbol", "run").agg(
        F.min("dt").alias("start_dt"), F.max("dt").alias("end_dt"), F.count("*").alias("n_days"))
