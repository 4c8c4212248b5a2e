"""Signal strategy on single symbols: entries and exits, equity, parameter search, walk-forward."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import ratio
from tidemark.operators import indicators as ind

CASH, FEE, YEAR = 10_000.0, 0.001, 365
RSI_PERIODS, OVERSOLD = (7, 10, 14, 21), (25.0, 30.0, 35.0)
OVERBOUGHT = 70.0


def entry_exit(rows: DataFrame, keys: tuple[str, ...], rsi: Column, oversold: Column, overbought: float = OVERBOUGHT) -> DataFrame:
    """Add ``entry``, ``exit`` and ``strategy``.

    Entry: an oversold reading and an upward MACD cross, both within three bars; exit mirrored.
    A key without any such entry falls back to the RSI alone, and says so.
    """
    w = Window.partitionBy(*keys).orderBy("rn")
    pm, ps = F.lag("macd").over(w), F.lag("macd_signal").over(w)
    no = F.lit(False)
    rows = rows.withColumns({
        "_low": F.coalesce(rsi < oversold, no), "_high": F.coalesce(rsi > overbought, no),
        "_up": F.coalesce((pm < ps) & (F.col("macd") >= F.col("macd_signal")), no),
        "_down": F.coalesce((pm > ps) & (F.col("macd") <= F.col("macd_signal")), no)})
    near = lambda c: (F.col("rn") >= 2) & ind.within(F.col(c), 3, keys)
    rows = rows.withColumns({"_e": near("_low") & near("_up"), "_x": near("_high") & near("_down")})
    both = F.max("_e").over(Window.partitionBy(*keys))
    return rows.withColumn("_both", both).withColumns({
        "entry": F.when(F.col("_both"), F.col("_e")).otherwise(F.col("_low")),
        "exit": F.when(F.col("_both"), F.col("_x")).otherwise(F.col("_high")),
        "strategy": F.when(F.col("_both"), "rsi_macd_3day_window").otherwise("rsi_only_fallback"),
    }).drop("_low", "_high", "_up", "_down", "_e", "_x", "_both")


def equity(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Long-only equity: orders fill at the signal bar's close, all in or all out, fee on each order.

    A bar with both signals changes nothing. ``trade`` numbers the held spells.
    """
    w = Window.partitionBy(*keys).orderBy("rn")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    order = F.when(F.col("entry") & ~F.col("exit"), 1).when(F.col("exit") & ~F.col("entry"), 0)
    rows = rows.withColumn("pos", F.coalesce(F.last(order, ignorenulls=True).over(run), F.lit(0)))
    rows = rows.withColumn("was", F.coalesce(F.lag("pos").over(w), F.lit(0)))
    bought, sold = (F.col("was") == 0) & (F.col("pos") == 1), (F.col("was") == 1) & (F.col("pos") == 0)
    factor = (F.when(F.col("was") == 1, 1 + F.col("ret")).otherwise(1.0)
              * F.when(bought, 1 / (1 + FEE)).when(sold, 1 - FEE).otherwise(1.0))
    rows = rows.withColumns({"factor": factor, "trade": F.sum(F.when(bought, 1).otherwise(0)).over(run),
                             "bought": bought, "sold": sold})
    rows = rows.withColumn("equity", F.product("factor").over(run) * CASH)
    return rows.withColumn("dd", F.col("equity") / F.max("equity").over(run) - 1)


def sharpe_of() -> Column:
    step = F.col("factor") - 1
    return F.coalesce(ratio(F.avg(step), F.stddev_samp(step)) * math.sqrt(YEAR), F.lit(0.0))


def results(curves: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Return, Sharpe ratio, drawdown, win rate and trades per key; no trades give zeros."""
    spells = curves.filter((F.col("trade") > 0) & ((F.col("pos") == 1) | F.col("sold"))).groupBy(*keys, "trade").agg(
        F.min_by("close", "rn").alias("p_in"), F.max_by("close", "rn").alias("p_out"), F.max("sold").alias("closed"))
    won = F.col("p_out") * F.when(F.col("closed"), 1 - FEE).otherwise(1.0) > F.col("p_in") * (1 + FEE)
    wins = spells.groupBy(*keys).agg((F.count_if(won) / F.count("*") * 100).alias("win_rate"))
    total = curves.groupBy(*keys).agg(
        F.first("strategy").alias("strategy"), F.max("trade").alias("num_trades"),
        ((F.max_by("equity", "rn") / CASH - 1) * 100).alias("total"), sharpe_of().alias("sr"), (F.min("dd") * 100).alias("dd"),
        ((F.max_by("close", "rn") / F.min_by("close", "rn") - 1) * 100).alias("benchmark_return"))
    some = lambda c: F.when(F.col("num_trades") > 0, F.col(c)).otherwise(0.0)
    out = total.join(wins, list(keys), "left").select(
        *keys, "strategy", "num_trades", some("total").alias("total_return"), some("sr").alias("sharpe_ratio"),
        some("dd").alias("max_drawdown"), F.coalesce("win_rate", F.lit(0.0)).alias("win_rate"), "benchmark_return")
    return out.withColumn("outperformed", F.col("total_return") > F.col("benchmark_return"))


def signals(prices: DataFrame) -> DataFrame:
    rows = ind.with_macd(ind.with_rsi(ind.number_rows(prices)))
    return entry_exit(rows, ("symbol",), F.col("rsi"), F.lit(30.0))


def run(prices: DataFrame) -> DataFrame:
    return results(equity(signals(prices), ("symbol",)), ("symbol",))


def search(prices: DataFrame, train_share: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Best RSI settings per symbol on the first 70 % of rows, judged on the rest.

    Indicators are recomputed inside each part, so no warm-up crosses the split. Symbols with
    fewer than 60 training or 30 test rows are left out. Returns (grid, best); both name the first and
    last day that each part covers.
    """
    keyed = ind.number_rows(prices).withColumn("split", F.floor(F.col("n_rows") * train_share))
    keyed = keyed.filter((F.col("split") >= 60) & (F.col("n_rows") - F.col("split") >= 30))
    keyed = keyed.select("symbol", "dt", "close", F.when(F.col("rn") < F.col("split"), "train").otherwise("test").alias("part"))
    keys = ("symbol", "part")
    rows = ind.with_macd(ind.with_rsi(ind.number_rows(keyed, keys), {f"rsi{p}": p for p in RSI_PERIODS}, keys), keys=keys)
    grid = F.explode(F.array(*[
        F.struct(F.lit(i * len(OVERSOLD) + j).alias("no"), F.lit(p).alias("rsi_period"), F.lit(o).alias("rsi_oversold"), F.col(f"rsi{p}").alias("rsi"))
        for i, p in enumerate(RSI_PERIODS) for j, o in enumerate(OVERSOLD)])).alias("g")
    rows = rows.select("symbol", "part", "dt", "rn", "close", "ret", "macd", "macd_signal", grid).select("*", "g.*").drop("g")
    full = (*keys, "no")
    curves = equity(entry_exit(rows, full, F.col("rsi"), F.col("rsi_oversold")), full)
    score = curves.groupBy(*keys, "no", "rsi_period", "rsi_oversold").agg(
        F.when(F.max("trade") > 0, sharpe_of()).otherwise(0.0).alias("sharpe"), F.min("dt").alias("first_day"), F.max("dt").alias("last_day"))
    # one row per symbol: both parts of a setting side by side, then the setting best in training
    sides = lambda part: F.max(F.when(F.col("part") == part, F.struct("sharpe", "first_day", "last_day"))).alias(part)
    setting = score.groupBy("symbol", "no", "rsi_period", "rsi_oversold").agg(sides("train"), sides("test"))
    best = setting.groupBy("symbol").agg(F.min_by(F.struct("rsi_period", "rsi_oversold", "train", "test"), F.struct(-F.col("train.sharpe"), "no")).alias("b"))
    out = best.select(
        "symbol", "b.rsi_period", "b.rsi_oversold", F.greatest(F.col("b.train.sharpe"), F.lit(0.0)).alias("train_sharpe"), F.col("b.test.sharpe").alias("test_sharpe"),
        *[F.col(f"b.{p}.{d}_day").alias(f"{p}_{e}") for p in ("train", "test") for d, e in (("first", "start"), ("last", "end"))])
    return score.filter(F.col("part") == "train"), out


def forecast_rows(bars: DataFrame) -> DataFrame:
    """Rows usable for forecasting (RSI and volume average known) with an expanding log-linear fit."""
    df = ind.features(bars).filter(F.col("rsi").isNotNull() & F.col("volume_ma20").isNotNull())
    w = Window.partitionBy("symbol").orderBy("dt")
    x = F.date_diff("dt", F.first("dt").over(w)).cast("double")
    df = df.select("symbol", "dt", "close", x.alias("x"), F.ln("close").alias("y"), F.row_number().over(w).alias("n_train"))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"slope": F.regr_slope("y", "x").over(so_far), "icept": F.regr_intercept("y", "x").over(so_far)})


def folds(rows: DataFrame, window_months: int = 6, test_days: int = 30) -> DataFrame:
    """Monthly folds per symbol: train before ``train_end``, test the following ``test_days`` days.

    Starts step month by month from the first day, each from the one before (short months clip).
    """
    span = rows.groupBy("symbol").agg(F.min("dt").alias("d0"), F.max("dt").alias("d1"))
    n = F.greatest(F.ceil(F.months_between("d1", "d0")), F.lit(1)).cast("int")
    starts = F.aggregate(F.sequence(F.lit(1), n), F.array("d0"),
                         lambda acc, _i: F.concat(acc, F.array(F.add_months(F.element_at(acc, -1), 1))))
    out = span.select("symbol", "d1", F.posexplode(starts).alias("fold", "begin"))
    out = out.withColumn("train_end", F.add_months("begin", window_months)).withColumn("test_end", F.date_add("train_end", test_days))
    return out.filter(F.col("test_end") <= F.col("d1")).drop("d1", "begin")


def walk_forward(bars: DataFrame, min_train: int = 50, min_test: int = 5) -> DataFrame:
    """Mean MAE, RMSE and MAPE over folds for two plain forecasters: last value and log-linear trend."""
    from tidemark.operators.asof import asof_lookup

    rows = forecast_rows(bars)
    plan = folds(rows)
    model = asof_lookup(plan, rows, "train_end", "dt", ["close", "x", "slope", "icept", "n_train"], by=["symbol"], strict=True)
    fitted = plan.join(model.select("symbol", "train_end", F.col("close").alias("last"), "slope", "icept", "n_train"), ["symbol", "train_end"])
    # a test span touches at most two calendar months; they are the equi-join key
    months = F.explode(F.array_distinct(F.array(F.trunc("train_end", "month"), F.trunc(F.date_sub("test_end", 1), "month")))).alias("month")
    spans = fitted.filter(F.col("n_train") >= min_train).select("*", months)
    test = spans.join(rows.select("symbol", "dt", F.col("close").alias("actual"), "x", F.trunc("dt", "month").alias("month")), ["symbol", "month"])
    test = test.filter((F.col("dt") >= F.col("train_end")) & (F.col("dt") < F.col("test_end")))
    made = F.explode(F.array(
        F.struct(F.lit("last_value").alias("model"), F.col("last").alias("yhat")),
        F.struct(F.lit("log_trend").alias("model"), F.exp(F.col("icept") + F.col("slope") * F.col("x")).alias("yhat")))).alias("m")
    test = test.select("symbol", "fold", "actual", made).select("symbol", "fold", "actual", "m.*").withColumn("err", F.col("actual") - F.col("yhat"))
    per = test.groupBy("symbol", "model", "fold").agg(
        F.count("*").alias("n"), F.avg(F.abs("err")).alias("mae"), F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rmse"),
        (F.avg(F.abs(F.col("err") / F.col("actual"))) * 100).alias("mape")).filter(F.col("n") >= min_test)
    return per.groupBy("symbol", "model").agg(F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"), F.avg("mape").alias("mape"), F.count("*").alias("n_folds"))


def forecast_trend(bars: DataFrame, days: int = 30) -> DataFrame:
    """Log-linear forecast ``days`` ahead and its direction against the last price (one percent band)."""
    last = forecast_rows(bars).groupBy("symbol").agg(F.max_by(F.struct("close", "x", "slope", "icept"), "dt").alias("m")).select("symbol", "m.*")
    rows = last.withColumn("forecast", F.exp(F.col("icept") + F.col("slope") * (F.col("x") + days)))
    pct = (F.col("forecast") / F.col("close") - 1) * 100
    return rows.withColumn("change_pct", pct).withColumn(
        "trend", F.when(F.col("change_pct") > 1, "up").when(F.col("change_pct") < -1, "down").otherwise("sideways"))
