"""Technical indicators: one wide feature table, computed once per symbol and day.

Every column depends on earlier rows only, so the value on a row equals the value computed
from the history up to that row. Columns a job does not use are pruned from the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import signals as sig
from tidemark.functions.numeric import ratio
from tidemark.operators.ewma import Ewma, span, with_ewma
from tidemark.operators.panel import resample_last, week_friday


def _rows(n: int, keys: tuple[str, ...]):
    # ordered by day like every other window of the table, so that one sort serves them all
    return Window.partitionBy(*keys).orderBy("dt").rowsBetween(-(n - 1), 0)


def full(col: Column, n: int, keys: tuple[str, ...] = ("symbol",), how=F.avg) -> Column:
    """Rolling aggregate that is NULL until ``n`` values are in the window."""
    w = _rows(n, keys)
    return F.when(F.count(col).over(w) == n, how(col).over(w))


def full_close(n: int, keys: tuple[str, ...] = ("symbol",), how=F.avg) -> Column:
    """As ``full`` for the close of numbered rows, which is never missing: the row number decides."""
    return F.when(F.col("rn") >= n - 1, how("close").over(_rows(n, keys)))


def sma(n: int, keys: tuple[str, ...] = ("symbol",)) -> Column:
    return full_close(n, keys)


def number_rows(prices: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Add ``rn`` (from 0), ``n_rows``, ``prev`` and ``ret`` per key; missing closes are dropped first."""
    w = Window.partitionBy(*keys).orderBy("dt")
    numbered = prices.filter(F.col("close").isNotNull()).withColumns({
        "rn": F.row_number().over(w) - 1, "prev": F.lag("close").over(w)})
    return numbered.withColumns({
        "n_rows": F.count("*").over(Window.partitionBy(*keys)),
        "ret": ratio(F.col("close"), F.col("prev")) - 1})


def rsi_from(gain: Column, loss: Column) -> Column:
    """100 when there was no loss at all; NULL while either average is warming up."""
    return F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / loss))


def with_rsi(numbered: DataFrame, periods: dict[str, int] | None = None,
             keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Wilder RSI columns ``{name: period}``, seeded on the second price of each key."""
    periods = periods or {"rsi": 14}
    move = F.col("close") - F.col("prev")
    specs = []
    for name, n in periods.items():
        specs += [Ewma(f"_g_{name}", F.greatest(move, F.lit(0.0)), 1.0 / n, 1, n),
                  Ewma(f"_s_{name}", F.greatest(-move, F.lit(0.0)), 1.0 / n, 1, n)]
    smoothed = with_ewma(numbered, *specs, keys=keys)
    out = smoothed.withColumns({n: rsi_from(F.col(f"_g_{n}"), F.col(f"_s_{n}")) for n in periods})
    return out.drop(*[s.name for s in specs])


def with_macd(numbered: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9,
              keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """MACD line, signal and histogram; the signal starts at the line's first value."""
    close = F.col("close")
    df = with_ewma(numbered, Ewma("_fast", close, span(fast), 0, fast), Ewma("_slow", close, span(slow), 0, slow),
                   keys=keys)
    df = df.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    df = with_ewma(df, Ewma("macd_signal", F.col("macd"), span(signal), max(fast, slow) - 1, signal), keys=keys)
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def with_bands(numbered: DataFrame, n: int = 20, width: float = 2.0,
               keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Bollinger bands with the population deviation, plus the relative band width."""
    df = numbered.withColumns({"bb_middle": sma(n, keys), "_dev": full_close(n, keys, F.stddev_pop)})
    df = df.withColumns({"bb_upper": F.col("bb_middle") + F.col("_dev") * width,
                         "bb_lower": F.col("bb_middle") - F.col("_dev") * width}).drop("_dev")
    return df.withColumn("bandwidth", ratio(F.col("bb_upper") - F.col("bb_lower"), F.col("bb_middle")))


def features(bars: DataFrame) -> DataFrame:
    """The wide feature row per symbol and day used by signals, scores, screens and backtests."""
    # rolling windows first, while rows lie in day order; the averages then sort once by block
    df = with_bands(number_rows(bars)).withColumns({
        "ma50": sma(50), "ma200": sma(200),
        "mom_1m": F.sum("ret").over(_rows(21, ("symbol",))) * 100,
        "mom_3m": F.sum("ret").over(_rows(63, ("symbol",))) * 100,
        "support": F.min("close").over(_rows(60, ("symbol",))),
        "resistance": F.max("close").over(_rows(60, ("symbol",))),
        "peak": F.max("close").over(Window.partitionBy("symbol").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)),
    })
    if "volume" in bars.columns:
        df = df.withColumn("volume_ma20", full(F.col("volume"), 20))
    df = with_macd(with_rsi(df))
    return df.withColumn("signal", sig.dca_signal(F.col("close"), F.col("ma50"), F.col("ma200"), F.col("rsi")))


def last_row(feats: DataFrame) -> DataFrame:
    """The newest row of each symbol (a filter, no further shuffle)."""
    return feats.filter(F.col("rn") == F.col("n_rows") - 1)


def cross_up(fast: Column, slow: Column, w, mode: str) -> Column:
    """True where ``fast`` moves above ``slow``; three rules exist and differ on ties.

    ``flip``: the state fast > slow was false on the row before. ``strict``: below, then above.
    ``touch``: at or below, then above. Rows with a missing average are never a cross.
    """
    pf, ps = F.lag(fast).over(w), F.lag(slow).over(w)
    before = {"flip": ~(pf > ps), "strict": pf < ps, "touch": pf <= ps}[mode]
    return F.coalesce(before & (fast > slow), F.lit(False))


def cross_down(fast: Column, slow: Column, w, mode: str) -> Column:
    pf, ps = F.lag(fast).over(w), F.lag(slow).over(w)
    before = {"flip": pf > ps, "strict": pf > ps, "touch": pf >= ps}[mode]
    now = ~(fast > slow) if mode == "flip" else fast < slow
    return F.coalesce(before & now, F.lit(False))


def within(flag: Column, n: int, keys: tuple[str, ...] = ("symbol",)) -> Column:
    """True when the flag was true on any of the last ``n`` rows."""
    return F.max(flag).over(_rows(n, keys))


def ma_cross_dates(feats: DataFrame, fast: str = "ma50", slow: str = "ma200") -> DataFrame:
    """All dates on which the fast average changes side; warm-up rows never count."""
    w = Window.partitionBy("symbol").orderBy("dt")
    known = feats.filter(F.col(fast).isNotNull() & F.col(slow).isNotNull())
    kinds = known.select(
        "symbol", "dt",
        F.when(cross_up(F.col(fast), F.col(slow), w, "flip"), "golden")
        .when(cross_down(F.col(fast), F.col(slow), w, "flip"), "death").alias("cross"))
    return kinds.filter(F.col("cross").isNotNull())


def cross_flags(feats: DataFrame, n: int, mode: str) -> DataFrame:
    """Last row per symbol with ``golden``/``death``: a 50/200 cross within the last ``n`` rows."""
    w = Window.partitionBy("symbol").orderBy("dt")
    f, s = F.col("ma50"), F.col("ma200")
    df = feats.withColumns({"_up": cross_up(f, s, w, mode), "_down": cross_down(f, s, w, mode)})
    df = df.withColumns({"golden": within(F.col("_up"), n), "death": within(F.col("_down"), n)})
    return last_row(df).drop("_up", "_down")


def snapshot(bars: DataFrame) -> DataFrame:
    """Newest indicator row per symbol with labels; ``data_ok`` needs 200 rows."""
    df = cross_flags(features(bars), 5, "touch")
    return df.withColumns({
        "label": sig.technical_label(F.col("signal")),
        "overall": sig.overall_signal(F.col("signal"), F.col("golden"), F.col("death"), F.col("rsi")),
        "data_ok": (F.col("n_rows") >= 200) & (F.col("signal") != "no_data")})


def weekly_signal(prices: DataFrame) -> DataFrame:
    """The DCA signal on Friday weeks with 10/40-week averages; under 41 weeks it is ``no_data``."""
    weeks = number_rows(resample_last(prices, week_friday).drop("dt").withColumnRenamed("period", "dt"))
    df = last_row(with_rsi(weeks).withColumns({"ma10": sma(10), "ma40": sma(40)}))
    enough = F.col("n_rows") >= 41
    keep = lambda c: F.when(enough, F.col(c))
    return df.select(
        "symbol", F.col("n_rows").alias("weeks"), keep("close").alias("price"), keep("ma10").alias("ma10w"),
        keep("ma40").alias("ma40w"), keep("rsi").alias("rsi14w"),
        F.when(enough, sig.dca_signal(F.col("close"), F.col("ma10"), F.col("ma40"), F.col("rsi")))
        .otherwise("no_data").alias("signal"))
