"""Price panels in long form: cleaning, calendar alignment, resampling and returns.

A panel has one row per symbol and day, so a window over one symbol never holds more rows than
the calendar has days, however many raw trades the symbol had.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import number_or_null, ratio

# Period name and row offset on the shared calendar.
RETURN_WINDOWS = {"1M": 21, "3M": 63, "6M": 126, "1Y": 252, "3Y": 756, "5Y": 1260, "10Y": 2520}


class PriceDataUnavailable(ValueError):
    """Raised when a requested panel has no usable row."""


def by_day(*keys: str):
    return Window.partitionBy(*(keys or ("symbol",))).orderBy("dt")


def so_far(*keys: str):
    return by_day(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def clean_closes(prices: DataFrame) -> DataFrame:
    """Numeric closes only; text that is no number, NaN and NULL rows are dropped."""
    return (prices.withColumn("close", number_or_null(F.col("close")))
            .filter(F.col("close").isNotNull()))


def clean_bars(bars: DataFrame) -> DataFrame:
    """Rows whose four prices are all missing are dropped, other gaps stay NULL."""
    fields = ["open", "high", "low", "close"]
    typed = bars.withColumns({c: number_or_null(F.col(c)) for c in [*fields, "volume"]})
    return typed.dropna(how="all", subset=fields)


def price_panel(prices: DataFrame, symbols: list[str], since=None) -> DataFrame:
    """Chosen symbols since a date; raises when nothing is left."""
    panel = clean_closes(prices.filter(F.col("symbol").isin(symbols)))
    if since is not None:
        panel = panel.filter(F.col("dt") >= F.lit(since))
    if panel.isEmpty():
        raise PriceDataUnavailable(f"no prices for {', '.join(symbols)}")
    return panel


def calendar(panel: DataFrame) -> DataFrame:
    """Shared calendar ``(dt, day_no)`` from 0; its size is bounded by the days covered."""
    days = panel.select("dt").distinct().agg(F.array_sort(F.collect_set("dt")).alias("days"))
    return days.select(F.size("days").alias("n_days"), F.posexplode("days").alias("day_no", "dt")).select("dt", "day_no", "n_days")


def forward_fill(panel: DataFrame, value: str = "close") -> DataFrame:
    """Every symbol on every shared day from its first bar on, last value carried forward.

    Each bar covers the days up to the symbol's next bar, so the fill is an explode of that
    span: no symbol-by-calendar product is formed.
    """
    days = F.broadcast(calendar(panel))  # one row per shared day
    known = panel.filter(F.col(value).isNotNull()).join(days, "dt")
    w = Window.partitionBy("symbol").orderBy("day_no")
    spans = known.select(
        "symbol", value, F.col("dt").alias("bar_dt"),
        F.sequence("day_no", F.lead("day_no").over(w) - 1).alias("inner"),
        F.col("day_no"), F.col("n_days"))
    spans = spans.withColumn("span", F.coalesce(F.col("inner"), F.sequence(F.col("day_no"), F.col("n_days") - 1)))
    filled = spans.select("symbol", value, "bar_dt", F.explode("span").alias("day_no"))
    return (filled.join(days, "day_no")
            .select("symbol", "dt", "day_no", value, (F.col("dt") != F.col("bar_dt")).alias("filled")))


def common_history(panel: DataFrame, weights: DataFrame, keep: tuple[str, ...] = (), least_days: int = 1) -> DataFrame:
    """Rows ``(portfolio_id, symbol, dt, close, weight)`` on days where every weighted symbol has a price.

    Weights above zero only; symbols without any price are left out and the rest renormalised. ``keep`` names
    further columns of the panel. With ``least_days=2`` a portfolio that has a single such day is an error.
    """
    held = weights.filter(F.col("weight") > 0).select("portfolio_id", "symbol", "weight")
    # symbols are unique within a panel, so one aggregate row per symbol is enough to test presence
    present = held.join(panel.select("symbol").distinct(), "symbol", "left_semi")
    per_pf = Window.partitionBy("portfolio_id")
    mix = present.select(
        "portfolio_id", "symbol",
        (F.col("weight") / F.sum("weight").over(per_pf)).alias("weight"),
        F.count("*").over(per_pf).alias("n_symbols"))
    rows = panel.select("symbol", "dt", "close", *keep).filter(F.col("close").isNotNull()).join(mix, "symbol")
    on_day = Window.partitionBy("portfolio_id", "dt")
    common = (rows.withColumn("n_priced", F.count("*").over(on_day))
              .filter(F.col("n_priced") == F.col("n_symbols")).drop("n_priced", "n_symbols"))
    if least_days < 2:
        return common
    per_pf = Window.partitionBy("portfolio_id")
    too_short = F.min("dt").over(per_pf) == F.max("dt").over(per_pf)
    message = F.concat(F.lit("fewer than two common days for portfolio "), F.col("portfolio_id").cast("string"))
    checked = common.withColumn("_short", too_short)
    return checked.filter(F.when(F.col("_short"), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))).drop("_short")


def month_end(day: Column) -> Column:
    return F.last_day(day)


def year_end(day: Column) -> Column:
    return F.make_date(F.year(day), F.lit(12), F.lit(31))


def week_friday(day: Column) -> Column:
    """The Friday that ends the week of ``day`` (a Friday is its own)."""
    return F.next_day(F.date_sub(day, 1), "FRI")


def month_start(day: Column) -> Column:
    return F.trunc(day, "month")


def resample_last(prices: DataFrame, bucket, keys=("symbol",), value: str = "close") -> DataFrame:
    """Last known value per bucket; partial final buckets are kept."""
    return (prices.filter(F.col(value).isNotNull())
            .groupBy(*keys, bucket(F.col("dt")).alias("period"))
            .agg(F.max_by(value, "dt").alias(value), F.max("dt").alias("dt")))


def resample_first(prices: DataFrame, bucket, keys=("symbol",), value: str = "close") -> DataFrame:
    return (prices.filter(F.col(value).isNotNull())
            .groupBy(*keys, bucket(F.col("dt")).alias("period"))
            .agg(F.min_by(value, "dt").alias(value), F.min("dt").alias("dt")))


def weekly_bars(bars: DataFrame) -> DataFrame:
    """Week bars: first open, highest high, lowest low, last close (missing values skipped)."""
    known = lambda c: F.when(F.col(c).isNotNull(), F.col("dt"))
    return (bars.groupBy("symbol", week_friday(F.col("dt")).alias("period"))
            .agg(F.min_by("open", known("open")).alias("open"), F.max("high").alias("high"),
                 F.min("low").alias("low"), F.max_by("close", known("close")).alias("close")))


def daily_returns(prices: DataFrame) -> DataFrame:
    """One-day return per symbol over its own rows; a day without a price yields no return."""
    prev = F.lag("close").over(by_day())
    return (prices.filter(F.col("close").isNotNull()).select("symbol", "dt", (ratio(F.col("close"), prev) - 1).alias("ret"))
            .filter(F.col("ret").isNotNull()))


def underwater(prices: DataFrame, *keys: str) -> DataFrame:
    """Fraction below the running high; a missing price stays missing."""
    keys = keys or ("symbol",)
    return prices.withColumn("underwater", ratio(F.col("close"), F.max("close").over(so_far(*keys))) - 1)


def period_returns(panel: DataFrame) -> DataFrame:
    """Percent return per symbol and look-back; offsets count rows of the shared calendar.

    The value at a calendar row is the last close at or before it (forward fill), found by a
    single aggregate per symbol against a handful of calendar dates.
    """
    cal = calendar(panel)
    last = F.max("day_no")
    picks = cal.agg(F.collect_list(F.struct("day_no", "dt")).alias("days"), last.alias("last_no"))
    dates = picks.select(F.array(*[
        F.try_element_at(F.map_from_entries("days"), F.col("last_no") - off)
        for off in RETURN_WINDOWS.values()]).alias("d")).scalar()
    tagged = panel.filter(F.col("close").isNotNull()).withColumn("d", dates)
    names = list(RETURN_WINDOWS)
    agg = tagged.groupBy("symbol").agg(
        F.max_by("close", "dt").alias("latest"),
        *[F.max_by("close", F.when(F.col("dt") <= F.col("d")[i], F.col("dt"))).alias(f"b{i}")
          for i in range(len(names))])
    rows = F.explode(F.array(*[
        F.struct(F.lit(n).alias("period"), ((ratio(F.col("latest"), F.col(f"b{i}")) - 1) * 100).alias("ret_pct"))
        for i, n in enumerate(names)])).alias("r")
    return agg.select("symbol", rows).select("symbol", "r.period", "r.ret_pct")


def latest_vs_previous(prices: DataFrame) -> DataFrame:
    """Last close, the one before, percent change (0 when the earlier is not positive), direction."""
    recent = Window.partitionBy("symbol").orderBy(F.desc("dt"))
    two = prices.filter(F.col("close").isNotNull()).withColumn("r", F.row_number().over(recent)).filter("r <= 2")
    row = two.groupBy("symbol").agg(
        F.max(F.when(F.col("r") == 1, F.col("dt"))).alias("bar_date"),
        F.max(F.when(F.col("r") == 1, F.col("close"))).alias("price"),
        F.coalesce(F.max(F.when(F.col("r") == 2, F.col("close"))),
                   F.max(F.when(F.col("r") == 1, F.col("close")))).alias("previous_close"))
    diff = F.col("price") - F.col("previous_close")
    return row.withColumns({
        "change_pct": F.when(F.col("previous_close") > 0, diff / F.col("previous_close") * 100).otherwise(0.0),
        "direction": F.when(diff > 0, "up").when(diff < 0, "down").otherwise("flat")})
