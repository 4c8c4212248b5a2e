"""Macro series: year-over-year, trends, daily alignment and the summary table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import ratio
from tidemark.functions.signals import macro_regime
from tidemark.operators.asof import asof_join

# Units of the summary table.
UNITS = {"FEDFUNDS": "percent", "CPI_YOY": "percent_yoy"}


def year_over_year(series: DataFrame, lag: int = 12) -> DataFrame:
    """Percent change against 12 rows earlier; nothing when the series is shorter."""
    w = Window.partitionBy("series_id").orderBy("dt")
    known = series.filter(F.col("value").isNotNull())
    out = known.withColumn("value", (ratio(F.col("value"), F.lag("value", lag).over(w)) - 1) * 100)
    return out.filter(F.col("value").isNotNull())


def trends(series: DataFrame, lookback: int = 3) -> DataFrame:
    """``up``/``down`` when the last three values average over one percent off the three before."""
    w = Window.partitionBy("series_id").orderBy(F.desc("dt"))
    rows = series.filter(F.col("value").isNotNull()).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= 2 * lookback)
    agg = rows.groupBy("series_id").agg(
        F.count("*").alias("n"), F.avg(F.when(F.col("r") <= lookback, F.col("value"))).alias("recent"),
        F.avg(F.when(F.col("r") > lookback, F.col("value"))).alias("before"),
        F.max_by("value", "dt").alias("latest"), F.max("dt").alias("last_dt"))
    pct = ratio(F.col("recent") - F.col("before"), F.abs("before")) * 100
    flat = F.coalesce((F.col("n") < 2 * lookback) | (F.col("before") == 0), F.lit(True))
    return agg.withColumn("trend", F.when(flat, "flat").when(pct > 1, "up").when(pct < -1, "down").otherwise("flat"))


def with_inflation(series: DataFrame) -> DataFrame:
    """The series plus ``CPI_YOY`` derived from the CPI level."""
    yoy = year_over_year(series.filter(F.col("series_id") == "CPI")).withColumn("series_id", F.lit("CPI_YOY"))
    return series.unionByName(yoy)


SHOWN = ["FEDFUNDS", "CPI_YOY", "TNX", "DXY", "VIX"]


def macro_table(series: DataFrame) -> DataFrame:
    """Latest value, trend and unit per shown series; empty when any series is missing."""
    rows = trends(with_inflation(series).filter(F.col("series_id").isin(SHOWN)))
    everything = Window.partitionBy(F.lit(1))  # five rows
    unit = F.lit(None).cast("string")
    for name, label in UNITS.items():
        unit = F.when(F.col("series_id") == name, label).otherwise(unit)
    out = rows.withColumns({"n_series": F.count("*").over(everything), "as_of": F.max("last_dt").over(everything), "unit": unit})
    return out.filter(F.col("n_series") == len(SHOWN)).select("series_id", F.round("latest", 2).alias("value"), "trend", "unit", "as_of")


def macro_summary(series: DataFrame) -> DataFrame:
    """One row with the three regime codes."""
    row = macro_table(series).groupBy().agg(*[
        F.max(F.when(F.col("series_id") == s, F.col(c))).alias(f"{s}_{c}") for s in SHOWN for c in ("value", "trend")])
    row = row.filter(F.col("VIX_value").isNotNull())
    return row.select(macro_regime(F.col("FEDFUNDS_trend"), F.col("VIX_value"), F.col("CPI_YOY_trend"), F.col("DXY_trend")).alias("r")).select("r.*")


def daily_frame(series: DataFrame) -> DataFrame:
    """Daily rows of the market series, carried forward, with the monthly series as of each day.

    The ten-year yield is divided by ten when its median shows it is quoted tenfold.
    """
    daily = series.filter(F.col("series_id").isin("VIX", "DXY", "TNX"))
    tenfold = daily.filter((F.col("series_id") == "TNX") & F.col("value").isNotNull()).agg(F.median("value").alias("m")).scalar()
    wide = daily.groupBy("dt").agg(*[F.max(F.when(F.col("series_id") == s, F.col("value"))).alias(s) for s in ("VIX", "DXY", "TNX")])
    run = Window.partitionBy(F.lit(1)).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)  # one row per day
    filled = wide.select("dt", *[F.last(s, ignorenulls=True).over(run).alias(s.lower()) for s in ("VIX", "DXY", "TNX")])
    filled = filled.withColumn("med", tenfold).withColumn("tnx", F.when(F.col("med") > 20, F.col("tnx") / 10).otherwise(F.col("tnx"))).drop("med")
    monthly = with_inflation(series)
    for name, label in (("FEDFUNDS", "fed_rate"), ("CPI_YOY", "cpi_yoy")):
        ref = monthly.filter(F.col("series_id") == name).select(F.col("dt").alias("ref_dt"), F.col("value").alias(label))
        filled = asof_join(filled, ref, "dt", "ref_dt", [label]).drop("matched_on")
    return filled
