"""Small report tables: weekly summary, symbol lists, alert counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import ratio
from tidemark.operators import indicators as ind
from tidemark.operators.panel import calendar


def weekly_report(panel: DataFrame) -> DataFrame:
    """Latest RSI, one-week and one-month return per symbol with two counts over all symbols."""
    cal = calendar(panel)
    days = cal.agg(F.map_from_entries(F.collect_list(F.struct("day_no", "dt"))).alias("d"), F.max("day_no").alias("n"))
    pick = lambda back: days.select(F.try_element_at("d", F.col("n") - back)).scalar()
    tagged = panel.filter(F.col("close").isNotNull()).withColumns({"w_dt": pick(5), "m_dt": pick(21)})
    at = lambda c: F.max_by("close", F.when(F.col("dt") <= F.col(c), F.col("dt")))
    moves = tagged.groupBy("symbol").agg(F.max_by("close", "dt").alias("l"), at("w_dt").alias("w"), at("m_dt").alias("m"))
    pct = lambda c: (ratio(F.col("l"), F.col(c)) - 1) * 100
    rsi = ind.last_row(ind.with_rsi(ind.number_rows(panel))).select("symbol", "rsi")
    rows = moves.join(rsi, "symbol").select(
        "symbol", "rsi", pct("w").alias("ret_1w_pct"), pct("m").alias("ret_1m_pct"))
    totals = rows.agg(F.count_if((F.col("rsi") < 30) | (F.col("rsi") > 70)).alias("abnormal_rsi"),
                      F.count_if(F.col("ret_1w_pct") >= 0).alias("non_negative_weeks"))
    return rows.join(F.broadcast(totals))  # the totals are one row


def requested_symbols(asked: DataFrame, allowed: list[str]) -> DataFrame:
    """Asked-for symbols, cleaned, allow-listed and de-duplicated at their first position."""
    return (asked.select(F.upper(F.trim("symbol")).alias("symbol"), "pos")
            .filter(F.col("symbol").isin(allowed))
            .groupBy("symbol").agg(F.min("pos").alias("pos")))


def alert_status(alerts: DataFrame) -> DataFrame:
    done = F.coalesce(F.col("triggered"), F.lit(False))
    return alerts.agg(F.count_if(~done).alias("pending"), F.count_if(done).alias("triggered"))
