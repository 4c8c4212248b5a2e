"""Queries over macro series."""

from pyspark.sql import functions as F

from tidemark.functions import signals as sig
from tidemark.operators import macro as ma
from tidemark.operators.asof import asof_join
from tidemark.queries.oracle_ctes import CTES
from tidemark.queries.registry import query

CTES["cpi_yoy"] = """
SELECT 'CPI_YOY' AS series_id, dt, value FROM (SELECT dt, (value / lag(value, 12) OVER (ORDER BY dt) - 1)*100 AS value FROM macro WHERE series_id = 'CPI') WHERE value IS NOT NULL"""
CTES["mtrend"] = """
SELECT series_id, max_by(value, dt) AS latest, max(dt) AS last_dt, CASE WHEN count(*) < 6 OR avg(value) FILTER (WHERE r > 3) = 0 THEN 'flat'
 WHEN (avg(value) FILTER (WHERE r <= 3) - avg(value) FILTER (WHERE r > 3))/abs(avg(value) FILTER (WHERE r > 3))*100 > 1 THEN 'up'
 WHEN (avg(value) FILTER (WHERE r <= 3) - avg(value) FILTER (WHERE r > 3))/abs(avg(value) FILTER (WHERE r > 3))*100 < -1 THEN 'down' ELSE 'flat' END AS trend
FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY dt DESC) AS r FROM (SELECT * FROM macro UNION ALL SELECT * FROM cpi_yoy)) WHERE r <= 6 GROUP BY 1"""
CTES["mdaily"] = """
SELECT d.dt, d.vix, d.dxy, CASE WHEN (SELECT median(tnx) FROM macro_daily) > 20 THEN d.tnx/10 ELSE d.tnx END AS tnx FROM macro_daily d"""


@query("W21_inflation_yoy", "dt:d value:5", "SELECT dt, value FROM cpi_yoy")
def _(t):
    return ma.year_over_year(t.macro().filter(F.col("series_id") == "CPI"))


@query("W22_series_trend", "series_id:s latest:5 trend:s", "SELECT series_id, latest, trend FROM mtrend")
def _(t):
    return ma.trends(ma.with_inflation(t.macro()))


@query("T12_macro_table", "series_id:s value:3 trend:s unit:s as_of:d", """
SELECT series_id, round(latest, 2) AS value, trend, CASE series_id WHEN 'FEDFUNDS' THEN 'percent' WHEN 'CPI_YOY' THEN 'percent_yoy' END AS unit, (SELECT max(last_dt) FROM mtrend) AS as_of FROM mtrend WHERE series_id <> 'CPI'""")
def _(t):
    return ma.macro_table(t.macro())


@query("P11_macro_regime", "mood:s inflation:s dollar:s", """
WITH r AS (SELECT max(trend) FILTER (WHERE series_id = 'FEDFUNDS') AS rt, max(round(latest, 2)) FILTER (WHERE series_id = 'VIX') AS v, max(trend) FILTER (WHERE series_id = 'CPI_YOY') AS c, max(trend) FILTER (WHERE series_id = 'DXY') AS d FROM mtrend)
SELECT CASE WHEN rt = 'up' AND v < 20 THEN 'rates_up_calm' WHEN rt = 'down' AND v < 20 THEN 'rates_down_calm' WHEN v >= 25 THEN 'high_volatility' ELSE 'mixed' END AS mood,
 CASE c WHEN 'down' THEN 'easing' WHEN 'up' THEN 'rising' ELSE 'flat' END AS inflation, CASE d WHEN 'up' THEN 'strong' ELSE 'soft' END AS dollar FROM r""")
def _(t):
    return ma.macro_summary(t.macro())


@query("P7_volatility_regime", "dt:d value:1 regime:s warning:b", """
SELECT dt, vix AS value, CASE WHEN vix < 20 THEN 'calm' WHEN vix <= 30 THEN 'caution' ELSE 'high' END AS regime, vix > 25 AS warning FROM macro_daily""")
def _(t):
    return t.macro().filter(F.col("series_id") == "VIX").withColumns({
        "regime": sig.volatility_regime(F.col("value")), "warning": sig.volatility_warning(F.col("value"))})


@query("J3_monthly_to_daily", "dt:d value:5 ref_dt:d", """
SELECT d.dt, c.value, c.dt AS ref_dt FROM (SELECT dt FROM macro_daily) d ASOF LEFT JOIN cpi_yoy c ON d.dt >= c.dt""")
def _(t):
    days = t.macro().filter(F.col("series_id") == "VIX").select("dt")
    ref = ma.year_over_year(t.macro().filter(F.col("series_id") == "CPI")).withColumnRenamed("dt", "rdt")
    return asof_join(days, ref, "dt", "rdt", ["value"]).withColumnRenamed("matched_on", "ref_dt")


@query("T11_macro_daily_frame", "dt:d vix:2 dxy:4 tnx:3 fed_rate:4 cpi_yoy:5", """
SELECT d.dt, d.vix, d.dxy, d.tnx, f.value AS fed_rate, c.value AS cpi_yoy FROM mdaily d
ASOF LEFT JOIN (SELECT dt, value FROM macro WHERE series_id = 'FEDFUNDS') f ON d.dt >= f.dt ASOF LEFT JOIN (SELECT dt, value FROM cpi_yoy) c ON d.dt >= c.dt""")
def _(t):
    return ma.daily_frame(t.macro())
