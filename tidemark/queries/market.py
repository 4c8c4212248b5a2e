"""Queries over the price panel: cleaning, returns, risk, resampling and indicators."""

from pyspark.sql import functions as F

from tidemark.functions import signals as sig
from tidemark.operators import indicators as ind
from tidemark.operators import panel as pan
from tidemark.operators import risk
from tidemark.queries.oracle_ctes import CTES, signal_sql
from tidemark.queries.registry import query
from tidemark.sources.adapters import TARGETS

# --- scans -------------------------------------------------------------------------------


@query("SRC1_price_panel", "symbol:s dt:d close:4", """
SELECT symbol, dt, close FROM bars WHERE symbol IN ('STANDARD','ECONOMY','MEDIUM','SMALL','LARGE') AND dt >= DATE '1997-01-01'""")
def _(t):
    return pan.price_panel(t.prices(), [s for s, w in TARGETS.items() if w > 0], "1997-01-01")


@query("SRC2_clean_closes", "symbol:s dt:d close:4", "SELECT symbol, dt, close FROM bars")
def _(t):
    # unusable rows stand beside the good ones: texts that are no numbers, and no price at all
    good = t.prices().withColumn("close", F.col("close").cast("string"))
    bad = t.prices().select("symbol", "dt", F.explode(F.array(F.lit("N/D"), F.lit("NaN"), F.lit(None).cast("string"))).alias("close"))
    return pan.clean_closes(good.unionByName(bad))


@query("SRC3_ohlc_bars", "symbol:s dt:d open:4 high:4 low:4 close:4 volume:2", """
SELECT symbol, dt, open, high, low, close, volume FROM bars UNION ALL SELECT symbol || '-gap', dt, open, high, low, NULL, volume FROM bars""")
def _(t):
    # beside the bars: rows without any price, which go, and bars of further symbols without a close, which stay
    bars = t.bars().select("symbol", "dt", "open", "high", "low", "close", "volume")
    none = F.lit(None).cast("double")
    empty = bars.withColumns({c: none for c in ("open", "high", "low", "close")})
    gaps = bars.withColumns({"symbol": F.concat("symbol", F.lit("-gap")), "close": none})
    return pan.clean_bars(bars.unionByName(empty).unionByName(gaps))


@query("SRC8_macro_series", "series_id:s dt:d value:4", "SELECT series_id, dt, value FROM macro")
def _(t):
    return t.macro()


# --- returns and risk --------------------------------------------------------------------


@query("W1_daily_returns", "symbol:s dt:d ret:6", "SELECT symbol, dt, ret FROM px WHERE ret IS NOT NULL")
def _(t):
    return pan.daily_returns(t.prices())


@query("W6_underwater", "symbol:s dt:d underwater:6", """
SELECT symbol, dt, close / max(close) OVER (PARTITION BY symbol ORDER BY dt) - 1 AS underwater FROM bars""")
def _(t):
    return pan.underwater(t.prices())


@query("A1_volatility", "symbol:s volatility:6",
       "SELECT symbol, stddev_samp(ret) * sqrt(252) AS volatility FROM px GROUP BY symbol")
def _(t):
    return risk.risk_table(t.prices()).select("symbol", "volatility")


@query("A2_sharpe_ratio", "symbol:s sharpe:6", """
SELECT symbol, (avg(ret)*252 - 0.02) / nullif(stddev_samp(ret)*sqrt(252), 0) AS sharpe FROM px GROUP BY symbol""")
def _(t):
    return risk.risk_table(t.prices()).select("symbol", "sharpe")


@query("A3_max_drawdown", "symbol:s max_drawdown:6", """
SELECT symbol, min(uw) AS max_drawdown FROM (
  SELECT symbol, close / max(close) OVER (PARTITION BY symbol ORDER BY dt) - 1 AS uw FROM bars) GROUP BY symbol""")
def _(t):
    return risk.risk_table(t.prices()).select("symbol", "max_drawdown")


RISK_SQL = """
SELECT symbol, count(ret) AS n_returns, avg(ret)*252 AS mean_return, stddev_samp(ret)*sqrt(252) AS volatility,
       (avg(ret)*252 - 0.02) / nullif(stddev_samp(ret)*sqrt(252), 0) AS sharpe, min(uw) AS max_drawdown
FROM (SELECT *, close / max(close) OVER (PARTITION BY symbol ORDER BY dt) - 1 AS uw FROM px) GROUP BY symbol"""


@query("A4_risk_table", "symbol:s n_returns:i mean_return:6 volatility:6 sharpe:6 max_drawdown:6", RISK_SQL)
def _(t):
    return risk.risk_table(t.prices())


@query("W2_period_returns", "symbol:s period:s ret_pct:4", """
WITH cal AS (SELECT dt, row_number() OVER (ORDER BY dt DESC) - 1 AS back FROM (SELECT DISTINCT dt FROM bars)),
per AS (SELECT * FROM (VALUES ('1M',21),('3M',63),('6M',126),('1Y',252),('3Y',756),('5Y',1260),('10Y',2520)) v(period, off)),
syms AS (SELECT DISTINCT symbol FROM bars),
base AS (SELECT s.symbol, p.period, (SELECT dt FROM cal WHERE back = p.off) AS base_dt FROM syms s CROSS JOIN per p)
SELECT b.symbol, b.period, (l.price / x.close - 1) * 100 AS ret_pct
FROM base b JOIN latest l ON l.symbol = b.symbol
LEFT JOIN LATERAL (SELECT close FROM bars q WHERE q.symbol = b.symbol AND q.dt <= b.base_dt ORDER BY q.dt DESC LIMIT 1) x ON true""")
def _(t):
    return pan.period_returns(t.prices())


CORR_CTES = """WITH pairs AS (SELECT a.symbol AS symbol_a, b.symbol AS symbol_b, count(*) AS n_days, corr(a.ret, b.ret) AS corr
  FROM px a JOIN px b ON a.dt = b.dt AND a.symbol < b.symbol WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2)"""


@query("A5_correlation_matrix", "symbol_a:s symbol_b:s corr:6", CORR_CTES + " SELECT symbol_a, symbol_b, corr FROM pairs")
def _(t):
    return risk.correlation_pairs(t.prices())


@query("J9_pair_overlap_days", "symbol_a:s symbol_b:s n_days:i", CORR_CTES + " SELECT symbol_a, symbol_b, n_days FROM pairs")
def _(t):
    return risk.correlation_pairs(t.prices())


@query("A6_correlation_extremes", "highest_pair:s highest_corr:6 lowest_pair:s lowest_corr:6", CORR_CTES + """
SELECT max_by(symbol_a || '/' || symbol_b, corr) AS highest_pair, max(corr) AS highest_corr,
       min_by(symbol_a || '/' || symbol_b, corr) AS lowest_pair, min(corr) AS lowest_corr FROM pairs""")
def _(t):
    return risk.correlation_extremes(risk.correlation_pairs(t.prices()))


@query("A6_overlap_pairs", "symbol_a:s symbol_b:s corr:6 overlap:s", CORR_CTES + """
SELECT symbol_a, symbol_b, corr, CASE WHEN corr >= 0.85 THEN 'high' ELSE 'low' END AS overlap FROM pairs
WHERE corr >= 0.85 OR corr <= 0.30""")
def _(t):
    return risk.overlap_pairs(risk.correlation_pairs(t.prices()))


@query("A7_monthly_seasonality", "symbol:s month:i median_pct:4 mean_pct:4 positive_rate_pct:4 n_samples:i", """
WITH m AS (SELECT symbol, last_day(dt) AS period, max_by(close, dt) AS close FROM bars GROUP BY 1, 2),
r AS (SELECT symbol, extract(month FROM period) AS month, close / lag(close) OVER (PARTITION BY symbol ORDER BY period) - 1 AS r FROM m),
s AS (SELECT symbol, month, median(r)*100 AS median_pct, avg(r)*100 AS mean_pct,
      avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END)*100 AS positive_rate_pct, count(*) AS n_samples
      FROM r WHERE r IS NOT NULL GROUP BY 1, 2)
SELECT k.symbol, k.month, median_pct, mean_pct, positive_rate_pct, n_samples
FROM (SELECT DISTINCT symbol, g.month FROM bars CROSS JOIN range(1, 13) g(month)) k
LEFT JOIN s ON s.symbol = k.symbol AND s.month = k.month""")
def _(t):
    return risk.monthly_seasonality(t.prices())


@query("A8_portfolio_mu_sigma", "portfolio_id:s n_days:i mu:6 sigma:6 usable:b", """
WITH n AS (SELECT portfolio_id, sum(weight) AS tot, count(*) AS k FROM weights WHERE weight > 0 GROUP BY 1),
d AS (SELECT w.portfolio_id, p.dt, sum(p.ret * w.weight / n.tot) AS r, count(*) AS c, max(n.k) AS k
      FROM px p JOIN weights w ON w.symbol = p.symbol AND w.weight > 0 JOIN n ON n.portfolio_id = w.portfolio_id
      WHERE p.ret IS NOT NULL GROUP BY 1, 2 HAVING count(*) = max(n.k))
SELECT portfolio_id, count(*) AS n_days, avg(r)*252 AS mu, stddev_samp(r)*sqrt(252) AS sigma, stddev_samp(r) > 0 AS usable
FROM d GROUP BY 1""")
def _(t):
    return risk.portfolio_mu_sigma(t.prices(), t.weights())


@query("A18_basket_summary", "basket_return_pct:4 best_symbol:s best_pct:4 worst_symbol:s worst_pct:4", """
WITH f AS (SELECT max(f) AS f FROM (SELECT symbol, min(dt) AS f FROM bars GROUP BY symbol)),
e AS (SELECT b.symbol, max_by(close, dt) AS latest, max_by(close, dt) FILTER (WHERE dt <= (SELECT f FROM f)) AS base FROM bars b GROUP BY 1),
cal AS (SELECT dt FROM (SELECT DISTINCT dt FROM bars) ORDER BY dt DESC LIMIT 1 OFFSET 252),
y AS (SELECT symbol, (max_by(close, dt) / max_by(close, dt) FILTER (WHERE dt <= (SELECT dt FROM cal)) - 1) * 100 AS r FROM bars GROUP BY 1)
SELECT (avg(latest/base) - 1) * 100 AS basket_return_pct, (SELECT max_by(symbol, r) FROM y) AS best_symbol, (SELECT max(r) FROM y) AS best_pct,
  (SELECT min_by(symbol, r) FROM y) AS worst_symbol, (SELECT min(r) FROM y) AS worst_pct FROM e""")
def _(t):
    return risk.basket_summary(t.prices())


@query("A19_annual_return_stats", "symbol:s n_years:i avg_return:6 return_std:6 last3_return:6", """
WITH y AS (SELECT symbol, extract(year FROM dt) AS yr, max_by(close, dt) AS close FROM bars GROUP BY 1, 2),
r AS (SELECT symbol, yr, close / lag(close) OVER (PARTITION BY symbol ORDER BY yr) - 1 AS r,
      row_number() OVER (PARTITION BY symbol ORDER BY yr DESC) AS back FROM y)
SELECT symbol, count(r) AS n_years, avg(r) AS avg_return, stddev_samp(r) AS return_std,
  avg(r) FILTER (WHERE back <= 3) AS last3_return FROM r WHERE r IS NOT NULL GROUP BY 1""")
def _(t):
    return risk.annual_return_stats(t.prices())


# --- calendar and resampling -------------------------------------------------------------


@query("T1_forward_fill", "symbol:s dt:d close:4 filled:b", """
WITH cal AS (SELECT DISTINCT dt FROM bars), f AS (SELECT symbol, min(dt) AS f FROM bars GROUP BY 1),
g AS (SELECT f.symbol, cal.dt, b.close FROM f JOIN cal ON cal.dt >= f.f LEFT JOIN bars b ON b.symbol = f.symbol AND b.dt = cal.dt)
SELECT symbol, dt, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY dt) AS close, close IS NULL AS filled FROM g""")
def _(t):
    return pan.forward_fill(t.prices())


@query("T2_common_history", "portfolio_id:s symbol:s dt:d close:4", """
WITH d AS (SELECT w.portfolio_id, w.symbol, b.dt, b.close, count(*) OVER (PARTITION BY w.portfolio_id, b.dt) AS c
  FROM weights w JOIN bars b ON b.symbol = w.symbol)
SELECT portfolio_id, symbol, dt, close FROM d WHERE c = 5""")
def _(t):
    return pan.common_history(t.prices(), t.weights())


@query("T3_resampled_bars", "symbol:s freq:s period:d close:4", """
SELECT symbol, 'month_end' AS freq, last_day(dt) AS period, max_by(close, dt) AS close FROM bars GROUP BY 1, 3
UNION ALL SELECT symbol, 'year_end', make_date(extract(year FROM dt), 12, 31), max_by(close, dt) FROM bars GROUP BY 1, 3
UNION ALL SELECT symbol, 'month_start', CAST(date_trunc('month', dt) AS DATE), min_by(close, dt) FROM bars GROUP BY 1, 3
UNION ALL SELECT symbol, 'week', CAST(dt + CAST((12 - dayofweek(dt)) % 7 AS INTEGER) AS DATE), max_by(close, dt) FROM bars GROUP BY 1, 3""")
def _(t):
    p = t.prices()
    tag = lambda df, f: df.select("symbol", F.lit(f).alias("freq"), "period", "close")
    return (tag(pan.resample_last(p, pan.month_end), "month_end")
            .unionByName(tag(pan.resample_last(p, pan.year_end), "year_end"))
            .unionByName(tag(pan.resample_first(p, pan.month_start), "month_start"))
            .unionByName(tag(pan.resample_last(p, pan.week_friday), "week")))


@query("T3_weekly_ohlc", "symbol:s period:d open:4 high:4 low:4 close:4", """
SELECT symbol, CAST(dt + CAST((12 - dayofweek(dt)) % 7 AS INTEGER) AS DATE) AS period, min_by(open, dt) AS open, max(high) AS high,
  min(low) AS low, max_by(close, dt) AS close FROM bars GROUP BY 1, 2""")
def _(t):
    return pan.weekly_bars(t.bars())


# --- indicators --------------------------------------------------------------------------


@query("W3_moving_averages", "symbol:s dt:d ma50:4 ma200:4", "SELECT symbol, dt, ma50, ma200 FROM feat")
def _(t):
    return ind.features(t.prices())


@query("W4_bollinger_bands", "symbol:s dt:d bb_lower:4 bb_middle:4 bb_upper:4", """
SELECT symbol, dt, ma20 - 2*sd20 AS bb_lower, ma20 AS bb_middle, ma20 + 2*sd20 AS bb_upper FROM feat""")
def _(t):
    return ind.features(t.prices())


@query("W5_volume_spike", "symbol:s dt:d volume_ma20:4 spike:b", """
SELECT symbol, dt, vol_ma20 AS volume_ma20, coalesce(volume > 2*vol_ma20, false) AS spike FROM feat""")
def _(t):
    return ind.features(t.bars()).withColumn(
        "spike", F.coalesce(F.col("volume") > F.col("volume_ma20") * 2.0, F.lit(False)))


@query("T4_ewma", "symbol:s dt:d ema12:4 ema26:4", """
SELECT p.symbol, p.dt, CASE WHEN p.rn >= 11 THEN e12 END AS ema12, CASE WHEN p.rn >= 25 THEN e26 END AS ema26
FROM px p JOIN ewm e ON e.symbol = p.symbol AND e.rn = p.rn""")
def _(t):
    c = F.col("close")
    return ind.with_ewma(ind.number_rows(t.prices()), ind.Ewma("ema12", c, ind.span(12), 0, 12),
                         ind.Ewma("ema26", c, ind.span(26), 0, 26))


@query("T5_wilder_rsi", "symbol:s dt:d rsi:6", "SELECT symbol, dt, rsi FROM feat")
def _(t):
    return ind.with_rsi(ind.number_rows(t.prices()))


@query("T6_macd", "symbol:s dt:d macd:4 macd_signal:4 macd_hist:4", "SELECT symbol, dt, macd, macd_signal, macd_hist FROM feat")
def _(t):
    return ind.with_macd(ind.number_rows(t.prices()))


CROSS = """WITH c AS (SELECT symbol, dt, rn, n, ma50, ma200, lag(ma50) OVER w AS p50, lag(ma200) OVER w AS p200 FROM feat
  WINDOW w AS (PARTITION BY symbol ORDER BY dt))"""

SNAP_SQL = CROSS + """, x AS (SELECT symbol, bool_or(ma50 > ma200 AND p50 <= p200) AS golden, bool_or(ma50 < ma200 AND p50 >= p200) AS death
  FROM c WHERE rn >= n - 5 AND ma200 IS NOT NULL AND p200 IS NOT NULL GROUP BY symbol),
s AS (SELECT l.*, coalesce(x.golden, false) AS golden, coalesce(x.death, false) AS death FROM lastrow l LEFT JOIN x USING (symbol)),
z AS (SELECT *, CASE WHEN signal IN ('bullish','accumulate') THEN 'bullish' WHEN signal IN ('downtrend','downtrend_watch') THEN 'bearish' ELSE 'neutral' END AS label,
  CASE WHEN signal = 'no_data' THEN 'no_data' WHEN signal IN ('bullish','accumulate') THEN CASE WHEN golden AND rsi < 65 THEN 'strong_buy' ELSE 'buy' END
  WHEN signal = 'downtrend' AND death THEN 'sell' ELSE 'hold' END AS overall FROM s)"""


@query("T7_indicator_snapshot", "symbol:s price:4 rsi:4 macd:4 macd_signal:4 macd_hist:4 bb_lower:4 bb_middle:4 bb_upper:4 ma50:4 ma200:4 "
       "volume_ma20:4 golden:b death:b label:s overall:s", SNAP_SQL + """
SELECT symbol, close AS price, rsi, macd, macd_signal, macd_hist, ma20 - 2*sd20 AS bb_lower, ma20 AS bb_middle, ma20 + 2*sd20 AS bb_upper,
  ma50, ma200, vol_ma20 AS volume_ma20, golden, death, label, overall FROM z""")
def _(t):
    return ind.snapshot(t.bars()).withColumnRenamed("close", "price")


@query("T8_technical_state", "symbol:s data_ok:b price:4 ma50_state:s ma200_state:s rsi:4 signal:s", """
SELECT symbol, n >= 200 AND signal <> 'no_data' AS data_ok, close AS price, CASE WHEN close >= ma50 THEN 'Above' ELSE 'Below' END AS ma50_state,
  CASE WHEN close >= ma200 THEN 'Above' ELSE 'Below' END AS ma200_state, rsi, signal FROM lastrow""")
def _(t):
    side = lambda c: F.when(F.col("data_ok"), F.when(F.col("close") >= F.col(c), "Above").otherwise("Below"))
    return ind.snapshot(t.prices()).withColumns({"ma50_state": side("ma50"), "ma200_state": side("ma200")}
                                                ).withColumnRenamed("close", "price")


CTES["weeks"] = """
SELECT symbol, period, close, row_number() OVER (PARTITION BY symbol ORDER BY period) - 1 AS rn,
  count(*) OVER (PARTITION BY symbol) AS n, lag(close) OVER (PARTITION BY symbol ORDER BY period) AS prev
FROM (SELECT symbol, CAST(dt + CAST((12 - dayofweek(dt)) % 7 AS INTEGER) AS DATE) AS period, max_by(close, dt) AS close FROM bars GROUP BY 1, 2)"""
CTES["wewm"] = """
SELECT symbol, rn, greatest(close - prev, 0) AS ag, greatest(prev - close, 0) AS al FROM weeks WHERE rn = 1
UNION ALL
SELECT p.symbol, p.rn, e.ag*13/14 + greatest(p.close - p.prev, 0)/14, e.al*13/14 + greatest(p.prev - p.close, 0)/14
FROM wewm e JOIN weeks p ON p.symbol = e.symbol AND p.rn = e.rn + 1"""
CTES["wsig"] = f"""
SELECT symbol, n AS weeks, close AS price, ma10 AS ma10w, ma40 AS ma40w, rsi AS rsi14w, {signal_sql('close', 'ma10', 'ma40', 'rsi')} AS signal FROM (
 SELECT w.*, 100 - 100/(1 + e.ag/e.al) AS rsi,
  avg(close) OVER (PARTITION BY w.symbol ORDER BY w.rn ROWS 9 PRECEDING) AS ma10,
  avg(close) OVER (PARTITION BY w.symbol ORDER BY w.rn ROWS 39 PRECEDING) AS ma40
 FROM weeks w JOIN wewm e ON e.symbol = w.symbol AND e.rn = w.rn) WHERE rn = n - 1"""


@query("T9_weekly_signal", "symbol:s weeks:i price:4 ma10w:4 ma40w:4 rsi14w:4 signal:s", "SELECT * FROM wsig")
def _(t):
    return ind.weekly_signal(t.prices())


@query("W8_ma_cross_dates", "symbol:s dt:d cross:s", CROSS + """
SELECT symbol, dt, CASE WHEN ma50 > ma200 THEN 'golden' ELSE 'death' END AS "cross" FROM c
WHERE ma200 IS NOT NULL AND p200 IS NOT NULL AND (ma50 > ma200) <> (p50 > p200)""")
def _(t):
    return ind.ma_cross_dates(ind.features(t.prices()))


@query("W9_cross_last_3", "symbol:s dt:d golden:b death:b", CROSS + """
SELECT symbol, dt, coalesce(bool_or(p50 < p200 AND ma50 > ma200) OVER w3, false) AS golden,
  coalesce(bool_or(p50 > p200 AND ma50 < ma200) OVER w3, false) AS death FROM c
WINDOW w3 AS (PARTITION BY symbol ORDER BY dt ROWS 2 PRECEDING)""")
def _(t):
    w = pan.by_day()
    df = ind.features(t.prices())
    f, s = F.col("ma50"), F.col("ma200")
    df = df.withColumns({"u": ind.cross_up(f, s, w, "strict"), "d": ind.cross_down(f, s, w, "strict")})
    return df.withColumns({"golden": ind.within(F.col("u"), 3), "death": ind.within(F.col("d"), 3)})


@query("W10_cross_last_5", "symbol:s golden:b death:b", SNAP_SQL + " SELECT symbol, golden, death FROM z")
def _(t):
    return ind.cross_flags(ind.features(t.prices()), 5, "touch")


@query("W11_macd_cross", "symbol:s dt:d cross:s", """
WITH h AS (SELECT symbol, dt, macd_hist AS h, lag(macd_hist) OVER (PARTITION BY symbol ORDER BY dt) AS p FROM feat)
SELECT symbol, dt, CASE WHEN p < 0 AND h > 0 THEN 'bullish' ELSE 'bearish' END AS "cross" FROM h WHERE (p < 0 AND h > 0) OR (p > 0 AND h < 0)""")
def _(t):
    df = ind.with_macd(ind.number_rows(t.prices()))
    p, h = F.lag("macd_hist").over(pan.by_day()), F.col("macd_hist")
    return df.withColumn("cross", F.when((p < 0) & (h > 0), "bullish").when((p > 0) & (h < 0), "bearish")
                         ).filter(F.col("cross").isNotNull())


@query("W12_band_squeeze", "symbol:s dt:d bandwidth:6 avg_bandwidth:6 squeeze:b", """
WITH b AS (SELECT symbol, dt, rn, 4*sd20/ma20 AS bw FROM feat),
a AS (SELECT *, CASE WHEN rn >= 68 THEN avg(bw) OVER (PARTITION BY symbol ORDER BY rn ROWS 49 PRECEDING) END AS avg_bw FROM b)
SELECT symbol, dt, bw AS bandwidth, avg_bw AS avg_bandwidth, coalesce(bw < 0.5*avg_bw, false) AS squeeze FROM a""")
def _(t):
    df = ind.features(t.prices()).withColumn("avg_bandwidth", ind.full(F.col("bandwidth"), 50))
    return df.withColumn("squeeze", F.coalesce(F.col("bandwidth") < F.col("avg_bandwidth") * 0.5, F.lit(False)))


@query("W13_price_drop", "symbol:s dt:d drop_pct:4 dropped:b", """
SELECT symbol, dt, (p - close)/p*100 AS drop_pct, (p - close)/p*100 >= 5 AS dropped FROM (
  SELECT symbol, dt, close, lag(close, 9) OVER (PARTITION BY symbol ORDER BY dt) AS p FROM bars)""")
def _(t):
    then = F.lag("close", 9).over(pan.by_day())
    return t.prices().withColumn("drop_pct", (then - F.col("close")) / then * 100).withColumn("dropped", F.col("drop_pct") >= 5)


@query("W14_support_resistance", "symbol:s support:2 resistance:2", """
SELECT symbol, low60 AS support, high60 AS resistance FROM lastrow""")
def _(t):
    return ind.last_row(ind.features(t.prices()))


@query("W15_momentum_sums", "symbol:s dt:d mom_1m:4 mom_3m:4", "SELECT symbol, dt, mom_1m, mom_3m FROM feat")
def _(t):
    return ind.features(t.prices())


@query("W16_uptrend_runs", "symbol:s start_dt:d end_dt:d n_days:i", """
WITH u AS (SELECT symbol, dt, close >= ma200 AS up, rn - row_number() OVER (PARTITION BY symbol, close >= ma200 ORDER BY dt) AS grp
  FROM feat WHERE ma200 IS NOT NULL)
SELECT symbol, min(dt) AS start_dt, max(dt) AS end_dt, count(*) AS n_days FROM u WHERE up GROUP BY symbol, grp""")
def _(t):
    return risk.uptrend_runs(ind.features(t.prices()))


@query("W19_latest_vs_previous", "symbol:s bar_date:d price:4 previous_close:4 change_pct:4 direction:s", """
SELECT symbol, dt AS bar_date, close AS price, prev AS previous_close, (close - prev)/prev*100 AS change_pct,
  CASE WHEN close > prev THEN 'up' WHEN close < prev THEN 'down' ELSE 'flat' END AS direction FROM px WHERE rn = n - 1""")
def _(t):
    return pan.latest_vs_previous(t.prices())


@query("W23_three_bar_flags", "symbol:s dt:d oversold_3:b overbought_3:b", """
SELECT symbol, dt, rn >= 2 AND bool_or(coalesce(rsi < 30, false)) OVER w AS oversold_3, rn >= 2 AND bool_or(coalesce(rsi > 70, false)) OVER w AS overbought_3
FROM feat WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS 2 PRECEDING)""")
def _(t):
    df = ind.with_rsi(ind.number_rows(t.prices()))
    recent = lambda c: (F.col("rn") >= 2) & ind.within(F.coalesce(c, F.lit(False)), 3)
    return df.withColumns({"oversold_3": recent(F.col("rsi") < 30), "overbought_3": recent(F.col("rsi") > 70)})


# --- classification over the panel ---------------------------------------------------------


@query("P1_rsi_zone", "symbol:s dt:d zone:s", """
SELECT symbol, dt, CASE WHEN rsi IS NULL THEN 'no_data' WHEN rsi < 30 THEN 'oversold' WHEN rsi > 70 THEN 'overbought' ELSE 'neutral' END AS zone FROM feat""")
def _(t):
    return ind.features(t.prices()).withColumn("zone", sig.rsi_zone(F.col("rsi")))


@query("P2_dca_signal", "symbol:s dt:d signal:s", "SELECT symbol, dt, signal FROM sigs")
def _(t):
    return ind.features(t.prices())


@query("P3_technical_label", "label:s n_days:i", """
SELECT CASE WHEN signal IN ('bullish','accumulate') THEN 'bullish' WHEN signal IN ('downtrend','downtrend_watch') THEN 'bearish' ELSE 'neutral' END AS label,
 count(*) AS n_days FROM sigs GROUP BY 1""")
def _(t):
    return ind.features(t.prices()).groupBy(sig.technical_label(F.col("signal")).alias("label")).agg(F.count("*").alias("n_days"))


@query("P4_overall_signal", "symbol:s overall:s", SNAP_SQL + " SELECT symbol, overall FROM z")
def _(t):
    return ind.snapshot(t.prices())


@query("P5_zone_text", "symbol:s dt:d zone:s", """
SELECT symbol, dt, CASE WHEN ma200 IS NOT NULL THEN (CASE WHEN ma50 > ma200 THEN 'Bullish' ELSE 'Bearish' END) || ' | ' ||
 (CASE WHEN close >= ma200 THEN 'Above MA200' ELSE 'Below MA200' END) || ' | RSI: ' ||
 (CASE WHEN rsi < 30 THEN 'Oversold' WHEN rsi > 70 THEN 'Overbought' ELSE 'Neutral' END) END AS zone FROM feat""")
def _(t):
    return ind.features(t.prices()).withColumn(
        "zone", sig.zone_text(F.col("close"), F.col("ma50"), F.col("ma200"), F.col("rsi")))


@query("P6_confluence", "symbol:s daily:s weekly:s confluence:s", """
SELECT l.symbol, l.signal AS daily, w.signal AS weekly, CASE WHEN l.signal = 'no_data' OR w.signal = 'no_data' THEN 'no_data'
 WHEN l.signal IN ('bullish','accumulate') AND w.signal IN ('bullish','accumulate') THEN 'both_up'
 WHEN l.signal IN ('downtrend','downtrend_watch') AND w.signal IN ('downtrend','downtrend_watch') THEN 'both_down'
 WHEN l.signal = w.signal THEN 'equal' ELSE 'mixed' END AS confluence FROM lastrow l JOIN wsig w USING (symbol)""")
def _(t):
    daily = ind.last_row(ind.features(t.prices())).select("symbol", F.col("signal").alias("daily"))
    weekly = ind.weekly_signal(t.prices()).select("symbol", F.col("signal").alias("weekly"))
    return daily.join(weekly, "symbol").withColumn("confluence", sig.confluence(F.col("daily"), F.col("weekly")))


@query("P8_technical_alert", "symbol:s dt:d alert:s rsi_only:b", """
SELECT symbol, dt, CASE WHEN rsi < 30 THEN 'oversold' WHEN rsi > 70 THEN 'overbought' WHEN prev <= ma200 AND ma200 < close THEN 'crossed_above'
 WHEN prev >= ma200 AND ma200 > close THEN 'crossed_below' ELSE 'none' END AS alert,
 coalesce(rn >= 14 AND ma200 IS NOT NULL AND (rsi < 30 OR rsi > 70), false) AS rsi_only FROM feat""")
def _(t):
    r = F.col("rsi")
    return ind.features(t.prices()).withColumns({
        "alert": sig.technical_alert(r, F.col("close"), F.col("prev"), F.col("ma200")),
        "rsi_only": F.coalesce((F.col("rn") >= 14) & F.col("ma200").isNotNull() & ((r < 30) | (r > 70)), F.lit(False))})


# --- drawdowns and trend -----------------------------------------------------------------

CTES["episodes"] = """
SELECT symbol, peak_date, trough_date, recovery_date, depth*100 AS depth_pct, date_diff('day', peak_date, trough_date)/30.44 AS months_to_trough,
  date_diff('day', peak_date, recovery_date)/30.44 AS months_to_recover FROM (
 SELECT symbol, min(prev_dt) AS peak_date, min_by(dt, uw) AS trough_date, CASE WHEN bool_or(next_dt IS NULL) THEN NULL ELSE max(next_dt) END AS recovery_date, min(uw) AS depth FROM (
  SELECT *, rn - row_number() OVER (PARTITION BY symbol, uw < 0 ORDER BY dt) AS grp FROM (
   SELECT symbol, dt, rn, lag(dt) OVER w AS prev_dt, lead(dt) OVER w AS next_dt, close / max(close) OVER w - 1 AS uw FROM px
   WINDOW w AS (PARTITION BY symbol ORDER BY dt))) WHERE uw < 0 GROUP BY symbol, grp) WHERE depth <= -0.1"""


@query("B1_drawdown_episodes", "symbol:s peak_date:d trough_date:d recovery_date:d depth_pct:4 months_to_trough:4 months_to_recover:4",
       "SELECT * FROM episodes")
def _(t):
    return risk.drawdown_episodes(t.prices())


@query("A21_recovery_stats", "symbol:s n_recovered:i n_open:i median_months:4 deepest_recovered_pct:1", """
SELECT symbol, count(recovery_date) AS n_recovered, count(*) - count(recovery_date) AS n_open, median(round(months_to_recover, 1)) AS median_months,
 min(round(depth_pct, 1)) FILTER (WHERE recovery_date IS NOT NULL) AS deepest_recovered_pct FROM episodes GROUP BY 1""")
def _(t):
    return risk.recovery_stats(risk.drawdown_episodes(t.prices()))


CTES["channel"] = """
SELECT symbol, max(n) AS n_rows, stddev_samp(res) AS sigma_log, max_by(res, rn) / stddev_samp(res) AS current_sigma,
 (exp(max(slope)*252) - 1)*100 AS annual_growth_pct, max_by(exp(fit), rn) AS trend FROM (
  SELECT p.symbol, p.rn, p.n, f.slope, f.slope*p.rn + f.icept AS fit, ln(p.close) - (f.slope*p.rn + f.icept) AS res FROM px p JOIN (
   SELECT symbol, regr_slope(ln(close), rn) AS slope, regr_intercept(ln(close), rn) AS icept FROM px GROUP BY 1) f ON f.symbol = p.symbol) GROUP BY 1"""


@query("T10_trend_channel", "symbol:s n_rows:i error:s sigma_log:6 current_sigma:6 annual_growth_pct:4 trend:3 upper_1:3 lower_1:3 upper_2:3 lower_2:3", """
SELECT symbol, n_rows, NULL AS error, sigma_log, current_sigma, annual_growth_pct, trend, trend*exp(sigma_log) AS upper_1,
 trend*exp(-sigma_log) AS lower_1, trend*exp(2*sigma_log) AS upper_2, trend*exp(-2*sigma_log) AS lower_2 FROM channel""")
def _(t):
    return risk.trend_channel(t.prices())


@query("P12_channel_zone", "symbol:s current_sigma:6 zone:s", """
SELECT symbol, current_sigma, CASE WHEN current_sigma >= 1.5 THEN 'upper' WHEN current_sigma <= -1.5 THEN 'lower' ELSE 'middle' END AS zone FROM channel""")
def _(t):
    return risk.trend_channel(t.prices()).withColumn("zone", sig.channel_zone(F.col("current_sigma")))


# --- reports over the panel ----------------------------------------------------------------


@query("A22_weekly_report", "symbol:s rsi:4 ret_1w_pct:4 ret_1m_pct:4 abnormal_rsi:i non_negative_weeks:i", """
WITH cal AS (SELECT dt, row_number() OVER (ORDER BY dt DESC) - 1 AS back FROM (SELECT DISTINCT dt FROM bars)),
e AS (SELECT symbol, max_by(close, dt) AS l, max_by(close, dt) FILTER (WHERE dt <= (SELECT dt FROM cal WHERE back = 5)) AS w,
  max_by(close, dt) FILTER (WHERE dt <= (SELECT dt FROM cal WHERE back = 21)) AS m FROM bars GROUP BY 1)
SELECT symbol, r.rsi, (l/w - 1)*100 AS ret_1w_pct, (l/m - 1)*100 AS ret_1m_pct, count_if(r.rsi < 30 OR r.rsi > 70) OVER () AS abnormal_rsi,
 count_if(l/w - 1 >= 0) OVER () AS non_negative_weeks FROM e JOIN lastrow r USING (symbol)""")
def _(t):
    from tidemark.operators.reports import weekly_report
    return weekly_report(t.prices())


@query("P15_usable_symbols", "symbol:s pos:i", """
SELECT symbol, min(pos) AS pos FROM (SELECT upper(trim(p_type)) AS symbol, p_partkey AS pos FROM part WHERE p_type IN ('STANDARD','ECONOMY','MEDIUM')) GROUP BY 1""")
def _(t):
    from tidemark.operators.reports import requested_symbols
    asked = t.table("part").select(F.lower(F.concat(F.lit(" "), "p_type")).alias("symbol"), F.col("p_partkey").alias("pos"))
    return requested_symbols(asked, ["STANDARD", "ECONOMY", "MEDIUM"])
