"""Shared CTEs of the check SQL (DuckDB dialect).

They state the domain tables and indicators in plain SQL. Recursive averages use a recursive
CTE here, unlike the Spark jobs, so that a check does not share the recipe it tests.
"""

CTES: dict[str, str] = {}

CTES["bars"] = """
SELECT p_type AS symbol, CAST(l_shipdate AS DATE) AS dt,
       min_by(l_extendedprice/l_quantity, l_orderkey*10+l_linenumber) AS open,
       max(l_extendedprice/l_quantity) AS high, min(l_extendedprice/l_quantity) AS low,
       avg(l_extendedprice/l_quantity) AS close, sum(l_quantity) AS volume
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type, CAST(l_shipdate AS DATE)"""

CTES["px"] = """
SELECT *, close/prev - 1 AS ret FROM (
  SELECT symbol, dt, open, high, low, close, volume,
         row_number() OVER (PARTITION BY symbol ORDER BY dt) - 1 AS rn,
         count(*) OVER (PARTITION BY symbol) AS n,
         lag(close) OVER (PARTITION BY symbol ORDER BY dt) AS prev FROM bars)"""

CTES["latest"] = "SELECT symbol, max_by(close, dt) AS price, max(dt) AS dt FROM bars GROUP BY symbol"

# rn counts from 0; gains start at rn 1, the MACD line at rn 25
CTES["ewm"] = """
SELECT symbol, rn, CAST(NULL AS DOUBLE) AS ag, CAST(NULL AS DOUBLE) AS al, close AS e12, close AS e26,
       CAST(NULL AS DOUBLE) AS sig FROM px WHERE rn = 0
UNION ALL
SELECT p.symbol, p.rn,
  CASE WHEN p.rn = 1 THEN greatest(p.close - p.prev, 0) ELSE e.ag*13/14 + greatest(p.close - p.prev, 0)/14 END,
  CASE WHEN p.rn = 1 THEN greatest(p.prev - p.close, 0) ELSE e.al*13/14 + greatest(p.prev - p.close, 0)/14 END,
  e.e12*11/13 + p.close*2/13, e.e26*25/27 + p.close*2/27,
  CASE WHEN p.rn < 25 THEN NULL
       WHEN p.rn = 25 THEN (e.e12*11/13 + p.close*2/13) - (e.e26*25/27 + p.close*2/27)
       ELSE e.sig*0.8 + 0.2*((e.e12*11/13 + p.close*2/13) - (e.e26*25/27 + p.close*2/27)) END
FROM ewm e JOIN px p ON p.symbol = e.symbol AND p.rn = e.rn + 1"""

CTES["feat"] = """
SELECT p.*,
  CASE WHEN p.rn >= 14 THEN CASE WHEN e.al = 0 THEN 100 ELSE 100 - 100/(1 + e.ag/e.al) END END AS rsi,
  CASE WHEN p.rn >= 25 THEN e.e12 - e.e26 END AS macd,
  CASE WHEN p.rn >= 33 THEN e.sig END AS macd_signal,
  CASE WHEN p.rn >= 33 THEN e.e12 - e.e26 - e.sig END AS macd_hist,
  CASE WHEN p.rn >= 19 THEN avg(close) OVER w20 END AS ma20,
  CASE WHEN p.rn >= 49 THEN avg(close) OVER w50 END AS ma50,
  CASE WHEN p.rn >= 199 THEN avg(close) OVER w200 END AS ma200,
  CASE WHEN p.rn >= 19 THEN stddev_pop(close) OVER w20 END AS sd20,
  CASE WHEN p.rn >= 19 THEN avg(volume) OVER w20 END AS vol_ma20,
  sum(ret) OVER w21 * 100 AS mom_1m, sum(ret) OVER w63 * 100 AS mom_3m,
  min(close) OVER w60 AS low60, max(close) OVER w60 AS high60,
  close / max(close) OVER wc - 1 AS underwater
FROM px p JOIN ewm e ON p.symbol = e.symbol AND p.rn = e.rn
WINDOW w20 AS (PARTITION BY p.symbol ORDER BY p.rn ROWS 19 PRECEDING),
  w21 AS (PARTITION BY p.symbol ORDER BY p.rn ROWS 20 PRECEDING),
  w50 AS (PARTITION BY p.symbol ORDER BY p.rn ROWS 49 PRECEDING),
  w60 AS (PARTITION BY p.symbol ORDER BY p.rn ROWS 59 PRECEDING),
  w63 AS (PARTITION BY p.symbol ORDER BY p.rn ROWS 62 PRECEDING),
  w200 AS (PARTITION BY p.symbol ORDER BY p.rn ROWS 199 PRECEDING),
  wc AS (PARTITION BY p.symbol ORDER BY p.rn)"""

_SIGNAL = """CASE WHEN {p} IS NULL OR {m200} IS NULL OR {r} IS NULL THEN 'no_data'
  WHEN {r} > 70 THEN 'overbought_caution'
  WHEN {r} < 30 THEN CASE WHEN {p} >= {m200} THEN 'accumulate' ELSE 'downtrend_watch' END
  WHEN {p} >= {m200} THEN CASE WHEN {m50} IS NOT NULL AND {p} >= {m50} THEN 'bullish' ELSE 'neutral' END
  ELSE 'downtrend' END"""


def signal_sql(p: str, m50: str, m200: str, r: str) -> str:
    return _SIGNAL.format(p=p, m50=m50, m200=m200, r=r)


CTES["sigs"] = f"SELECT *, {signal_sql('close', 'ma50', 'ma200', 'rsi')} AS signal FROM feat"
CTES["lastrow"] = "SELECT * FROM sigs WHERE rn = n - 1"

CTES["transactions"] = """
SELECT o_custkey AS portfolio_id,
       concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS tx_id,
       CAST(l_shipdate AS DATE) AS date, p_type AS ticker,
       CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE l_quantity END AS shares,
       CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE l_extendedprice/l_quantity END AS price_usd,
       33.5 + l_tax*10 AS fx_rate_thb,
       l_extendedprice * (33.5 + l_tax*10) * CASE WHEN l_returnflag = 'R' THEN 0.01 ELSE 1.0 END AS amount_thb,
       CASE WHEN l_linestatus = 'F' THEN NULL ELSE l_extendedprice * 0.05 END AS fee_thb,
       CASE WHEN l_returnflag = 'R' THEN 'dividend' ELSE 'buy' END AS tx_type
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"""

CTES["cashflow_tx"] = """
SELECT o_custkey AS household_id, CAST(o_orderdate AS DATE) AS date,
       CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END AS amount,
       o_orderpriority AS category,
       CASE WHEN o_orderstatus = 'F' THEN 'income' ELSE 'expense' END AS type
FROM orders"""

CTES["sentiment_results"] = """
SELECT source AS symbol, d.doc_id AS doc_id, text AS title,
       CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS sentiment,
       CAST(least(1.0, n_chars/5000.0) AS DOUBLE) AS confidence
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""

CTES["ticks"] = "SELECT event_type AS symbol, ts, value AS price, event_id FROM events"

CTES["goals"] = """
SELECT c_custkey AS goal_id, CAST(100000 + c_custkey*100 AS DOUBLE) AS target_amount,
       greatest(c_acctbal, 0.0) AS current_amount,
       CAST(500 + (c_custkey % 50)*20 AS DOUBLE) AS monthly_contribution,
       12 + c_custkey % 120 AS months_remaining,
       CASE c_nationkey % 3 WHEN 0 THEN 'conservative' WHEN 1 THEN 'moderate' ELSE 'aggressive' END AS risk_profile
FROM customer"""

CTES["risk_profiles"] = """
SELECT c_custkey AS household_id,
       CASE c_custkey % 4 WHEN 0 THEN 'very_stable' WHEN 1 THEN 'stable' WHEN 2 THEN 'unstable' ELSE 'freelance' END AS job_stability,
       c_custkey % 6 AS dependents,
       CASE c_nationkey % 4 WHEN 0 THEN 'salary' WHEN 1 THEN 'mixed' WHEN 2 THEN 'freelance' ELSE 'business' END AS income_type,
       c_custkey % 2 = 0 AS has_health_insurance,
       CASE c_custkey % 5 WHEN 0 THEN 'government' WHEN 1 THEN 'startup' WHEN 2 THEN 'self_employed' ELSE 'other' END AS industry,
       CAST(1000 + c_custkey AS DOUBLE) AS monthly_expense, greatest(c_acctbal, 0.0) AS current_savings,
       CAST(c_custkey % 7 AS DOUBLE)*100 AS monthly_saving_capacity
FROM customer"""

CTES["debts"] = """
SELECT c_nationkey AS household_id, c_custkey AS debt_id, abs(c_acctbal) + 1 AS balance,
       CAST(3 + c_custkey % 20 AS DOUBLE) AS interest_rate, CAST(20 + c_custkey % 30 AS DOUBLE) AS min_payment
FROM customer"""

CTES["fundamentals"] = """
SELECT p_type AS symbol, avg(p_size)/2 AS trailing_pe, avg(p_retailprice)/1000 AS dividend_rate,
       CASE p_type WHEN 'PROMO' THEN 0.0 ELSE 0.8 + avg(p_size)/100 END AS beta,
       CAST(CASE p_type WHEN 'SMALL' THEN NULL WHEN 'LARGE' THEN 3.5 ELSE 0.025 END AS DOUBLE) AS dividend_yield
FROM part GROUP BY p_type"""

CTES["networth_lines"] = """
SELECT o_custkey AS household_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS snapshot_date,
       o_orderkey AS snapshot_line_id, o_orderpriority AS name,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'etf' ELSE 'cash' END AS type,
       CASE WHEN o_orderstatus = 'P' THEN 'liability' ELSE 'asset' END AS side, o_totalprice AS value_thb
FROM orders"""

CTES["macro_monthly"] = """
SELECT 'CPI' AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS dt, avg(o_totalprice) AS value
FROM orders GROUP BY CAST(date_trunc('month', o_orderdate) AS DATE)
UNION ALL
SELECT 'FEDFUNDS', CAST(date_trunc('month', o_orderdate) AS DATE), avg(o_custkey)/100
FROM orders GROUP BY CAST(date_trunc('month', o_orderdate) AS DATE)"""

CTES["macro_daily"] = """
SELECT CAST(o_orderdate AS DATE) AS dt, CAST(count(*) % 31 + 10 AS DOUBLE) AS vix, avg(o_totalprice)/1000 AS dxy,
       CAST(count(*) % 21 + 30 AS DOUBLE) AS tnx
FROM orders GROUP BY CAST(o_orderdate AS DATE)"""

CTES["macro"] = """
SELECT series_id, dt, value FROM macro_monthly
UNION ALL SELECT 'VIX', dt, vix FROM macro_daily
UNION ALL SELECT 'DXY', dt, dxy FROM macro_daily
UNION ALL SELECT 'TNX', dt, tnx FROM macro_daily"""

CTES["news"] = """
SELECT 'ALL' AS symbol, html AS title, url, page_id % 30 AS age_days, page_id, 1 AS source_priority FROM pages
UNION ALL
SELECT 'ALL', html, url, page_id % 30, page_id, 2 FROM pages WHERE page_id % 5 = 0"""

CTES["alerts"] = """
SELECT symbol || '-above' AS alert_id, symbol AS ticker, 'above' AS alert_type, price * 1.02 AS target FROM latest
UNION ALL SELECT symbol || '-below', symbol, 'below', price * 0.98 FROM latest"""

CTES["quotes"] = """
SELECT symbol, 1 AS source_priority, CASE WHEN symbol = 'SMALL' THEN 0.0 ELSE price END AS price FROM latest WHERE symbol <> 'PROMO'
UNION ALL SELECT symbol, 2, price * 1.001 FROM latest
UNION ALL SELECT symbol, 3, price * 1.002 FROM latest"""

CTES["targets"] = """
SELECT * FROM (VALUES ('STANDARD', CAST(0.35 AS DOUBLE), 0), ('ECONOMY', 0.25, 1), ('MEDIUM', 0.20, 2),
  ('SMALL', 0.10, 3), ('LARGE', 0.10, 4), ('PROMO', 0.0, 5)) AS t(symbol, weight, ord)"""

CTES["weights"] = """
SELECT * FROM (VALUES
  ('conservative', 'STANDARD', CAST(0.30 AS DOUBLE), 0), ('conservative', 'ECONOMY', 0.30, 1), ('conservative', 'MEDIUM', 0.10, 2),
  ('conservative', 'SMALL', 0.20, 3), ('conservative', 'LARGE', 0.10, 4),
  ('moderate', 'STANDARD', 0.35, 0), ('moderate', 'ECONOMY', 0.25, 1), ('moderate', 'MEDIUM', 0.20, 2),
  ('moderate', 'SMALL', 0.10, 3), ('moderate', 'LARGE', 0.10, 4),
  ('aggressive', 'STANDARD', 0.25, 0), ('aggressive', 'ECONOMY', 0.10, 1), ('aggressive', 'MEDIUM', 0.45, 2),
  ('aggressive', 'SMALL', 0.10, 3), ('aggressive', 'LARGE', 0.10, 4)) AS t(portfolio_id, symbol, weight, ord)"""
