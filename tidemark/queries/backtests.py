"""Queries for curves, backtests, tilts, the signal strategy and forecasts."""

from pyspark.sql import functions as F

from tidemark.plans import dynamic_buying as dyn
from tidemark.plans import portfolio_backtest as pb
from tidemark.plans import signal_backtest as sb
from tidemark.queries.oracle_ctes import CTES
from tidemark.queries.registry import query
from tidemark.sources.adapters import BENCHMARK

START, AMOUNT = "1998-01-01", 10000.0
SPANS = {"proxy": "1997-01-01", "real": "1999-06-01"}

# The sample prices jump from day to day, so a daily rebalanced value leaves the range of doubles: curves report the
# logarithm of their growth.
CTES["fpanel"] = """
SELECT symbol, dt, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY dt) AS close FROM (
 SELECT f.symbol, cal.dt, b.close FROM (SELECT symbol, min(dt) AS f FROM bars GROUP BY 1) f JOIN (SELECT DISTINCT dt FROM bars) cal ON cal.dt >= f.f
 LEFT JOIN bars b ON b.symbol = f.symbol AND b.dt = cal.dt)"""


def curve_sql(where: str) -> str:
    return f"""
SELECT portfolio_id, dt, sum(r*weight) AS ret FROM (
 SELECT *, coalesce(close / lag(close) OVER (PARTITION BY portfolio_id, symbol ORDER BY dt) - 1, 0) AS r FROM (
  SELECT w.portfolio_id, w.symbol, w.weight, p.dt, p.close, count(*) OVER (PARTITION BY w.portfolio_id, p.dt) AS c FROM weights w JOIN fpanel p ON p.symbol = w.symbol {where}) WHERE c = 5) GROUP BY 1, 2"""


CTES["pcurve"] = curve_sql("")
CTES["scurve"] = curve_sql(f"WHERE p.dt >= DATE '{START}'")
CTES["both_curves"] = f"""
SELECT s.portfolio_id, s.dt, s.ret, sum(ln(1 + s.ret)) OVER w AS lg, b.ret AS benchmark_ret, b.v AS benchmark_lg FROM scurve s JOIN (
 SELECT dt, ret, sum(ln(1 + ret)) OVER (ORDER BY dt) AS v FROM (SELECT dt, coalesce(close / lag(close) OVER (ORDER BY dt) - 1, 0) AS ret FROM bars WHERE symbol = 'STANDARD' AND dt >= DATE '{START}')) b ON b.dt = s.dt
WINDOW w AS (PARTITION BY s.portfolio_id ORDER BY s.dt)"""


@query("B2_portfolio_curve", "portfolio_id:s dt:d ret:8 log_growth:6", """
SELECT portfolio_id, dt, ret, sum(ln(1 + ret)) OVER (PARTITION BY portfolio_id ORDER BY dt) AS log_growth FROM pcurve""")
def _(t):
    return pb.portfolio_curve(t.prices(), t.weights())


@query("W7_value_curve", "symbol:s dt:d value:3", """
SELECT symbol, dt, 10000*product(1 + ret) OVER (PARTITION BY symbol ORDER BY dt) AS value FROM px WHERE ret IS NOT NULL""")
def _(t):
    from tidemark.operators.panel import daily_returns
    return pb.value_curve(daily_returns(t.prices()), 10000.0, ("symbol",))


@query("J6_curve_and_benchmark", "portfolio_id:s dt:d log_growth:6 benchmark_log_growth:6", "SELECT portfolio_id, dt, sum(ln(1 + ret)) OVER (PARTITION BY portfolio_id ORDER BY dt) AS log_growth, benchmark_log_growth FROM ("
       "SELECT s.portfolio_id, s.dt, s.ret, b.benchmark_lg AS benchmark_log_growth FROM scurve s LEFT JOIN (SELECT DISTINCT dt, benchmark_lg FROM both_curves) b ON b.dt = s.dt) QUALIFY benchmark_log_growth IS NOT NULL")
def _(t):
    return pb.curve_against_benchmark(t.prices(), t.weights(), t.benchmark(), 10000.0, START)


@query("U2_common_dates", "portfolio_id:s n_days:i first_dt:d last_dt:d", """
SELECT portfolio_id, count(*) AS n_days, min(dt) AS first_dt, max(dt) AS last_dt FROM both_curves GROUP BY 1""")
def _(t):
    both = pb.curve_against_benchmark(t.prices(), t.weights(), t.benchmark(), 10000.0, START)
    return both.groupBy("portfolio_id").agg(F.count("*").alias("n_days"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"))


@query("B3_backtest_metrics", "portfolio_id:s curve:s log_growth:6 annual_log_growth:6 max_drawdown_pct:4 sharpe:6", """
WITH full_v AS (SELECT portfolio_id, dt, ret, sum(ln(1 + ret)) OVER (PARTITION BY portfolio_id ORDER BY dt) AS lg FROM scurve),
c AS (SELECT f.portfolio_id, f.dt, unnest(['portfolio', 'benchmark']) AS curve, unnest([f.lg, b.benchmark_lg]) AS v, unnest([f.ret, b.benchmark_ret]) AS r
  FROM full_v f JOIN both_curves b ON b.portfolio_id = f.portfolio_id AND b.dt = f.dt),
d AS (SELECT *, exp(v - max(v) OVER (PARTITION BY portfolio_id, curve ORDER BY dt)) - 1 AS uw FROM c)
SELECT portfolio_id, curve, max_by(v, dt) - min_by(v, dt) AS log_growth, (max_by(v, dt) - min_by(v, dt))*365.25/greatest(date_diff('day', min(dt), max(dt)), 1) AS annual_log_growth,
 min(uw)*100 AS max_drawdown_pct, (avg(r)*252 - 0.02)/(stddev_samp(r)*sqrt(252)) AS sharpe FROM d GROUP BY 1, 2""")
def _(t):
    return pb.backtest_metrics(t.prices(), t.weights(), t.benchmark(), 10000.0, START)


@query("B4_monthly_buying", "portfolio_id:s period:d invested:2 value:3 profit:3 profit_pct:4", """
WITH m AS (SELECT symbol, CAST(date_trunc('month', dt) AS DATE) AS period, min_by(close, dt) AS close FROM fpanel GROUP BY 1, 2),
r AS (SELECT w.portfolio_id, w.symbol, w.weight, m.period, m.close, count(*) OVER (PARTITION BY w.portfolio_id, m.period) AS c FROM weights w JOIN m ON m.symbol = w.symbol),
s AS (SELECT *, sum(1000*weight/close) OVER (PARTITION BY portfolio_id, symbol ORDER BY period) AS sh FROM r WHERE c = 5),
v AS (SELECT portfolio_id, period, sum(sh*close) AS value, 1000*row_number() OVER (PARTITION BY portfolio_id ORDER BY period) AS invested FROM s GROUP BY 1, 2)
SELECT *, value - invested AS profit, (value - invested)/invested*100 AS profit_pct FROM v""")
def _(t):
    return pb.monthly_buying(t.prices(), t.weights(), 1000.0)


# --- dynamic buying ----------------------------------------------------------------------

CTES["bmix"] = """
SELECT w.win, w.start, coalesce(p.proxy, t.symbol) AS symbol, t.weight FROM targets t
CROSS JOIN (VALUES ('proxy', DATE '1997-01-01'), ('real', DATE '1999-06-01')) w(win, start)
LEFT JOIN (VALUES ('proxy', 'LARGE', 'PROMO')) p(win, symbol, proxy) ON p.win = w.win AND p.symbol = t.symbol WHERE t.weight > 0"""
CTES["buys"] = """
SELECT r.win, r.symbol, r.weight, r.dt, r.close FROM (SELECT m.*, b.dt, b.close FROM bmix m JOIN bars b ON b.symbol = m.symbol) r
JOIN (SELECT win, min(dt) AS dt FROM (SELECT m.win, b.dt FROM bmix m JOIN bars b ON b.symbol = m.symbol GROUP BY 1, 2 HAVING count(*) = 5)
 GROUP BY win, date_trunc('month', dt)) f ON f.win = r.win AND f.dt = r.dt WHERE r.dt >= r.start"""
CTES["dfeat"] = """
SELECT f.symbol, f.dt, f.rn, s.pct, stddev_samp(f.ret) OVER (PARTITION BY f.symbol ORDER BY f.rn ROWS 62 PRECEDING) AS vol63,
 (f.close / lag(f.close, 126) OVER (PARTITION BY f.symbol ORDER BY f.rn) - 1) / stddev_samp(f.ret) OVER (PARTITION BY f.symbol ORDER BY f.rn ROWS 125 PRECEDING) AS strength,
 -f.underwater AS depth, f.close/f.ma200 AS ratio FROM feat f LEFT JOIN daily_scores s ON s.symbol = f.symbol AND s.dt = f.dt"""
CTES["dec0"] = """
SELECT b.win, b.symbol, b.weight, b.dt, b.close, f.rn, f.pct, f.vol63, f.strength, f.depth, f.ratio FROM buys b ASOF LEFT JOIN dfeat f ON f.symbol = b.symbol AND b.dt > f.dt"""
CTES["dec"] = """
SELECT d.*, q.n_ratio, q.pctl FROM dec0 d LEFT JOIN (
 SELECT d.symbol, d.rn, count(*) AS n_ratio, avg(CASE WHEN g.ratio <= d.ratio THEN 1.0 ELSE 0.0 END) AS pctl FROM (SELECT DISTINCT symbol, rn, ratio FROM dec0) d
 JOIN dfeat g ON g.symbol = d.symbol AND g.rn <= d.rn AND g.rn > d.rn - 504 WHERE g.ratio IS NOT NULL GROUP BY 1, 2) q ON q.symbol = d.symbol AND q.rn = d.rn"""
CTES["tilts"] = """
SELECT *, greatest(0.8, least(1.2, underwater*inverse_vol)) AS uw_x_ivol FROM (
 SELECT *, 1.0 AS plain, CASE WHEN pct IS NULL THEN 1.0 ELSE 0.6 + 0.8*pct/100 END AS tilt,
  CASE WHEN rn >= 251 THEN least(1.2, 1 + least(greatest(depth, 0), 0.2)) ELSE 1.0 END AS underwater,
  CASE WHEN nv >= 2 AND v IS NOT NULL THEN greatest(0.8, least(1.2, mv/v)) ELSE 1.0 END AS inverse_vol,
  CASE WHEN ns >= 3 AND sds > 0 AND s IS NOT NULL THEN greatest(0.8, least(1.2, 1 + 0.1333*(s - avs)/sds)) ELSE 1.0 END AS rel_strength,
  CASE WHEN rn >= 451 AND n_ratio >= 252 THEN greatest(0.8, least(1.2, 1.2 - 0.4*pctl)) ELSE 1.0 END AS stretch FROM (
  SELECT *, count(v) OVER d AS nv, median(v) OVER d AS mv, count(s) OVER d AS ns, avg(s) OVER d AS avs, stddev_pop(s) OVER d AS sds FROM (
   SELECT *, CASE WHEN rn >= 63 AND vol63 > 0 THEN vol63 END AS v, CASE WHEN rn >= 126 THEN strength END AS s FROM dec)
  WINDOW d AS (PARTITION BY win, dt)))"""
CTES["armrows"] = """
SELECT win, symbol, weight, dt, close, unnest(['plain','tilt','underwater','inverse_vol','rel_strength','stretch','uw_x_ivol']) AS arm,
 unnest([plain, tilt, underwater, inverse_vol, rel_strength, stretch, uw_x_ivol]) AS t FROM tilts
UNION ALL SELECT m.win, 'STANDARD', 1.0, b.dt, b.close, 'benchmark', 1.0 FROM (SELECT DISTINCT win, start FROM bmix) m
 JOIN (SELECT min(dt) AS dt FROM bars WHERE symbol = 'STANDARD' GROUP BY date_trunc('month', dt)) f ON f.dt >= m.start JOIN bars b ON b.symbol = 'STANDARD' AND b.dt = f.dt"""
CTES["sim"] = """
SELECT win, arm, dt, value, invested, vb / lag(value) OVER (PARTITION BY win, arm ORDER BY dt) - 1 AS twr FROM (
 SELECT win, arm, dt, sum(sh*close) AS value, sum((sh - b)*close) AS vb, 10000*row_number() OVER (PARTITION BY win, arm ORDER BY dt) AS invested FROM (
  SELECT *, sum(b) OVER (PARTITION BY win, arm, symbol ORDER BY dt) AS sh FROM (
   SELECT *, weight*t / sum(weight*t) OVER (PARTITION BY win, arm, dt) * 10000/close AS b FROM armrows)) GROUP BY 1, 2, 3)"""
CTES["met"] = """
SELECT win, arm, count(*) AS n_months, round(max(invested), 2) AS total_invested, round(max_by(value, dt), 2) AS final_value, round((max_by(value, dt)/max(invested) - 1)*100, 2) AS pl_pct,
 round((power(max_by(g, dt), 12.0/count(twr)) - 1)*100, 2) AS cagr_pct, round(stddev_samp(twr)*sqrt(12)*100, 2) AS vol_pct, round(avg(twr)/stddev_samp(twr)*sqrt(12), 2) AS sharpe, round(min(dd)*100, 2) AS max_drawdown_pct FROM (
 SELECT *, g / max(g) OVER (PARTITION BY win, arm ORDER BY dt) - 1 AS dd FROM (SELECT *, product(1 + coalesce(twr, 0)) OVER (PARTITION BY win, arm ORDER BY dt) AS g FROM sim)) GROUP BY 1, 2"""
CTES["verd"] = """
SELECT m.win, m.arm, m.final_value > p.final_value AS by_value, coalesce(m.sharpe >= p.sharpe, false) AS by_sharpe,
 m.final_value > p.final_value AND coalesce(m.sharpe >= p.sharpe, false) AS overall FROM met m JOIN met p ON p.win = m.win AND p.arm = 'plain'"""
EDGES = "('underwater','inverse_vol','rel_strength','stretch','uw_x_ivol')"


def mix(t):
    proxies = t.spark.createDataFrame([("proxy", "LARGE", "PROMO")], "win string, symbol string, proxy string")
    return dyn.mapped_mix(t.targets(), SPANS, proxies)


def benchmark_mix(t):
    one = t.targets().filter(F.col("symbol") == BENCHMARK).withColumn("weight", F.lit(1.0))
    none = t.spark.createDataFrame([], "win string, symbol string, proxy string")
    return dyn.mapped_mix(one, SPANS, none)


@query("J12_proxy_mix", "win:s symbol:s weight:4 n_days:i", """
SELECT m.win, m.symbol, m.weight, count(*) AS n_days FROM bmix m JOIN bars b ON b.symbol = m.symbol GROUP BY 1, 2, 3""")
def _(t):
    m = mix(t)
    dyn.require_prices(m, t.prices())
    return t.prices().groupBy("symbol").agg(F.count("*").alias("n_days")).join(m, "symbol")


@query("B5_dynamic_buying", "win:s arm:s dt:d invested:2 value:3 twr:6", "SELECT * FROM sim WHERE arm IN ('plain', 'tilt')")
def _(t):
    return dyn.simulate(dyn.decisions(t.prices(), mix(t)), ("plain", "tilt"), AMOUNT)


@query("B5_final_shares", "win:s arm:s symbol:s shares:4 start_used:d end_used:d", """
SELECT win, arm, symbol, sum(b) AS shares, min(min(dt)) OVER (PARTITION BY win, arm) AS start_used, max(max(dt)) OVER (PARTITION BY win, arm) AS end_used FROM (
 SELECT *, weight*t / sum(weight*t) OVER (PARTITION BY win, arm, dt) * 10000/close AS b FROM armrows WHERE arm IN ('plain', 'tilt')) GROUP BY 1, 2, 3""")
def _(t):
    return dyn.final_shares(dyn.purchases(dyn.decisions(t.prices(), mix(t)), ("plain", "tilt"), AMOUNT))


METRICS = "win:s arm:s n_months:i total_invested:2 final_value:3 pl_pct:3 cagr_pct:3 vol_pct:3 sharpe:3 max_drawdown_pct:3"


@query("B6_arm_metrics", METRICS, "SELECT * FROM met WHERE arm IN ('plain', 'tilt')")
def _(t):
    return dyn.arm_metrics(dyn.simulate(dyn.decisions(t.prices(), mix(t)), ("plain", "tilt"), AMOUNT))


@query("B7_weight_policies", "win:s symbol:s months_neutral:i n_months:i", """
SELECT win, symbol, count_if(pct IS NULL) AS months_neutral, count(*) AS n_months FROM dec GROUP BY 1, 2""")
def _(t):
    return dyn.neutral_counts(dyn.decisions(t.prices(), dyn.mapped_mix(t.targets(), SPANS, t.spark.createDataFrame(
        [("proxy", "LARGE", "PROMO")], "win string, symbol string, proxy string"))))


@query("B8_ab_metrics", METRICS, "SELECT * FROM met WHERE arm IN ('plain', 'tilt', 'benchmark')")
def _(t):
    return dyn.ab_backtest(t.prices(), mix(t), benchmark_mix(t), AMOUNT)[0]


@query("B8_ab_verdict", "win:s arm:s by_value:b by_sharpe:b overall:b", "SELECT * FROM verd WHERE arm = 'tilt'")
def _(t):
    return dyn.ab_backtest(t.prices(), mix(t), benchmark_mix(t), AMOUNT)[1]


@query("B9_edge_tilts", "win:s symbol:s dt:d underwater:6 inverse_vol:6 rel_strength:6 stretch:6 uw_x_ivol:6", "SELECT * FROM tilts")
def _(t):
    return dyn.decisions(t.prices(), mix(t))


@query("W24_cross_symbol_z", "win:s symbol:s dt:d z:6", """
SELECT win, symbol, dt, CASE WHEN sds > 0 THEN (s - avs)/sds END AS z FROM tilts WHERE s IS NOT NULL""")
def _(t):
    rows = dyn.decisions(t.prices(), mix(t)).filter(F.col("str_ok").isNotNull())
    return rows.withColumn("z", F.when(F.col("sd_str") > 0, (F.col("str_ok") - F.col("avg_str")) / F.col("sd_str")))


@query("W25_own_percentile", "symbol:s dt:d n_ratio:i pctl:6", "SELECT DISTINCT symbol, dt, n_ratio, pctl FROM dec WHERE n_ratio >= 252")
def _(t):
    return dyn.decisions(t.prices(), mix(t)).filter(F.col("n_ratio") >= 252).select("symbol", "dt", "n_ratio", "pctl").distinct()


@query("B10_edge_lab", "win:s arm:s by_value:b by_sharpe:b overall:b passes:b", f"""
SELECT *, bool_and(overall) OVER (PARTITION BY arm) AS passes FROM verd WHERE arm IN {EDGES}""")
def _(t):
    return dyn.edge_lab(t.prices(), mix(t), AMOUNT)[1]


# --- signal strategy ---------------------------------------------------------------------

CTES["strat"] = """
SELECT symbol, dt, rn, n, close, ret, CASE WHEN bool_or(e) OVER s THEN e ELSE lo END AS entry, CASE WHEN bool_or(e) OVER s THEN x ELSE hi END AS ex,
 CASE WHEN bool_or(e) OVER s THEN 'rsi_macd_3day_window' ELSE 'rsi_only_fallback' END AS strategy FROM (
 SELECT *, rn >= 2 AND bool_or(lo) OVER w3 AND bool_or(up) OVER w3 AS e, rn >= 2 AND bool_or(hi) OVER w3 AND bool_or(dn) OVER w3 AS x FROM (
  SELECT *, coalesce(rsi < 30, false) AS lo, coalesce(rsi > 70, false) AS hi,
   coalesce(lag(macd) OVER w < lag(macd_signal) OVER w AND macd >= macd_signal, false) AS up, coalesce(lag(macd) OVER w > lag(macd_signal) OVER w AND macd <= macd_signal, false) AS dn
  FROM feat WINDOW w AS (PARTITION BY symbol ORDER BY rn)) WINDOW w3 AS (PARTITION BY symbol ORDER BY rn ROWS 2 PRECEDING)) WINDOW s AS (PARTITION BY symbol)"""
CTES["eq"] = """
SELECT *, 10000*product(f) OVER (PARTITION BY symbol ORDER BY rn) AS equity FROM (
 SELECT *, CASE WHEN was = 1 THEN 1 + ret ELSE 1.0 END * CASE WHEN was = 0 AND pos = 1 THEN 1/1.001 WHEN was = 1 AND pos = 0 THEN 0.999 ELSE 1.0 END AS f,
  sum(CASE WHEN was = 0 AND pos = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY rn) AS trade FROM (
  SELECT *, coalesce(lag(pos) OVER (PARTITION BY symbol ORDER BY rn), 0) AS was FROM (
   SELECT *, coalesce(last_value(CASE WHEN entry AND NOT ex THEN 1 WHEN ex AND NOT entry THEN 0 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY rn), 0) AS pos FROM strat)))"""


@query("B11_strategy_signals", "symbol:s dt:d entry:b exit:b strategy:s", "SELECT symbol, dt, entry, ex AS exit, strategy FROM strat")
def _(t):
    return sb.signals(t.prices())


@query("B12_signal_backtest", "symbol:s strategy:s num_trades:i total_return:4 sharpe_ratio:4 max_drawdown:4 win_rate:4 benchmark_return:4 outperformed:b", """
WITH d AS (SELECT *, equity / max(equity) OVER (PARTITION BY symbol ORDER BY rn) - 1 AS dd FROM eq),
k AS (SELECT symbol, trade, max_by(close, rn) * CASE WHEN bool_or(was = 1 AND pos = 0) THEN 0.999 ELSE 1.0 END > min_by(close, rn)*1.001 AS won FROM eq
  WHERE trade > 0 AND (pos = 1 OR was = 1) GROUP BY 1, 2),
w AS (SELECT symbol, avg(CASE WHEN won THEN 100.0 ELSE 0.0 END) AS wr FROM k GROUP BY 1),
a AS (SELECT symbol, max(strategy) AS strategy, max(trade) AS num_trades, (max_by(equity, rn)/10000 - 1)*100 AS total_return, coalesce(avg(f - 1)/nullif(stddev_samp(f - 1), 0)*sqrt(365), 0) AS sharpe_ratio,
  min(dd)*100 AS max_drawdown, (max_by(close, rn)/min_by(close, rn) - 1)*100 AS benchmark_return FROM d GROUP BY 1)
SELECT a.*, coalesce(wr, 0) AS win_rate, total_return > benchmark_return AS outperformed FROM a LEFT JOIN w ON w.symbol = a.symbol""")
def _(t):
    return sb.run(t.prices())


CTES["parts"] = """
SELECT symbol, part, dt, close, row_number() OVER q - 1 AS rn, lag(close) OVER q AS prev, close/lag(close) OVER q - 1 AS ret FROM (
 SELECT symbol, dt, close, CASE WHEN rn < floor(n*0.7) THEN 'train' ELSE 'test' END AS part FROM px WHERE floor(n*0.7) >= 60 AND n - floor(n*0.7) >= 30)
WINDOW q AS (PARTITION BY symbol, part ORDER BY dt)"""


def wilder(n: int) -> str:
    return (f"e.g{n}*{n - 1}/{n} + greatest(p.close - p.prev, 0)/{n}, e.l{n}*{n - 1}/{n} + greatest(p.prev - p.close, 0)/{n}")


CTES["pewm"] = f"""
SELECT symbol, part, rn, CAST(NULL AS DOUBLE) AS g7, CAST(NULL AS DOUBLE) AS l7, CAST(NULL AS DOUBLE) AS g10, CAST(NULL AS DOUBLE) AS l10, CAST(NULL AS DOUBLE) AS g14, CAST(NULL AS DOUBLE) AS l14,
 CAST(NULL AS DOUBLE) AS g21, CAST(NULL AS DOUBLE) AS l21, close AS e12, close AS e26, CAST(NULL AS DOUBLE) AS sig FROM parts WHERE rn = 0
UNION ALL
SELECT p.symbol, p.part, p.rn, {", ".join(f"CASE WHEN p.rn = 1 THEN greatest(p.close - p.prev, 0) ELSE {wilder(n).split(', e.')[0]} END, CASE WHEN p.rn = 1 THEN greatest(p.prev - p.close, 0) ELSE e.{wilder(n).split(', e.')[1]} END" for n in (7, 10, 14, 21))},
 e.e12*11/13 + p.close*2/13, e.e26*25/27 + p.close*2/27,
 CASE WHEN p.rn < 25 THEN NULL WHEN p.rn = 25 THEN (e.e12*11/13 + p.close*2/13) - (e.e26*25/27 + p.close*2/27) ELSE e.sig*0.8 + 0.2*((e.e12*11/13 + p.close*2/13) - (e.e26*25/27 + p.close*2/27)) END
FROM pewm e JOIN parts p ON p.symbol = e.symbol AND p.part = e.part AND p.rn = e.rn + 1"""
CTES["gridrows"] = """
SELECT symbol, part, rn, ret, period, thr, CASE WHEN bool_or(e) OVER s THEN e ELSE lo END AS entry, CASE WHEN bool_or(e) OVER s THEN x ELSE hi END AS ex FROM (
 SELECT *, rn >= 2 AND bool_or(lo) OVER w3 AND bool_or(up) OVER w3 AS e, rn >= 2 AND bool_or(hi) OVER w3 AND bool_or(dn) OVER w3 AS x FROM (
  SELECT *, coalesce(rsi < thr, false) AS lo, coalesce(rsi > 70, false) AS hi, coalesce(lag(m) OVER w < lag(ms) OVER w AND m >= ms, false) AS up, coalesce(lag(m) OVER w > lag(ms) OVER w AND m <= ms, false) AS dn FROM (
   SELECT *, CASE WHEN rn >= period THEN CASE WHEN l = 0 THEN 100 ELSE 100 - 100/(1 + g/l) END END AS rsi FROM (
    SELECT p.symbol, p.part, p.rn, p.ret, unnest([7, 10, 14, 21]) AS period, unnest([g7, g10, g14, g21]) AS g, unnest([l7, l10, l14, l21]) AS l,
     CASE WHEN p.rn >= 25 THEN e12 - e26 END AS m, CASE WHEN p.rn >= 33 THEN sig END AS ms FROM parts p JOIN pewm e ON e.symbol = p.symbol AND e.part = p.part AND e.rn = p.rn))
   CROSS JOIN (VALUES (25), (30), (35)) v(thr) WINDOW w AS (PARTITION BY symbol, part, period, thr ORDER BY rn))
 WINDOW w3 AS (PARTITION BY symbol, part, period, thr ORDER BY rn ROWS 2 PRECEDING)) WINDOW s AS (PARTITION BY symbol, part, period, thr)"""
CTES["gridscore"] = """
SELECT symbol, part, period, thr, CASE WHEN max(pos) = 1 THEN coalesce(avg(f - 1)/nullif(stddev_samp(f - 1), 0)*sqrt(365), 0) ELSE 0 END AS sharpe FROM (
 SELECT *, CASE WHEN was = 1 THEN 1 + ret ELSE 1.0 END * CASE WHEN was = 0 AND pos = 1 THEN 1/1.001 WHEN was = 1 AND pos = 0 THEN 0.999 ELSE 1.0 END AS f FROM (
  SELECT *, coalesce(lag(pos) OVER q, 0) AS was FROM (
   SELECT *, coalesce(last_value(CASE WHEN entry AND NOT ex THEN 1 WHEN ex AND NOT entry THEN 0 END IGNORE NULLS) OVER q, 0) AS pos FROM gridrows WINDOW q AS (PARTITION BY symbol, part, period, thr ORDER BY rn))
  WINDOW q AS (PARTITION BY symbol, part, period, thr ORDER BY rn))) GROUP BY 1, 2, 3, 4"""


CTES["partdays"] = "SELECT symbol, part, min(dt) AS first_day, max(dt) AS last_day FROM parts GROUP BY 1, 2"


@query("J10_parameter_grid", "symbol:s rsi_period:i rsi_oversold:1 sharpe:4 first_day:d last_day:d", """
SELECT g.symbol, period AS rsi_period, thr AS rsi_oversold, sharpe, first_day, last_day FROM gridscore g JOIN partdays d ON d.symbol = g.symbol AND d.part = g.part WHERE g.part = 'train'""")
def _(t):
    return sb.search(t.prices())[0]


@query("B13_parameter_search", "symbol:s rsi_period:i rsi_oversold:1 train_sharpe:4 test_sharpe:4 train_start:d train_end:d test_start:d test_end:d", """
SELECT a.symbol, a.period AS rsi_period, a.thr AS rsi_oversold, greatest(a.sharpe, 0) AS train_sharpe, b.sharpe AS test_sharpe,
 x.first_day AS train_start, x.last_day AS train_end, y.first_day AS test_start, y.last_day AS test_end FROM (
 SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY sharpe DESC, period, thr) AS r FROM gridscore WHERE part = 'train') a
JOIN gridscore b ON b.symbol = a.symbol AND b.part = 'test' AND b.period = a.period AND b.thr = a.thr
JOIN partdays x ON x.symbol = a.symbol AND x.part = 'train' JOIN partdays y ON y.symbol = a.symbol AND y.part = 'test' WHERE a.r = 1""")
def _(t):
    return sb.search(t.prices())[1]


# --- walk-forward ------------------------------------------------------------------------

CTES["frows"] = """
SELECT *, regr_slope(y, x) OVER w AS slope, regr_intercept(y, x) OVER w AS icept FROM (
 SELECT symbol, dt, close, ln(close) AS y, date_diff('day', first_value(dt) OVER (PARTITION BY symbol ORDER BY dt), dt) AS x, row_number() OVER (PARTITION BY symbol ORDER BY dt) AS n_train
 FROM feat WHERE rsi IS NOT NULL AND vol_ma20 IS NOT NULL) WINDOW w AS (PARTITION BY symbol ORDER BY dt ROWS UNBOUNDED PRECEDING)"""
CTES["begins"] = """
SELECT symbol, 0 AS fold, min(dt) AS b, max(dt) AS d1 FROM frows GROUP BY 1
UNION ALL SELECT symbol, fold + 1, CAST(b + INTERVAL 1 MONTH AS DATE), d1 FROM begins WHERE b + INTERVAL 6 MONTH <= d1"""
CTES["wfolds"] = """
SELECT symbol, fold, CAST(b + INTERVAL 6 MONTH AS DATE) AS train_end, CAST(b + INTERVAL 6 MONTH + INTERVAL 30 DAY AS DATE) AS test_end FROM begins WHERE CAST(b + INTERVAL 6 MONTH + INTERVAL 30 DAY AS DATE) <= d1"""


@query("J13_fold_ranges", "symbol:s fold:i train_end:d test_end:d n_train:i n_test:i", """
SELECT f.symbol, f.fold, f.train_end, f.test_end, count_if(r.dt < f.train_end) AS n_train, count_if(r.dt >= f.train_end AND r.dt < f.test_end) AS n_test
FROM wfolds f JOIN frows r ON r.symbol = f.symbol GROUP BY 1, 2, 3, 4""")
def _(t):
    rows = sb.forecast_rows(t.bars())
    plan = sb.folds(rows)
    # rows before a day = the row number of the last row before it, so both counts are look-ups
    from tidemark.operators.asof import asof_lookup
    at = plan.select("symbol", F.explode(F.array("train_end", "test_end")).alias("day")).distinct()
    upto = asof_lookup(at, rows, "day", "dt", ["n_train"], by=["symbol"], strict=True).select("symbol", "day", "n_train")
    a, b = upto.select("symbol", F.col("day").alias("train_end"), "n_train"), upto.select("symbol", F.col("day").alias("test_end"), F.col("n_train").alias("n_all"))
    return plan.join(a, ["symbol", "train_end"]).join(b, ["symbol", "test_end"]).withColumn("n_test", F.col("n_all") - F.col("n_train"))


@query("B14_walk_forward", "symbol:s model:s mae:3 rmse:3 mape:3 n_folds:i", """
WITH t AS (SELECT f.symbol, f.fold, r.close AS actual, m.close AS last, exp(m.icept + m.slope*r.x) AS lt FROM wfolds f
 JOIN (SELECT f.symbol, f.fold, r.close, r.slope, r.icept, r.n_train FROM wfolds f ASOF JOIN frows r ON r.symbol = f.symbol AND f.train_end > r.dt) m ON m.symbol = f.symbol AND m.fold = f.fold AND m.n_train >= 50
 JOIN frows r ON r.symbol = f.symbol AND r.dt >= f.train_end AND r.dt < f.test_end),
u AS (SELECT symbol, fold, actual, unnest(['last_value', 'log_trend']) AS model, unnest([last, lt]) AS yhat FROM t),
e AS (SELECT symbol, model, fold, avg(abs(actual - yhat)) AS mae, sqrt(avg((actual - yhat)*(actual - yhat))) AS rmse, avg(abs((actual - yhat)/actual))*100 AS mape FROM u GROUP BY 1, 2, 3 HAVING count(*) >= 5)
SELECT symbol, model, avg(mae) AS mae, avg(rmse) AS rmse, avg(mape) AS mape, count(*) AS n_folds FROM e GROUP BY 1, 2""")
def _(t):
    return sb.walk_forward(t.bars())


@query("B15_forecast_trend", "symbol:s forecast:3 change_pct:4 trend:s", """
WITH l AS (SELECT symbol, max_by(close, dt) AS c, exp(max_by(icept, dt) + max_by(slope, dt)*(max(x) + 30)) AS f FROM frows GROUP BY 1)
SELECT symbol, f AS forecast, (f/c - 1)*100 AS change_pct, CASE WHEN (f/c - 1)*100 > 1 THEN 'up' WHEN (f/c - 1)*100 < -1 THEN 'down' ELSE 'sideways' END AS trend FROM l""")
def _(t):
    return sb.forecast_trend(t.bars())


# --- stress context ------------------------------------------------------------------------


def segment_shares(t):
    """Shares per customer segment: the segment stands for one large portfolio."""
    seg = t.table("customer").select(F.col("c_custkey").alias("portfolio_id"), "c_mktsegment")
    tx = t.transactions().filter("tx_type <> 'dividend'").groupBy("portfolio_id", "ticker").agg(F.sum("shares").alias("shares"))
    return (tx.join(seg, "portfolio_id").groupBy(F.col("c_mktsegment").alias("portfolio_id"), F.col("ticker").alias("symbol"))
            .agg(F.sum("shares").alias("shares")))


CTES["stress_curve"] = """
SELECT portfolio_id, dt, v AS close, row_number() OVER (PARTITION BY portfolio_id ORDER BY dt) AS rn, v / max(v) OVER (PARTITION BY portfolio_id ORDER BY dt) - 1 AS uw FROM (
 SELECT s.portfolio_id, b.dt, sum(s.sh*b.close) AS v FROM (SELECT c_mktsegment AS portfolio_id, ticker, sum(shares) AS sh FROM transactions JOIN customer ON c_custkey = portfolio_id
  WHERE tx_type <> 'dividend' GROUP BY 1, 2) s JOIN bars b ON b.symbol = s.ticker GROUP BY 1, 2 HAVING count(*) = 6)"""


@query("B20_stress_curve", "portfolio_id:s dt:d close:1 underwater:6", "SELECT portfolio_id, dt, close, uw AS underwater FROM stress_curve")
def _(t):
    return pb.stress_context(t.prices(), segment_shares(t))[0]


@query("B20_stress_summary", "portfolio_id:s n_recovered:i n_open:i median_months:4 deepest_recovered_pct:1", """
WITH g AS (SELECT *, rn - row_number() OVER (PARTITION BY portfolio_id, uw < 0 ORDER BY dt) AS grp, lag(dt) OVER w AS pd, lead(dt) OVER w AS nd FROM stress_curve WINDOW w AS (PARTITION BY portfolio_id ORDER BY dt)),
e AS (SELECT portfolio_id, min(uw)*100 AS depth, min(pd) AS peak, CASE WHEN bool_or(nd IS NULL) THEN NULL ELSE max(nd) END AS rec FROM g WHERE uw < 0 GROUP BY portfolio_id, grp HAVING min(uw) <= -0.1)
SELECT portfolio_id, count(rec) AS n_recovered, count(*) - count(rec) AS n_open, median(round(date_diff('day', peak, rec)/30.44, 1)) AS median_months,
 min(round(depth, 1)) FILTER (WHERE rec IS NOT NULL) AS deepest_recovered_pct FROM e GROUP BY 1""")
def _(t):
    return pb.stress_context(t.prices(), segment_shares(t))[2]
