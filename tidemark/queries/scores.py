"""Queries for scores, plans, screens, rebalancing and valuation."""

from pyspark.sql import functions as F

from tidemark.functions import signals as sig
from tidemark.operators import allocation as al
from tidemark.operators import indicators as ind
from tidemark.operators import scoring as sc
from tidemark.operators import valuation as va
from tidemark.queries.oracle_ctes import CTES
from tidemark.operators.ranking import numbered
from tidemark.queries.registry import query
from tidemark.sources.adapters import TARGETS

BUDGET = 12300.0

_PARTS = """CASE WHEN close >= ma200 THEN CASE WHEN close >= ma50 THEN 40 ELSE 30 END ELSE CASE WHEN close >= ma50 THEN 10 ELSE 0 END END AS trend_score,
 CASE WHEN rsi < 30 THEN CASE WHEN close >= ma200 THEN 30 ELSE 10 END WHEN rsi > 70 THEN 0 WHEN rsi < 50 THEN 20 ELSE 10 END AS timing_score,
 CASE WHEN mom_1m > 0 THEN 10 ELSE 0 END + CASE WHEN mom_3m > 0 THEN 10 ELSE 0 END AS momentum_score"""

CTES["scores"] = f"""
SELECT *, trend_score + timing_score + momentum_score + dividend_score AS total_score,
  round((trend_score + timing_score + momentum_score + dividend_score) * 100.0 / max_score, 1) AS total_pct FROM (
 SELECT l.symbol, close, rsi, ma50, ma200, mom_1m, mom_3m, signal, {_PARTS},
  CASE WHEN dy > 0.04 THEN 10 WHEN dy > 0.02 THEN 5 WHEN dy > 0 THEN 2 ELSE 0 END AS dividend_score,
  CASE WHEN dy IS NULL THEN 90 ELSE 100 END AS max_score
 FROM lastrow l LEFT JOIN (SELECT symbol, CASE WHEN dividend_yield > 1 THEN dividend_yield/100 WHEN dividend_yield >= 0 THEN dividend_yield END AS dy FROM fundamentals) f ON f.symbol = l.symbol)"""
CTES["labels_of"] = """
SELECT symbol, CASE WHEN total_pct >= 70 THEN 'Strong Buy' WHEN total_pct >= 55 THEN 'Buy' WHEN total_pct >= 40 THEN 'Neutral'
 WHEN total_pct >= 25 THEN 'Caution' ELSE 'Avoid' END AS label FROM scores"""


@query("C1_component_scores", "symbol:s dt:d trend_score:i timing_score:i momentum_score:i",
       f"SELECT symbol, dt, {_PARTS} FROM feat WHERE rn >= 199")
def _(t):
    return sc.with_scores(ind.features(t.prices())).filter("data_ok")


@query("C2_symbol_scores", "symbol:s data_ok:b price:2 ma50:2 ma200:2 rsi:4 mom_1m:4 mom_3m:4 total_score:i max_score:i total_pct:1 label:s signal:s", """
SELECT s.symbol, true AS data_ok, close AS price, ma50, ma200, rsi, mom_1m, mom_3m, total_score, max_score, total_pct, label, signal
FROM scores s JOIN labels_of USING (symbol)""")
def _(t):
    return sc.symbol_scores(t.prices(), t.fundamentals()).withColumnRenamed("close", "price")


@query("C3_yield_repair", "symbol:s div_yield:6", """
SELECT symbol, CASE WHEN dividend_yield > 1 THEN dividend_yield/100 WHEN dividend_yield >= 0 THEN dividend_yield END AS div_yield FROM fundamentals""")
def _(t):
    return t.fundamentals().withColumn("div_yield", sig.repaired_yield(F.col("dividend_yield")))


CTES["daily_scores"] = f"""
SELECT symbol, dt, round((trend_score + timing_score + momentum_score) * 100.0 / 90, 1) AS pct FROM (SELECT symbol, dt, {_PARTS} FROM feat WHERE rn >= 199)"""


@query("C4_score_tilt", "symbol:s dt:d total_pct:1 tilt:6",
       "SELECT symbol, dt, pct AS total_pct, 0.6 + 0.8*pct/100 AS tilt FROM daily_scores")
def _(t):
    return sc.with_scores(ind.features(t.prices())).filter("data_ok").withColumn("tilt", sig.score_tilt(F.col("total_pct")))


@query("P14_score_label", "label:s n_days:i", """
SELECT CASE WHEN pct >= 70 THEN 'Strong Buy' WHEN pct >= 55 THEN 'Buy' WHEN pct >= 40 THEN 'Neutral' WHEN pct >= 25 THEN 'Caution' ELSE 'Avoid' END AS label,
 count(*) AS n_days FROM daily_scores GROUP BY 1""")
def _(t):
    df = sc.with_scores(ind.features(t.prices())).filter("data_ok")
    return df.groupBy(sig.score_label(F.col("total_pct")).alias("label")).agg(F.count("*").alias("n_days"))


CTES["plan"] = """
SELECT portfolio_id, symbol, weight, total_pct, (fl + CASE WHEN rk <= 123 - sum(fl) OVER (PARTITION BY portfolio_id) THEN 1 ELSE 0 END) * 100 AS amount FROM (
 SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY ex - fl DESC, total_pct DESC, ord) AS rk FROM (
  SELECT *, floor(ex) AS fl FROM (
   SELECT w.*, s.total_pct, w.weight*(0.6 + 0.8*s.total_pct/100) / sum(w.weight*(0.6 + 0.8*s.total_pct/100)) OVER (PARTITION BY w.portfolio_id) * 123 AS ex
   FROM weights w JOIN scores s ON s.symbol = w.symbol)))"""


@query("C5_budget_allocation", "portfolio_id:s symbol:s amount:i percent:1 target_percent:1 tilt:4 label:s score:1", """
SELECT portfolio_id, p.symbol, amount, amount/12300.0*100 AS percent, weight*100 AS target_percent, 0.6 + 0.8*total_pct/100 AS tilt, label, total_pct AS score
FROM plan p JOIN labels_of l ON l.symbol = p.symbol WHERE amount > 0""")
def _(t):
    return al.allocate_budget(sc.symbol_scores(t.prices(), t.fundamentals()), t.weights(), BUDGET)


@query("C17_plan_rollup", "portfolio_id:s allocated:i unallocated:2 n_no_data:i", """
SELECT portfolio_id, sum(amount) AS allocated, 12300.0 - sum(amount) AS unallocated, 0 AS n_no_data FROM plan GROUP BY 1""")
def _(t):
    scores = sc.symbol_scores(t.prices(), t.fundamentals())
    return al.plan_rollup(al.allocate_budget(scores, t.weights(), BUDGET), scores, BUDGET)


@query("C12_order_list", "portfolio_id:s symbol:s amount:i usd:4 est_shares:6 fee_thb:4", """
SELECT portfolio_id, p.symbol, amount, amount/33.5 AS usd, amount/33.5/k.price AS est_shares, amount*0.0015 AS fee_thb
FROM plan p LEFT JOIN latest k ON k.symbol = p.symbol WHERE amount > 0""")
def _(t):
    plan = al.allocate_budget(sc.symbol_scores(t.prices(), t.fundamentals()), t.weights(), BUDGET)
    return al.order_list(plan, t.latest(), 33.5)


@query("C6_target_weights", "portfolio_id:s symbol:s weight:6", """
WITH a AS (SELECT c.portfolio_id, b.symbol FROM (VALUES ('a'), ('b')) c(portfolio_id) CROSS JOIN (SELECT DISTINCT p_type AS symbol FROM part) b),
r AS (SELECT a.*, coalesce(CASE WHEN a.portfolio_id = 'a' AND a.symbol = 'PROMO' THEN 0.15 WHEN a.portfolio_id = 'a' AND a.symbol = 'LARGE' THEN 0.2 END,
  CASE WHEN a.portfolio_id = 'a' THEN t.weight WHEN a.symbol IN ('STANDARD', 'SMALL') THEN t.weight END, 0) AS raw
  FROM a LEFT JOIN targets t ON t.symbol = a.symbol),
s AS (SELECT *, sum(raw) OVER p AS tot, count_if(raw <= 0) OVER p AS nu, count(*) OVER p AS n FROM r WINDOW p AS (PARTITION BY portfolio_id)),
f AS (SELECT *, CASE WHEN raw > 0 THEN raw WHEN 1 - tot > 0 THEN (1 - tot)/nu ELSE 1.0/n END AS w FROM s)
SELECT portfolio_id, symbol, w / sum(w) OVER (PARTITION BY portfolio_id) AS weight FROM f""")
def _(t):
    asked = t.table("part").select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("portfolio_id"), F.col("p_type").alias("symbol")).distinct()
    custom = t.spark.createDataFrame([("a", "PROMO", 0.15), ("a", "LARGE", 0.2), ("b", "LARGE", -1.0)], "portfolio_id string, symbol string, weight double")
    preset = t.targets().select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("portfolio_id"), "symbol", "weight").filter(
        "portfolio_id = 'a' or symbol in ('STANDARD', 'SMALL')")
    return al.target_weights(asked, custom, preset)


CTES["newmoney"] = """
SELECT *, (fl + CASE WHEN rk <= 123 - sum(fl) OVER (PARTITION BY portfolio_id) THEN 1 ELSE 0 END) * 100 AS amount FROM (
 SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY ex - fl DESC, ord) AS rk FROM (
  SELECT *, floor(ex) AS fl FROM (
   SELECT *, CASE WHEN gaps >= 12300 THEN 12300*gap/gaps ELSE gap + (12300 - gaps)*weight END / 12300 * 123 AS ex FROM (
    SELECT *, sum(gap) OVER (PARTITION BY portfolio_id) AS gaps FROM (
     SELECT q.portfolio_id, t.symbol, t.weight, t.ord, q.tot, coalesce(h.value, 0) AS value, greatest(0, t.weight*(q.tot + 12300) - coalesce(h.value, 0)) AS gap
     FROM (SELECT portfolio_id, sum(current_value_thb) AS tot FROM holdings WHERE current_value_thb > 0 GROUP BY 1) q
     CROSS JOIN (SELECT * FROM targets WHERE weight > 0) t
     LEFT JOIN (SELECT portfolio_id, ticker, current_value_thb AS value FROM holdings WHERE current_value_thb > 0) h ON h.portfolio_id = q.portfolio_id AND h.ticker = t.symbol)))))"""


@query("C7_new_money_plan", "portfolio_id:i symbol:s amount:i current_pct:4 target_pct:4 projected_pct:4", """
SELECT portfolio_id, symbol, amount, value/tot*100 AS current_pct, weight*100 AS target_pct, (value + amount)/(tot + 12300)*100 AS projected_pct
FROM newmoney WHERE amount > 0""")
def _(t):
    from tidemark.queries.ledger import holding_values
    return al.new_money_plan(holding_values(t), {s: w for s, w in TARGETS.items() if w > 0}, BUDGET)


CTES["drifts"] = """
SELECT q.portfolio_id, t.symbol, t.weight AS target, q.total, q.unpriced, coalesce(h.v, 0) AS value, coalesce(h.v, 0)/nullif(q.total, 0) AS cur FROM (
 SELECT portfolio_id, sum(shares*coalesce(price, 0)) AS total, count_if(price IS NULL) AS unpriced FROM holdings GROUP BY 1) q
CROSS JOIN targets t LEFT JOIN (SELECT portfolio_id, ticker, shares*coalesce(price, 0) AS v FROM holdings) h ON h.portfolio_id = q.portfolio_id AND h.ticker = t.symbol"""


@query("A20_max_drift", "portfolio_id:i max_drift:6 unpriced:i", """
SELECT portfolio_id, coalesce(max(abs(cur - target)), 1.0) AS max_drift, max(unpriced) AS unpriced FROM drifts GROUP BY 1""")
def _(t):
    from tidemark.queries.ledger import holding_positions
    return al.max_drift(holding_positions(t), TARGETS)


@query("J11_actual_target_union", "portfolio_id:i symbol:s value:2 weight:4", """
SELECT portfolio_id, symbol, value, target AS weight FROM drifts""")
def _(t):
    from tidemark.queries.ledger import holding_positions
    held = holding_positions(t).withColumn("value", F.col("shares") * F.coalesce("price", F.lit(0.0)))
    return al.union_of_symbols(held, TARGETS)


@query("C8_rebalance_plan", "portfolio_id:i symbol:s action:s shares:5 usd_amount:2 thb_amount:2 fee_thb:3", """
WITH d AS (SELECT d.*, k.price, max(coalesce(abs(cur - target), 1.0)) OVER (PARTITION BY d.portfolio_id) AS md FROM drifts d LEFT JOIN latest k ON k.symbol = d.symbol),
e AS (SELECT *, target*(total + 300) - value AS delta FROM d WHERE md >= 0.05 AND price > 0)
SELECT portfolio_id, symbol, CASE WHEN abs(delta) < 0.01 THEN 'hold' WHEN delta > 0 THEN 'buy' ELSE 'sell' END AS action,
 CASE WHEN abs(delta) < 0.01 THEN 0 ELSE abs(delta) END / price AS shares, CASE WHEN abs(delta) < 0.01 THEN 0 ELSE abs(delta) END AS usd_amount,
 CASE WHEN abs(delta) < 0.01 THEN 0 ELSE abs(delta) END * 33.5 AS thb_amount, CASE WHEN abs(delta) < 0.01 THEN 0 ELSE abs(delta) END * 0.0015 * 33.5 AS fee_thb FROM e""")
def _(t):
    from tidemark.queries.ledger import holding_positions
    return al.rebalance_plan(holding_positions(t), TARGETS, t.latest(), 300.0, 33.5)


@query("C9_price_level_drift", "portfolio_id:s symbol:s target:6 current:6 drift:6 need_rebalance:b", """
SELECT *, abs(current - target) AS drift, abs(current - target) > 0.05 AS need_rebalance FROM (
 SELECT portfolio_id, w.symbol, weight / sum(weight) OVER p AS target, price / sum(price) OVER p AS current FROM weights w JOIN latest l ON l.symbol = w.symbol
 WINDOW p AS (PARTITION BY portfolio_id))""")
def _(t):
    return al.price_level_drift(t.latest(), t.weights())


@query("C10_drift_advisory", "portfolio_id:i symbol:s drift_pct:4", """
SELECT * FROM (SELECT h.portfolio_id, h.ticker AS symbol, shares*price / sum(shares*price) OVER (PARTITION BY h.portfolio_id) * 100 - coalesce(t.weight, 0)*100 AS drift_pct
 FROM holdings h LEFT JOIN targets t ON t.symbol = h.ticker WHERE price IS NOT NULL AND shares*price > 0) WHERE abs(drift_pct) >= 5""")
def _(t):
    from tidemark.queries.ledger import holding_positions
    return al.drift_advisory(holding_positions(t), TARGETS)


@query("C11_alert_levels", "symbol:s price:2 buy_alert:2 buy_reason:s warning_alert:2 warning_reason:s", """
WITH r AS (SELECT symbol, round(close, 2) AS price, round(low60, 2) AS s, round(ma200, 2) AS m200, round(ma50, 2) AS m50, round(high60, 2) AS res FROM lastrow),
c AS (SELECT symbol, price, res, max(l) FILTER (WHERE l < price*0.995) AS best, max_by(nm, l) FILTER (WHERE l < price*0.995) AS nm FROM (
 SELECT symbol, price, res, unnest([s, m200, m50]) AS l, unnest(['support_60d', 'ma200', 'ma50']) AS nm FROM r) GROUP BY 1, 2, 3)
SELECT symbol, price, coalesce(best, price*0.95) AS buy_alert, coalesce(nm, 'minus_5_pct') AS buy_reason, CASE WHEN res > price*1.005 THEN res ELSE price*1.05 END AS warning_alert,
 CASE WHEN res > price*1.005 THEN 'resistance_60d' ELSE 'plus_5_pct' END AS warning_reason FROM c""")
def _(t):
    return sc.alert_levels(ind.features(t.prices()))


@query("C13_broker_fee", "portfolio_id:i tx_id:s fee_thb:4", """
SELECT portfolio_id, tx_id, coalesce(fee_thb, CASE WHEN tx_type = 'dividend' THEN 0 ELSE shares*price_usd*0.0015*fx_rate_thb END) AS fee_thb FROM transactions""")
def _(t):
    from tidemark.operators.ledger import fill_fees
    return fill_fees(t.transactions())


@query("C14_cost_layer", "goal_id:i fee_thb:6 spread_thb:6 total_thb:6 total_pct:6 gross:4 withheld:4", """
SELECT goal_id, b*0.0015 AS fee_thb, b*0.0025 AS spread_thb, b*0.004 AS total_thb, CASE WHEN b > 0 THEN 0.4 ELSE 0 END AS total_pct,
 CASE WHEN b > 0 THEN b/0.85 ELSE 0 END AS gross, CASE WHEN b > 0 THEN b/0.85 - b ELSE 0 END AS withheld
FROM (SELECT goal_id, greatest(monthly_contribution - 700, 0) AS b FROM goals)""")
def _(t):
    from tidemark.operators.ledger import gross_up
    df = al.monthly_costs(t.goals().withColumn("budget", F.col("monthly_contribution") - 700))
    return df.withColumns({"gross": gross_up(F.col("budget")), "withheld": gross_up(F.col("budget")) - F.greatest("budget", F.lit(0.0))})


CTES["dcf"] = """
WITH b AS (SELECT f.symbol, l.price, coalesce(nullif(f.beta, 0), 1.0) AS beta, least(0.12, greatest(0.04, coalesce(a.last3, 0))) AS g, f.trailing_pe, f.dividend_rate
  FROM fundamentals f JOIN latest l ON l.symbol = f.symbol LEFT JOIN (
   SELECT symbol, avg(r) FILTER (WHERE back <= 3) AS last3 FROM (
    SELECT symbol, close / lag(close) OVER (PARTITION BY symbol ORDER BY yr) - 1 AS r, row_number() OVER (PARTITION BY symbol ORDER BY yr DESC) AS back FROM (
     SELECT symbol, extract(year FROM dt) AS yr, max_by(close, dt) AS close FROM bars GROUP BY 1, 2)) WHERE r IS NOT NULL GROUP BY 1) a ON a.symbol = f.symbol
  WHERE f.trailing_pe > 0),
w AS (SELECT *, 0.043 + beta*0.065 AS wacc FROM b),
v AS (SELECT *, CASE WHEN wacc - 0.03 < 0.005 THEN greatest(0.01, wacc - 0.01) ELSE 0.03 END AS tg FROM w),
y AS (SELECT v.*, k.y, (price/trailing_pe + dividend_rate) * power(1 + g, least(k.y, 5)) * power(1 + tg, greatest(k.y - 5, 0)) AS cf FROM v CROSS JOIN range(1, 11) k(y)),
z AS (SELECT symbol, max(price) AS price, max(wacc) AS wacc, max(tg) AS tg, max(g) AS g, max(beta) AS beta, sum(round(cf/power(1 + wacc, y), 2)) AS pv, max_by(round(cf, 2), y) AS lastcf FROM y GROUP BY 1)
SELECT *, pv + lastcf*(1 + tg)/(wacc - tg)/power(1 + wacc, 10) AS intrinsic FROM z"""


@query("C15_dcf_valuation", "symbol:s price:2 intrinsic:3 margin:3 wacc:6 growth:6 terminal:6 beta:4 verdict:s", """
SELECT symbol, price, intrinsic, m AS margin, wacc, g AS growth, tg AS terminal, beta, CASE WHEN m > 30 THEN 'Strong Buy' WHEN m > 15 THEN 'Buy' WHEN m > 0 THEN 'Fair Value' WHEN m > -15 THEN 'Overvalued' ELSE 'Avoid' END AS verdict
FROM (SELECT *, (intrinsic - price)/intrinsic*100 AS m FROM dcf)""")
def _(t):
    return va.dcf_valuation(t.prices(), t.fundamentals())


@query("P13_valuation_verdict", "symbol:s verdict:s", """
SELECT symbol, CASE WHEN m > 30 THEN 'Strong Buy' WHEN m > 15 THEN 'Buy' WHEN m > 0 THEN 'Fair Value' WHEN m > -15 THEN 'Overvalued' ELSE 'Avoid' END AS verdict
FROM (SELECT *, (intrinsic - price)/intrinsic*100 AS m FROM dcf)""")
def _(t):
    return va.dcf_valuation(t.prices(), t.fundamentals())


@query("C16_score_and_value", "symbol:s pos:i total_pct:1 label:s intrinsic:3 margin:3 dcf_available:b", """
SELECT s.symbol, t.ord AS pos, total_pct, label, intrinsic, (intrinsic - price)/intrinsic*100 AS margin, d.symbol IS NOT NULL AS dcf_available
FROM scores s JOIN labels_of l ON l.symbol = s.symbol LEFT JOIN dcf d ON d.symbol = s.symbol LEFT JOIN targets t ON t.symbol = s.symbol""")
def _(t):
    scores = sc.symbol_scores(t.prices(), t.fundamentals())
    return va.score_and_value(scores, va.dcf_valuation(t.prices(), t.fundamentals()), t.targets())


@query("K1_score_ranking", "symbol:s total_pct:1 rank:i", """
SELECT symbol, total_pct, row_number() OVER (ORDER BY total_pct DESC NULLS LAST, symbol) AS rank FROM scores""")
def _(t):
    return numbered(sc.symbol_scores(t.prices(), t.fundamentals()), [], [F.desc_nulls_last("total_pct"), F.col("symbol")], "rank")


CTES["screen_rows"] = """
SELECT symbol, n, close, rsi, volume, vol_ma20, close > ma200 AS over200, hp < 0 AND h > 0 AS mup, hp > 0 AND h < 0 AS mdown, bw < 0.5*abw AS squeeze,
 gold, (p9 - close)/p9*100 AS drop_pct FROM (
 SELECT *, avg(bw) OVER (PARTITION BY symbol ORDER BY rn ROWS 49 PRECEDING) AS abw,
  bool_or(p50 < p200 AND ma50 > ma200) OVER (PARTITION BY symbol ORDER BY rn ROWS 2 PRECEDING) AS gold FROM (
  SELECT *, macd_hist AS h, lag(macd_hist) OVER w AS hp, 4*sd20/ma20 AS bw, lag(close, 9) OVER w AS p9, lag(ma50) OVER w AS p50, lag(ma200) OVER w AS p200
  FROM feat WINDOW w AS (PARTITION BY symbol ORDER BY rn))) WHERE rn = n - 1"""
CTES["screen_rules"] = """
SELECT symbol, close, rsi, 'oversold_momentum' AS preset, unnest([rsi < 35, mup, over200]) AS passed FROM screen_rows
UNION ALL SELECT symbol, close, rsi, 'golden_cross_alert', coalesce(gold, false) FROM screen_rows
UNION ALL SELECT symbol, close, rsi, 'bb_breakout_watch', unnest([coalesce(squeeze, false), coalesce(volume > 2*vol_ma20, false)]) FROM screen_rows
UNION ALL SELECT symbol, close, rsi, 'dividend_dip', drop_pct >= 5 FROM screen_rows
UNION ALL SELECT symbol, close, rsi, 'overbought_warning', unnest([rsi > 70, mdown]) FROM screen_rows"""


@query("C18_screener_rules", "symbol:s preset:s n_rules:i n_passed:i", """
SELECT symbol, preset, count(*) AS n_rules, count_if(passed) AS n_passed FROM screen_rules GROUP BY 1, 2""")
def _(t):
    rows = sc.rule_rows(t.bars(), sc.preset_table(t.spark))
    return rows.groupBy("symbol", "preset").agg(F.count("*").alias("n_rules"), F.count_if(F.col("passed")).alias("n_passed"))


@query("C18_screener_any", "symbol:s preset:s price:4 matched:i strength:1 rules:s", """
WITH g AS (SELECT symbol, preset, max(close) AS price, max(rsi) AS rsi, count(*) AS n, count_if(passed) AS m FROM screen_rules GROUP BY 1, 2)
SELECT symbol, preset, price, m AS matched, least(10, round(m*7.0/n + CASE WHEN rsi < 35 THEN 1.5 WHEN rsi > 65 THEN 1.0 ELSE 0 END, 1)) AS strength,
 CASE preset WHEN 'dividend_dip' THEN 'Price dropped 5%+ in 10 days' WHEN 'golden_cross_alert' THEN 'Golden Cross within 3 days' END AS rules
FROM g WHERE m > 0""")
def _(t):
    single = F.col("preset").isin("dividend_dip", "golden_cross_alert")
    rules = sc.preset_table(t.spark).withColumn("logic", F.lit("OR"))
    return sc.screen(t.bars(), rules).withColumn("rules", F.when(single, F.concat_ws(";", "matched_rules")))


@query("C18_screener", "symbol:s preset:s price:4 matched:i strength:1", """
WITH g AS (SELECT symbol, preset, max(close) AS price, max(rsi) AS rsi, count(*) AS n, count_if(passed) AS m FROM screen_rules GROUP BY 1, 2)
SELECT symbol, preset, price, m AS matched, least(10, round(m*7.0/n + CASE WHEN rsi < 35 THEN 1.5 WHEN rsi > 65 THEN 1.0 ELSE 0 END, 1)) AS strength FROM g WHERE m = n""")
def _(t):
    return sc.screen(t.bars(), sc.preset_table(t.spark))
