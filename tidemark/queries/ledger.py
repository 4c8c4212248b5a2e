"""Queries over the transaction ledger."""

from pyspark.sql import functions as F

from tidemark.functions.signals import repaired_yield
from tidemark.operators import ledger as lg
from tidemark.operators.asof import asof_join
from tidemark.queries.oracle_ctes import CTES
from tidemark.queries.registry import query
from tidemark.sources import sinks
from tidemark.sources.adapters import AS_OF, BENCHMARK

CTES["holdings"] = """
SELECT *, shares*price AS current_value_usd, shares*price*33.5 AS current_value_thb, price IS NOT NULL AS price_ok FROM (
 SELECT portfolio_id, ticker, sum(shares) AS shares, sum(shares*price_usd) AS invested_usd, sum(shares*price_usd*fx_rate_thb) AS invested_thb,
  sum(coalesce(fee_thb, shares*price_usd*0.0015*fx_rate_thb)) AS fee_thb FROM transactions WHERE tx_type <> 'dividend' GROUP BY 1, 2) h
LEFT JOIN latest k ON k.symbol = h.ticker"""
CTES["bench"] = "SELECT dt, close FROM bars WHERE symbol = 'STANDARD'"


def held(t):
    return lg.holdings(t.transactions(), t.latest())


def holding_positions(t):
    return held(t).select("portfolio_id", F.col("ticker").alias("symbol"), "shares", "price")


def holding_values(t):
    return held(t).filter("price_ok").select("portfolio_id", F.col("ticker").alias("symbol"), F.col("current_value_thb").alias("value"))


def raw_ledger(t):
    """Ledger as untyped text with gaps: odd kinds, padded tickers, missing rates and bad numbers."""
    tx = t.transactions()
    seq = F.substring_index("tx_id", "-", -1)
    text = lambda c: F.col(c).cast("string")
    return tx.select(
        text("portfolio_id").alias("portfolio_id"), "tx_id", text("date").alias("date"),
        F.concat(F.lit("  "), F.lower("ticker"), F.lit(" ")).alias("ticker"),
        F.when(seq == "3", "n/a").otherwise(text("shares")).alias("shares"), text("price_usd").alias("price_usd"),
        F.when(seq == "2", "").otherwise(text("fx_rate_thb")).alias("fx_rate_thb"), text("amount_thb").alias("amount_thb"),
        text("fee_thb").alias("fee_thb"), F.when(seq == "1", " Transfer").otherwise(F.upper("tx_type")).alias("tx_type"))


@query("SRC4_ledger_scan", "portfolio_id:s tx_id:s date:d ticker:s shares:4 price_usd:4 fx_rate_thb:4 amount_thb:6 fee_thb:4 tx_type:s", """
SELECT CAST(portfolio_id AS VARCHAR) AS portfolio_id, tx_id, date, ticker, shares, price_usd, CASE WHEN tx_id LIKE '%-2' THEN 33.5 ELSE fx_rate_thb END AS fx_rate_thb,
 amount_thb, fee_thb, CASE WHEN tx_id LIKE '%-1' THEN 'buy' ELSE tx_type END AS tx_type FROM transactions WHERE tx_id NOT LIKE '%-3'""")
def _(t):
    return lg.normalize_ledger(raw_ledger(t))


@query("SNK1_ledger_append", "portfolio_id:i tx_id:s date:d ticker:s shares:4 price_usd:4 amount_thb:6 fee_thb:4 tx_type:s ok:b", """
SELECT portfolio_id, tx_id, date, ticker, shares, price_usd, amount_thb, CASE WHEN tx_type = 'dividend' THEN 0 ELSE shares*price_usd*0.0015*fx_rate_thb END AS fee_thb, tx_type,
 CASE WHEN tx_type = 'dividend' THEN amount_thb/fx_rate_thb > 0 ELSE shares > 5 END AS ok FROM transactions""")
def _(t):
    new = lg.dividends(t.transactions()).unionByName(
        t.transactions().filter("tx_type = 'buy'"), allowMissingColumns=True)
    new = new.withColumn("offered", F.when(F.col("tx_type") == "buy", F.when(F.col("shares") > 5, F.col("shares")).otherwise(-F.col("shares"))).otherwise(F.col("shares")))
    accepted, rejected = sinks.check_ledger_rows(new.withColumn("shares", F.col("offered")))
    back = rejected.withColumn("shares", F.abs("shares")).withColumn("fee_thb", lg.broker_fee(F.col("shares") * F.col("price_usd"), F.col("fx_rate_thb")))
    return accepted.withColumn("ok", F.lit(True)).unionByName(back.withColumn("ok", F.lit(False)), allowMissingColumns=True)


@query("SNK3_delete_by_key", "portfolio_id:i tx_id:s", """
SELECT portfolio_id, tx_id FROM transactions WHERE tx_id NOT IN (SELECT tx_id FROM transactions WHERE tx_type = 'dividend')""")
def _(t):
    return sinks.without_keys(t.transactions(), lg.dividends(t.transactions()).select("tx_id"), ["tx_id"])


@query("A9_holdings", "portfolio_id:i ticker:s shares:3 invested_usd:2 invested_thb:4 fee_thb:3 avg_cost_usd:4 fx_rate_buy:6 price:4 price_ok:b current_value_usd:2 "
       "current_value_thb:2 pnl_usd:2 pnl_thb:2 return_pct:4", """
SELECT portfolio_id, ticker, shares, invested_usd, invested_thb, fee_thb, invested_usd/shares AS avg_cost_usd, invested_thb/invested_usd AS fx_rate_buy, price, price_ok,
 current_value_usd, current_value_thb, current_value_usd - invested_usd AS pnl_usd, current_value_thb - invested_thb AS pnl_thb,
 (current_value_usd - invested_usd)/invested_usd*100 AS return_pct FROM holdings""")
def _(t):
    return held(t)


@query("J5_holdings_with_prices", "portfolio_id:i ticker:s shares:3 price:4 price_ok:b", "SELECT portfolio_id, ticker, shares, price, price_ok FROM holdings")
def _(t):
    return held(t)


@query("A10_portfolio_totals", "portfolio_id:i holdings_count:i total_invested_thb:4 current_value_thb:2 current_value_usd:2 total_pnl_thb:2 total_return_pct:4 total_fee_thb:3 missing_prices:s", """
SELECT portfolio_id, count(*) AS holdings_count, sum(invested_thb) AS total_invested_thb, coalesce(sum(current_value_thb), 0) AS current_value_thb, coalesce(sum(current_value_usd), 0) AS current_value_usd,
 coalesce(sum(current_value_thb), 0) - coalesce(sum(invested_thb) FILTER (WHERE price_ok), 0) AS total_pnl_thb,
 coalesce((sum(current_value_thb) - sum(invested_thb) FILTER (WHERE price_ok)) / sum(invested_thb) FILTER (WHERE price_ok) * 100, 0) AS total_return_pct,
 sum(fee_thb) AS total_fee_thb, coalesce(string_agg(CASE WHEN NOT price_ok THEN ticker END, ',' ORDER BY ticker), '') AS missing_prices FROM holdings GROUP BY 1""")
def _(t):
    return lg.portfolio_totals(held(t))


@query("K2_top_holdings", "portfolio_id:i ticker:s current_value_usd:2 rank:i", """
SELECT portfolio_id, ticker, current_value_usd, row_number() OVER (PARTITION BY portfolio_id ORDER BY current_value_usd DESC, ticker) AS rank
FROM holdings WHERE price_ok QUALIFY rank <= 3""")
def _(t):
    return lg.top_holdings(held(t))


@query("A11_dividend_summary", "portfolio_id:i total_thb:4 total_usd:5 n:i this_year_thb:4", """
SELECT portfolio_id, sum(amount_thb) AS total_thb, sum(amount_thb/fx_rate_thb) AS total_usd, count(*) AS n,
 coalesce(sum(amount_thb) FILTER (WHERE extract(year FROM date) = 2001), 0) AS this_year_thb FROM transactions WHERE tx_type = 'dividend' GROUP BY 1""")
def _(t):
    return lg.dividend_summary(t.transactions(), AS_OF)


@query("A11_dividends_by_ticker", "portfolio_id:i ticker:s total_thb:4", """
SELECT portfolio_id, ticker, sum(amount_thb) AS total_thb FROM transactions WHERE tx_type = 'dividend' GROUP BY 1, 2""")
def _(t):
    return lg.dividends(t.transactions()).groupBy("portfolio_id", "ticker").agg(F.sum("amount_thb").alias("total_thb"))


@query("A25_dividend_tax", "portfolio_id:i tax_thb:2 n_holdings:i", """
SELECT portfolio_id, sum(current_value_thb*dy*0.15) AS tax_thb, count(*) AS n_holdings FROM holdings h JOIN (
 SELECT symbol, CASE WHEN dividend_yield > 1 THEN dividend_yield/100 ELSE dividend_yield END AS dy FROM fundamentals) f ON f.symbol = h.ticker
WHERE price_ok AND dy > 0 GROUP BY 1""")
def _(t):
    return lg.dividend_tax(held(t), t.fundamentals().select("symbol", repaired_yield(F.col("dividend_yield")).alias("div_yield")))


@query("W17_running_average_cost", "portfolio_id:i ticker:s date:d shares:3 avg_cost_usd:4", """
SELECT DISTINCT portfolio_id, ticker, date, sum(shares) OVER w AS shares, sum(shares*price_usd) OVER w / sum(shares) OVER w AS avg_cost_usd
FROM transactions WHERE shares > 0 AND price_usd > 0 WINDOW w AS (PARTITION BY portfolio_id, ticker ORDER BY date)""")
def _(t):
    return lg.running_average_cost(t.transactions())


@query("W18_trade_number_in_month", "portfolio_id:i tx_id:s date:d trade_number_in_month:i", """
SELECT portfolio_id, tx_id, date, row_number() OVER (PARTITION BY portfolio_id, date_trunc('month', date) ORDER BY date, tx_id) AS trade_number_in_month
FROM transactions WHERE tx_type <> 'dividend' UNION ALL SELECT portfolio_id, tx_id, date, 0 FROM transactions WHERE tx_type = 'dividend'""")
def _(t):
    return lg.trade_numbers(t.transactions())


@query("K6_ledger_history", "portfolio_id:i tx_id:s date:d ticker:s", "SELECT portfolio_id, tx_id, date, ticker FROM transactions WHERE ticker = 'SMALL' ORDER BY date DESC")
def _(t):
    return t.transactions().filter(F.col("ticker") == "SMALL").orderBy(F.desc("date"))


@query("J1_buys_to_benchmark", "portfolio_id:i tx_id:s date:d close:4 price_date:d", """
SELECT t.portfolio_id, t.tx_id, t.date, b.close, b.dt AS price_date FROM transactions t ASOF LEFT JOIN bench b ON t.date >= b.dt WHERE t.tx_type <> 'dividend'""")
def _(t):
    buys = t.transactions().filter("tx_type <> 'dividend'").select("portfolio_id", "tx_id", "date")
    return asof_join(buys, t.benchmark(), "date", "dt", ["close"]).withColumnRenamed("matched_on", "price_date")


@query("J2_dividends_to_prices", "portfolio_id:i tx_id:s date:d ticker:s close:4", """
SELECT t.portfolio_id, t.tx_id, t.date, t.ticker, b.close FROM transactions t ASOF LEFT JOIN bars b ON t.ticker = b.symbol AND t.date >= b.dt WHERE t.tx_type = 'dividend'""")
def _(t):
    ref = t.prices().withColumnRenamed("symbol", "ticker")
    return asof_join(lg.dividends(t.transactions()), ref, "date", "dt", ["close"], by=["ticker"])


@query("B16_shadow_benchmark", "portfolio_id:i invested_usd:2 benchmark_shares:5 benchmark_value_usd:2 rounds:i skipped:i", """
SELECT portfolio_id, coalesce(sum(v) FILTER (WHERE close IS NOT NULL), 0) AS invested_usd, coalesce(sum(v/close), 0) AS benchmark_shares,
 coalesce(sum(v/close), 0) * (SELECT max_by(close, dt) FROM bench) AS benchmark_value_usd, count(close) AS rounds, count(*) - count(close) AS skipped
FROM (SELECT t.portfolio_id, t.shares*t.price_usd AS v, b.close FROM transactions t ASOF LEFT JOIN bench b ON t.date >= b.dt WHERE t.tx_type <> 'dividend') GROUP BY 1""")
def _(t):
    return lg.shadow_benchmark(t.transactions(), t.benchmark())


@query("B19_reinvested_dividends", "portfolio_id:i ticker:s cash_usd:5 extra_shares:6 drip_value_usd:3 advantage_usd:3 rounds:i skipped:i", """
SELECT portfolio_id, ticker, coalesce(sum(v) FILTER (WHERE close IS NOT NULL), 0) AS cash_usd, coalesce(sum(v/close), 0) AS extra_shares, coalesce(sum(v/close), 0)*max(lp) AS drip_value_usd,
 coalesce(sum(v/close), 0)*max(lp) - coalesce(sum(v) FILTER (WHERE close IS NOT NULL), 0) AS advantage_usd, count(close) AS rounds, count(*) - count(close) AS skipped
FROM (SELECT t.portfolio_id, t.ticker, t.amount_thb/t.fx_rate_thb AS v, b.close, l.price AS lp FROM transactions t ASOF LEFT JOIN bars b ON t.ticker = b.symbol AND t.date >= b.dt
 JOIN latest l ON l.symbol = t.ticker WHERE t.tx_type = 'dividend') GROUP BY 1, 2""")
def _(t):
    return lg.reinvested_dividends(t.transactions(), t.prices())


CTES["flows"] = """
SELECT portfolio_id, date, -shares*price_usd AS amount FROM transactions WHERE tx_type <> 'dividend'
UNION ALL SELECT portfolio_id, date, amount_thb/fx_rate_thb FROM transactions WHERE tx_type = 'dividend'
UNION ALL SELECT portfolio_id, DATE '2001-11-05', sum(current_value_usd) FROM holdings GROUP BY 1 HAVING sum(current_value_usd) IS NOT NULL"""
CTES["flow_lists"] = """
SELECT portfolio_id, list({'t': date_diff('day', t0, date)/365.25, 'a': amount}) AS f FROM (
 SELECT *, min(date) OVER (PARTITION BY portfolio_id) AS t0 FROM flows WHERE amount <> 0)
GROUP BY 1 HAVING count(*) >= 2 AND count_if(amount < 0) > 0 AND count_if(amount > 0) > 0"""


def npv(rate):
    return f"list_sum(list_transform(f, lambda x: x.a / power(1 + {rate}, x.t)))"


CTES["roots"] = f"""
SELECT * FROM (SELECT portfolio_id, f, CAST(-0.9999 AS DOUBLE) AS lo, CAST(10 AS DOUBLE) AS hi, {npv('CAST(-0.9999 AS DOUBLE)')} AS flo, {npv('CAST(10 AS DOUBLE)')} AS fhi, 0 AS i FROM flow_lists) WHERE flo*fhi <= 0
UNION ALL
SELECT portfolio_id, f, CASE WHEN flo*m < 0 THEN lo ELSE (lo + hi)/2 END, CASE WHEN flo*m < 0 THEN (lo + hi)/2 ELSE hi END, CASE WHEN flo*m < 0 THEN flo ELSE m END, fhi, i + 1
FROM (SELECT *, {npv('(lo + hi)/2')} AS m FROM roots WHERE i < 60)"""


@query("B17_xirr", "portfolio_id:i n_flows:i xirr:6", """
SELECT n.portfolio_id, n.n_flows, (r.lo + r.hi)/2 AS xirr FROM (SELECT portfolio_id, count(*) AS n_flows FROM flows WHERE amount <> 0 GROUP BY 1) n
LEFT JOIN (SELECT * FROM roots WHERE i = 60) r ON r.portfolio_id = n.portfolio_id""")
def _(t):
    return lg.xirr(lg.ledger_flows(t.transactions(), t.latest(), AS_OF))


@query("B18_money_weighted_return", "portfolio_id:i xirr_pct:4 real_pct:4", """
SELECT n.portfolio_id, CASE WHEN b.fb <= DATE '2001-08-07' THEN (r.lo + r.hi)/2*100 END AS xirr_pct, CASE WHEN b.fb <= DATE '2001-08-07' THEN (r.lo + r.hi)/2*100 - 2.5 END AS real_pct
FROM (SELECT DISTINCT portfolio_id FROM flows WHERE amount <> 0) n LEFT JOIN (SELECT * FROM roots WHERE i = 60) r ON r.portfolio_id = n.portfolio_id
LEFT JOIN (SELECT portfolio_id, min(date) AS fb FROM transactions WHERE tx_type <> 'dividend' GROUP BY 1) b ON b.portfolio_id = n.portfolio_id""")
def _(t):
    return lg.ledger_returns(t.transactions(), t.latest(), AS_OF, 2.5)


@query("U1_flow_union", "portfolio_id:i n:i total:2", "SELECT portfolio_id, count(*) AS n, sum(amount) AS total FROM (SELECT portfolio_id, date, sum(amount) AS amount, "
       "CASE WHEN amount < 0 THEN 1 WHEN date = DATE '2001-11-05' AND amount > 0 THEN 2 ELSE 3 END AS leg FROM flows GROUP BY 1, 2, 4) GROUP BY 1")
def _(t):
    return lg.ledger_flows(t.transactions(), t.latest(), AS_OF).filter("amount is not null").groupBy("portfolio_id").agg(
        F.count("*").alias("n"), F.sum("amount").alias("total"))


@query("U3_missing_symbols", "symbol:s", "SELECT DISTINCT p_brand AS symbol FROM part WHERE p_brand NOT IN (SELECT symbol FROM latest) "
       "UNION SELECT DISTINCT p_type FROM part WHERE p_type NOT IN (SELECT symbol FROM latest)")
def _(t):
    # brands are asked for beside the types; they have no prices of their own
    asked = t.table("part").select(F.explode(F.array("p_brand", "p_type")).alias("symbol")).distinct()
    return asked.join(t.latest(), "symbol", "left_anti")


@query("U1_tracked_symbols", "symbol:s", f"SELECT DISTINCT ticker AS symbol FROM holdings UNION SELECT ticker FROM alerts UNION SELECT '{BENCHMARK}'")
def _(t):
    one = t.latest().filter(F.col("symbol") == BENCHMARK).select("symbol")
    return (held(t).select(F.col("ticker").alias("symbol")).union(t.alerts().select("ticker")).union(one)).distinct()
