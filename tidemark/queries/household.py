"""Queries over household tables: cash flow, emergency fund, goals, debts and net worth."""

from pyspark.sql import functions as F

from tidemark.operators import household as hh
from tidemark.operators import risk
from tidemark.queries.ledger import held, holding_values
from tidemark.queries.oracle_ctes import CTES
from tidemark.queries.registry import query
from tidemark.sources import sinks
from tidemark.sources.adapters import AS_OF

CTES["hmonth"] = """
SELECT household_id, CAST(date_trunc('month', date) AS DATE) AS month, sum(CASE WHEN type = 'income' THEN abs(amount) ELSE 0 END) AS income,
 sum(CASE WHEN type = 'income' THEN 0 ELSE abs(amount) END) AS expense FROM cashflow_tx GROUP BY 1, 2"""
CTES["hcat"] = """
SELECT household_id, category, CAST(date_trunc('month', date) AS DATE) AS month, sum(abs(amount)) AS expense FROM cashflow_tx WHERE type = 'expense' GROUP BY 1, 2, 3"""


@query("A12_monthly_cashflow", "household_id:i month:d income:4 expense:4", "SELECT * FROM hmonth")
def _(t):
    return hh.monthly_summary(t.cashflow_tx())


@query("A13_category_month_expense", "household_id:i category:s month:d expense:4", "SELECT * FROM hcat")
def _(t):
    return hh.category_monthly(t.cashflow_tx())


@query("A14_category_anomalies", "household_id:i category:s avg_monthly:4 last_value:4 change_pct:1", """
WITH m AS (SELECT household_id, max(month) AS lm, count(*) AS n FROM hmonth GROUP BY 1 HAVING count(*) >= 2),
a AS (SELECT c.household_id, c.category, coalesce(sum(expense) FILTER (WHERE month = lm), 0) AS last_value, coalesce(sum(expense) FILTER (WHERE month <> lm), 0)/(max(n) - 1) AS avg_monthly
  FROM hcat c JOIN m ON m.household_id = c.household_id GROUP BY 1, 2)
SELECT *, round((last_value - avg_monthly)/avg_monthly*100, 1) AS change_pct FROM a WHERE avg_monthly <> 0 AND abs(round((last_value - avg_monthly)/avg_monthly*100, 1)) >= 15""")
def _(t):
    return hh.category_anomalies(t.cashflow_tx())


CTES["hfore"] = """
SELECT h.household_id, k.step, CAST(DATE '2001-11-01' + to_months(CAST(k.step AS INTEGER)) AS DATE) AS month, coalesce(a.inc, 0) AS income, coalesce(a.exp, 0)*(1 + coalesce(s.delta, 0)) AS expense,
 coalesce(a.inc, 0) - coalesce(a.exp, 0)*(1 + coalesce(s.delta, 0)) AS net, coalesce(a.exp, 0) AS avg_expense, h.balance + k.step*(coalesce(a.inc, 0) - coalesce(a.exp, 0)*(1 + coalesce(s.delta, 0))) AS ending_balance
FROM (SELECT c_custkey AS household_id, c_acctbal*100 AS balance FROM customer) h
LEFT JOIN (SELECT household_id, avg(income) AS inc, avg(expense) AS exp, count(*) AS n FROM hmonth GROUP BY 1) a ON a.household_id = h.household_id
LEFT JOIN (SELECT c.household_id, sum(CASE WHEN a.exp <> 0 THEN c.sp/a.n/a.exp*CASE WHEN category = '2-HIGH' THEN 10 ELSE -20 END/100 ELSE 0 END) AS delta
 FROM (SELECT household_id, category, sum(expense) AS sp FROM hcat WHERE category IN ('2-HIGH', '5-LOW') GROUP BY 1, 2) c
 JOIN (SELECT household_id, avg(expense) AS exp, count(*) AS n FROM hmonth GROUP BY 1) a ON a.household_id = c.household_id GROUP BY 1) s ON s.household_id = h.household_id
CROSS JOIN range(1, 7) k(step)"""


def forecast(t):
    who = t.table("customer").select(F.col("c_custkey").alias("household_id"), (F.col("c_acctbal") * 100).alias("balance"))
    item = lambda c, p, n: F.struct(F.lit(c).alias("category"), F.lit(p).alias("change_pct"), F.lit(n).alias("seq"))
    plans = F.explode(F.array(item("2-HIGH", 50.0, 1), item("2-HIGH", 10.0, 2), item("5-LOW", -20.0, 3))).alias("s")
    return hh.cashflow_forecast(who, t.cashflow_tx(), who.select("household_id", plans).select("household_id", "s.*"), 6, AS_OF)


@query("C22_cashflow_forecast", "household_id:i step:i month:d income:4 expense:3 net:3 ending_balance:2", "SELECT * FROM hfore")
def _(t):
    return forecast(t)


@query("C23_emergency_breach", "household_id:i breach_month:d", """
SELECT household_id, min(CASE WHEN round(ending_balance, 2) < avg_expense*3 THEN month END) AS breach_month FROM hfore GROUP BY 1""")
def _(t):
    return hh.emergency_breach(forecast(t))


@query("C19_emergency_fund", "household_id:i risk_score:i multiplier:1 target:2 gap:3 months_to_goal:i", """
WITH s AS (SELECT *, greatest(0, least(100, CASE job_stability WHEN 'very_stable' THEN 0 WHEN 'stable' THEN 20 WHEN 'unstable' THEN 60 ELSE 80 END + least(dependents, 3)*10
 + CASE income_type WHEN 'salary' THEN 0 WHEN 'mixed' THEN 15 WHEN 'freelance' THEN 35 ELSE 40 END + CASE WHEN has_health_insurance THEN 0 ELSE 20 END
 + CASE industry WHEN 'government' THEN -10 WHEN 'startup' THEN 20 WHEN 'self_employed' THEN 15 ELSE 0 END)) AS risk_score FROM risk_profiles),
m AS (SELECT *, CASE WHEN risk_score <= 20 THEN 2.5 WHEN risk_score <= 40 THEN 3.5 WHEN risk_score <= 60 THEN 5.0 WHEN risk_score <= 80 THEN 6.5 ELSE 8.0 END AS multiplier FROM s)
SELECT household_id, risk_score, multiplier, round(monthly_expense*multiplier, 2) AS target, round(monthly_expense*multiplier - current_savings, 2) AS gap,
 CASE WHEN round(monthly_expense*multiplier - current_savings, 2) > 0 AND monthly_saving_capacity > 0 THEN ceil(round(monthly_expense*multiplier - current_savings, 2)/monthly_saving_capacity) END AS months_to_goal FROM m""")
def _(t):
    return hh.emergency_fund(t.risk_profiles())


CTES["gprog"] = """
SELECT *, CASE WHEN n <= 0 THEN greatest(0, target_amount - current_amount) ELSE greatest(0, (target_amount - current_amount*g)*m/(g - 1)) END AS required_pmt,
 current_amount*g + monthly_contribution*(g - 1)/m AS projected_value FROM (
 SELECT *, power(1 + m, n) AS g FROM (SELECT *, CASE risk_profile WHEN 'conservative' THEN 0.07 WHEN 'moderate' THEN 0.09 ELSE 0.12 END/12 AS m, months_remaining AS n FROM goals))"""
_GAP = "(current_amount*power(1 + {r}, n) + monthly_contribution*CASE WHEN abs({r}) < 1e-12 THEN n ELSE (power(1 + {r}, n) - 1)/({r}) END - target_amount)"
CTES["grate"] = f"""
SELECT * FROM (SELECT goal_id, current_amount, monthly_contribution, target_amount, n, CAST(-0.99 AS DOUBLE) AS lo, CAST(1.0 AS DOUBLE) AS hi, {_GAP.format(r='CAST(-0.99 AS DOUBLE)')} AS flo,
 {_GAP.format(r='CAST(1.0 AS DOUBLE)')} AS fhi, 0 AS i FROM gprog) WHERE flo*fhi <= 0
UNION ALL SELECT goal_id, current_amount, monthly_contribution, target_amount, n, CASE WHEN flo*f < 0 THEN lo ELSE (lo + hi)/2 END, CASE WHEN flo*f < 0 THEN (lo + hi)/2 ELSE hi END,
 CASE WHEN flo*f < 0 THEN flo ELSE f END, fhi, i + 1 FROM (SELECT *, {_GAP.format(r='(lo + hi)/2')} AS f FROM grate WHERE i < 60)"""


@query("C20_goal_progress", "goal_id:i required_pmt:3 projected_value:2 required_return:5 on_track:b warning:b", """
SELECT g.goal_id, required_pmt, projected_value, power(1 + (r.lo + r.hi)/2, 12) - 1 AS required_return, monthly_contribution >= required_pmt*0.85 AS on_track,
 coalesce(power(1 + (r.lo + r.hi)/2, 12) - 1, m*12) > m*12*1.2 AS warning FROM gprog g LEFT JOIN (SELECT goal_id, lo, hi FROM grate WHERE i = 60) r ON r.goal_id = g.goal_id""")
def _(t):
    return hh.goal_progress(t.goals())


CTES["owner_mu"] = """
SELECT portfolio_id, avg(r)*252 AS mu FROM (
 SELECT w.portfolio_id, p.dt, sum(p.ret*w.w) AS r FROM (SELECT portfolio_id, ticker, current_value_thb/sum(current_value_thb) OVER (PARTITION BY portfolio_id) AS w,
  count(*) OVER (PARTITION BY portfolio_id) AS k FROM holdings WHERE price_ok AND current_value_thb > 0) w
 JOIN px p ON p.symbol = w.ticker WHERE p.ret IS NOT NULL GROUP BY 1, 2 HAVING count(*) = max(w.k)) GROUP BY 1"""


@query("C20_owner_goal_progress", "goal_id:i rate:6 from_portfolio:b required_pmt:3 shortfall:3 projected_log:6 on_track:b", """
WITH r AS (SELECT g.*, mu IS NOT NULL AS from_portfolio, months_remaining AS n,
 coalesce(mu, CASE risk_profile WHEN 'conservative' THEN 0.07 WHEN 'moderate' THEN 0.09 ELSE 0.12 END) AS rate FROM goals g LEFT JOIN owner_mu o ON o.portfolio_id = g.goal_id),
v AS (SELECT *, rate/12 AS m, power(1 + rate/12, n) AS gr FROM r),
p AS (SELECT *, greatest(0, CASE WHEN m = 0 THEN (target_amount - current_amount)/n ELSE (target_amount - current_amount*gr)*m/(gr - 1) END) AS required_pmt,
 CASE WHEN m > 0 THEN current_amount*gr + monthly_contribution*(gr - 1)/m ELSE current_amount + monthly_contribution*n END AS projected FROM v)
SELECT goal_id, rate, from_portfolio, required_pmt, CASE WHEN monthly_contribution < required_pmt*0.85 THEN required_pmt - monthly_contribution END AS shortfall,
 ln(projected) AS projected_log, monthly_contribution >= required_pmt*0.85 AS on_track FROM p""")
def _(t):
    values = holding_values(t).withColumnRenamed("value", "weight")
    owner = risk.owner_returns(t.prices(), values).select(F.col("portfolio_id").alias("owner_id"), "mu")
    return hh.goal_progress(t.goals(), owner).withColumn("projected_log", F.log("projected_value"))


@query("C20_goal_allocation", "goal_id:i symbol:s weight:4", """
SELECT goal_id, symbol, weight FROM goals JOIN weights w ON w.portfolio_id = risk_profile""")
def _(t):
    return hh.goal_allocation(t.goals(), t.weights())


@query("A24_goal_summary", "goal_id:i on_track:b n_goals:i", """
SELECT goal_id, monthly_contribution >= required_pmt*0.85 AS on_track, count(*) OVER (PARTITION BY monthly_contribution >= required_pmt*0.85) AS n_goals FROM gprog""")
def _(t):
    return hh.goals_summary(hh.goal_progress(t.goals()))


@query("C21_debt_order", "household_id:i debt_id:i avalanche:i snowball:i total_min:2 feasible:b", """
SELECT household_id, debt_id, row_number() OVER (PARTITION BY household_id ORDER BY interest_rate DESC, debt_id) AS avalanche, row_number() OVER (PARTITION BY household_id ORDER BY balance, debt_id) AS snowball,
 sum(min_payment) OVER (PARTITION BY household_id) AS total_min, 2000 >= sum(min_payment) OVER (PARTITION BY household_id) AS feasible FROM debts""")
def _(t):
    return hh.debt_order(t.debts(), 2000)


@query("C24_purchase_days", "household_id:i month:d buy_dt:d remind_dt:d", """
SELECT household_id, month, CAST(month + to_days(CAST(least(household_id % 31 + 1, extract(day FROM last_day(month))) - 1 AS INTEGER)) AS DATE) AS buy_dt,
 CAST(month + to_days(CAST(least(household_id % 31 + 1, extract(day FROM last_day(month))) - 2 AS INTEGER)) AS DATE) AS remind_dt FROM hmonth""")
def _(t):
    plans = hh.monthly_summary(t.cashflow_tx()).withColumn("buy_day", (F.col("household_id") % 31 + 1).cast("int"))
    return hh.purchase_days(plans)


CTES["snaps"] = """
SELECT household_id, snapshot_date, sum(CASE WHEN side = 'asset' THEN value_thb ELSE 0 END) AS total_assets, sum(CASE WHEN side = 'liability' THEN value_thb ELSE 0 END) AS total_liabilities,
 sum(CASE WHEN side = 'asset' THEN value_thb ELSE -value_thb END) AS net_worth, max(snapshot_line_id) AS snapshot_id FROM networth_lines GROUP BY 1, 2"""


@query("A16_net_worth_now", "household_id:i etf_live:b etf_assets:2 other_assets:4 liabilities:4 net_worth:2", """
WITH l AS (SELECT n.household_id, sum(CASE WHEN side = 'asset' AND type <> 'etf' THEN value_thb ELSE 0 END) AS other_assets, sum(CASE WHEN side = 'liability' THEN value_thb ELSE 0 END) AS liabilities
 FROM networth_lines n JOIN (SELECT household_id, max(snapshot_date) AS d FROM networth_lines GROUP BY 1) x ON x.household_id = n.household_id AND x.d = n.snapshot_date GROUP BY 1),
e AS (SELECT portfolio_id AS household_id, sum(round(current_value_thb, 2)) AS etf_assets FROM holdings WHERE price_ok GROUP BY 1)
SELECT coalesce(l.household_id, e.household_id) AS household_id, e.household_id IS NOT NULL AS etf_live, coalesce(etf_assets, 0) AS etf_assets, coalesce(other_assets, 0) AS other_assets,
 coalesce(liabilities, 0) AS liabilities, coalesce(etf_assets, 0) + coalesce(other_assets, 0) - coalesce(liabilities, 0) AS net_worth FROM l FULL JOIN e ON e.household_id = l.household_id""")
def _(t):
    etf = held(t).filter("price_ok").select(F.col("portfolio_id").alias("household_id"), F.col("current_value_thb").alias("value_thb"))
    return hh.net_worth_now(t.networth_lines(), etf)


@query("SNK5_snapshot_totals", "snapshot_id:i total_assets_thb:4 total_liabilities_thb:4 net_worth_thb:4 n_assets:i", """
SELECT l_orderkey AS snapshot_id, sum(CASE WHEN l_linestatus = 'F' THEN l_extendedprice ELSE 0 END) AS total_assets_thb, sum(CASE WHEN l_linestatus = 'F' THEN 0 ELSE l_extendedprice END) AS total_liabilities_thb,
 sum(CASE WHEN l_linestatus = 'F' THEN l_extendedprice ELSE -l_extendedprice END) AS net_worth_thb, count_if(l_linestatus = 'F') AS n_assets FROM lineitem GROUP BY 1""")
def _(t):
    # one nested snapshot per order; an order has few lines
    line = F.struct(F.col("l_returnflag").alias("name"), F.lit("cash").alias("type"), F.col("l_extendedprice").alias("value_thb"))
    nested = t.table("lineitem").groupBy(F.col("l_orderkey").alias("snapshot_id")).agg(
        F.collect_list(F.when(F.col("l_linestatus") == "F", line)).alias("assets"), F.collect_list(F.when(F.col("l_linestatus") != "F", line)).alias("liabilities"))
    back = F.from_json("assets_json", "array<struct<name:string,type:string,value_thb:double>>")
    return sinks.snapshot_rows(nested).withColumn("n_assets", F.size(back))


@query("K4_snapshot_history", "household_id:i snapshot_date:d net_worth:4 snapshot_id:i", """
SELECT household_id, snapshot_date, net_worth, snapshot_id FROM snaps WHERE snapshot_date >= DATE '2001-11-05' - INTERVAL 720 DAY""")
def _(t):
    return hh.snapshot_history(hh.snapshot_totals(t.networth_lines()), AS_OF, 24)


@query("W20_net_worth_change", "household_id:i current_net_worth:4 previous_net_worth:4 change:4 change_pct:3", """
WITH h AS (SELECT *, row_number() OVER (PARTITION BY household_id ORDER BY snapshot_date DESC) AS r FROM snaps WHERE snapshot_date >= DATE '1999-12-01' - INTERVAL 90 DAY),
c AS (SELECT household_id, max(net_worth) FILTER (WHERE r = 1) AS cur, max_by(net_worth, snapshot_date) FILTER (WHERE r > 1 AND snapshot_date < DATE '1999-12-01') AS prv FROM h GROUP BY 1)
SELECT household_id, cur AS current_net_worth, coalesce(prv, cur) AS previous_net_worth, cur - coalesce(prv, cur) AS change, coalesce((cur - coalesce(prv, cur))/nullif(coalesce(prv, cur), 0)*100, 0) AS change_pct FROM c""")
def _(t):
    return hh.net_worth_change(hh.snapshot_totals(t.networth_lines()), "1999-12-01")
