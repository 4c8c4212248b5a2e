import pytest
from pyspark.sql import functions as F

from tests.conftest import weekdays
from tidemark.operators import alerts as al
from tidemark.operators import allocation as alloc
from tidemark.operators import scoring as sc
from tidemark.operators import valuation as va

H = "portfolio_id string, symbol string, value double"
T = "portfolio_id string, symbol string, weight double, ord int"


def plan(spark, held, budget, mix={"A": 0.5, "B": 0.5}):
    h = spark.createDataFrame([("p", s, float(v)) for s, v in held.items()], H)
    t = alloc.assign_mix(h.select("portfolio_id").distinct(), mix)
    return {r["symbol"]: r["amount"] for r in alloc.new_money_plan(h, t, budget).collect()}


def test_new_money_goes_to_the_gap(spark):
    assert plan(spark, {"A": 55000, "B": 45000}, 20000) == {"A": 5000, "B": 15000}
    assert plan(spark, {"A": 55000, "B": 45000}, 30000) == {"A": 10000, "B": 20000}
    assert plan(spark, {"A": 70000, "B": 30000}, 20000) == {"B": 20000}


def test_one_mix_equals_targets_per_portfolio(spark):
    mix = {"A": 0.6, "B": 0.4, "D": 0.0}
    held = spark.createDataFrame([
        ("p", "A", 3.0, 10.0), ("p", "C", 1.0, 5.0), ("q", "B", 2.0, None), ("r", "C", 4.0, 2.0), ("r", "A", 1.0, 2.0), ("s", None, 1.0, 3.0)],
        "portfolio_id string, symbol string, shares double, price double")
    prices = spark.createDataFrame([("A", 10.0), ("B", 4.0), ("C", 5.0)], "symbol string, price double")
    rows = alloc.assign_mix(held.select("portfolio_id").distinct(), mix)
    seen = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    valued = held.withColumn("value", F.col("shares") * F.coalesce("price", F.lit(0.0)))
    for call in (lambda t: alloc.union_of_symbols(valued, t), lambda t: alloc.max_drift(held, t), lambda t: alloc.rebalance_plan(held, t, prices, 300.0, 33.5),
                 lambda t: alloc.drift_advisory(held, t).select("portfolio_id", "symbol", F.round("drift_pct", 6)),
                 lambda t: alloc.new_money_plan(valued.select("portfolio_id", "symbol", "value"), t, 5000)):
        assert seen(call(mix)) == seen(call(rows)) != []
    assert alloc.union_of_symbols(valued.limit(0), mix).count() == 0


def test_new_money_uses_the_whole_budget(spark):
    got = plan(spark, {"A": 33000, "B": 33000, "C": 34000}, 10000, {"A": 1 / 3, "B": 1 / 3, "C": 1 / 3})
    assert sum(got.values()) == 10000


def test_no_holdings_no_plan(spark):
    assert plan(spark, {"A": 0}, 20000) == {}


@pytest.mark.parametrize("budget", [100, 700, 5000, 12345, 99999])
def test_allocation_sums_to_budget_in_lots(spark, budget):
    scores = spark.createDataFrame([("A", True, 80.0), ("B", True, 30.0), ("C", True, 55.5), ("D", False, None)], "symbol string, data_ok boolean, total_pct double")
    targets = spark.createDataFrame([("p", s, w, i) for i, (s, w) in enumerate([("A", 0.4), ("B", 0.3), ("C", 0.2), ("D", 0.1)])], T)
    got = {r["symbol"]: r["amount"] for r in alloc.allocate_budget(scores, targets, budget).collect()}
    assert sum(got.values()) == budget // 100 * 100 and "D" not in got
    assert all(v % 100 == 0 for v in got.values())


def test_target_weights_fill_and_normalise(spark):
    asked = spark.createDataFrame([("p", s) for s in "ABC"], "portfolio_id string, symbol string")
    custom = spark.createDataFrame([("p", "A", 0.5), ("p", "C", -1.0)], "portfolio_id string, symbol string, weight double")
    preset = spark.createDataFrame([("p", "A", 0.9), ("p", "B", 0.3)], "portfolio_id string, symbol string, weight double")
    got = {r["symbol"]: r["weight"] for r in alloc.target_weights(asked, custom, preset).collect()}
    assert got == {"A": pytest.approx(0.5), "B": pytest.approx(0.3), "C": pytest.approx(0.2)}


def test_drift_without_value_is_one(spark):
    held = spark.createDataFrame([("p", "A", 1.0, None), ("q", "A", 1.0, 100.0)], "portfolio_id string, symbol string, shares double, price double")
    got = {r["portfolio_id"]: (r["max_drift"], r["unpriced"]) for r in alloc.max_drift(held, alloc.assign_mix(held.select("portfolio_id").distinct(), {"A": 0.6, "B": 0.4})).collect()}
    assert got == {"p": (1.0, 1), "q": (pytest.approx(0.4), 0)}


def test_monthly_costs(spark):
    row = alloc.monthly_costs(spark.createDataFrame([(5000.0,), (-1.0,)], "budget double")).orderBy(F.desc("budget")).collect()
    assert (row[0]["fee_thb"], row[0]["spread_thb"], row[0]["total_thb"], row[0]["total_pct"]) == (pytest.approx(7.5), pytest.approx(12.5), pytest.approx(20), pytest.approx(0.4))
    assert row[1]["total_thb"] == 0 and row[1]["total_pct"] == 0


def test_scores_need_200_days_and_stay_in_range(panel):
    up = [100 * 1.001 ** i + (i % 3) for i in range(260)]
    got = {r["symbol"]: r for r in sc.symbol_scores(panel({"up": up, "short": up[:199]}, weekdays("2023-01-02", 260))).collect()}
    assert 0 <= got["up"]["total_pct"] <= 100 and got["up"]["max_score"] == 90
    assert not got["short"]["data_ok"] and got["short"]["total_pct"] is None and got["short"]["label"] == "NO DATA" and got["short"]["error"] == "short_history"


def test_screener_drops_symbols_it_cannot_judge(panel, spark):
    p = panel({"long": [100 + (i % 7) for i in range(260)], "short": [100 + (i % 7) for i in range(100)]}, weekdays("2023-01-02", 260)).withColumn("volume", F.lit(10.0))
    rules = spark.createDataFrame([("any", "OR", 0, "price_vs_ma200", "gt", None, "over"), ("any", "OR", 1, "price_drop_pct", "drop_pct", -1000.0, "drop"), ("odd", "OR", 0, "unknown", "gt", 1.0, "?")],
                                  sc.preset_table(spark).schema)
    got = sc.screen(p, rules).collect()
    assert {(r["symbol"], r["preset"]) for r in got} == {("long", "any")}
    assert got[0]["matched_rules"][-1] == "drop"


def test_dcf_needs_a_pe_and_repairs_beta(panel, spark):
    dates = [d for d in weekdays("2020-01-01", 1000)]
    p = panel({"A": [100 + i * 0.05 for i in range(1000)], "G": [50.0] * 1000}, dates)
    f = spark.createDataFrame([("A", 20.0, 1.5, 0.0), ("G", 0.0, 1.0, 1.0)], "symbol string, trailing_pe double, dividend_rate double, beta double")
    rows = va.dcf_valuation(p, f).collect()
    assert [r["symbol"] for r in rows] == ["A"] and rows[0]["beta"] == 1.0 and len(rows[0]["cash_flows"]) == 10


def test_quote_fallback(spark):
    import datetime as dt
    d = dt.date(2025, 1, 1)
    q = spark.createDataFrame([(1, "A", d, "10"), (1, "B", d, "N/D"), (2, "b ", d, "7"), (2, "A", d, "99"), (3, "C", d, "0")], "source_priority int, symbol string, ts date, price string")
    wanted = spark.createDataFrame([("a",), ("B",), ("C",)], "symbol string")
    got = {r["symbol"]: (r["price"], r["source_priority"]) for r in al.latest_with_fallback(wanted, q).collect()}
    assert got == {"A": (10.0, 1), "B": (7.0, 2)}


def test_fx_falls_back_to_default(spark):
    import datetime as dt
    c = spark.createDataFrame([(1, dt.date(2025, 1, 1), 3400.0), (2, dt.date(2025, 1, 1), 34.5)], "source_priority int, ts date, rate double")
    assert tuple(al.resolve_fx(c).first()) == (34.5, True)
    assert tuple(al.resolve_fx(c.filter("rate > 100")).first()) == (33.5, False)


def test_alert_documents_and_upsert(spark, tmp_path):
    from tidemark.sources import sinks
    from tidemark.sources.readers import read_alert_documents
    (tmp_path / "good.json").write_text('{"alerts": [\n {"id": "1", "ticker": "VOO", "alert_type": "above", "price": 500.0, "triggered": false},\n {"id": "2", "ticker": "VOO", "alert_type": "below", "price": 400.0, "triggered": true}]}')
    (tmp_path / "bad.json").write_text('{"alerts": [')
    (tmp_path / "odd.json").write_text('{"alerts": 3}')
    alerts = read_alert_documents(spark, str(tmp_path)).withColumnRenamed("id", "alert_id")
    assert sorted(r["alert_id"] for r in alerts.collect()) == ["1", "2"]
    new = spark.createDataFrame([("n1", "voo", "ABOVE", 510.0), ("n2", "voo", "below", 390.0), ("n3", "voo", "sideways", 1.0), ("n4", "x", "above", -1.0)],
                                "alert_id string, ticker string, alert_type string, price double")
    got = sorted((r["alert_id"], r["price"], r["triggered"]) for r in sinks.upsert_alerts(alerts.select("alert_id", "ticker", "alert_type", "price", "triggered"), new).collect())
    assert got == [("1", 510.0, False), ("2", 400.0, True), ("n2", 390.0, False)]
