"""Readers, writers and feeds on small inputs, with the paths that the sample tables do not have."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import days
from tidemark.operators import household as hh
from tidemark.operators import ledger as lg
from tidemark.operators import news as nw
from tidemark.operators import risk
from tidemark.operators.panel import common_history
from tidemark.plans import portfolio_backtest as pb
from tidemark.sources import readers, sinks


def test_bars_and_macro_from_csv(spark, tmp_path):
    (tmp_path / "bars.csv").write_text("symbol,dt,open,high,low,close,volume\nA,2024-01-01,1,2,0.5,1.5,10\nA,2024-01-02,N/D,N/D,N/D,N/D,0\nA,2024-01-03,1,2,1,n/a,5\n")
    rows = readers.read_bars(spark, str(tmp_path / "bars.csv"), "csv").orderBy("dt").collect()
    assert [(r.dt.day, r.close) for r in rows] == [(1, 1.5), (3, None)]
    (tmp_path / "macro.csv").write_text("series_id,dt,value\nCPI,2024-01-01,3.1\nCPI,2024-02-01,\n")
    assert [(r.series_id, r.value) for r in readers.read_macro(spark, str(tmp_path / "macro.csv")).collect()] == [("CPI", 3.1)]


def test_screen_results_append_and_list(spark, tmp_path):
    path = str(tmp_path / "screens")
    for day, symbol in (("2024-01-01", "A"), ("2024-01-02", "B")):
        sinks.save_screen_results(spark.createDataFrame([(symbol, "dip")], "symbol string, preset string"), day, path)
    rows = sinks.screen_history(spark.read.parquet(path)).collect()
    assert [r.symbol for r in rows] == ["B", "A"]


def test_feeds_keep_whole_texts_and_ties_are_settled(spark):
    long = "word " * 400
    feed = spark.createDataFrame([("A", long, "u1", 2), ("A", "first", "u1", 1), ("A", "blank", " ", 3)], "symbol string, t string, u string, position int")
    rows = nw.feed_rows(feed, "wire", 1, F.col("t"), F.col("t"), F.col("u"), F.lit(None).cast("string"))
    assert {r.title for r in rows.collect()} == {r.description for r in rows.collect()} == {long, "first", "blank"}
    both = feed.select("symbol", F.col("t").alias("title"), F.col("u").alias("url"), F.lit(1).alias("source_priority"), "position")
    assert [r.title for r in nw.dedupe_by_url(both.repartition(3), F.col("position")).collect()] == ["first"]


def test_screen_summary_counts_more_than_a_page(spark):
    day = dt.date(2024, 5, 1)
    rows = [(f"S{i % 7}", "dip" if i % 3 else "cross", day) for i in range(900)] + [("old", "dip", dt.date(2024, 1, 1))]
    history = spark.createDataFrame(rows, "symbol string, preset string, created_at date")
    got = {r.preset: (r.n, r.total, r.n_symbols) for r in nw.screen_summary(history, day).collect()}
    assert got == {"dip": (600, 900, 7), "cross": (300, 900, 7)}
    assert {r.symbol for r in nw.screen_symbols(history, day).collect()} == {f"S{i}" for i in range(7)}


def test_made_ids_do_not_depend_on_partitions(spark):
    row = ("", "2024-01-01", "A", "1", "2", "33", "66")
    raw = spark.createDataFrame([row, row, ("", "2024-01-02", *row[2:]), ("x", *row[1:])],
                                "tx_id string, date string, ticker string, shares string, price_usd string, fx_rate_thb string, amount_thb string")
    ids = [sorted(r.tx_id for r in lg.normalize_ledger(raw.repartition(n)).collect()) for n in (1, 3, 7)]
    assert ids[0] == ids[1] == ids[2] and len(set(ids[0])) == 4 and "x" in ids[0]


def test_missing_prices_and_days_before_history(spark):
    kind = ("portfolio_id int, tx_id string, date date, ticker string, shares double, price_usd double, fx_rate_thb double, amount_thb double, "
            "fee_thb double, tx_type string")
    tx = spark.createDataFrame([(1, "a", dt.date(2024, 1, 1), "A", 2.0, 50.0, 33.0, 3300.0, None, "buy"),
                                (1, "b", dt.date(2025, 1, 2), "B", 1.0, 10.0, 33.0, 330.0, None, "buy")], kind)
    prices = spark.createDataFrame([("A", 60.0)], "symbol string, price double")
    total = lg.portfolio_totals(lg.holdings(tx, prices)).first()
    assert total.missing_prices == "B" and total.current_value_usd == 120.0
    bench = spark.createDataFrame([(dt.date(2025, 1, 1), 5.0)], "dt date, close double")
    shadow = lg.shadow_benchmark(tx, bench).first()
    assert (shadow.rounds, shadow.skipped, shadow.invested_usd) == (1, 1, 10.0)


def test_one_common_day_is_an_error_for_a_backtest_only(panel, spark):
    weights = spark.createDataFrame([("p", "A", 1.0), ("p", "B", 1.0)], "portfolio_id string, symbol string, weight double")
    short = panel({"A": [1, 2, 3], "B": [None, None, 5]}, days("2024-01-01", 3))
    assert common_history(short, weights).count() == 2
    with pytest.raises(Exception, match="fewer than two common days"):
        pb.portfolio_curve(short, weights).collect()


def test_goals_use_the_owners_portfolio(panel, spark):
    prices = panel({"A": [100, 110, 99, 120], "B": [50, None, 55, 60]}, days("2024-01-01", 4))
    weights = spark.createDataFrame([("1", "A", 3.0), ("1", "B", 1.0), ("2", "A", 2.0)], "portfolio_id string, symbol string, weight double")
    fast = {r.portfolio_id: r.mu for r in risk.owner_returns(prices, weights).collect()}
    slow = {r.portfolio_id: r.mu for r in risk.portfolio_mu_sigma(prices, weights).collect()}
    assert fast == pytest.approx(slow)
    goal = ("goal_id int, owner_id string, target_amount double, current_amount double, monthly_contribution double, months_remaining int, risk_profile string")
    goals = spark.createDataFrame([(1, "x", 1000.0, 0.0, 1.0, 12, "moderate"), (2, "y", 1000.0, 0.0, 1.0, 12, "odd")], goal)
    own = spark.createDataFrame([("x", 0.24)], "owner_id string, mu double")
    got = {r.goal_id: r for r in hh.goal_progress(goals, own).collect()}
    assert (got[1].rate, got[1].from_portfolio, got[2].rate, got[2].from_portfolio) == (0.24, True, 0.09, False)
    assert got[1].shortfall == pytest.approx(1000 * 0.02 / (1.02 ** 12 - 1) - 1)
    mix = spark.createDataFrame([("moderate", "A", 0.6), ("moderate", "B", 0.4)], "portfolio_id string, symbol string, weight double")
    assert sorted((r.goal_id, r.symbol, r.weight) for r in hh.goal_allocation(goals, mix).collect()) == [
        (1, "A", 0.6), (1, "B", 0.4), (2, "A", 0.6), (2, "B", 0.4)]
