import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import household as hh
from tidemark.operators import macro as ma
from tidemark.operators import news as nw

PROFILE = ("household_id int, job_stability string, dependents int, income_type string, has_health_insurance boolean, industry string, "
           "monthly_expense double, current_savings double, monthly_saving_capacity double")


@pytest.mark.parametrize("row,score,mult", [
    (("very_stable", 0, "salary", True, "government"), 0, 2.5), (("stable", 0, "salary", True, "other"), 20, 2.5),
    (("stable", 1, "salary", True, "other"), 30, 3.5), (("stable", 2, "salary", True, "other"), 40, 3.5), (("unstable", 0, "salary", True, "other"), 60, 5.0),
    (("freelance", 0, "salary", True, "other"), 80, 6.5), (("freelance", 9, "business", False, "startup"), 100, 8.0)])
def test_emergency_fund(spark, row, score, mult):
    got = hh.emergency_fund(spark.createDataFrame([(1, *row, 1000.0, 500.0, 300.0)], PROFILE)).first()
    assert (got["risk_score"], got["multiplier"], got["target"]) == (score, mult, 1000 * mult)
    assert got["months_to_goal"] == -(-(1000 * mult - 500) // 300)


def test_emergency_fund_no_months_without_gap_or_saving(spark):
    df = spark.createDataFrame([(1, "stable", 0, "salary", True, "other", 100.0, 9999.0, 10.0), (2, "stable", 0, "salary", True, "other", 100.0, 0.0, 0.0)], PROFILE)
    assert [r["months_to_goal"] for r in hh.emergency_fund(df).collect()] == [None, None]


GOAL = "goal_id int, target_amount double, current_amount double, monthly_contribution double, months_remaining int, risk_profile string"


def test_goal_progress(spark):
    df = spark.createDataFrame([(1, 120000.0, 0.0, 10000.0, 12, "moderate"), (2, 100.0, 200.0, 0.0, 0, "moderate"), (3, 1e9, 1.0, 1.0, 12, "moderate")], GOAL)
    got = {r["goal_id"]: r for r in hh.goal_progress(df).collect()}
    m = 0.09 / 12
    assert got[1]["required_pmt"] == pytest.approx(120000 * m / ((1 + m) ** 12 - 1)) and got[1]["on_track"]
    assert got[1]["required_return"] == pytest.approx(0.0, abs=1e-6)
    assert got[2]["required_pmt"] == 0 and got[2]["required_return"] is None
    assert not got[3]["on_track"]


def test_months_until(spark):
    df = spark.createDataFrame([("2025-01-31",), ("2024-06-01",), ("",), (None,), ("2026-03-10T00",)], "d string")
    assert [r[0] for r in df.select(hh.months_until(F.col("d"), "2024-12-15")).collect()][:4] == [1, 1, 0, 0]


def test_anomaly_counts_absent_months_as_zero(spark):
    d = dt.date
    tx = spark.createDataFrame([(1, d(2025, 1, 5), -100.0, "food", "expense"), (1, d(2025, 2, 5), 50.0, "pay", "income"), (1, d(2025, 3, 5), -60.0, "food", "expense"),
                                (2, d(2025, 1, 5), -100.0, "food", "expense")], "household_id int, date date, amount double, category string, type string")
    got = [(r["household_id"], r["category"], r["avg_monthly"], r["change_pct"]) for r in hh.category_anomalies(tx).collect()]
    assert got == [(1, "food", 50.0, 20.0)]


def test_forecast_of_empty_history_is_flat(spark):
    tx = spark.createDataFrame([], "household_id int, date date, amount double, category string, type string")
    who = spark.createDataFrame([(1, 500.0)], "household_id int, balance double")
    none = spark.createDataFrame([], "household_id int, category string, change_pct double, seq int")
    rows = hh.cashflow_forecast(who, tx, none, 3, "2024-12-15").orderBy("step").collect()
    assert [(str(r["month"]), r["net"], r["ending_balance"]) for r in rows] == [("2025-01-01", 0.0, 500.0), ("2025-02-01", 0.0, 500.0), ("2025-03-01", 0.0, 500.0)]


def test_debt_order_with_a_large_household(spark):
    import random
    rnd = random.Random(3)
    rows = [(1 if i % 3 else 2 + i % 5, i, float(rnd.randint(1, 50)), float(rnd.randint(1, 9)), 10.0) for i in range(900)]
    df = spark.createDataFrame(rows, "household_id int, debt_id int, balance double, interest_rate double, min_payment double")
    got = {r["debt_id"]: (r["avalanche"], r["snowball"]) for r in hh.debt_order(df, 100).collect()}
    for h in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == h]
        for pos, r in enumerate(sorted(mine, key=lambda r: (-r[3], r[1])), 1):
            assert got[r[1]][0] == pos
        for pos, r in enumerate(sorted(mine, key=lambda r: (r[2], r[1])), 1):
            assert got[r[1]][1] == pos


def test_purchase_day_clips(spark):
    df = spark.createDataFrame([(31, "2025-02-01"), (5, "2025-02-01")], "buy_day int, month string").withColumn("month", F.col("month").cast("date"))
    assert [(str(r["buy_dt"]), str(r["remind_dt"])) for r in hh.purchase_days(df).collect()] == [("2025-02-28", "2025-02-27"), ("2025-02-05", "2025-02-04")]


def test_inflation_and_trend(spark):
    months = [dt.date(2024 + i // 12, i % 12 + 1, 1) for i in range(14)]
    df = spark.createDataFrame([("CPI", m, 100.0 + i) for i, m in enumerate(months)] + [("SHORT", m, 1.0) for m in months[:5]], "series_id string, dt date, value double")
    assert [round(r["value"], 6) for r in ma.year_over_year(df.filter("series_id = 'CPI'")).orderBy("dt").collect()] == [12.0, round(12 / 101 * 100, 6)]
    assert {r["series_id"]: r["trend"] for r in ma.trends(df).collect()} == {"CPI": "up", "SHORT": "flat"}
    assert ma.macro_table(df).count() == 0  # a series is missing


def test_reply_parsing(spark):
    texts = ['```json\n[{"title": "a", "sentiment": "positive", "confidence": 1.7, "reason": "r"}, 3, {"title": "b", "confidence": "x"}]\n```',
             '[{"title": "c, [d] {e}", "sentiment": "", "confidence": -1}]', '{"title": "no list"}', "broken", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, reply string")
    got = sorted((r["id"], r["title"], r["sentiment"], r["confidence"], r["reason"]) for r in nw.parse_replies(df).collect())
    assert got == [(0, "a", "positive", 1.0, "r"), (0, "b", "neutral", 0.0, ""), (1, "c, [d] {e}", "neutral", 0.0, "")]


def test_sentiment_rollup_and_ties(spark):
    df = spark.createDataFrame([("A", "Positive ", "0.5"), ("A", "weird", "bad"), ("B", "negative", None)], "symbol string, sentiment string, confidence string")
    got = {r["symbol"]: r for r in nw.sentiment_rollup(df).collect()}
    assert (got["A"]["positive"], got["A"]["neutral"], got["A"]["score"], got["A"]["avg_confidence"], got["A"]["overall"]) == (1, 1, 0.5, 0.5, "positive")
    assert got["B"]["overall"] == "negative" and got["B"]["avg_confidence"] == 0.0
    s = spark.createDataFrame([("A", 2, 1), ("A", 2, 2), ("A", 1, 3)], "symbol string, created_at int, id int")
    assert nw.latest_with_ties(s).count() == 2 and nw.latest_single(s, "id").first()["id"] == 2


def test_news_dedupe_and_undated_last(spark):
    rows = [("A", "u1", 2, "2025-01-02T00:00:00Z"), ("A", "u1", 1, "2025-01-01T00:00:00Z"), ("A", " ", 1, None), ("A", "u2", 1, "not a date"), ("A", "u3", 1, "2025-01-03T08:00:00+07:00")]
    df = spark.createDataFrame(rows, "symbol string, url string, source_priority int, published_at string")
    got = [r["url"] for r in nw.newest_news(df, nw.parse_time(F.col("published_at")), F.col("published_at"), [F.col("url")]).orderBy("rank").collect()]
    assert got == ["u3", "u1", "u2"]
