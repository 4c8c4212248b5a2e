import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import days, weekdays
from tidemark.operators import indicators as ind
from tidemark.operators import panel as pan
from tidemark.operators import risk
from tidemark.operators.ewma import Ewma, with_ewma


def by(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_underwater(panel):
    got = by(pan.underwater(panel({"A": [100, 110, 99, 110, 121]}, days("2024-01-01", 5))).orderBy("dt"), "underwater")
    assert got == [(0.0,), (0.0,), (pytest.approx(-0.1),), (0.0,), (0.0,)]


def test_max_drawdown_per_symbol(panel):
    table = risk.risk_table(panel({"A": [100, 80, 120], "B": [50, 55, 60]}, days("2024-01-01", 3)))
    assert dict(by(table, "symbol", "max_drawdown")) == {"A": pytest.approx(-0.2), "B": 0.0}


def test_episodes(panel):
    p = panel({"A": [100, 110, 99, 88, 110, 120, 96]}, days("2024-01-01", 7))
    got = risk.drawdown_episodes(p, 0.15).orderBy("peak_date").collect()
    assert [(r["peak_date"].day, r["trough_date"].day, r["recovery_date"] and r["recovery_date"].day) for r in got] == [(2, 4, 5), (6, 7, None)]
    assert [round(r["depth_pct"], 6) for r in got] == [-20.0, -20.0]
    stats = risk.recovery_stats(risk.drawdown_episodes(p, 0.15)).first()
    assert (stats["n_recovered"], stats["n_open"]) == (1, 1)
    assert risk.drawdown_episodes(p, 0.5).count() == 0


def test_seasonality_march(panel):
    ends = [d.date() for d in pd.date_range("2015-01-31", periods=72, freq="ME")]
    value, closes = 100.0, []
    for d in ends:
        value *= 1.1 if d.month == 3 else 1.0
        closes.append(value)
    got = {r["month"]: r for r in risk.monthly_seasonality(panel({"A": closes}, ends)).collect()}
    assert len(got) == 12
    assert got[3]["median_pct"] == pytest.approx(10) and got[3]["positive_rate_pct"] == 100
    assert got[6]["median_pct"] == pytest.approx(0) and got[6]["positive_rate_pct"] == 0


def test_seasonality_absent_month_is_null(panel):
    got = {r["month"]: r for r in risk.monthly_seasonality(panel({"A": [1, 2]}, [dt.date(2024, 1, 31), dt.date(2024, 2, 29)])).collect()}
    assert len(got) == 12 and got[2]["n_samples"] == 1 and got[7]["n_samples"] is None and got[7]["median_pct"] is None


def test_trend_channel(panel):
    n = 600
    base = [100 * math.exp(0.0008 * i + 0.04 * math.sin(i / 25)) for i in range(n)]
    spike, dip = base[:-1] + [base[-1] * 1.35], base[:-1] + [base[-1] * 0.70]
    p = panel({"base": base, "spike": spike, "dip": dip, "short": base[:400]}, weekdays("2020-01-01", n))
    got = {r["symbol"]: r for r in risk.trend_channel(p).collect()}
    assert abs(got["base"]["annual_growth_pct"] - (math.exp(0.0008 * 252) - 1) * 100) < 3
    assert got["spike"]["current_sigma"] > 1.5 and got["dip"]["current_sigma"] < -1.5
    assert got["short"]["error"] == "short_history" and got["short"]["sigma_log"] is None


def test_trend_channel_rejects_non_positive(panel):
    p = panel({"A": [1.0 + i for i in range(503)] + [0.0], "flat": [5.0] * 504}, weekdays("2020-01-01", 504))
    got = {r["symbol"]: r["error"] for r in risk.trend_channel(p).collect()}
    assert got == {"A": "non_positive_price", "flat": "no_spread"}


@pytest.mark.parametrize("alpha,start", [(1 / 14, 1), (2 / 13, 0), (2 / 27, 0), (0.2, 25), (1 / 21, 0), (2 / 201, 0), (0.6, 0)])
def test_ewma_matches_pandas(spark, alpha, start):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 5, 2600).cumsum() + 200
    df = spark.createDataFrame([("A", i, float(v)) for i, v in enumerate(x)], "symbol string, rn int, x double")
    got = with_ewma(df, Ewma("y", F.col("x"), alpha, start, 5)).orderBy("rn").toPandas()["y"].to_numpy()
    want = pd.Series(x[start:]).ewm(alpha=alpha, adjust=False, min_periods=5).mean().to_numpy()
    assert np.isnan(got[:start + 4]).all()
    np.testing.assert_allclose(got[start + 4:], want[4:], rtol=1e-11)


def test_rsi_warmup_and_no_loss(panel):
    p = panel({"up": list(range(1, 40)), "mix": [10 + (i * 7) % 5 for i in range(39)]}, weekdays("2024-01-01", 39))
    rows = ind.with_rsi(ind.number_rows(p)).collect()
    assert all((r["rsi"] is None) == (r["rn"] < 14) for r in rows)
    assert {r["rsi"] for r in rows if r["symbol"] == "up" and r["rn"] >= 14} == {100.0}


def test_macd_warmup(panel):
    p = panel({"A": [10 + (i * 7) % 5 for i in range(60)]}, weekdays("2024-01-01", 60))
    rows = sorted(ind.with_macd(ind.number_rows(p)).collect(), key=lambda r: r["rn"])
    assert [r["rn"] for r in rows if r["macd"] is not None][0] == 25
    assert [r["rn"] for r in rows if r["macd_signal"] is not None][0] == 33


def test_cross_dates(spark):
    d = days("2024-01-01", 10)
    rows = [("A", x, float(f), 2.5) for x, f in zip(d, [1, 2, 3, 4, 3, 2, 1, 2, 3, 4])]
    df = spark.createDataFrame(rows, "symbol string, dt date, ma50 double, ma200 double")
    got = sorted((r["cross"], r["dt"].day) for r in ind.ma_cross_dates(df).collect())
    assert got == [("death", 6), ("golden", 3), ("golden", 9)]
    warm = spark.createDataFrame([("A", x, f, s) for x, f, s in zip(d, [None, None, 3.0, 4.0, 5.0], [None, None, 2.0, 2.0, 2.0])],
                                 "symbol string, dt date, ma50 double, ma200 double")
    assert ind.ma_cross_dates(warm).count() == 0


def test_weekly_signal_needs_41_weeks(panel):
    p = panel({"A": list(np.linspace(100, 120, 100))}, weekdays("2024-01-01", 100))
    row = ind.weekly_signal(p).first()
    assert row["signal"] == "no_data" and row["price"] is None
    p = panel({"A": list(np.linspace(100, 200, 400))}, weekdays("2024-01-01", 400))
    row = ind.weekly_signal(p).first()
    assert row["signal"] == "overbought_caution" and row["rsi14w"] == 100.0


def test_forward_fill(panel):
    p = panel({"A": [1, 2, 3, 4], "B": [None, 5, None, None]}, days("2024-01-01", 4))
    got = sorted(by(pan.forward_fill(p), "symbol", "dt", "close", "filled"))
    assert [(s, d.day, c, f) for s, d, c, f in got if s == "B"] == [("B", 2, 5.0, False), ("B", 3, 5.0, True), ("B", 4, 5.0, True)]
    assert len([1 for r in got if r[0] == "A"]) == 4


def test_common_history_cut(panel, spark):
    p = panel({"A": [1, 2, 3], "B": [None, 4, 5]}, days("2024-01-01", 3))
    w = spark.createDataFrame([("p", "A", 1.0), ("p", "B", 3.0), ("p", "missing", 1.0), ("p", "C", 0.0)], "portfolio_id string, symbol string, weight double")
    got = sorted(by(pan.common_history(p, w), "symbol", "dt", "weight"))
    assert [(s, d.day, x) for s, d, x in got] == [("A", 2, 0.25), ("A", 3, 0.25), ("B", 2, 0.75), ("B", 3, 0.75)]


def test_period_returns_follow_shared_calendar(panel):
    n = 30
    p = panel({"A": list(range(1, n + 1)), "B": [None] * 5 + [2.0] * (n - 10) + [None] * 5}, days("2024-01-01", n))
    got = {(r["symbol"], r["period"]): r["ret_pct"] for r in pan.period_returns(p).collect()}
    assert got[("A", "1M")] == pytest.approx((30 / 9 - 1) * 100)
    assert got[("B", "1M")] == 0.0 and got[("A", "3M")] is None


def test_empty_panel_raises(panel):
    with pytest.raises(pan.PriceDataUnavailable):
        pan.price_panel(panel({"A": [None, None]}, days("2024-01-01", 2)), ["A"])


def test_correlation_tiles_agree_with_pandas(panel):
    rng = np.random.default_rng(3)
    d = days("2024-01-01", 80)
    series = {f"S{i}": [None if rng.random() < 0.1 else float(v) for v in 100 + rng.normal(0, 1, 80).cumsum()] for i in range(7)}
    p = panel(series, d)
    wide = pd.DataFrame({s: pd.Series([v for v in vals if v is not None], index=[x for x, v in zip(d, vals) if v is not None]).pct_change()
                         for s, vals in series.items()})
    want = wide.corr(min_periods=2)
    for block in (2, 256):
        got = risk.correlation_pairs(p, block).collect()
        assert len(got) == 21 and len({(r["symbol_a"], r["symbol_b"]) for r in got}) == 21
        for r in got:
            assert r["symbol_a"] < r["symbol_b"]
            assert r["corr"] == pytest.approx(want.loc[r["symbol_a"], r["symbol_b"]], abs=1e-10)


def test_row_order_and_partitions_do_not_matter(panel):
    rng = np.random.default_rng(5)
    p = panel({s: list(100 + rng.normal(0, 1, 260).cumsum()) for s in "ABC"}, weekdays("2023-01-02", 260))
    key = lambda df: sorted((r["symbol"], r["dt"], round(r["rsi"] or -1, 9), round(r["macd_signal"] or -1, 9)) for r in ind.features(df).collect())
    assert key(p) == key(p.orderBy(F.rand(1)).repartition(7))
