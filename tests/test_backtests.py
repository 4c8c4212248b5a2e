import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import weekdays
from tidemark.plans import dynamic_buying as dyn
from tidemark.plans import portfolio_backtest as pb
from tidemark.plans import signal_backtest as sb

MIX = "win string, start date, symbol string, weight double"


def mix(spark, weights, start="2000-01-01"):
    return spark.createDataFrame([("w", start, s, float(w)) for s, w in weights.items()], "win string, start string, symbol string, weight double").withColumn("start", F.col("start").cast("date"))


def walk(seed, n, sd=0.01):
    return list(100 * np.exp(np.random.default_rng(seed).normal(0, sd, n).cumsum()))


def test_constant_prices_by_hand(panel, spark):
    p = panel({"A": [10.0] * 65, "B": [20.0] * 65}, weekdays("2024-01-01", 65))
    rows = dyn.decisions(p, mix(spark, {"A": 0.5, "B": 0.5})).withColumn("plain", F.lit(1.0))
    months = dyn.simulate(rows, ("plain",), 1000.0).orderBy("dt").collect()
    assert [m["invested"] for m in months] == [1000, 2000, 3000] and months[-1]["value"] == pytest.approx(3000)
    assert [m["twr"] for m in months] == [None, 0.0, 0.0]


def test_final_shares_and_days_used(panel, spark):
    p = panel({"A": [10.0] * 65, "B": [20.0] * 65}, weekdays("2024-01-01", 65))
    rows = dyn.decisions(p, mix(spark, {"A": 0.5, "B": 0.5})).withColumn("plain", F.lit(1.0))
    got = {r["symbol"]: (r["shares"], str(r["start_used"]), str(r["end_used"])) for r in dyn.final_shares(dyn.purchases(rows, ("plain",), 1000.0)).collect()}
    assert got == {"A": (150.0, "2024-01-01", "2024-03-01"), "B": (75.0, "2024-01-01", "2024-03-01")}


def test_start_is_warm_up_only(panel, spark):
    p = panel({"A": walk(1, 300)}, weekdays("2023-01-02", 300))
    first = dyn.decisions(p, mix(spark, {"A": 1.0}, "2023-06-15")).agg(F.min("dt")).first()[0]
    assert str(first) == "2023-07-03"


def test_no_decision_sees_its_future(panel, spark):
    d = weekdays("2020-01-01", 800)
    series = {s: walk(i, 800) for i, s in enumerate("ABCD")}
    m = mix(spark, dict.fromkeys("ABCD", 0.25))
    cols = ["symbol", "dt", "tilt", *dyn.CANDIDATES]
    key = lambda df, last: {(r["symbol"], r["dt"]): tuple(round(r[c], 9) for c in cols[2:]) for r in df.select(*cols).collect() if r["dt"] <= last}
    whole = key(dyn.decisions(panel(series, d), m), d[600])
    cut = {s: v[:601] for s, v in series.items()}
    assert key(dyn.decisions(panel(cut, d), m), d[600]) == whole
    # a spike on the buy day itself must not move that day's tilt
    buy = max(k[1] for k in whole)
    spiked = {s: [v * (5 if day == buy else 1) for v, day in zip(vals[:601], d)] for s, vals in series.items()}
    assert key(dyn.decisions(panel(spiked, d), m), buy) == {k: v for k, v in whole.items() if k[1] <= buy}


def test_short_history_is_neutral(panel, spark):
    p = panel({"A": walk(1, 100), "B": walk(2, 100)}, weekdays("2023-01-02", 100))
    rows = dyn.decisions(p, mix(spark, {"A": 0.5, "B": 0.5})).collect()
    assert all(r["neutral"] and r["tilt"] == 1.0 and r["underwater"] == 1.0 and r["stretch"] == 1.0 for r in rows)


def test_tilts_have_direction_and_bounds(panel, spark):
    n = 420
    high = [100.0 + i * 0.1 for i in range(n)]
    low = high[:-40] + [high[-41] * 0.7] * 40
    p = panel({"high": high, "low": low, "calm": walk(3, n, 0.004), "wild": walk(4, n, 0.03)}, weekdays("2022-01-03", n))
    last = dyn.decisions(p, mix(spark, dict.fromkeys(["high", "low", "calm", "wild"], 0.25)))
    got = {r["symbol"]: r for r in last.filter(F.col("dt") == last.agg(F.max("dt")).first()[0]).collect()}
    assert got["high"]["underwater"] == 1.0 and got["low"]["underwater"] == pytest.approx(1.2)
    assert got["calm"]["inverse_vol"] > 1 > got["wild"]["inverse_vol"]
    for r in got.values():
        assert all(0.8 <= r[c] <= 1.2 for c in dyn.CANDIDATES)


def test_stretch_percentile_by_brute_force(panel, spark):
    n = 900
    p = panel({"A": walk(9, n)}, weekdays("2020-01-01", n))
    s = pd.Series(walk(9, n))
    ratio = s / s.rolling(200).mean()
    feats = dyn.decision_features(p)
    got = {r["rn"]: (r["n_ratio"], r["pctl"]) for r in dyn.stretch_percentile(feats.filter("rn in (460, 503, 504, 700, 899)"), feats).collect()}
    for rn, (count, pctl) in got.items():
        tail = ratio.iloc[:rn + 1].dropna().tail(504)
        assert count == len(tail) and pctl == pytest.approx((tail <= tail.iloc[-1]).mean())
    assert len(got) == 5


def test_portfolio_curve_matches_pandas(panel, spark):
    d = weekdays("2023-01-02", 50)
    a, b = walk(1, 50), walk(2, 50)
    p = panel({"A": a, "B": [None] * 10 + b[10:]}, d)
    w = spark.createDataFrame([("p", "A", 3.0), ("p", "B", 1.0)], "portfolio_id string, symbol string, weight double")
    got = pb.portfolio_curve(p, w, 100.0).orderBy("dt").toPandas()
    frame = pd.DataFrame({"A": a, "B": b})[10:]
    rets = (frame.pct_change().fillna(0.0) * [0.75, 0.25]).sum(axis=1)
    np.testing.assert_allclose(got["value"], ((1 + rets).cumprod() * 100).to_numpy(), rtol=1e-12)


def test_negative_weight_is_an_error_when_buying(panel, spark):
    p = panel({"A": walk(1, 50), "B": walk(2, 50)}, weekdays("2023-01-02", 50))
    w = spark.createDataFrame([("p", "A", 1.5), ("p", "B", -0.5)], "portfolio_id string, symbol string, weight double")
    with pytest.raises(Exception, match="must not be negative"):
        pb.monthly_buying(p, w, 100.0).collect()


def test_stress_curve_uses_todays_shares(panel, spark):
    p = panel({"A": [10.0, 8.0, 12.0], "B": [1.0, 1.0, 1.0]}, weekdays("2024-01-01", 3))
    held = spark.createDataFrame([("p", "A", 5.0), ("p", "B", 10.0)], "portfolio_id string, symbol string, shares double")
    curve, episodes, stats = pb.stress_context(p, held)
    assert [r["close"] for r in curve.orderBy("dt").collect()] == pytest.approx([60.0, 50.0, 70.0])
    assert episodes.count() == 1 and stats.first()["n_recovered"] == 1


def equity_by_loop(close, entry, exit_, fee=0.001):
    cash, shares, out = 10000.0, 0.0, []
    for c, e, x in zip(close, entry, exit_):
        if e and not x and shares == 0:
            shares, cash = cash / (c * (1 + fee)), 0.0
        elif x and not e and shares > 0:
            cash, shares = shares * c * (1 - fee), 0.0
        out.append(cash + shares * c)
    return out


def test_equity_matches_an_order_loop(panel, spark):
    n = 400
    p = panel({"A": walk(11, n, 0.02)}, weekdays("2022-01-03", n))
    rows = sb.signals(p)
    got = sb.equity(rows, ("symbol",)).orderBy("rn").toPandas()
    want = equity_by_loop(got["close"], got["entry"], got["exit"])
    np.testing.assert_allclose(got["equity"], want, rtol=1e-9)
    res = sb.run(p).first()
    assert res["strategy"] in ("rsi_macd_3day_window", "rsi_only_fallback") and res["total_return"] == pytest.approx((want[-1] / 10000 - 1) * 100)


def test_search_leaves_out_short_symbols(panel):
    p = panel({"long": walk(1, 200), "short": walk(2, 80)}, weekdays("2022-01-03", 200))
    grid, best = sb.search(p)
    assert {r["symbol"] for r in best.collect()} == {"long"} and grid.filter("symbol = 'long'").count() == 12
    days, row = weekdays("2022-01-03", 200), best.first()
    assert [row[c] for c in ("train_start", "train_end", "test_start", "test_end")] == [days[0], days[139], days[140], days[199]]
    assert {(r["first_day"], r["last_day"]) for r in grid.collect()} == {(days[0], days[139])}


def test_folds_clip_short_months(spark):
    import datetime as dt
    rows = spark.createDataFrame([("A", dt.date(2020, 8, 31)), ("A", dt.date(2021, 8, 31))], "symbol string, dt date")
    got = [str(r["train_end"]) for r in sb.folds(rows).orderBy("fold").collect()]
    assert got[:3] == ["2021-02-28", "2021-03-30", "2021-04-30"] and max(got) <= "2021-08-01"
