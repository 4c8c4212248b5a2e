import pytest
from pyspark.sql import functions as F

from tidemark.functions import signals as sig


@pytest.mark.parametrize("price,ma50,ma200,rsi,want", [
    (None, 1, 1, 50, "no_data"), (1, 1, None, 50, "no_data"), (1, 1, 1, None, "no_data"),
    (110, 100, 100, 75, "overbought_caution"), (110, 100, 100, 25, "accumulate"), (90, 100, 100, 25, "downtrend_watch"),
    (110, 100, 100, 50, "bullish"), (110, 120, 100, 50, "neutral"), (110, None, 100, 50, "neutral"), (90, 100, 100, 50, "downtrend"),
    (110, 100, 100, 70, "bullish"), (110, 100, 100, 30, "bullish"), (100, 100, 100, 50, "bullish")])
def test_dca_signal(spark, price, ma50, ma200, rsi, want):
    num = lambda v: F.lit(v).cast("double")
    row = spark.range(1).select(sig.dca_signal(num(price), num(ma50), num(ma200), num(rsi)).alias("s")).first()
    assert row["s"] == want


def test_zones_and_labels(spark):
    df = spark.createDataFrame([(None,), (29.9,), (30.0,), (70.0,), (70.1,)], "v double")
    assert [r[0] for r in df.select(sig.rsi_zone(F.col("v"))).collect()] == ["no_data", "oversold", "neutral", "neutral", "overbought"]
    pct = spark.createDataFrame([(70.0,), (55.0,), (40.0,), (25.0,), (24.9,), (None,)], "v double")
    assert [r[0] for r in pct.select(sig.score_label(F.col("v"))).collect()] == ["Strong Buy", "Buy", "Neutral", "Caution", "Avoid", None]
    assert [r[0] for r in pct.select(sig.score_tilt(F.col("v"))).collect()][-1] is None
    sigma = spark.createDataFrame([(1.5,), (0.0,), (-1.5,)], "v double")
    assert [r[0] for r in sigma.select(sig.channel_zone(F.col("v"))).collect()] == ["upper", "middle", "lower"]


@pytest.mark.parametrize("signal,golden,death,rsi,want", [
    ("no_data", True, False, 50.0, "no_data"), ("bullish", True, False, 64.0, "strong_buy"), ("bullish", True, False, 65.0, "buy"),
    ("accumulate", False, False, 20.0, "buy"), ("bullish", True, False, None, "buy"), ("downtrend", False, True, 40.0, "sell"),
    ("downtrend", False, False, 40.0, "hold"), ("overbought_caution", True, False, 80.0, "hold"), ("downtrend_watch", False, True, 20.0, "hold")])
def test_overall_signal(spark, signal, golden, death, rsi, want):
    got = spark.range(1).select(sig.overall_signal(F.lit(signal), F.lit(golden), F.lit(death), F.lit(rsi).cast("double"))).first()[0]
    assert got == want


def test_price_alert_and_distance(spark):
    df = spark.createDataFrame([("above", 100.0, 100.0), ("below", 99.0, 100.0), ("above", 99.0, 100.0), ("below", None, 100.0)], "k string, p double, t double")
    rows = df.select(sig.price_alert_hit(F.col("k"), F.col("p"), F.col("t")), sig.alert_distance_pct(F.col("k"), F.col("p"), F.col("t"))).collect()
    assert [r[0] for r in rows] == [True, True, False, False]
    assert [r[1] for r in rows] == [0.0, -1.0, 1.0, None]


def test_technical_alert(spark):
    df = spark.createDataFrame([(25.0, 9.0, 9.0), (75.0, 9.0, 9.0), (50.0, 11.0, 10.0), (50.0, 9.0, 10.0), (50.0, 9.0, 9.5)], "r double, p double, q double")
    got = [r[0] for r in df.select(sig.technical_alert(F.col("r"), F.col("p"), F.col("q"), F.lit(10.0))).collect()]
    assert got == ["oversold", "overbought", "crossed_above", "crossed_below", "none"]


def test_yield_repair(spark):
    df = spark.createDataFrame([(-0.1,), (3.5,), (0.035,), (None,)], "y double")
    assert [r[0] for r in df.select(sig.repaired_yield(F.col("y"))).collect()] == [None, 0.035, 0.035, None]
