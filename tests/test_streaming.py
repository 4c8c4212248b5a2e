import datetime as dt

from tidemark.functions.signals import price_alert_hit
from tidemark.streaming import live

T0 = dt.datetime(2025, 1, 2, 10, 0, 0)
SCHEMA = "symbol string, ts timestamp, price double, event_id bigint"
KIND = "alert_id string, ticker string, alert_type string, price double, triggered boolean"
NAN = float("nan")


def put(spark, folder, rows):
    spark.createDataFrame([(s, T0 + dt.timedelta(seconds=sec), p, i) for s, sec, p, i in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def snapshot(spark, out):
    schema = "symbol string, price double, previous_close double, change_pct double, ts timestamp"
    rows = live.read_snapshot(spark, out, spark.createDataFrame([], schema).schema).collect()
    assert len({r["symbol"] for r in rows}) == len(rows)
    return {r["symbol"]: (r["price"], r["change_pct"]) for r in rows}


def test_snapshot_stream_overwrites_by_symbol_and_equals_batch(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    prev = spark.createDataFrame([("A", 100.0), ("B", 0.0), *[(f"S{k}", 10.0) for k in range(90)]], "symbol string, previous_close double")
    put(spark, src, [("A", 1, 101.0, 1), ("B", 1, 5.0, 2), *[(f"S{k}", 1, 11.0, 100 + k) for k in range(90)]])
    live.start_snapshot(live.read_ticks(spark, src), prev, out, ck).awaitTermination(120)
    first = snapshot(spark, out)
    assert len(first) == 92 and first["S7"] == (11.0, 10.0)
    put(spark, src, [("A", 9, 103.0, 3), ("A", 5, 90.0, 4), ("A", 10, None, 5), ("A", 11, NAN, 6), ("S7", 3, 12.0, 7)])
    live.start_snapshot(live.read_ticks(spark, src), prev, out, ck).awaitTermination(120)
    newest = snapshot(spark, out)
    assert newest == {**first, "A": (103.0, 3.0), "S7": (12.0, 20.0)} and newest["B"] == (5.0, 0.0)
    batch = {r["symbol"]: (r["price"], r["change_pct"]) for r in live.live_snapshot(spark.read.schema(SCHEMA).parquet(src), prev).collect()}
    assert batch == newest


def test_snapshot_with_idle_symbols_lets_their_state_go_and_keeps_their_rows(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    prev = spark.createDataFrame([("A", 100.0), ("B", 50.0)], "symbol string, previous_close double")
    for rows in ([("A", 0, 101.0, 1), ("B", 5, 55.0, 2)], [("A", 7200, 110.0, 3), ("A", 7201, 109.0, 4)], [("A", 7300, 108.0, 5), ("B", 6, 1.0, 6)], [("A", 7400, 107.0, 7)]):
        put(spark, src, rows)
        query = live.start_snapshot(live.read_ticks(spark, src, 1), prev, out, ck, idle="10 minutes")
        query.awaitTermination(120)
    assert snapshot(spark, out) == {"A": (107.0, 7.0), "B": (55.0, 10.0)}      # the tick of B two hours late is not taken
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2        # windows of A still open


def fired(spark, out):
    return sorted((r["alert_id"], r["triggered_price"], (r["triggered_at"] - T0).seconds) for r in spark.read.schema(live.FIRED).parquet(out).collect())


def test_alert_fires_once_and_late_ticks_change_nothing(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    alerts = spark.createDataFrame([("up", "A", "above", 105.0, False), ("down", "A", "below", 95.0, False), ("spent", "A", "above", 1.0, True)], KIND)
    put(spark, src, [("A", 10, 104.0, 1), ("A", 30, 107.0, 2), ("A", 20, 106.0, 3), ("A", 19, NAN, 9), ("A", 18, None, 8)])
    live.start_alert_latch(live.read_ticks(spark, src), alerts, out, ck).awaitTermination(120)
    assert fired(spark, out) == [("up", 106.0, 20)]
    put(spark, src, [("A", 5, 110.0, 4), ("A", 40, 94.0, 5), ("A", 41, NAN, 6)])  # the first one is late and older
    live.start_alert_latch(live.read_ticks(spark, src), alerts, out, ck).awaitTermination(120)
    assert fired(spark, out) == [("down", 94.0, 40), ("up", 106.0, 20)]


def test_three_batches_and_a_restart_give_the_rows_of_one(spark, tmp_path):
    ticks = [[(s, 100 * b + k, 100 + ((k * 37 + b * 11 + ord(s)) % 41) - 20.0, 1000 * b + k) for k in range(40) for s in "ABC"] for b in range(3)]
    alerts = spark.createDataFrame([(f"{s}{kind}{d}", s, kind, 100.0 + d * (1 if kind == "above" else -1), False)
                                    for s in "ABC" for kind in ("above", "below") for d in (1, 15, 19, 30)], KIND)
    one, three = ([str(tmp_path / f"{n}{x}") for x in ("src", "out", "ck")] for n in ("one", "three"))
    for batch in ticks:
        put(spark, one[0], batch)
        put(spark, three[0], batch)
        live.start_alert_latch(live.read_ticks(spark, three[0], 1), alerts, *three[1:]).awaitTermination(120)
    live.start_alert_latch(live.read_ticks(spark, one[0]), alerts, *one[1:]).awaitTermination(120)
    assert fired(spark, one[1]) == fired(spark, three[1])
    twin = live.first_hits(spark.read.schema(SCHEMA).parquet(one[0]), alerts).collect()
    assert fired(spark, one[1]) == sorted((r["alert_id"], r["triggered_price"], (r["triggered_at"] - T0).seconds) for r in twin)
    assert 0 < len(twin) < alerts.count()


def test_alerts_added_later_join(spark, tmp_path):
    src, out, ck, book = (str(tmp_path / n) for n in ("src", "out", "ck", "book"))
    spark.createDataFrame([("up", "A", "above", 105.0, False)], KIND).write.parquet(book)
    for batch, late in (([("A", 10, 106.0, 1), ("A", 11, 120.0, 2)], ("low", "A", "below", 95.0, False)),
                        ([("A", 20, 94.0, 3), ("A", 21, 110.0, 4)], ("top", "A", "above", 119.0, False)),
                        ([("A", 30, 118.0, 5), ("A", 31, 119.0, 6), ("A", 32, 90.0, 7)], None)):
        put(spark, src, batch)
        live.start_alert_latch(live.read_ticks(spark, src), lambda: spark.read.schema(KIND).parquet(book), out, ck).awaitTermination(120)
        if late:
            spark.createDataFrame([late], KIND).write.mode("append").parquet(book)
    assert fired(spark, out) == [("low", 94.0, 20), ("top", 119.0, 31), ("up", 106.0, 10)]


def test_extremes_keep_every_first_hit(spark):
    rows = [("A", T0 + dt.timedelta(minutes=7 * i), float((i * 37) % 23), i) for i in range(200)]
    ticks = spark.createDataFrame(rows, SCHEMA)
    kept = live.extremes(ticks)
    assert kept.count() < ticks.count()
    for target in range(24):
        first = min((r[1] for r in rows if r[2] >= target), default=None)
        assert kept.filter(f"price >= {target}").agg({"ts": "min"}).first()[0] == first
        first = min((r[1] for r in rows if r[2] <= target), default=None)
        assert kept.filter(f"price <= {target}").agg({"ts": "min"}).first()[0] == first


def test_prices_that_are_no_numbers_never_fire(spark):
    rows = [(k, p, t) for k in ("above", "below", "other", None) for p in (NAN, None, 5.0) for t in (NAN, None, 5.0)]
    df = spark.createDataFrame(rows, "k string, p double, t double")
    from pyspark.sql import functions as F
    hit = df.withColumn("hit", price_alert_hit(F.col("k"), F.col("p"), F.col("t"))).filter("hit").collect()
    assert sorted((r["k"], r["p"], r["t"]) for r in hit) == [("above", 5.0, 5.0), ("below", 5.0, 5.0)]
