"""Row numbers and as-of joins over ranges of the data, against plain versions."""

import bisect
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof
from tidemark.operators.household import debt_order
from tidemark.operators.ledger import trade_numbers
from tidemark.operators.ranking import numbered


@pytest.mark.parametrize("keys", [["k", "m"], []])
def test_numbers_equal_a_plain_count_under_a_hot_key_with_nulls(spark, keys):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([1, 1, 2, None]), rng.choice([None, *range(40)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, m int, v int, id int").repartition(5)
    out = numbered(df, keys, [F.desc_nulls_last("v"), F.col("id")], "n")
    assert out.columns == ["k", "m", "v", "id", "n"]
    got = {r.id: r.n for r in out.collect()}
    want, seen = {}, {}
    for k, m, v, i in sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[3])):
        key = (k, m) if keys else ()
        seen[key] = seen.get(key, 0) + 1
        want[i] = seen[key]
    assert got == want
    assert numbered(df.limit(0), keys, [F.col("id")], "n").count() == 0


def test_no_row_is_lost_for_a_null_key(spark):
    d = dt.date(2024, 1, 5)
    rows = [(1, "a", d, "buy"), (1, "b", None, "buy"), (None, "c", d, "buy"), (1, None, d, "dividend"), (1, "d", d, None)]
    got = trade_numbers(spark.createDataFrame(rows, "portfolio_id int, tx_id string, date date, tx_type string")).collect()
    assert sorted((r.tx_id or "-", r.trade_number_in_month) for r in got) == [("-", 0), ("a", 1), ("b", 1), ("c", 1), ("d", 2)]
    debts = spark.createDataFrame([(None, 1, 5.0, 3.0, 1.0), (7, 2, 5.0, None, 1.0), (7, 3, 9.0, 4.0, 1.0), (7, 4, None, 4.0, 2.5)],
                                  "household_id int, debt_id int, balance double, interest_rate double, min_payment double")
    got = {r.debt_id: (r.avalanche, r.snowball, r.total_min, r.feasible) for r in debt_order(debts, 4.0).collect()}
    assert got == {1: (1, 1, 1.0, True), 2: (3, 1, 4.5, False), 3: (1, 2, 4.5, False), 4: (2, 3, 4.5, False)}


@pytest.mark.parametrize("direction,strict", [("backward", False), ("backward", True), ("forward", False)])
@pytest.mark.parametrize("times", ["timestamp", "date", "string"])
def test_asof_without_key_equals_bisection(spark, direction, strict, times):
    rng = random.Random(2)
    t0 = dt.datetime(2024, 1, 1)
    unit = dt.timedelta(days=1) if times != "timestamp" else dt.timedelta(microseconds=1)
    at = {"timestamp": lambda k: t0 + k * unit, "date": lambda k: (t0 + k * unit).date(), "string": lambda k: str((t0 + k * unit).date())}[times]
    ref = sorted(rng.sample(range(5000, 9000), 300))      # nothing is given at either end, and little in between
    ref = [k for k in ref if not 6000 < k < 7500]
    probes = [rng.randint(0, 10_000) for _ in range(2000)] + ref[:20]
    r = spark.createDataFrame([(at(k), float(k)) for k in ref], f"rt {times}, v double")
    p = spark.createDataFrame([(at(k), k) for k in probes] + [(None, -1)], f"t {times}, k int")
    got = {x.k: (x.v, x.matched_on) for x in asof.asof_join(p, r, "t", "rt", ["v"], direction=direction, strict=strict).collect()}
    for k in probes:
        i = bisect.bisect_left(ref, k) if direction == "forward" else (bisect.bisect_left if strict else bisect.bisect_right)(ref, k) - 1
        assert got[k] == ((float(ref[i]), at(ref[i])) if 0 <= i < len(ref) else (None, None)), k
    assert got[-1] == (None, None)


def test_asof_ranges_are_even_and_rows_meet_in_no_single_task(spark):
    times = spark.range(0, 200_000).select((F.col("id") * F.col("id")).alias("t"))
    borders = asof.range_borders(times, "t")
    sizes = [r["count"] for r in times.groupBy(asof.range_of(F.col("t"), borders).alias("r")).count().collect()]
    assert len(sizes) == asof.RANGES and max(sizes) < 2 * min(sizes)
    ref = spark.range(0, 1000).select((F.col("id") * 10 ** 7).alias("rt"), F.col("id").alias("v"))
    plan = asof.asof_join(times, ref, "t", "rt", ["v"])._jdf.queryExecution().executedPlan().toString()
    single = [line for line in plan.split("\n") if "SinglePartition" in line]
    assert len(single) <= 1  # the carried values, one row for each range


def test_asof_with_empty_sides(spark):
    ref = spark.createDataFrame([], "rt date, v double")
    p = spark.createDataFrame([(dt.date(2024, 1, 1),)], "t date")
    assert [tuple(r) for r in asof.asof_join(p, ref, "t", "rt", ["v"]).collect()] == [(dt.date(2024, 1, 1), None, None)]
    assert asof.asof_join(p.limit(0), ref, "t", "rt", ["v"]).count() == 0
