"""As-of joins that hold under skew.

The probe side may have a key with a third of all rows, so it is never put through a window.
Only its distinct ``(key, time)`` pairs are (bounded by the days of a key, combined map-side);
they are resolved against the reference rows in one sorted pass, and the answer returns to the
probe rows by an ordinary equi-join, which adaptive execution can split or broadcast by size.

Without a key all days meet in one window, which the calendar bounds; other times are dealt over ranges. Their borders are quantiles of the
times that are looked up or given, a sketch of a fixed number of values; each range is resolved
alone, and a range in which nothing was given before a time takes the last value of the ranges before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64  # ranges of times in a join without a key; as many rows carry values from range to range


def range_of(value: Column, borders: list) -> Column:
    """Number of borders at or below a value, as nested comparisons of which each row passes the logarithm."""
    def split(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value >= F.lit(borders[middle]), split(middle + 1, high)).otherwise(split(low, middle))

    return split(0, len(borders))


def range_borders(times: DataFrame, on: str) -> list:
    """Distinct quantiles of the times, at most ``RANGES`` - 1; none if the times are no dates, times or numbers."""
    shares = [(i + 1) / RANGES for i in range(RANGES - 1)]
    kind = times.schema[on].dataType.typeName()
    if kind in ("string", "binary", "boolean"):
        return []
    found = times.agg(F.percentile_approx(on, shares, 1000).alias("q")).first()["q"]
    return sorted(set(found or []))


def asof_by_range(ref: DataFrame, probe: DataFrame, on: str, order: list[Column], backward: bool, given: int) -> DataFrame:
    """As-of lookup without a key over rows (on, side, hit): (on, hit) of the probe rows."""
    rows = ref.unionByName(probe)
    rows = rows.withColumn("_range", range_of(F.col(on), range_borders(rows, on)))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.max_by if backward else F.min_by
    ends = rows.filter(F.col("side") == given).groupBy("_range").agg(last("hit", on).alias("_end"))  # at most RANGES rows
    every = rows.sparkSession.range(RANGES).select(F.col("id").cast("int").alias("_range")).join(F.broadcast(ends), "_range", "left")
    along = Window.orderBy("_range" if backward else F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select("_range", F.last("_end", ignorenulls=True).over(along).alias("_carried"))
    found = rows.withColumn("hit", F.last("hit", ignorenulls=True).over(inside)).filter(F.col("side") == 1 - given)
    return found.join(F.broadcast(carried), "_range").select(on, F.coalesce("hit", "_carried").alias("hit"))


def asof_lookup(probe: DataFrame, ref: DataFrame, on: str, ref_on: str, values: list[str],
                by: list[str] | None = None, direction: str = "backward", strict: bool = False) -> DataFrame:
    """``(by, on, values, matched_on)`` per distinct probe key; values are NULL without a match.

    ``backward``: the last reference row at or before (``strict``: before) the probe time.
    ``forward``: the first reference row at or after it.
    """
    by = by or []
    payload = F.struct(F.col(ref_on).alias("matched_on"), *values)
    empty = F.lit(None).cast(ref.select(payload.alias("p")).schema["p"].dataType)
    # side 0 sorts first on ties in the scan direction
    ref_side = 1 if strict else 0
    rows = (ref.select(*by, F.col(ref_on).alias(on), F.lit(ref_side).alias("side"), payload.alias("hit"))
            .unionByName(probe.select(*by, on).distinct()
                         .select(*by, on, F.lit(1 - ref_side).alias("side"), empty.alias("hit"))))
    order = [F.col(on), F.col("side")] if direction == "backward" else [F.col(on).desc(), F.col("side")]
    if not by and ref.schema[ref_on].dataType.typeName() != "date":  # days are few thousand a decade, other times have no bound
        ref_rows, probe_rows = (rows.filter(F.col("side") == s) for s in (ref_side, 1 - ref_side))
        return asof_by_range(ref_rows.filter(F.col(on).isNotNull()), probe_rows, on, order, direction == "backward", ref_side).select(on, "hit.*")
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (rows.withColumn("hit", F.last("hit", ignorenulls=True).over(w))
            .filter(F.col("side") == 1 - ref_side)
            .select(*by, on, "hit.*"))


def asof_join(probe: DataFrame, ref: DataFrame, on: str, ref_on: str, values: list[str],
              by: list[str] | None = None, **kw) -> DataFrame:
    """Every probe row plus ``values`` and ``matched_on`` of its as-of reference row."""
    return probe.join(asof_lookup(probe, ref, on, ref_on, values, by, **kw), [*(by or []), on], "left")
