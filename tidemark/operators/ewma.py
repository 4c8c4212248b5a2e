"""Exponentially weighted averages as plain window sums.

``y[s] = x[s]``, ``y[i] = (1-a) y[i-1] + a x[i]``. With ``d = 1-a`` and rows cut into blocks,
the part inside a block is ``d**k * sum(v / d**k)`` (``v`` is ``x`` at the seed row and ``a*x``
after it), and all earlier blocks enter through the previous block's end times ``d**(k+1)``.
The block length is chosen so that what lies two blocks back is below double precision while
``d**-k`` stays far from overflow. All windows share one sort order (key, block, row).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import ewma_block


@dataclass(frozen=True)
class Ewma:
    """``start`` is the seed row (``rn`` from 0), ``min_periods`` the observations before a value shows."""

    name: str
    value: Column
    alpha: float
    start: int = 0
    min_periods: int = 1


def span(n: int) -> float:
    return 2.0 / (n + 1)


def with_ewma(df: DataFrame, *specs: Ewma, keys: tuple[str, ...] = ("symbol",), row: str = "rn") -> DataFrame:
    """Add one column per spec; ``row`` numbers the rows of each key from 0 without gaps."""
    rn = F.col(row)
    local, names = {}, [s.name for s in specs]
    blocks = {s.name: ewma_block(s.alpha) for s in specs}
    for size in set(blocks.values()):
        df = df.withColumn(f"_b{size}", F.floor(rn / size))
    for s in specs:
        size, d = blocks[s.name], F.lit(1.0 - s.alpha)
        k = (rn % size).cast("double")
        v = F.when(rn < s.start, 0.0).when(rn == s.start, s.value).otherwise(s.value * s.alpha)
        inside = Window.partitionBy(*keys, f"_b{size}").orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
        local[f"_l_{s.name}"] = F.pow(d, k) * F.sum(v * F.pow(d, -k)).over(inside)
    df = df.withColumns(local)
    out = {}
    for s in specs:
        size, d = blocks[s.name], F.lit(1.0 - s.alpha)
        k = (rn % size).cast("double")
        before = Window.partitionBy(*keys).orderBy(f"_b{size}", row).rowsBetween(Window.unboundedPreceding, -1)
        end = F.last(F.when(rn % size == size - 1, F.col(f"_l_{s.name}")), ignorenulls=True).over(before)
        y = F.col(f"_l_{s.name}") + F.coalesce(end, F.lit(0.0)) * F.pow(d, k + 1)
        out[s.name] = F.when(rn >= s.start + s.min_periods - 1, y)
    df = df.withColumns(out)
    return df.drop(*local, *[f"_b{b}" for b in set(blocks.values())]) if names else df
