"""Null-safe arithmetic on columns.

Spark's ``least``/``greatest`` skip NULL and NaN sorts above every number, so each helper
states what a missing input gives: always NULL, never a made-up bound.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dbl(value: float) -> Column:
    """Double literal (plain decimals would turn a column into DECIMAL in SQL text)."""
    return F.lit(float(value)).cast("double")


def nan_to_null(col: Column) -> Column:
    return F.when(F.isnan(col), F.lit(None)).otherwise(col)


def number_or_null(col: Column) -> Column:
    """Text or number to DOUBLE; unparsable text and NaN become NULL."""
    return nan_to_null(col.try_cast("double"))


def clamp(col: Column, low: float, high: float) -> Column:
    return F.when(col.isNotNull(), F.greatest(dbl(low), F.least(dbl(high), col)))


def ratio(num: Column, den: Column) -> Column:
    """``num / den``, NULL when the divisor is zero or missing."""
    return num / F.when(den != 0, den)


def falsy_to_null(col: Column) -> Column:
    """Zero counts as missing, so that the next alias is tried."""
    return F.when(col != 0, col)


def first_truthy(*cols: Column, default: float | None = None) -> Column:
    choices = [falsy_to_null(c) for c in cols]
    if default is not None:
        choices.append(dbl(default))
    return F.coalesce(*choices)


def bisect_root(fn, low: float, high: float, steps: int, tol: float = 0.0) -> Column:
    """Root of ``fn(rate Column) -> Column`` on ``[low, high]`` by interval halving.

    The fold runs inside one expression: no rows are added and nothing leaves the executor.
    The sign test always compares with the value at the current low end, so the function need
    not be monotone. NULL when both ends have the same sign.
    """
    start = F.struct(dbl(low).alias("lo"), dbl(high).alias("hi"), fn(dbl(low)).alias("f_lo"),
                     F.lit(None).cast("double").alias("hit"))

    def step(acc: Column, _i: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2.0
        # one evaluation per step: bind it by a one-element transform
        bound = F.transform(F.array(F.struct(mid.alias("m"), fn(mid).alias("f"))), lambda b: F.struct(
            F.when(acc["hit"].isNotNull(), acc["lo"]).when(acc["f_lo"] * b["f"] < 0, acc["lo"]).otherwise(b["m"]).alias("lo"),
            F.when(acc["hit"].isNotNull(), acc["hi"]).when(acc["f_lo"] * b["f"] < 0, b["m"]).otherwise(acc["hi"]).alias("hi"),
            F.when(acc["hit"].isNotNull(), acc["f_lo"]).when(acc["f_lo"] * b["f"] < 0, acc["f_lo"]).otherwise(b["f"]).alias("f_lo"),
            F.coalesce(acc["hit"], F.when(F.abs(b["f"]) < tol, b["m"])).alias("hit"),
        ))
        return F.element_at(bound, 1)

    folded = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step,
                         lambda acc: F.coalesce(acc["hit"], (acc["lo"] + acc["hi"]) / 2.0))
    return F.when(fn(dbl(low)) * fn(dbl(high)) <= 0, folded)


def ewma_block(alpha: float) -> int:
    """Rows per block for the scaled prefix sum, see ``operators.ewma``."""
    h = -math.log1p(-alpha)
    return 1024 if 39.0 <= 1024 * h <= 600.0 else math.ceil(100.0 / h)
