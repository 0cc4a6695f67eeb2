"""Distance decay as column expressions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def power_law_interaction(cost: Column | str | float, a: float = 1.0, b: float = -2.0, offset: float = 5000.0):
    """a * (offset + cost) ** b, and 0 where unreachable; of a number or a column."""
    if isinstance(cost, (int, float)):
        return 0.0 if cost == INF else a * (offset + cost) ** b
    c = F.col(cost) if isinstance(cost, str) else cost
    return F.when(c == INF, 0.0).otherwise(F.lit(float(a)) * F.pow(F.lit(float(offset)) + c, F.lit(float(b))))


def exponential_interaction(cost: Column | str | float, a: float = 1e-3):
    """exp(-a * cost), and 0 where unreachable; of a number or a column."""
    if a < 0:
        raise ValueError(f"a must be non-negative, got {a!r}")
    if isinstance(cost, (int, float)):
        import math

        return 0.0 if cost == INF else math.exp(-a * cost)
    c = F.col(cost) if isinstance(cost, str) else cost
    return F.when(c == INF, 0.0).otherwise(F.exp(F.lit(-float(a)) * c))


def as_column(fn: Callable | str, cost: Column) -> Column:
    """The decay function applied to a cost column, inside the JVM if it can be; a Python function of numbers runs on Arrow batches."""
    if isinstance(fn, str):
        return F.expr(fn)
    if not callable(fn):
        raise TypeError("interaction_fn must be callable or a SQL expression in cost")
    try:
        made = fn(cost)
    except Exception:  # a function of plain numbers cannot take a column
        made = None
    if isinstance(made, Column):
        return made

    @F.pandas_udf("double")
    def each(c: pd.Series) -> pd.Series:
        return c.map(lambda x: float(fn(x)))

    return each(cost)
