"""Predicates and casts shared by the operators."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """Neither null nor NaN nor infinite."""
    x = as_column(c).cast("double")
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf), F.lit(False))


def all_finite(*columns: str | Column) -> Column:
    return reduce(lambda a, b: a & b, (finite(c) for c in columns))


def ratio(a: Column, b: Column) -> Column:
    """a / b; a signed infinity for a non-zero a over 0, null for 0 over 0."""
    return F.when(b != 0, a / F.when(b != 0, b)).when(a > 0, F.lit(math.inf)).when(a < 0, F.lit(-math.inf))


def check_alpha(alpha: float) -> None:
    if not 0 < alpha < 1:
        raise ValueError(f"alpha must lie between 0 and 1, not {alpha}")
