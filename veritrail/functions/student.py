"""Student's t distribution as column expressions.

Up to ``EXACT`` degrees of freedom the two-sided tail is a finite trigonometric sum; beyond, t is mapped to a
normal deviate by an expansion in 1/df.  Critical values come from a table computed here, or from the
Cornish-Fisher expansion.
"""

from __future__ import annotations

import functools
import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT = 200


def two_sided_p_exact(t: float, df: int) -> float:
    """The finite sum in Python (for the table, and for tests)."""
    theta = math.atan2(abs(t), math.sqrt(df))
    c, s = math.cos(theta), math.sin(theta)
    if df == 1:
        return 1 - 2 * theta / math.pi
    term, total = (1.0, 1.0) if df % 2 == 0 else (c, c)
    for k in range(1, (df - 2) // 2 + 1 if df % 2 == 0 else (df - 3) // 2 + 1):
        term *= c * c * ((2 * k - 1) / (2 * k) if df % 2 == 0 else 2 * k / (2 * k + 1))
        total += term
    return 1 - s * total if df % 2 == 0 else 1 - 2 / math.pi * (theta + s * total)


def _expanded(df, z: float):
    """Cornish-Fisher terms of the quantile; df may be a number or a column."""
    return (
        z
        + (z**3 + z) / (4 * df)
        + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df**2)
        + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * df**3)
        + (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / (92160 * df**4)
    )


@functools.lru_cache(maxsize=16)
def critical_table(alpha: float) -> tuple[float, ...]:
    """Two-sided critical values for 1 .. EXACT degrees of freedom, by bisection."""
    out = []
    for df in range(1, EXACT + 1):
        low, high = 0.0, 1e4 / alpha
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if two_sided_p_exact(mid, df) > alpha else (low, mid)
            if high - low <= 1e-15 * high:
                break
        out.append((low + high) / 2)
    return tuple(out)


def critical_value(df: float | None, alpha: float = 0.05) -> float:
    if df is None or not df >= 1:
        return math.inf
    return critical_table(alpha)[int(df) - 1] if df <= EXACT else float(_expanded(df, NormalDist().inv_cdf(1 - alpha / 2)))


def _bound_once(body, *values: Column) -> Column:
    """``body`` of the values, which stand in the plan once however often it uses them."""
    one = F.struct(*(v.cast("double").alias(f"v{k}") for k, v in enumerate(values)))
    return F.element_at(F.transform(F.array(one), lambda s: body(*(s[f"v{k}"] for k in range(len(values))))), 1)


def critical(df: Column, alpha: float = 0.05) -> Column:
    """Critical |t|; infinite where df is null or below 1."""
    return _bound_once(lambda x: _critical(x, alpha), df)


def _critical(df: Column, alpha: float) -> Column:
    table = F.array(*(F.lit(x) for x in critical_table(alpha)))
    z = NormalDist().inv_cdf(1 - alpha / 2)
    wide = F.greatest(df, F.lit(float(EXACT + 1)))
    far = F.lit(z) + (z**3 + z) / (4 * wide) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * wide * wide)
    far = far + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * wide * wide * wide)
    near = F.element_at(table, F.least(F.greatest(df, F.lit(1.0)), F.lit(float(EXACT))).cast("int"))
    return F.when(df.isNull() | F.isnan(df) | (df < 1), F.lit(math.inf)).when(df <= EXACT, near).otherwise(far)


def _erfc(x: Column) -> Column:
    """Complementary error function of a non-negative column: series of positive terms, or fraction."""
    start = F.struct(x.alias("t"), x.alias("s"))

    def add(a, n):
        t = a["t"] * 2 * x * x / (2 * n + 1)
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

    series = 1 - 2 / math.sqrt(math.pi) * F.exp(-x * x) * F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, add, lambda a: a["s"])
    low = F.greatest(x, F.lit(1.0))
    tail = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), low, lambda a, k: low + k / 2 / a)
    return F.when(x < 2.5, series).otherwise(F.exp(-x * x) / math.sqrt(math.pi) / tail)


def two_sided_p(t: Column, df: Column) -> Column:
    """P(|T| >= |t|); null where t or df is null; 0 for infinite t."""
    return _bound_once(_two_sided_p, t, df)


def _two_sided_p(t: Column, df: Column) -> Column:
    nu = F.least(F.greatest(df.cast("int"), F.lit(1)), F.lit(EXACT))
    a = F.abs(t)
    theta = F.atan2(a, F.sqrt(nu.cast("double")))
    c, s = F.cos(theta), F.sin(theta)
    even = nu % 2 == 0
    first = F.when(even, F.lit(1.0)).otherwise(c)
    last = F.when(even, F.floor((nu - 2) / 2)).otherwise(F.floor((nu - 3) / 2)).cast("int")

    def add(acc, k):
        ratio = F.when(even, (2 * k - 1) / (2 * k)).otherwise(2 * k / (2 * k + 1))
        term = acc["t"] * c * c * ratio
        return F.struct(term.alias("t"), (acc["s"] + term).alias("s"))

    steps = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(steps, F.struct(first.alias("t"), first.alias("s")), add, lambda acc: acc["s"])
    exact = F.when(nu == 1, 1 - 2 * theta / math.pi).when(even, 1 - s * total).otherwise(1 - 2 / math.pi * (theta + s * total))
    n = F.greatest(df, F.lit(float(EXACT + 1)))
    b = n - 0.5
    y = F.sqrt(b * F.log1p(t * t / n))  # Hill's normal deviate
    w = 48 * b * b
    z = y + (F.pow(y, 3) + 3 * y) / w - (4 * F.pow(y, 7) + 33 * F.pow(y, 5) + 240 * F.pow(y, 3) + 855 * y) / (10 * w * (w + 0.8 * F.pow(y, 4) + 100))
    p = F.when(df <= EXACT, exact).otherwise(_erfc(F.abs(z) / math.sqrt(2)))
    return F.when(t.isNull() | F.isnan(t) | df.isNull() | (df < 1), None).when(a == math.inf, 0.0).otherwise(F.greatest(p, F.lit(0.0)))
