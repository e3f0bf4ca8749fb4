"""Tail probabilities for small frames of test statistics.

The statistics themselves are Spark aggregates; these functions see one row per test, series or segment.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Executors need no copy of the package to run these helpers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# --- fixed values: polynomial approximation 26.2.17 of the normal tail, as rounded by the specification -------
NORMAL_DENSITY = 0.3989423
NORMAL_RATE = 0.2316419
NORMAL_TERMS = (0.3193815, -0.3565638, 1.781478, -1.821256, 1.330274)
T_QUANTILE_CAP = 50.0
# ----------------------------------------------------------------------------------------------------------------


def _continued_fraction(terms: Iterator[tuple[float, float]], first: float, tiny: float = 1e-300, limit: int = 2000) -> float:
    """first + a1/(b1 + a2/(b2 + ...)) from (a, b) pairs, evaluated front to back."""
    value = first or tiny
    upper, lower = value, 0.0
    for _, (a, b) in zip(range(limit), terms):
        lower = b + a * lower
        lower = 1.0 / (lower if abs(lower) > tiny else tiny)
        upper = b + a / upper
        upper = upper if abs(upper) > tiny else tiny
        ratio = upper * lower
        value *= ratio
        if abs(ratio - 1.0) < 1e-15:
            break
    return value


def beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_share(1.0 - x, b, a)

    def terms():
        m = 0
        while True:
            if m:
                yield m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0
            yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
            m += 1

    log_front = a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    return math.exp(log_front) / a / _continued_fraction(terms(), 1.0)


def gamma_upper_share(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0.0:
        return 1.0
    log_front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1.0
            term *= x / n
            total += term
        return 1.0 - total * math.exp(log_front)

    def terms():
        n = 1
        while True:
            yield n * (a - n), x - a + 2 * n + 1
            n += 1

    return math.exp(log_front) / _continued_fraction(terms(), x - a + 1.0)


def t_two_sided(t: float, df: float) -> float:
    return beta_share(df / (df + t * t), df / 2.0, 0.5)


def t_quantile(p: float, df: float) -> float:
    """Upper quantile by halving, between 0 and the cap."""
    low, high = 0.0, T_QUANTILE_CAP
    for _ in range(80):
        mid = (low + high) / 2.0
        if 1.0 - t_two_sided(mid, df) / 2.0 < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2.0


def f_upper(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_share(d2 / (d2 + d1 * f), d2 / 2.0, d1 / 2.0)


def chi2_upper(x: float, k: float) -> float:
    return gamma_upper_share(k / 2.0, x / 2.0)


def normal_cdf(z: Column) -> Column:
    """Normal distribution function as a plain Column."""
    t = 1 / (1 + NORMAL_RATE * F.abs(z))
    tail = F.lit(0.0)
    for term in reversed(NORMAL_TERMS):
        tail = t * (F.lit(term) + tail)
    tail = NORMAL_DENSITY * F.exp(-z * z / 2) * tail
    return F.when(z > 0, 1 - tail).otherwise(tail)


def _rowwise(fn: Callable[..., float]):
    """Arrow batches in, one call per statistic; any missing input gives a missing result."""

    @F.pandas_udf("double")
    def apply(*columns: pd.Series) -> pd.Series:
        out = []
        for row in zip(*columns):
            bad = any(v is None or not math.isfinite(v) for v in row)
            out.append(None if bad else fn(*[float(v) for v in row]))
        return pd.Series(out, dtype="float64")

    return apply


def p_t(t: Column, df: Column) -> Column:
    return _rowwise(t_two_sided)(t.cast("double"), df.cast("double"))


def p_f(f: Column, d1: Column, d2: Column) -> Column:
    return _rowwise(f_upper)(f.cast("double"), d1.cast("double"), d2.cast("double"))


def p_chi2(x: Column, k: Column) -> Column:
    return _rowwise(chi2_upper)(x.cast("double"), k.cast("double"))


def t_critical(p: Column, df: Column) -> Column:
    return _rowwise(t_quantile)(p.cast("double"), df.cast("double"))


def p_normal(z: Column) -> Column:
    return 2 * normal_cdf(-F.abs(z))


def add_p_values(results: DataFrame, kind: str, statistic: str, df1: str | None = None, df2: str | None = None, name: str = "p") -> DataFrame:
    """Append p-values to a table of t, F, chi-square or normal statistics."""
    made = {
        "t": lambda: p_t(F.col(statistic), F.col(df1)),
        "f": lambda: p_f(F.col(statistic), F.col(df1), F.col(df2)),
        "chi2": lambda: p_chi2(F.col(statistic), F.col(df1)),
        "normal": lambda: p_normal(F.col(statistic)),
    }
    return results.withColumn(name, made[kind]())
