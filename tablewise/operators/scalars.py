"""One-row facts as scalar subqueries: planned with the query, shipped to tasks as a literal, no cross join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.operators.ordered import quantiles


def scalar(df: DataFrame, **aggregates: Column) -> Column:
    """Struct of global aggregates, usable in any expression."""
    return df.agg(F.struct(*[c.alias(n) for n, c in aggregates.items()]).alias("s")).scalar()


def scalar_quantiles(df: DataFrame, col: str, method: str = "exact", **probs: float) -> Column:
    frame = quantiles(df.select(col), col, probs, method=method)
    return frame.select(F.struct(*probs).alias("s")).scalar()


def numeric(c: Column) -> Column:
    """Double with NaN and infinities read as missing."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def correlation_of(a: Column, b: Column) -> Column:
    """Pearson's r over complete pairs; null instead of an error where a side does not vary."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y)))
