"""Predicates, projections and derived columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.functions.parsing import number_text, parse_date, parse_number
from tablewise.meta import is_numeric, is_temporal


def predicate(df: DataFrame, col: str, op: str, value) -> Column:
    """Comparison that null never passes; text compares without case for =, != and contains."""
    c = F.col(col)
    if op == "in":
        shown = number_text(c) if is_numeric(df, col) else c.cast("string")
        return F.coalesce(shown.isin(*[str(v) for v in value]), F.lit(False))
    if op == "contains":
        shown = number_text(c) if is_numeric(df, col) else c.cast("string")
        return F.coalesce(F.lower(shown).contains(str(value).lower()), F.lit(False))
    if is_numeric(df, col):
        target = F.lit(value) if isinstance(value, (int, float)) else parse_number(F.lit(str(value)))
    elif is_temporal(df, col):
        # Read the date once and compare with a plain literal, so that the test reaches the scan.
        moment = df.sparkSession.range(1).select(parse_date(F.lit(str(value)))).first()[0]
        target = F.lit(moment).cast("timestamp_ntz").cast(df.schema[col].dataType)
    else:
        if op in ("=", "!="):
            c, target = F.lower(c.cast("string")), F.lit(str(value).lower())
        else:
            target = F.lit(str(value))
    tests = {"=": c == target, "!=": c != target, ">": c > target, "<": c < target, ">=": c >= target, "<=": c <= target}
    if op not in tests:
        raise ValueError(f"Unknown comparison: {op}")
    return tests[op]


def filter_rows(df: DataFrame, col: str, op: str, value) -> DataFrame:
    return df.where(predicate(df, col, op, value))


def filtered_view(df: DataFrame, filters) -> DataFrame:
    """Rows that pass every (column, operator, value)."""
    tests = [predicate(df, *f) for f in filters]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def rename(df: DataFrame, col: str, to: str) -> DataFrame:
    if col not in df.columns:
        raise ValueError(f"Column not found: {col}")
    if to in df.columns:
        raise ValueError(f"A column called {to} already exists")
    return df.withColumnRenamed(col, to)


def drop_column(df: DataFrame, col: str) -> DataFrame:
    return df.drop(col)


def derive(df: DataFrame, name: str, a: str, op: str, b, constant: bool = False) -> DataFrame:
    """Arithmetic on two columns or a column and a constant; division by zero gives null."""
    x = F.col(a).cast("double")
    y = F.lit(float(b)) if constant else F.col(b).cast("double")
    made = {"+": x + y, "-": x - y, "*": x * y, "/": F.try_divide(x, y)}[op]
    return df.withColumn(name, made)


def derived_unit(op: str, unit: str | None, constant: bool) -> str | None:
    """A currency survives sums, differences and scaling; a percent sign never does."""
    keeps = op in "+-" or (op == "*" and constant)
    return unit if unit and unit != "%" and keeps else None


def preview(df: DataFrame, n: int = 50, order_by: list[str] = ()) -> DataFrame:
    """The first rows; which ones is only fixed by ``order_by``."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def sort_rows(df: DataFrame, by: str, descending: bool = False) -> DataFrame:
    """Missing values count as the smallest."""
    return df.orderBy(F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_first())


def top_k(df: DataFrame, by: str, k: int, tie: list[str] = (), bottom: bool = False) -> DataFrame:
    lead = F.col(by).asc_nulls_first() if bottom else F.col(by).desc_nulls_last()
    return df.orderBy(lead, *tie).limit(k)


def distinct_values(df: DataFrame, col: str, limit: int = 200) -> DataFrame:
    return df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col).limit(limit)


def systematic_sample(df: DataFrame, key: str, step: int) -> DataFrame:
    """Every ``step``-th key; a non-integer key is hashed first. No ordering and no shuffle."""
    whole = df.schema[key].dataType.typeName() in ("byte", "short", "integer", "long")
    spot = F.col(key) if whole else F.xxhash64(key)
    return df.where(F.pmod(spot, F.lit(step)) == 0)
