"""Group-by with calendar buckets, default ordering and shares."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.meta import is_numeric, is_temporal
from tablewise.operators.filters import filtered_view
from tablewise.operators.ordered import quantiles
from tablewise.operators.scalars import numeric

# --- fixed values -----------------------------------------------------------
GRAINS = ("day", "week", "month", "quarter", "year")
GRAIN_LIMITS = ((365 * 6, "year"), (365 * 2.5, "quarter"), (75, "month"), (20, "week"))
NON_ADDITIVE_NAME = (
    r"(delivery|duration|latency|wait|lead.?time|speed|response|rating|score|age|price|rate|pct|percent|ph|temperature|"
    r"temp|satisfaction|avg|mean|hours|sleep|latitude|longitude|year|protein)"
)
SCALE_NAME = r"satisf|\(1\s*-\s*\d+\)|scale|index"
COUNT_NAME = r"units|qty|quantity|count|number|items"
# ----------------------------------------------------------------------------

MISSING_LABEL = "(missing)"


@dataclass(frozen=True)
class AggSpec:
    by: tuple[str, ...] = ()
    metrics: tuple[tuple[str | None, str], ...] = ((None, "count"),)
    filters: tuple[tuple, ...] = ()
    time_grain: str | None = None
    sort: tuple[str, str] | None = None
    limit: int | None = None
    drop_null: bool = True
    orders: dict[str, tuple[str, ...]] = field(default_factory=dict)


def bucket(c: Column, grain: str) -> Column:
    """Start of the day, ISO week (Monday), month, quarter or year."""
    if grain not in GRAINS:
        raise ValueError(f"Unknown grain: {grain}")
    return F.date_trunc(grain, c).cast("timestamp_ntz")


def grain_for_span(days: float | None) -> str:
    if days is None:
        return "month"
    return next((g for limit, g in GRAIN_LIMITS if days > limit), "day")


def auto_grain(df: DataFrame, col: str) -> str:
    """Bucket size that suits the span of a date column."""
    c = F.col(col).cast("timestamp")
    row = df.agg(((F.unix_micros(F.max(c)) - F.unix_micros(F.min(c))) / 86400e6).alias("days")).first()
    return grain_for_span(row["days"])


def metric_name(col: str | None, agg: str) -> str:
    return "count" if col is None or agg == "count" else f"{agg}_{col}"


def metric_column(col: str | None, agg: str) -> Column:
    if agg == "count":
        return F.count(F.col(col)) if col else F.count(F.lit(1))
    if agg == "count_distinct":
        return F.count_distinct(F.col(col))
    if agg == "approx_distinct":
        return F.approx_count_distinct(F.col(col))
    v = numeric(F.col(col))
    made = {
        "sum": lambda: F.coalesce(F.sum(v), F.lit(0.0)),
        "mean": lambda: F.avg(v),
        "median": lambda: F.median(v),
        "min": lambda: F.min(v),
        "max": lambda: F.max(v),
        "std": lambda: F.stddev_samp(v),
    }
    if agg not in made:
        raise ValueError(f"Unknown aggregation: {agg}")
    return made[agg]()


def _keyed(df: DataFrame, spec: AggSpec) -> DataFrame:
    rows = filtered_view(df, spec.filters)
    for k in spec.by:
        if is_temporal(df, k):
            rows = rows.withColumn(k, bucket(F.col(k), spec.time_grain or auto_grain(df, k)))
        if not spec.drop_null:
            rows = rows.withColumn(k, F.coalesce(F.col(k).cast("string"), F.lit(MISSING_LABEL)))
    if spec.drop_null:
        # Plain null tests reach the scan, and leave later joins on the keys nothing to add.
        for k in spec.by:
            rows = rows.where(F.col(k).isNotNull())
    return rows


def _groups(df: DataFrame, spec: AggSpec) -> DataFrame:
    rows = _keyed(df, spec)
    metrics = list(spec.metrics)
    medians = [m for m in metrics if m[1] == "median"]
    aggregates = [metric_column(c, a).alias(metric_name(c, a)) for c, a in metrics if a != "median"]
    if not medians:
        if not spec.by:
            return rows.agg(*aggregates, F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 0).drop("__n")
        return rows.groupBy(*spec.by).agg(*aggregates)
    by = spec.by or ("__all",)  # a constant key lets the global median take the same way as the grouped one
    rows = rows if spec.by else rows.withColumn("__all", F.lit(0))
    out = rows.groupBy(*by).agg(*aggregates, F.count(F.lit(1)).alias("__n"))
    for col, agg in medians:
        clean = rows.withColumn(col, numeric(F.col(col)))
        keyed = quantiles(clean, col, {metric_name(col, agg): 0.5}, list(by)).withColumnsRenamed({k: f"__r{i}" for i, k in enumerate(by)})
        on = [F.col(k).eqNullSafe(F.col(f"__r{i}")) for i, k in enumerate(by)]
        out = out.join(keyed, on, "left").drop(*[f"__r{i}" for i in range(len(by))])
    return out.select(*spec.by, *[metric_name(c, a) for c, a in metrics])


def default_order(df: DataFrame, spec: AggSpec, out: DataFrame) -> list[Column]:
    if spec.sort:
        by, direction = spec.sort
        lead = F.col(by).asc_nulls_first() if direction == "asc" else F.col(by).desc_nulls_last()
        return [lead, *[F.col(k) for k in spec.by]]
    if not spec.by:
        return []
    first = spec.by[0]
    ties = [F.col(k) for k in spec.by]
    if first in spec.orders:
        levels = F.array(*[F.lit(v) for v in spec.orders[first]])
        return [F.array_position(levels, F.col(first)), *ties]
    if is_temporal(df, first) or is_numeric(df, first):
        return ties
    return [F.coalesce(F.col(out.columns[len(spec.by)]), F.lit(0)).desc(), *ties]


def aggregate(df: DataFrame, spec: AggSpec) -> DataFrame:
    """Grouped metrics in display order; groups with a missing key are left out unless asked for."""
    out = _groups(df, spec)
    order = default_order(df, spec, out)
    out = out.orderBy(*order) if order else out
    return out.limit(spec.limit) if spec.limit else out


def total_groups(df: DataFrame, spec: AggSpec) -> DataFrame:
    return _groups(df, spec).agg(F.count(F.lit(1)).alias("total_groups"))


def non_additive_by_name(col: str, unit: str | None = None, likert: bool = False) -> bool:
    return unit == "%" or likert or bool(re.search(NON_ADDITIVE_NAME, col, re.I) or re.search(SCALE_NAME, col, re.I))


def rating_like(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column: are all values whole numbers from 0 to 10?"""
    tests = []
    for c in cols:
        v = numeric(F.col(c))
        flag = (F.count(v) > 0) & (F.count_if(v != F.floor(v)) == 0) & (F.min(v) >= 0) & (F.max(v) <= 10)
        tests.append(F.struct(F.lit(c).alias("column"), F.coalesce(flag, F.lit(False)).alias("rating_like")))
    return df.agg(F.array(*tests).alias("t")).select(F.inline("t"))


def default_agg(df: DataFrame, col: str | None, unit: str | None = None, likert: bool = False) -> str:
    """``mean`` for rates, scores and ratings, ``sum`` for amounts, ``count`` without a column."""
    if col is None:
        return "count"
    if non_additive_by_name(col, unit, likert):
        return "mean"
    if re.search(COUNT_NAME, col, re.I):
        return "sum"
    return "mean" if rating_like(df, [col]).first()["rating_like"] else "sum"


def group_summary(df: DataFrame, by: str, measure: str | None = None, agg: str | None = None, grain: str | None = None) -> DataFrame:
    """Metric and row count per group; additive metrics also get their share of the total."""
    if measure is None:
        spec = AggSpec(by=(by,), time_grain=grain)
        value, kind = "count", "count"
        groups = _groups(df, spec)
    else:
        kind = agg or default_agg(df, measure)
        spec = AggSpec(by=(by,), metrics=((measure, kind), (measure, "count")) if kind != "count" else ((measure, "count"),), time_grain=grain)
        value = metric_name(measure, kind)
        groups = _groups(df, spec)
        if kind != "count":
            groups = groups.withColumnRenamed("count", "n")
    out = groups
    if kind in ("sum", "count"):
        # The total asks for every grouped column, so it reads the same exchange and the source is scanned once.
        rest = [F.max(c).alias(c) for c in groups.columns if c not in (by, value)]
        total = groups.agg(F.struct(F.sum(value).alias("t"), *rest).alias("s")).scalar()["t"]
        out = groups.withColumn("share", F.try_divide(F.col(value), total))
    order = default_order(df, spec, out)
    return out.orderBy(*order)
