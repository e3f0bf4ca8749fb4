"""Time series on a reduced frame.

The heavy step is the group-by that turns rows into one value per calendar bucket (and per series).  The windows
below run on that frame: a series can never hold more rows than its calendar has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise.operators.aggregate import auto_grain, bucket, default_agg, metric_column
from tablewise.operators.scalars import correlation_of, numeric, scalar

# --- fixed values -----------------------------------------------------------
PERIODS_PER_YEAR = {"day": 365, "week": 52, "month": 12, "quarter": 4, "year": 1}
GRAIN_STEP = {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month", "quarter": "interval 3 months", "year": "interval 1 year"}
# ----------------------------------------------------------------------------


def period_values(df: DataFrame, date: str, measure: str | None = None, agg: str | None = None, grain: str | None = None,
                  by=()) -> DataFrame:
    """(by..., period, value): one row per calendar bucket that has data."""
    grain = grain or auto_grain(df, date)
    agg = agg or default_agg(df, measure)
    rows = df.where(F.col(date).isNotNull()).groupBy(*by, bucket(F.col(date), grain).alias("period"))
    out = rows.agg(metric_column(measure, agg).cast("double").alias("value"))
    return out.where(F.col("value").isNotNull())


def _along(by, order="period"):
    return Window.partitionBy(*by).orderBy(order) if by else Window.orderBy(order)


def period_change(frame: DataFrame, by=(), name: str = "change") -> DataFrame:
    before = F.lag("value").over(_along(by))
    return frame.withColumn(name, F.when(before != 0, F.col("value") / before - 1))


def yoy_change(frame: DataFrame, grain: str, by=(), name: str = "yoy") -> DataFrame:
    """Against the row one year of periods earlier, by position."""
    before = F.lag("value", PERIODS_PER_YEAR[grain]).over(_along(by))
    return frame.withColumn(name, F.when(before != 0, F.col("value") / before - 1))


def rolling_mean(frame: DataFrame, k: int = 3, by=(), name: str = "rolling") -> DataFrame:
    w = _along(by).rowsBetween(-(k - 1), 0)
    return frame.withColumn(name, F.when(F.count(F.lit(1)).over(w) == k, F.avg("value").over(w)))


def indexed(frame: DataFrame, by=()) -> DataFrame:
    """Add the position from 0 and the series length."""
    whole = Window.partitionBy(*by) if by else Window.partitionBy()
    return frame.withColumn("i", F.row_number().over(_along(by)) - 1).withColumn("len", F.count(F.lit(1)).over(whole))


def growth_streak(frame: DataFrame, by=()) -> DataFrame:
    """Consecutive rises that end at the last period."""
    rows = indexed(frame, by).withColumn("before", F.lag("value").over(_along(by)))
    broke = F.max(F.when(F.col("before").isNull() | (F.col("value") <= F.col("before")), F.col("i")))
    return rows.groupBy(*by).agg((F.max("i") - F.coalesce(broke, F.lit(0))).alias("streak"))


def largest_jump(frame: DataFrame, by=()) -> DataFrame:
    """The biggest relative change, the spread of all changes, and whether it stands out."""
    before = F.lag("value").over(_along(by))
    rows = frame.withColumn("before", before).withColumn(
        "ch", F.when(F.col("before").isNotNull(), F.when(F.col("before") != 0, F.col("value") / F.col("before") - 1).otherwise(0.0)))
    sized = F.when(F.col("ch").isNotNull() & (F.col("ch") != 0), F.struct(F.abs("ch").alias("a"), (-F.unix_micros(F.col("period").cast("timestamp"))).alias("b")))
    out = rows.groupBy(*by).agg(F.max_by("period", sized).alias("period"), F.max_by("ch", sized).alias("change"),
                                F.stddev_samp("ch").alias("sd_change"))
    stands = (F.abs("change") > 0.15) & (F.abs("change") > 1.8 * F.col("sd_change"))
    return out.withColumn("flagged", F.coalesce(stands, F.lit(False)))


def half_split_change(frame: DataFrame, by=()) -> DataFrame:
    """Mean of the last half of the periods against the mean of the first half."""
    rows = indexed(frame, by)
    half = F.floor(F.col("len") / 2)
    out = rows.groupBy(*by).agg(
        F.avg(F.when(F.col("i") < half, F.col("value"))).alias("first_half"),
        F.avg(F.when(F.col("i") >= F.col("len") - half, F.col("value"))).alias("second_half"))
    return out.withColumn("change", F.when(F.col("first_half") != 0, F.col("second_half") / F.col("first_half") - 1))


def drop_partial_tail(frame: DataFrame, by=(), longer_than: int = 4) -> DataFrame:
    """Drop the last period when it is under half the mean of the three before it."""
    rows = indexed(frame, by).withColumn("prev3", F.avg("value").over(_along(by).rowsBetween(-3, -1)))
    partial = (F.col("i") == F.col("len") - 1) & (F.col("len") > longer_than) & (F.col("value") < F.col("prev3") * 0.5)
    return rows.where(~F.coalesce(partial, F.lit(False))).select(*frame.columns)


def time_series(df: DataFrame, date: str, measure: str | None = None, grain: str | None = None, agg: str | None = None,
                by=(), rolling: int = 3) -> DataFrame:
    """Value per period with change, year-on-year change and rolling mean."""
    grain = grain or auto_grain(df, date)
    frame = period_values(df, date, measure, agg, grain, by)
    return rolling_mean(yoy_change(period_change(frame, by), grain, by), rolling, by)


def trend_fit(frame: DataFrame, by=()) -> DataFrame:
    """Correlation (none of a constant series) and least-squares line of the value against its position."""
    rows = indexed(frame, by).withColumn("x", F.col("i").cast("double"))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), correlation_of(F.col("x"), F.col("value")).alias("r"),
        F.coalesce(F.regr_slope("value", "x"), F.lit(0.0)).alias("slope"),
        F.coalesce(F.regr_intercept("value", "x"), F.avg("value")).alias("intercept"),
        F.max_by("period", F.struct(F.col("value"), -F.col("i"))).alias("peak"))


def periods(df: DataFrame, date: str, grain: str | None = None) -> DataFrame:
    grain = grain or auto_grain(df, date)
    return df.where(F.col(date).isNotNull()).select(bucket(F.col(date), grain).alias("period")).distinct()


def resample(df: DataFrame, date: str, measure: str, grain: str = "month") -> DataFrame:
    """Sum per bucket on a complete calendar; empty buckets hold 0."""
    sums = df.where(F.col(date).isNotNull()).groupBy(bucket(F.col(date), grain).alias("period")).agg(
        F.coalesce(F.sum(numeric(F.col(measure))), F.lit(0.0)).alias("value"))
    span = sums.agg(F.min("period").alias("a"), F.max("period").alias("b"))
    calendar = span.select(F.explode(F.sequence("a", "b", F.expr(GRAIN_STEP[grain]))).alias("period"))
    return calendar.join(sums, "period", "left").select("period", F.coalesce("value", F.lit(0.0)).alias("value"))


def step_periods(start: Column, k: Column, grain: str) -> Column:
    """The bucket ``k`` steps after ``start``."""
    months = {"month": 1, "quarter": 3, "year": 12}
    if grain in months:
        return F.add_months(start, k * months[grain]).cast("timestamp_ntz")
    days = 7 if grain == "week" else 1
    return F.date_add(start.cast("date"), (k * days).cast("int")).cast("timestamp_ntz")


def kpis(df: DataFrame, measure: str, agg: str, date: str | None = None, grain: str | None = None) -> DataFrame:
    """Headline value, row and column counts, second half against first half unless one row dominates."""
    v = numeric(F.col(measure))
    main = F.coalesce(F.sum(v), F.lit(0.0)) if agg == "sum" else F.avg(v)
    facts = df.agg(main.alias("value"), F.count(F.lit(1)).alias("rows"), F.max(F.when(v > 0, v)).alias("__mx"), F.sum(F.when(v > 0, v)).alias("__tot"))
    facts = facts.withColumn("columns", F.lit(len(df.columns)))
    if not date:
        return facts.withColumn("delta", F.lit(None).cast("double")).select("value", "rows", "columns", "delta")
    frame = period_values(df, date, measure, agg, grain)
    halves = indexed(frame)
    half = F.floor(F.col("len") / 2)
    first, last = F.when(F.col("i") < half, F.col("value")), F.when(F.col("i") >= F.col("len") - half, F.col("value"))
    fold = F.sum if agg == "sum" else F.avg
    s = scalar(halves, n=F.count(F.lit(1)), a=fold(first), b=fold(last))
    dominated = F.lit(agg == "sum") & (F.col("__mx") / F.col("__tot") > 0.2) & (F.col("rows") >= 30)
    delta = F.when((s["n"] >= 4) & (s["a"] != 0) & ~F.coalesce(dominated, F.lit(False)), s["b"] / s["a"] - 1)
    return facts.withColumn("delta", delta).select("value", "rows", "columns", "delta")
