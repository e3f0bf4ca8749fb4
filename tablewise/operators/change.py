"""Which segments moved a measure between two periods."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewise.operators.aggregate import auto_grain, bucket
from tablewise.operators.scalars import numeric
from tablewise.operators.series import GRAIN_STEP, period_values


@dataclass(frozen=True)
class Change:
    previous: datetime
    current: datetime
    previous_value: float
    current_value: float

    @property
    def total(self) -> float:
        return self.current_value - self.previous_value


def pick_change(df: DataFrame, date: str, measure: str | None, grain: str, agg: str, period: datetime | None = None) -> Change | None:
    """The named period against the one before it, or else the largest absolute move (the earliest among equals)."""
    frame = period_values(df, date, measure, agg if measure else "count", grain)
    w = Window.orderBy("period")  # one row per calendar bucket
    rows = frame.select("period", "value", F.lag("period").over(w).alias("p0"), F.lag("value").over(w).alias("v0")).where(F.col("p0").isNotNull())
    chosen = None
    if period is not None:
        chosen = rows.where(F.col("period") == F.lit(period).cast("timestamp_ntz")).first()
    if chosen is None:
        chosen = rows.orderBy(F.abs(F.col("value") - F.col("v0")).desc(), "period").first()
    return Change(chosen["p0"], chosen["period"], chosen["v0"], chosen["value"]) if chosen else None


def _in_bucket(date: str, start: datetime, grain: str):
    low = F.lit(start).cast("timestamp_ntz")
    return (F.col(date) >= low) & (F.col(date) < low + F.expr(GRAIN_STEP[grain]))


def contributions(df: DataFrame, date: str, measure: str | None, dims: list[str], change: Change, grain: str, agg: str = "sum") -> DataFrame:
    """(dim, value, prev, cur, delta) for every value of every dimension.

    The two buckets are literal ranges on the raw column, so the scan reads only them; all dimensions are
    answered by one group-by of an unpivoted frame.
    """
    was, now = _in_bucket(date, change.previous, grain), _in_bucket(date, change.current, grain)
    amount = numeric(F.col(measure)) if measure else F.lit(1.0)
    rows = df.where(was | now).select(now.alias("__now"), amount.alias("__v"), *[F.col(d).cast("string").alias(d) for d in dims]).where(F.col("__v").isNotNull())
    long = rows.unpivot(["__now", "__v"], dims, "dim", "value").where(F.col("value").isNotNull())
    fold = F.avg if agg == "mean" else F.sum
    out = long.groupBy("dim", "value").agg(
        F.coalesce(fold(F.when(~F.col("__now"), F.col("__v"))), F.lit(0.0)).alias("prev"),
        F.coalesce(fold(F.when(F.col("__now"), F.col("__v"))), F.lit(0.0)).alias("cur"))
    return out.withColumn("delta", F.col("cur") - F.col("prev"))


def explain_change(df: DataFrame, date: str, measure: str | None, dims: list[str], grain: str | None = None, agg: str = "sum",
                   period: datetime | None = None, top: int = 4) -> DataFrame:
    """Top movers per dimension, dimensions ranked by how concentrated the change is."""
    grain = grain or auto_grain(df, date)
    change = pick_change(df, date, measure, grain, agg, period)
    if change is None:
        raise ValueError("Need at least two periods.")
    parts = contributions(df, date, measure, dims, change, grain, agg)
    spread = parts.groupBy("dim").agg(F.max(F.abs("delta")).alias("__top"), F.sum(F.abs("delta")).alias("__all"), F.count(F.lit(1)).alias("__n"))
    focus = F.coalesce(F.col("__top") / F.nullif(F.col("__all"), F.lit(0.0)), F.col("__top")) - 1 / F.col("__n")
    spread = spread.select("dim", (focus if agg == "sum" and change.total else F.lit(0.0)).alias("concentration"))
    place = Window.partitionBy("dim").orderBy(F.abs("delta").desc(), "value")
    best = parts.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    # One row per dimension on the small side, and at most five dimensions.
    return best.join(F.broadcast(spread), "dim").select("dim", "value", "prev", "cur", "delta", "rank", "concentration").orderBy(
        F.col("concentration").desc(), "dim", "rank")


def waterfall(df: DataFrame, date: str, measure: str | None, dim: str, grain: str | None = None, agg: str = "sum",
              period: datetime | None = None, top: int = 6) -> DataFrame:
    """Start, the largest moves, everything else, end."""
    grain = grain or auto_grain(df, date)
    change = pick_change(df, date, measure, grain, agg, period)
    parts = contributions(df, date, measure, [dim], change, grain, agg)
    lead = parts.orderBy(F.abs("delta").desc(), "value").limit(top)
    place = Window.orderBy(F.abs("delta").desc(), "value")  # at most ``top`` rows
    moves = lead.select(F.row_number().over(place).alias("step"), F.col("value").alias("label"), F.col("delta").alias("amount"))
    ends = lambda step, label, amount: lead.sparkSession.range(1).select(
        F.lit(step).alias("step"), F.lit(label).alias("label"), F.lit(float(amount)).alias("amount"))
    rest = lead.agg((F.lit(float(change.total)) - F.coalesce(F.sum("delta"), F.lit(0.0))).alias("amount")).where(F.abs("amount") > 1e-9)
    rest = rest.select(F.lit(top + 1).alias("step"), F.lit("Other").alias("label"), "amount")
    return ends(0, "start", change.previous_value).unionByName(moves).unionByName(rest).unionByName(ends(top + 2, "end", change.current_value))
