"""Ordered-scale questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
RELIABILITY_WORDS = ((0.9, "Excellent"), (0.8, "Good"), (0.7, "Acceptable"), (0.6, "Questionable"))
# ----------------------------------------------------------------------------


def survey_summary(df: DataFrame, orders: dict[str, list[str]]) -> DataFrame:
    """Per item: answers, mean score, and the shares of the top two, middle and bottom two levels."""
    items = list(orders)
    long = df.select(*items).unpivot([], items, "item", "answer").where(F.col("answer").isNotNull())
    levels = F.create_map(*[x for i in items for x in (F.lit(i), F.array(*[F.lit(v) for v in orders[i]]))])
    scored = long.withColumn("__l", levels[F.col("item")]).withColumn("s", F.array_position("__l", F.col("answer")).cast("int")).withColumn("size", F.size("__l"))
    share = lambda test: F.avg(test.cast("int"))
    # An answer outside the scale counts as a bottom answer, as position 0 does.
    out = scored.groupBy("item").agg(
        F.count(F.lit(1)).alias("n"), F.avg("s").alias("mean_score"), share(F.col("s") > F.col("size") - 2).alias("top_two"),
        share(F.col("s") <= 2).alias("bottom_two"))
    return out.select("item", "n", "mean_score", "top_two", (1 - F.col("top_two") - F.col("bottom_two")).alias("middle"), "bottom_two")


def reliability_label(alpha: Column) -> Column:
    (first, word), *rest = RELIABILITY_WORDS
    out = F.when(alpha >= first, word)
    for limit, word in rest:
        out = out.when(alpha >= limit, word)
    return F.when(alpha.isNotNull(), out.otherwise("Poor"))


def cronbach_alpha(df: DataFrame, orders: dict[str, list[str]]) -> DataFrame:
    """Internal consistency over complete rows, in one aggregation."""
    items = list(orders)
    place = lambda c: F.array_position(F.array(*[F.lit(v) for v in orders[c]]), F.col(c))
    scores = df.select(*[place(c).cast("double").alias(f"s{i}") for i, c in enumerate(items)])
    names = scores.columns
    complete = scores.dropna().withColumn("total", sum((F.col(c) for c in names[1:]), F.col(names[0])))
    row = complete.agg(F.count(F.lit(1)).alias("n"), sum((F.var_samp(c) for c in names[1:]), F.var_samp(names[0])).alias("items"), F.var_samp("total").alias("whole"))
    k = len(items)
    alpha = F.when((F.col("n") >= 3) & F.lit(k >= 2), k / max(1, k - 1) * (1 - F.try_divide("items", "whole")))
    return row.select("n", F.lit(k).alias("k"), alpha.alias("alpha")).withColumn("label", reliability_label(F.col("alpha")))
