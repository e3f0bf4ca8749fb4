"""Cross-tabs, series, folded tails, histograms and other frames behind charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.meta import is_string
from tablewise.operators.aggregate import AggSpec, _groups, metric_column, metric_name
from tablewise.operators.ordered import quantiles
from tablewise.operators.scalars import numeric

OTHER = "Other"


def leading_levels(df: DataFrame, cols: list[str], k: int) -> dict[str, list]:
    """The ``k`` most frequent values of every column, in one pass; only those few values reach the driver."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "column", "value").where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    place = Window.partitionBy("column").orderBy(F.col("n").desc(), "value")
    best = counts.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    out: dict[str, list] = {c: [] for c in cols}
    for row in best.orderBy("column", "rank").collect():
        out[row["column"]].append(row["value"])
    return out


def among(df: DataFrame, col: str, levels: list) -> Column:
    """Membership test; on string columns it reaches the scan."""
    return (F.col(col) if is_string(df, col) else F.col(col).cast("string")).isin(*levels)


def crosstab_cells(df: DataFrame, a: str, b: str, k: int | None = None) -> DataFrame:
    """Counts of all pairs of levels in long form; with ``k`` only of the top ``k`` levels of either column."""
    if k is None:
        return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    levels = leading_levels(df, [a, b], k)
    rows = df.where(among(df, a, levels[a]) & among(df, b, levels[b]))
    return rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def crosstab(df: DataFrame, a: str, b: str, k: int = 12, order_a=None, order_b=None) -> DataFrame:
    """Rows of ``a``, one column per level of ``b``, and the row total."""
    levels = leading_levels(df, [a, b], k)
    named = [v for v in order_b if v in levels[b]] if order_b else levels[b]
    rows = df.where(among(df, a, levels[a]) & among(df, b, named))
    wide = rows.groupBy(a).pivot(b, named).agg(F.count(F.lit(1))).fillna(0, subset=named)
    wide = wide.withColumn("Total", sum((F.col(f"`{v}`") for v in named), F.lit(0)))
    if order_a:
        return wide.orderBy(F.array_position(F.array(*[F.lit(v) for v in order_a]), F.col(a)))
    return wide.orderBy(F.col("Total").desc(), F.col(a))


def _folded(groups: DataFrame, col: str, keep: DataFrame, additive: bool, label: str = OTHER) -> DataFrame:
    """Levels outside ``keep`` become one label, or are dropped when the metric cannot be added up."""
    if not additive:
        return groups.join(F.broadcast(keep), col, "left_semi")
    marked = groups.join(F.broadcast(keep.withColumn("__kept", F.lit(True))), col, "left")
    return marked.withColumn(col, F.when(F.col("__kept"), F.col(col).cast("string")).otherwise(label)).drop("__kept")


def fold_top(groups: DataFrame, key: str, value: str, n: int, additive: bool = True) -> DataFrame:
    """Keep the ``n``-1 largest groups; the rest is summed into one row, or dropped if not additive."""
    ranked = [F.coalesce(F.col(value), F.lit(0)).desc(), F.col(key)]
    keep = groups.orderBy(*ranked).limit(n - 1).select(key)
    size = groups.agg(F.count(F.lit(1)).alias("c")).scalar()
    everything = groups.select(F.col(key).cast("string").alias(key), value).where(size <= n)
    folded = _folded(groups.select(key, value).where(size > n), key, keep, additive)
    folded = folded.groupBy(key).agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias(value))
    return everything.unionByName(folded.select(F.col(key).cast("string").alias(key), value))


def chart_series(df: DataFrame, x: str, color: str, measure: str | None = None, agg: str = "count", top_x: int | None = 15,
                 grain: str | None = None, filters=()) -> DataFrame:
    """Long (x, series, value) with every cell present; at most eight series, the tail folded into one if additive.

    The leading levels (at most nine and ``top_x``) are fetched first, so the final pass filters at the scan.
    """
    spec = AggSpec(by=(x, color), metrics=((measure, agg),), time_grain=grain, filters=tuple(filters))
    groups = _groups(df, spec).withColumnRenamed(metric_name(measure, agg), "value")
    leaders = lambda c, k: [row[0] for row in groups.groupBy(c).agg(F.sum("value").alias("w")).orderBy(F.col("w").desc(), F.col(c)).limit(k).collect()]
    colors = leaders(color, 9)
    keep = colors if len(colors) <= 8 else colors[:7]
    # Only categories are cut to the leading levels; dates and numbers keep every value.
    ordered = not isinstance(df.schema[x].dataType, T.StringType)
    rows = groups if top_x is None or ordered else groups.where(F.col(x).isin(*leaders(x, top_x)))
    known = F.col(color).isin(*keep)
    names = [str(c) for c in keep]
    if agg in ("sum", "count") and len(colors) > 8:
        rows, names = rows.withColumn("series", F.when(known, F.col(color).cast("string")).otherwise(OTHER)), [*names, OTHER]
    else:
        rows = rows.where(known).withColumn("series", F.col(color).cast("string"))
    wide = rows.groupBy(x).pivot("series", names).agg(F.sum("value"))
    filled = wide.select(x, *[F.coalesce(F.col(f"`{n}`"), F.lit(0)).alias(n) for n in names])
    return filled.unpivot([x], names, "series", "value")


def share_100(cells: DataFrame, x: str) -> DataFrame:
    """Each x adds up to one. ``cells`` is the folded frame, at most eight rows per x."""
    total = F.sum("value").over(Window.partitionBy(x))
    return cells.withColumn("value", F.col("value") / F.when(total == 0, 1).otherwise(total))


def pivot_wide(cells: DataFrame, x: str, names: list[str] | None = None) -> DataFrame:
    """One column per series; without ``names`` they are read off the cells (at most eight)."""
    names = names or [row[0] for row in cells.select("series").distinct().orderBy("series").collect()]
    return cells.groupBy(x).pivot("series", names).agg(F.sum("value")).fillna(0)


def heatmap(df: DataFrame, x: str, y: str, measure: str | None = None, agg: str = "count", k: int = 15) -> DataFrame:
    """Metric per cell of the ``k`` most frequent levels of both columns."""
    levels = leading_levels(df, [x, y], k)
    rows = df.where(among(df, x, levels[x]) & among(df, y, levels[y]))
    return rows.groupBy(x, y).agg(metric_column(measure, agg).alias(metric_name(measure, agg)))


def rate_heatmap(df: DataFrame, x: str, y: str, outcome: str, positive: str, k: int = 15) -> DataFrame:
    """Share of ``positive`` among rows with a known outcome, per cell."""
    hit = F.when(F.col(outcome).isNotNull(), (F.col(outcome) == positive).cast("int"))
    flagged = df.withColumn("__hit", hit)
    return heatmap(flagged, x, y, "__hit", "mean", k).withColumnRenamed("mean___hit", "rate")


def histogram(df: DataFrame, col: str, bins: int = 24) -> DataFrame:
    """Equal-width bins, the last one closed; a constant column gives a single bin."""
    spark = df.sparkSession
    values = df.select(numeric(F.col(col)).alias("v")).where(F.col("v").isNotNull())
    edge = F.struct(F.min("v").alias("mn"), F.max("v").alias("mx"), ((F.max("v") - F.min("v")) / bins).alias("w"))
    span = values.agg(edge.alias("s")).scalar()
    placed = values.withColumn("s", span)
    spot = F.least(F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("s.mn"), F.col("s.w"))), F.lit(0)), F.lit(bins - 1))
    counts = placed.groupBy(spot.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = spark.range(bins).select(F.col("id").cast("int").alias("bin"), span.alias("s")).where(
        F.col("s.mn").isNotNull() & ((F.col("s.w") > 0) | (F.col("bin") == 0)))
    edges = frame.select("bin", (F.col("s.mn") + F.col("bin") * F.col("s.w")).alias("x0"), (F.col("s.mn") + (F.col("bin") + 1) * F.col("s.w")).alias("x1"))
    return edges.join(F.broadcast(counts), "bin", "left").select("bin", "x0", "x1", F.coalesce("n", F.lit(0)).alias("n"))


def top_values(df: DataFrame, col: str, k: int = 12, order=None) -> DataFrame:
    """Most frequent values; an ordinal column lists its levels in order first."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    if order:
        place = F.nullif(F.array_position(F.array(*[F.lit(v) for v in order]), F.col(col)), F.lit(0))
        return counts.orderBy(place.asc_nulls_last(), F.col("n").desc(), F.col(col)).limit(k)
    return counts.orderBy(F.col("n").desc(), F.col(col)).limit(k)


def box_summary(df: DataFrame, y: str, by: str | None = None, k: int = 12, method: str = "exact") -> DataFrame:
    """n, mean, sd, quartiles and range, for the ``k`` most frequent groups."""
    rows = df.where(among(df, by, leading_levels(df, [by], k)[by])) if by else df
    rows = rows.select(F.col(by) if by else F.lit(0).alias("__all"), numeric(F.col(y)).alias(y)).where(F.col(y).isNotNull())
    facts = [F.count(y).alias("n"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("sd"), F.min(y).alias("min"), F.max(y).alias("max")]
    key = by or "__all"
    out = rows.groupBy(key).agg(*facts).join(quantiles(rows, y, {"q1": 0.25, "median": 0.5, "q3": 0.75}, [key], method), key)
    return out if by else out.drop("__all")


def scatter_points(df: DataFrame, x: str, y: str, key: str, color: str | None = None, size: str | None = None,
                   step: int = 1) -> DataFrame:
    """Complete points, systematically sampled for display, colours beyond the leading ones recoded."""
    from tablewise.operators.filters import systematic_sample

    need = [c for c in (x, y, size) if c]
    rows = df.dropna(subset=need)
    if step > 1:
        rows = systematic_sample(rows, key, step)
    if not color:
        return rows.select(key, *need)
    lead = leading_levels(rows, [color], 5)[color]
    keep = lead if len(lead) <= 4 else lead[:3]
    shown = F.when(among(rows, color, keep), F.col(color).cast("string")).otherwise(OTHER)
    return rows.select(key, *need, shown.alias(color))


def duplicate_count(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows, distinct rows and the difference.

    Rows are told apart by two 64-bit hashes, so long texts stay where they are; nested columns take part as they are. A hash passes
    over nulls, so each column comes with a flag for them."""
    chosen = [f for f in df.schema.fields if cols is None or f.name in cols]
    nested = [f.name for f in chosen if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType, T.VariantType))]
    flat = [x for f in chosen if f.name not in nested for x in (F.col(f"`{f.name}`"), F.col(f"`{f.name}`").isNull())]
    prints = [F.xxhash64(F.lit(seed), *(flat if seed % 2 else flat[::-1])).alias(f"__h{seed}") for seed in (1, 2)]
    per = df.select(*prints, *[F.col(f"`{c}`") for c in nested]).groupBy("__h1", "__h2", *[f"`{c}`" for c in nested]).agg(F.count(F.lit(1)).alias("c"))
    return per.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct_rows")).withColumn(
        "duplicates", F.col("rows") - F.col("distinct_rows"))


def likert_shares(df: DataFrame, items: list[str], levels: list[str]) -> DataFrame:
    """Share of every level per item; unlisted answers count in the denominator."""
    long = df.select(*items).unpivot([], items, "item", "level").where(F.col("level").isNotNull())
    counts = long.groupBy("item").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("level") == v).alias(f"l{i}") for i, v in enumerate(levels)])
    packed = F.array(*[F.struct(F.lit(i + 1).alias("position"), F.lit(v).alias("level"), (F.col(f"l{i}") / F.col("n")).alias("share")) for i, v in enumerate(levels)])
    return counts.select("item", "n", F.inline(packed))
