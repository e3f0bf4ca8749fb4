"""Cleaning steps: every one takes a DataFrame and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.functions.parsing import WEEKDAYS, MONTHS, excel_serial_date, js_round, number_text, parse_date, parse_number
from tablewise.functions.text import keep_plain, label_key, squish, title_case
from tablewise.meta import is_numeric, is_string, is_temporal
from tablewise.operators import filters as basic
from tablewise.operators.ordered import fill_backward, fill_forward, interpolate, quantiles
from tablewise.operators.scalars import numeric, scalar_quantiles

# --- fixed values: natural orders of extracted date parts --------------------
PART_ORDERS = {"month": MONTHS, "weekday": WEEKDAYS, "quarter": ("Q1", "Q2", "Q3", "Q4")}
FENCE_WIDTH = {"iqr": 1.5, "zscore": 3.0, "logiqr": 3.0}
# ----------------------------------------------------------------------------


def _need(df: DataFrame, col: str) -> None:
    if col not in df.columns:
        raise ValueError(f"Column not found: {col}")


def _value(df: DataFrame, col: str) -> Column:
    return numeric(F.col(col)) if is_numeric(df, col) else F.col(col)


def mode_value(df: DataFrame, col: str) -> Column:
    """Most frequent value, the smallest among equals."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), F.col(col)).limit(1).select(col).scalar()


def fill_missing(df: DataFrame, col: str, method: str, value=None, order_by=None, partition_by=(), quantile_method: str = "exact", known=None) -> DataFrame:
    """``known`` is the mean, median or mode where the caller has it already; otherwise it is found here."""
    _need(df, col)
    if method in ("ffill", "bfill", "interpolate"):
        if not order_by:
            raise ValueError(f"{method} needs order_by")
        fn = {"ffill": fill_forward, "bfill": fill_backward, "interpolate": interpolate}[method]
        return fn(df, col, list(order_by), list(partition_by))
    c = _value(df, col)
    if known is not None and method in ("mean", "median", "mode"):
        fill = js_round(F.lit(float(known)), 2) if is_numeric(df, col) else F.lit(known)
    elif method == "mean":
        fill = js_round(df.agg(F.avg(c).alias("m")).scalar(), 2)
    elif method == "median":
        fill = js_round(scalar_quantiles(df.select(c.alias(col)), col, quantile_method, m=0.5)["m"], 2)
    elif method == "mode":
        fill = mode_value(df, col)
        fill = js_round(fill, 2) if is_numeric(df, col) else fill
    elif method == "value":
        text = F.lit(str(value))
        fill = parse_number(text) if is_numeric(df, col) else parse_date(text) if is_temporal(df, col) else text
    else:
        raise ValueError(f"Unknown fill method: {method}")
    return df.withColumn(col, F.coalesce(c, fill.cast(df.schema[col].dataType) if not is_numeric(df, col) else fill))


def drop_missing(df: DataFrame, cols=None) -> DataFrame:
    return df.dropna(how="any", subset=list(cols) if cols else None)


def drop_duplicates(df: DataFrame, cols=None, fuzzy: bool = False, order_by=None) -> DataFrame:
    """One row per key; with ``order_by`` the first in that order.

    Keep-first is a partial aggregate (the earliest row per key), so a key that repeats endlessly
    is reduced before the shuffle.
    """
    keys = list(cols) if cols else list(df.columns)
    if not fuzzy and not order_by:
        return df.dropDuplicates(keys)
    made = [(label_key(F.col(k)) if fuzzy and is_string(df, k) else F.col(k)).alias(f"__k{i}") for i, k in enumerate(keys)]
    place = F.struct(*[F.col(o) for o in (order_by or df.columns)])
    kept = df.select(*made, F.struct(*df.columns).alias("__row"), place.alias("__place"))
    kept = kept.groupBy(*[f"__k{i}" for i in range(len(keys))]).agg(F.min_by("__row", "__place").alias("__row"))
    return kept.select("__row.*")


def convert_type(df: DataFrame, col: str, to: str, order: str = "dmy", has_time: bool = False, decimal_comma: bool = False) -> DataFrame:
    _need(df, col)
    c = F.col(col)
    if to == "number":
        made = numeric(c) if is_numeric(df, col) else parse_number(c, decimal_comma)
    elif to == "date":
        made = c.cast("timestamp_ntz") if is_temporal(df, col) else excel_serial_date(c) if is_numeric(df, col) else parse_date(c, order)
    elif to in ("category", "text"):
        if is_temporal(df, col):
            made = F.date_format(c, "d MMM yyyy HH:mm" if has_time else "d MMM yyyy")
        else:
            made = number_text(c) if is_numeric(df, col) else c.cast("string")
    else:
        raise ValueError(f"Unknown type: {to}")
    return df.withColumn(col, made)


def invalid_count(df: DataFrame, col: str, to: str, **kw) -> DataFrame:
    """How many non-missing values a conversion cannot read."""
    from tablewise.functions.parsing import is_missing_token

    both = convert_type(df.withColumn("__before", F.col(col)), col, to, **kw)
    lost = ~is_missing_token(F.col("__before")) & F.col(col).isNull()
    return both.agg(F.count_if(lost).alias("invalid"))


def text_clean(df: DataFrame, col: str, fn: str, known: dict[str, str] | None = None) -> DataFrame:
    """``known`` are the rewrites of standardize where the caller has them already; otherwise they are found here."""
    _need(df, col)
    if fn == "standardize" and known:
        return df.withColumn(col, F.coalesce(F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[F.col(col)], F.col(col)))
    if fn == "standardize":
        return standardize_labels(df, col)
    rewrites = {"trim": squish, "lower": F.lower, "upper": F.upper, "title": title_case, "remove_special": keep_plain}
    if fn not in rewrites:
        raise ValueError(f"Unknown text function: {fn}")
    return df.withColumn(col, rewrites[fn](F.col(col))) if is_string(df, col) else df


def label_variants(df: DataFrame, col: str) -> DataFrame:
    """Every spelling with its count and spelling-insensitive key."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("key", label_key(F.col("label")))


def standardize_labels(df: DataFrame, col: str) -> DataFrame:
    """Variants that differ by case, spacing or punctuation take the most frequent spelling (smallest on ties).

    Counting comes first, so the join carries one row per rewritten spelling; its size decides at run time
    whether it is broadcast.
    """
    variants = label_variants(df, col)
    best = variants.groupBy("key").agg(F.min_by("label", F.struct((-F.col("n")).alias("a"), F.col("label").alias("b"))).alias("best"))
    rewrites = variants.join(best, "key").select("label", squish_ends(F.col("best")).alias("__best")).where(F.col("label") != F.col("__best"))
    out = df.join(rewrites, F.col(col) == F.col("label"), "left")
    return out.withColumn(col, F.coalesce("__best", F.col(col))).select(*df.columns)


def squish_ends(c: Column) -> Column:
    from tablewise.functions.parsing import squeeze_ends

    return squeeze_ends(c)


def fences(df: DataFrame, col: str, method: str = "iqr", k: float | None = None, quantile_method: str = "exact") -> Column:
    """Lower and upper bound as one one-row subquery; a measure that is never negative keeps its own minimum as floor."""
    if method not in FENCE_WIDTH:
        raise ValueError(f"Unknown outlier method: {method}")
    width = float(k or FENCE_WIDTH[method])
    v = df.select(numeric(F.col(col)).alias(col))
    if method == "zscore":
        marks = v.agg(F.min(col).alias("floor"), (F.avg(col) - width * F.stddev_samp(col)).alias("low"), (F.avg(col) + width * F.stddev_samp(col)).alias("high"))
    elif method == "logiqr":
        logs = v.where(F.col(col) > 0).select(F.log(col).alias(col))
        q = quantiles(logs, col, {"q1": 0.25, "q3": 0.75}, method=quantile_method)
        span = F.col("q3") - F.col("q1")
        marks = q.select(v.agg(F.min(col).alias("m")).scalar().alias("floor"), F.exp(F.col("q1") - width * span).alias("low"), F.exp(F.col("q3") + width * span).alias("high"))
    else:
        q = quantiles(v, col, {"floor": 0.0, "q1": 0.25, "q3": 0.75}, method=quantile_method)
        span = F.col("q3") - F.col("q1")
        marks = q.select("floor", (F.col("q1") - width * span).alias("low"), (F.col("q3") + width * span).alias("high"))
    low = F.when((F.col("floor") >= 0) & (F.col("low") < F.col("floor")), F.col("floor")).otherwise(F.col("low"))
    return marks.select(F.struct(low.alias("low"), "high").alias("s")).scalar()


def outliers(df: DataFrame, col: str, method: str = "iqr", action: str = "cap", k: float | None = None, quantile_method: str = "exact", known: tuple[float, float] | None = None) -> DataFrame:
    """``known`` are the two bounds where the caller has them already; otherwise they are found here."""
    _need(df, col)
    bounds = dict(zip(("low", "high"), map(F.lit, known), strict=True)) if known else fences(df, col, method, k, quantile_method)
    v = numeric(F.col(col))
    if action == "cap":
        return df.withColumn(col, F.when(v < bounds["low"], bounds["low"]).when(v > bounds["high"], bounds["high"]).otherwise(v))
    return df.where(v.isNull() | v.between(bounds["low"], bounds["high"]))


def extract_date(df: DataFrame, col: str, part: str, name: str | None = None) -> DataFrame:
    _need(df, col)
    if not is_temporal(df, col):
        raise ValueError("Pick a date column")
    c = F.col(col)
    made = {
        "year": lambda: F.year(c),
        "month": lambda: F.date_format(c, "MMM"),
        "quarter": lambda: F.concat(F.lit("Q"), F.quarter(c)),
        "weekday": lambda: F.date_format(c, "E"),
        "hour": lambda: F.hour(c),
        "yearmonth": lambda: F.date_format(c, "yyyy-MM"),
        "week": lambda: F.weekofyear(c),
    }
    if part not in made:
        raise ValueError(f"Unknown date part: {part}")
    return df.withColumn(name or f"{col}_{part}", made[part]())


def replace_value(df: DataFrame, col: str, old, new) -> DataFrame:
    _need(df, col)
    if is_numeric(df, col):
        made = F.when(number_text(F.col(col)) == str(old), parse_number(F.lit(str(new)))).otherwise(F.col(col).cast("double"))
    else:
        made = F.when(F.col(col).cast("string") == str(old), F.lit(str(new))).otherwise(F.col(col).cast("string"))
    return df.withColumn(col, made)


def negative_to_missing(df: DataFrame, col: str) -> DataFrame:
    _need(df, col)
    return df.withColumn(col, F.when(F.col(col) >= 0, F.col(col)))


def likert_score(df: DataFrame, col: str, order, name: str | None = None) -> DataFrame:
    """Position in the scale, from one; answers outside it have no score."""
    _need(df, col)
    if not order:
        raise ValueError("Pick an ordered (Likert) column")
    return df.withColumn(name or f"{col} (score)", scale_score(F.col(col), order))


def scale_score(c: Column, order) -> Column:
    return F.nullif(F.array_position(F.array(*[F.lit(o) for o in order]), c).cast("int"), F.lit(0))


def add_clusters(df: DataFrame, cols, k: int, name: str = "segment") -> DataFrame:
    from tablewise.operators.models import add_segments

    return add_segments(df, list(cols), k, name)


OPS = {
    "fill_missing": fill_missing,
    "drop_missing": drop_missing,
    "drop_duplicates": drop_duplicates,
    "convert_type": convert_type,
    "text_clean": text_clean,
    "outliers": outliers,
    "extract_date": extract_date,
    "rename": basic.rename,
    "drop_column": basic.drop_column,
    "derive": basic.derive,
    "filter": basic.filter_rows,
    "replace_value": replace_value,
    "negative_to_missing": negative_to_missing,
    "likert_score": likert_score,
    "add_clusters": add_clusters,
}


def register_op(name: str, fn) -> None:
    """Add a step of your own: ``fn(df, **params) -> DataFrame``."""
    OPS[name] = fn
