"""Semantic types from the values themselves.

All string columns are unpivoted to (column, value), so one expression set serves any number of columns and the
group-by has one key per column with map-side combining.  Decisions run on the driver over one row per column.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.functions.parsing import CURRENCY_SYMBOLS, currency_symbol, date_order_votes, parse_date, parse_number, present
from tablewise.meta import ColumnMeta, is_string, is_temporal
from tablewise.operators.ordered import spread

# --- fixed values -----------------------------------------------------------
SCALES = (
    ("strongly disagree", "disagree", "neutral", "agree", "strongly agree"),
    ("strongly disagree", "disagree", "neither agree nor disagree", "agree", "strongly agree"),
    ("strongly disagree", "somewhat disagree", "neither agree nor disagree", "somewhat agree", "strongly agree"),
    ("very dissatisfied", "dissatisfied", "neutral", "satisfied", "very satisfied"),
    ("very unsatisfied", "unsatisfied", "neutral", "satisfied", "very satisfied"),
    ("never", "rarely", "sometimes", "often", "always"),
    ("very poor", "poor", "fair", "good", "excellent"),
    ("poor", "fair", "good", "very good", "excellent"),
    ("not at all likely", "unlikely", "neutral", "likely", "very likely"),
    ("very unlikely", "unlikely", "neutral", "likely", "very likely"),
    ("low", "medium", "high"),
    ("very low", "low", "medium", "high", "very high"),
    ("1st year", "2nd year", "3rd year", "4th year", "postgraduate"),
)
ID_NAME = r"(^id$|_id$|^id_|\bid\b|uuid|guid|^code$|postcode|zip|phone|email|^key$|order.?(no|number|id)|invoice|record)"
DATE_NAME = r"(date|time|timestamp|created|updated|month|day|period|week)"
MONEY_NAME = r"(revenue|sales|price|cost|amount|profit|income|spend|salary|\$|aud|usd|fee|value_aud|budget)"
PERCENT_NAME = r"(percent|pct|rate_%|%)"
NUMBER_SHARE, DATE_SHARE, UNIT_SHARE = 0.9, 0.85, 0.3
MAX_SCALE_VALUES = 12
# ----------------------------------------------------------------------------


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_string(df, f.name)]


def long_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value): one trimmed value per row and column, missing tokens as null."""
    return spread(df.select(*[F.col(f"`{c}`") for c in cols])).select(*[present(F.col(f"`{c}`")).alias(c) for c in cols]).unpivot([], cols, "column", "value")


def type_evidence(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column, how many values read as numbers, dates, money or long text."""
    v = F.col("value")
    dmy, mdy = date_order_votes(v)
    flags = long_values(df, cols).select(
        "column", "value", parse_number(v).isNotNull().alias("num"), parse_number(v, True).isNotNull().alias("num_comma"),
        parse_date(v).isNotNull().alias("date"), dmy.alias("dmy"), mdy.alias("mdy"), currency_symbol(v).alias("symbol"),
        v.rlike("%$").alias("pct"), v.rlike(r"\d:\d{2}").alias("clock"), F.length(v).alias("len"),
        (F.size(F.split(v, r"(?U)\s+")) > 6).alias("wordy"))
    some = F.col("value").isNotNull()
    return flags.groupBy("column").agg(
        F.count(F.lit(1)).alias("rows"), F.count("value").alias("present"), F.count_if(F.col("num")).alias("number_ok"),
        F.count_if(F.col("num_comma")).alias("comma_ok"), F.count_if(F.col("date")).alias("date_ok"),
        F.count_if(some & F.col("dmy")).alias("dmy_votes"), F.count_if(some & F.col("mdy")).alias("mdy_votes"),
        F.count("symbol").alias("currency"), F.count_if(F.col("pct")).alias("percent"), F.count_if(F.col("clock")).alias("clock"),
        F.coalesce(F.sum("len"), F.lit(0)).alias("total_length"), F.count_if(some & F.col("wordy")).alias("wordy"),
        *[F.count_if(F.col("symbol") == s).alias(f"symbol_{i}") for i, s in enumerate(CURRENCY_SYMBOLS)])


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, n) over non-missing values of all listed columns, one shuffle with map-side combining."""
    return long_values(df, cols).where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def unit_of(name: str, present_count: int, currency: int, percent: int, symbols: list[int]) -> str | None:
    """Unit from the values where enough carry one, else from the name."""
    if present_count and currency / present_count > UNIT_SHARE:
        return CURRENCY_SYMBOLS[max(range(len(symbols)), key=lambda i: (symbols[i], -i))]
    if re.search(MONEY_NAME, name, re.I):
        return "€" if re.search("eur|€", name, re.I) else "£" if re.search("gbp|£", name, re.I) else "$"
    if (present_count and percent / present_count > UNIT_SHARE) or re.search(PERCENT_NAME, name, re.I):
        return "%"
    return None


def match_scale(values: list[str], full_scale: bool = False) -> tuple[tuple[str, ...], bool] | None:
    """Known ordered scale that holds every value: its observed levels in order, and whether it is a Likert item."""
    lowered = {" ".join(v.lower().split()) for v in values}
    if len(lowered) < 2:
        return None
    for scale in SCALES:
        if lowered <= set(scale):
            spelling = {}
            for v in sorted(values):
                spelling.setdefault(v.lower().strip(), v)
            order = tuple(spelling.get(s, s) if full_scale else spelling[s] for s in scale if full_scale or s in spelling)
            return order, len(scale) == 5 and "postgraduate" not in scale
    return None


def _decide(name: str, e, distinct: int, number_distinct: int, small_values: list[str] | None, full_scale: bool) -> ColumnMeta:
    n = e["present"]
    if n == 0:
        return ColumnMeta(name, "category", empty=True)
    num, comma, date = e["number_ok"] / n, e["comma_ok"] / n, e["date_ok"] / n
    by_comma = num < NUMBER_SHARE <= comma
    if (num >= NUMBER_SHARE or by_comma) and not (re.search(DATE_NAME, name, re.I) and date > 0.5):
        unit = unit_of(name, n, e["currency"], e["percent"], [e[f"symbol_{i}"] for i in range(len(CURRENCY_SYMBOLS))])
        kind = "id" if re.search(ID_NAME, name, re.I) and number_distinct / n > 0.9 else "number"
        return ColumnMeta(name, kind, unit=unit, decimal_comma=by_comma, invalid=n - (e["comma_ok"] if by_comma else e["number_ok"]))
    if date >= DATE_SHARE:
        order = "mdy" if e["mdy_votes"] > e["dmy_votes"] else "dmy"
        return ColumnMeta(name, "date", has_time=e["clock"] > 0, date_order=order, invalid=n - e["date_ok"])
    found = match_scale(small_values, full_scale) if small_values else None
    if found:
        return ColumnMeta(name, "category", order=found[0], likert=found[1])
    unique, average = distinct / n, e["total_length"] / n
    if re.search(ID_NAME, name, re.I) and unique > 0.9:
        return ColumnMeta(name, "id")
    if distinct <= max(25, n * 0.02) or (unique < 0.5 and average < 30):
        return ColumnMeta(name, "category")
    if average > 35 or e["wordy"] / n > 0.3:
        return ColumnMeta(name, "text")
    return ColumnMeta(name, "id" if unique > 0.9 else "category")


def infer_schema(df: DataFrame, full_scale: bool = False) -> list[ColumnMeta]:
    """Semantic type of every column, in column order; reads all rows."""
    strings = string_columns(df)
    metas: dict[str, ColumnMeta] = {}
    if strings:
        evidence = {r["column"]: r for r in type_evidence(df, strings).collect()}
        counts = value_counts(df, strings)
        idish = [c for c in strings if re.search(ID_NAME, c, re.I)]
        number = F.when(F.col("column").isin(*idish), parse_number(F.col("value"))) if idish else F.lit(None).cast("double")
        sizes = {r["column"]: r for r in counts.groupBy("column").agg(
            F.count(F.lit(1)).alias("d"), F.count_distinct(number).alias("nd")).collect()}
        few = [c for c, r in sizes.items() if r["d"] <= MAX_SCALE_VALUES]
        small: dict[str, list[str]] = {}
        if few:
            for r in counts.where(F.col("column").isin(*few)).select("column", "value").collect():  # at most 12 per column
                small.setdefault(r["column"], []).append(r["value"])
        for c in strings:
            size = sizes.get(c)
            metas[c] = _decide(c, evidence[c], size["d"] if size else 0, size["nd"] if size else 0, small.get(c), full_scale)
    typed = [f.name for f in df.schema.fields if f.name not in metas]
    numbers = [c for c in typed if not is_temporal(df, c) and df.schema[c].dataType.typeName() not in ("boolean", "array", "map", "struct", "binary")]
    idish = [c for c in numbers if re.search(ID_NAME, c, re.I)]
    unique = df.agg(*[(F.count_distinct(F.col(c)) / F.count(F.col(c))).alias(c) for c in idish]).first() if idish else {}
    for c in typed:
        if is_temporal(df, c):
            metas[c] = ColumnMeta(c, "date", has_time=df.schema[c].dataType.typeName() != "date")
        elif c in numbers:
            metas[c] = ColumnMeta(c, "id" if c in idish and (unique[c] or 0) > 0.9 else "number", unit=unit_of(c, 0, 0, 0, []))
        else:
            metas[c] = ColumnMeta(c, "category")
    return [metas[c] for c in df.columns]


def apply_types(df: DataFrame, metas: list[ColumnMeta]) -> DataFrame:
    """Cast every column to its semantic type; values that do not read become null."""
    made = []
    for m in metas:
        c = F.col(f"`{m.name}`")
        if not is_string(df, m.name):
            made.append(c)
        elif m.type == "number":
            made.append(parse_number(present(c), m.decimal_comma).alias(m.name))
        elif m.type == "date":
            made.append(parse_date(present(c), m.date_order).alias(m.name))
        else:
            made.append(present(c).alias(m.name))
    return df.select(*made)


def invalid_examples(df: DataFrame, col: str, meta: ColumnMeta, k: int = 5) -> DataFrame:
    """A few values that could not be read as the column's type."""
    v = present(F.col(f"`{col}`"))
    read = parse_number(v, meta.decimal_comma) if meta.type in ("number", "id") else parse_date(v, meta.date_order)
    return df.select(v.alias("value"), read.isNull().alias("bad")).where(F.col("value").isNotNull() & F.col("bad")).select("value").limit(k)
