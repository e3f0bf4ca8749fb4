"""Deterministic text for numbers and periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fixed(c: Column, digits: int) -> Column:
    return F.replace(F.format_number(c, digits), F.lit(","), F.lit(""))


def thousands(c: Column, digits: int | None = None) -> Column:
    """Grouped digits with up to two decimals, fewer for larger numbers; trailing zeros dropped."""
    def shown(n):
        text = F.format_number(c, n)
        return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "") if n else text
    if digits is not None:
        return F.coalesce(shown(digits), F.lit("—"))
    size = F.abs(c)
    return F.when(c.isNull(), "—").when(size >= 100, shown(0)).when(size >= 10, shown(1)).otherwise(shown(2))


def compact(c: Column, unit: str | None = None) -> Column:
    """1234567 as 1.23M, with a leading currency sign or a trailing percent sign."""
    v = c.cast("double")
    size = F.abs(v)
    text = (
        F.when(size >= 1e10, F.concat(_fixed(v / 1e9, 1), F.lit("B")))
        .when(size >= 1e9, F.concat(_fixed(v / 1e9, 2), F.lit("B")))
        .when(size >= 1e7, F.concat(_fixed(v / 1e6, 1), F.lit("M")))
        .when(size >= 1e6, F.concat(_fixed(v / 1e6, 2), F.lit("M")))
        .when(size >= 1e5, F.concat(_fixed(v / 1e3, 0), F.lit("K")))
        .when(size >= 1e4, F.concat(_fixed(v / 1e3, 1), F.lit("K")))
        .otherwise(thousands(v))
    )
    if unit == "%":
        text = F.concat(text, F.lit("%"))
    elif unit:
        text = F.concat(F.when(v < 0, F.lit("-" + unit)).otherwise(F.lit(unit)), F.replace(text, F.lit("-"), F.lit("")))
    return F.when(v.isNull(), "—").otherwise(text)


def percent(c: Column, digits: int = 1) -> Column:
    return F.coalesce(F.concat(_fixed(c * 100, digits), F.lit("%")), F.lit("—"))


def signed_percent(c: Column, digits: int = 1) -> Column:
    return F.when(c.isNull(), "—").when(c >= 0, F.concat(F.lit("+"), percent(c, digits))).otherwise(percent(c, digits))


def p_text(p: Column) -> Column:
    return F.when(p.isNull(), "—").when(p < 0.001, "p < 0.001").otherwise(F.concat(F.lit("p = "), _fixed(p, 3)))


def period_label(ts: Column, grain: str = "day") -> Column:
    """Readable name of a calendar bucket."""
    t = ts.cast("timestamp")
    if grain == "year":
        label = F.year(t).cast("string")
    elif grain == "quarter":
        label = F.concat(F.year(t), F.lit(" Q"), F.quarter(t))
    elif grain == "month":
        label = F.date_format(t, "MMM yyyy")
    elif grain == "datetime":
        label = F.date_format(t, "d MMM yyyy HH:mm")
    else:
        label = F.date_format(t, "d MMM yyyy")
    return F.coalesce(label, F.lit("—"))
