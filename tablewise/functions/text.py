"""String helpers used by cleaning, quality and text operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewise.functions.parsing import squeeze_ends


def squish(c: Column) -> Column:
    """Trim and collapse every run of white space to one blank."""
    return F.regexp_replace(squeeze_ends(c), r"(?U)\s+", " ")


def label_key(c: Column) -> Column:
    """Spelling-insensitive form of a label: lower case, letters and digits only."""
    return F.regexp_replace(F.lower(c.cast("string")), r"[^\p{L}\p{N}]+", "")


def keep_plain(c: Column) -> Column:
    """Letters, digits, white space, dot and hyphen only."""
    return F.regexp_replace(c, r"(?U)[^\p{L}\p{N}\s.\-]", "")


def title_case(c: Column) -> Column:
    """Capital after the start, white space, hyphen, underscore or slash; all else lower."""
    low = F.lower(c)
    runs = F.regexp_extract_all(low, F.lit(r"(?U)[^\s\-_/]+|[\s\-_/]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, 2, 1 << 30))), "")


def formula_guard(c: Column) -> Column:
    """Quote strings a spreadsheet would run as a formula, leaving negative numbers alone."""
    risky = c.rlike(r"^[=+\-@]") & ~c.rlike(r"^-?\d")
    return F.when(risky, F.concat(F.lit("'"), c)).otherwise(c)
