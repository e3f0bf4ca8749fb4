"""Delimited text: separator, header row and leftovers of concatenated exports."""

from __future__ import annotations

import csv
import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions.parsing import is_missing_token, squeeze_ends
from tablewise.functions.text import formula_guard
from tablewise.meta import is_string, is_temporal

# --- fixed values -----------------------------------------------------------
SEPARATORS = (",", "\t", ";", "|")
FIXED_SEPARATORS = {".tsv": "\t", ".tab": "\t", ".psv": "|"}
PEEK_LINES = 50
HEADER_ROWS = 15
HEADER_GAIN = 0.25
HEADER_ENOUGH = 1.8
# ----------------------------------------------------------------------------
ROW_ID = "__rid"


def blank(c: Column) -> Column:
    return c.isNull() | (squeeze_ends(c.cast("string")) == "")


def sniff_separator(lines: list[str], path: str = "") -> str:
    """The separator that splits the first lines into the most, equally many, fields."""
    fixed = FIXED_SEPARATORS.get(os.path.splitext(path)[1].lower())
    if fixed:
        return fixed
    best, best_rank = ",", (0.0, 0)
    for sep in SEPARATORS:
        widths = [len(r) for r in csv.reader(lines, delimiter=sep) if r]
        if not widths:
            continue
        usual = max(set(widths), key=widths.count)
        rank = (widths.count(usual) / len(widths), usual) if usual > 1 else (0.0, 0)
        if rank > best_rank:
            best, best_rank = sep, rank
    return best


def header_index(rows: list[list]) -> int:
    """Which of the first rows names the columns: mostly filled, mostly words."""
    width = max([len(r) for r in rows[:PEEK_LINES]] + [1])
    best, best_score = 0, -1.0
    for i, row in enumerate(rows[:HEADER_ROWS]):
        cells = [str(v).strip() for v in row if v is not None and str(v).strip() != ""]
        score = (len(cells) + sum(not _plain_number(v) for v in cells)) / width
        if len(cells) >= max(2, width * 0.5) and score > best_score + HEADER_GAIN:
            best, best_score = i, score
        if best_score >= HEADER_ENOUGH:
            break
    return best


def _plain_number(text: str) -> bool:
    try:
        float(text)
        return "_" not in text
    except ValueError:
        return False


def clean_headers(names) -> list[str]:
    """Blank names become ``column_i``; repeats get a number."""
    seen: dict[str, int] = {}
    out = []
    for i, raw in enumerate(names):
        name = "" if raw is None else str(raw).strip()
        name = name or f"column_{i + 1}"
        if name in seen:
            seen[name] += 1
            name = f"{name}_{seen[name]}"
        else:
            seen[name] = 1
        out.append(name)
    return out


def drop_repeated_headers(df: DataFrame, headers: list[str] | None = None) -> DataFrame:
    """Rows that repeat the header cell by cell are removed."""
    names = headers or df.columns
    # zip stops at the shorter list, so a trailing row id takes no part in the comparison
    same = [F.coalesce(squeeze_ends(F.col(f"`{c}`").cast("string")), F.lit("")) == F.lit(str(h or "").strip()) for c, h in zip(df.columns, names)]
    return df.where(~reduce(lambda a, b: a & b, same))


def drop_blank(df: DataFrame) -> DataFrame:
    """Remove columns without any value and rows that hold only missing tokens."""
    cols = [c for c in df.columns if c != ROW_ID]
    filled = df.agg(*[F.count_if(~blank(F.col(f"`{c}`"))).alias(c) for c in cols]).first()
    keep = [c for c in df.columns if c == ROW_ID or filled[c]]
    some = [~is_missing_token(F.col(f"`{c}`")) for c in keep if c != ROW_ID]
    rows = df.select(*[F.col(f"`{c}`") for c in keep])
    return rows.where(reduce(lambda a, b: a | b, some)) if some else rows


def _all_fields(spark: SparkSession, path: str, sep: str) -> tuple[DataFrame, int]:
    """All rows as columns c0, c1, ..., and how many there are: as many as the row with the most fields has."""
    bare = F.regexp_replace("value", '"[^"]*"', "")
    facts = spark.read.text(path).agg(F.max(F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit("")))).alias("separators"),
                                      F.max(F.regexp_count("value", F.lit('"')) % 2).alias("broken")).first()
    width, broken = (facts["separators"] or 0) // len(sep) + 1, bool(facts["broken"])

    def rows(n: int) -> DataFrame:
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(n)])
        return spark.read.schema(schema).csv(path, sep=sep, header=False, multiLine=broken, quote='"', escape='"', mode="PERMISSIVE")

    # A record over several lines can hold more fields than any of its lines: widen until the column after the last one is empty.
    while broken and not rows(width + 1).where(F.col(f"c{width}").isNotNull()).isEmpty():
        width *= 2
    return rows(width), width


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, row_id: bool = False) -> DataFrame:
    """Delimited file as strings, header found among the first rows.

    The separator and the header come from a bounded peek (50 lines). The width and whether quoted fields hold line breaks come from
    one pass over all lines, so no field is lost; without such breaks the read stays splittable.
    """
    head = [r["value"].lstrip("﻿") for r in spark.read.text(path).limit(PEEK_LINES).collect()]
    sep = sep or sniff_separator([line for line in head if line.strip()], path)
    peek = [r for r in csv.reader([line + "\n" for line in head], delimiter=sep) if any(v.strip() for v in r)]
    if not peek:
        raise ValueError(f"{path} is empty.")
    raw, width = _all_fields(spark, path, sep)
    raw = raw.withColumn("c0", F.regexp_replace("c0", "^﻿", "")).withColumn(ROW_ID, F.monotonically_increasing_id())
    cols = [f"c{i}" for i in range(width)]
    rows = raw.where(~reduce(lambda a, b: a & b, [blank(F.col(c)) for c in cols]))
    at = header_index(peek)
    names = [v for v in peek[at]] + [""] * (width - len(peek[at]))
    if at:
        # Titles above the header: the first file partition holds them, and they match the peek cell by cell.
        lead = [reduce(lambda a, b: a & b, [F.coalesce(F.col(c), F.lit("")) == F.lit(v) for c, v in zip(cols, r + [""] * (width - len(r)))]) for r in peek[:at]]
        rows = rows.where(~((F.col(ROW_ID) < PEEK_LINES) & reduce(lambda a, b: a | b, lead)))
    body = drop_blank(drop_repeated_headers(rows, names))
    kept = [c for c in cols if c in body.columns]
    final = clean_headers([names[cols.index(c)] for c in kept])
    out = body.select(*[F.col(c).alias(n) for c, n in zip(kept, final)], ROW_ID)
    return out if row_id else out.drop(ROW_ID)


def with_row_id(df: DataFrame) -> DataFrame:
    """Row number as read, for operators that depend on row order."""
    return df.withColumn(ROW_ID, F.monotonically_increasing_id())


def guarded(df: DataFrame) -> DataFrame:
    """String columns made safe for spreadsheets."""
    return df.select(*[formula_guard(F.col(f"`{c}`")).alias(c) if is_string(df, c) else F.col(f"`{c}`") for c in df.columns])


def write_csv_safe(df: DataFrame, path: str, mode: str = "error") -> None:
    """CSV with ISO dates, empty cells for nulls and guarded strings."""
    made = []
    for c in guarded(df).columns:
        made.append(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if is_temporal(df, c) and df.schema[c].dataType.typeName() != "date" else F.col(f"`{c}`"))
    guarded(df).select(*made).write.csv(path, header=True, mode=mode, nullValue="", emptyValue="", dateFormat="yyyy-MM-dd", quote='"', escape='"')


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON object per line; missing values are written as null."""
    df.write.json(path, mode=mode, ignoreNullFields=False)
