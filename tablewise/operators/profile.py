"""Column profiles, dataset health, quality issues and column roles."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions.parsing import number_text, squeeze_ends
from tablewise.functions.text import label_key
from tablewise.meta import ColumnMeta, is_numeric, is_temporal, simple_metas
from tablewise.operators.aggregate import grain_for_span
from tablewise.operators.moments import describe_rows
from tablewise.operators.pivots import duplicate_count

# --- fixed values -----------------------------------------------------------
NEVER_NEGATIVE_NAME = (r"(price|cost|revenue|sales|amount|quantity|qty|count|days|age|hours|duration|weight|height|units|distance|"
                       r"salary|income|spend|total)")
MAY_BE_NEGATIVE_NAME = r"(change|diff|delta|growth|balance|profit|net|margin|temp|refund|return)"
MEASURE_NAME = (r"(revenue|sales|amount|profit|total|price|cost|spend|income|salary|score|yield|value|satisfaction|rating|units|"
                r"quantity|qty|hours|duration|weight|height|age|count)")
STRONG_MEASURE_NAME = r"(revenue|sales|amount|profit|total|spend|income|salary|yield|satisf|score)"
NOT_A_MEASURE_NAME = r"(^|_)(id|year|zip|postcode|lat|lon|latitude|longitude)$"
HEALTH_WEIGHTS = {"completeness": 0.3, "uniqueness": 0.2, "validity": 0.2, "consistency": 0.15, "structure": 0.15}
SEVERITY_RANK = {"critical": 0, "warning": 1, "info": 2}
FUTURE_SLACK_DAYS = 2
# ----------------------------------------------------------------------------


def _text(df: DataFrame, c: str):
    col = F.col(f"`{c}`")
    return number_text(col) if is_numeric(df, c) else col.cast("string")


def long_text(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[_text(df, c).alias(c) for c in cols]).unpivot([], cols, "column", "value")


def column_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, n): the one shuffle behind distinct counts, top values and label variants."""
    return long_text(df, cols).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def value_facts(counts: DataFrame, label_columns: list[str] = ()) -> DataFrame:
    """Per column: rows, missing, distinct values, stray spaces, text length, and labels spelled more than one way.

    Spellings of one label meet in a first group-by; columns that hold no labels collapse before that shuffle.
    """
    v, n = F.col("value"), F.col("n")
    labelled = F.col("column").isin(*label_columns) if label_columns else F.lit(False)
    keyed = counts.withColumn("key", F.when(labelled & v.isNotNull(), label_key(v)))
    per_key = keyed.groupBy("column", "key").agg(
        F.sum(n).alias("rows"), F.coalesce(F.sum(F.when(v.isNull(), n)), F.lit(0)).alias("missing"), F.count(v).alias("unique"),
        F.coalesce(F.sum(F.when(v != squeeze_ends(v), n)), F.lit(0)).alias("whitespace"), F.sum(F.length(v) * n).alias("chars"))
    return per_key.groupBy("column").agg(
        F.sum("rows").alias("rows"), F.sum("missing").alias("missing"), F.sum("unique").alias("unique"), F.sum("whitespace").alias("whitespace"),
        F.try_divide(F.sum("chars"), F.sum("rows") - F.sum("missing")).alias("avg_length"),
        F.count_if(F.col("key").isNotNull() & (F.col("unique") > 1)).alias("inconsistent"))


def inconsistent_labels(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, key, spellings, rows, best): labels written more than one way."""
    counts = column_counts(df, cols).where(F.col("value").isNotNull())
    return variants_of(counts)


def variants_of(counts: DataFrame) -> DataFrame:
    keyed = counts.where(F.col("value").isNotNull()).withColumn("key", label_key(F.col("value")))
    return keyed.groupBy("column", "key").agg(
        F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("rows"),
        F.min_by("value", F.struct((-F.col("n")).alias("a"), F.col("value").alias("b"))).alias("best")).where(F.col("spellings") > 1)


def top_per_column(counts: DataFrame, k: int = 12) -> DataFrame:
    # row_number <= k lets Spark cut each task's rows to k per column before the shuffle.
    place = Window.partitionBy("column").orderBy(F.col("n").desc(), "value")
    return counts.where(F.col("value").isNotNull()).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


EXACT_DISTINCT = 16  # a column other than a category is counted exactly up to 2 ** 16 distinct values, and estimated beyond
HISTOGRAM, TOP = 24, 12
TEXT_FACTS = ("rows", "missing", "unique", "whitespace", "avg_length", "inconsistent")


HELD_LABELS = 50_000  # value counts that are evaluated where they are collected
REWRITES = 1_000  # spellings of a column that a rewrite is kept for


def category_facts(df: DataFrame, labels: list[str], hashed: list[str] = (), k: int = TOP) -> dict[str, dict]:
    """Facts and top values of label columns through their value counts, and exact distinct counts of other columns through hashes.

    One group-by of (column, value) counts the labels. At most HELD_LABELS counts are evaluated on the driver; beyond that spellings
    of a label meet in a second group-by and top values are cut to k in every task, and only the results are collected."""
    out: dict[str, dict] = {}
    if hashed:
        prints = [F.struct(F.lit(c).alias("column"), F.xxhash64(f"`{c}`").alias("h"), F.col(f"`{c}`").isNotNull().alias("there")) for c in hashed]
        distinct = df.select(F.inline(F.array(*prints))).where("there").groupBy("column", "h").agg(F.lit(1).alias("one")).groupBy("column").agg(F.count("one").alias("unique"))
        out |= {c: {"unique": 0} for c in hashed} | {r["column"]: {"unique": r["unique"]} for r in distinct.collect()}
    if not labels:
        return out
    counts = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), _text(df, c).alias("value")) for c in labels]))).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    v = F.col("value")
    held = counts.select("*", label_key(v).alias("key"), (v != squeeze_ends(v)).alias("stray"), F.length(v).alias("chars"), squeeze_ends(v).alias("clean")).limit(HELD_LABELS + 1).collect()
    if len(held) <= HELD_LABELS:
        for c in labels:
            out[c] = _label_facts([r for r in held if r["column"] == c], k)
        return out
    place = Window.partitionBy("column").orderBy(v.isNull(), F.col("n").desc(), "value")
    best = counts.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).groupBy("column").agg(
        F.sort_array(F.collect_list(F.when(v.isNotNull(), F.struct("rank", "value", "n")))).alias("top"))
    for row in value_facts(counts, labels).join(best, "column", "left").collect():
        out[row["column"]] = {f: row[f] for f in TEXT_FACTS} | {"top": [(t["value"], t["n"]) for t in row["top"] or []]}
    return out


def _label_facts(rows: list, k: int) -> dict:
    known = [r for r in rows if r["value"] is not None]
    n = sum(r["n"] for r in rows)
    spellings: dict[str, list] = {}
    for r in known:
        spellings.setdefault(r["key"], []).append(r)
    several = {key: same for key, same in spellings.items() if len(same) > 1}
    there = sum(r["n"] for r in known)
    out = {"rows": n, "missing": n - there, "unique": len(known), "whitespace": sum(r["n"] for r in known if r["stray"]), "inconsistent": len(several),
           "avg_length": sum(r["chars"] * r["n"] for r in known) / there if there else None,
           "top": [(r["value"], r["n"]) for r in sorted(known, key=lambda r: (-r["n"], r["value"]))[:k]]}
    rewrites = {r["value"]: best["clean"] for same in several.values() for best in [min(same, key=lambda x: (-x["n"], x["value"]))] for r in same if r["value"] != best["clean"]}
    return out | ({"rewrites": rewrites} if 0 < len(rewrites) <= REWRITES else {})


def _plain_facts(df: DataFrame, c: str, i: int, now) -> list:
    """Aggregates of a column that is not a category: presence, distinct values, stray spaces and length of strings, range of dates."""
    v = F.col(f"`{c}`")
    kind = df.schema[c].dataType
    nested = isinstance(kind, (T.ArrayType, T.StructType, T.MapType, T.VariantType))
    known = F.when(v.isNotNull(), F.xxhash64(F.to_json(v) if nested else v))
    out = [F.count(v).alias(f"{i}_present"), F.theta_sketch_estimate(F.theta_sketch_agg(known, EXACT_DISTINCT)).alias(f"{i}_unique")]
    if isinstance(kind, T.StringType):
        out += [F.count_if(v != squeeze_ends(v)).alias(f"{i}_whitespace"), F.avg(F.length(v)).alias(f"{i}_avg_length")]
    if is_temporal(df, c):
        at = v.cast("timestamp")
        out += [F.min(at).alias(f"{i}_first"), F.max(at).alias(f"{i}_last"), F.count_if(at > now).alias(f"{i}_future")]
    return out


def profile_rows(df: DataFrame, metas: list[ColumnMeta], exact_unique: bool = False, histogram: int = HISTOGRAM, only: set[str] | None = None) -> dict[str, dict]:
    """One record per column: counts, distinct values, text facts; of numbers all descriptive statistics and a histogram; of categories
    the top values; of dates range, grain and values in the future. ``only`` names the columns to look at.

    Numbers go through histogram passes, categories through value counts; everything else, and what numbers need besides, is one
    aggregate of fixed-size states for all columns. No value of a number, date, id or text is shuffled."""
    metas = [m for m in metas if only is None or m.name in only]
    numbers = [m.name for m in metas if m.type == "number" and is_numeric(df, m.name)]
    labels = [m.name for m in metas if m.type == "category"]
    plain = [m.name for m in metas if m.name not in labels]
    now = F.current_timestamp() + F.expr(f"interval {FUTURE_SLACK_DAYS} days")
    also = [F.count(F.lit(1)).alias("__rows"), *[x for i, c in enumerate(plain) for x in _plain_facts(df, c, i, now)]]
    described, found = describe_rows(df, numbers, histogram, also)
    counted = category_facts(df, labels, plain if exact_unique else [])
    rows, out = found["__rows"], {}
    for m in metas:
        c = {"column": m.name, "type": m.type, "rows": rows, "missing": rows, "unique": 0, "whitespace": 0, "avg_length": None, "inconsistent": 0}
        if m.name in plain:
            mine = {k.split("_", 1)[1]: x for k, x in found.items() if k.split("_", 1)[0] == str(plain.index(m.name))}
            c |= {k: x for k, x in mine.items() if k != "present"} | {"missing": rows - mine["present"]}
            if "first" in mine:
                c["grain"] = grain_for_span(None if mine["first"] is None else (mine["last"] - mine["first"]).total_seconds() / 86400)
        c |= counted.get(m.name, {}) | described.get(m.name, {})
        c["missing_share"] = c["missing"] / rows if rows else None
        out[m.name] = c
    return out


PROFILE_SCHEMA = ("column string, type string, rows long, missing long, unique long, missing_share double, whitespace long, avg_length double, inconsistent long, invalid long, "
                  "invalid_examples array<string>, n long, mean double, sd double, min double, p5 double, q1 double, median double, q3 double, p95 double, max double, iqr double, "
                  "skew double, kurt double, cv double, sum double, zeros long, outliers long, se double, negatives long, whole boolean, extreme long, histogram array<long>, "
                  "top array<struct<value: string, n: long>>, first timestamp, last timestamp, future long, grain string")


def profile_frame(df: DataFrame, metas: list[ColumnMeta] | None = None, exact_unique: bool = False, histogram: int = HISTOGRAM) -> DataFrame:
    """One row per column with everything that ``profile_rows`` finds. Distinct values of columns that are no categories are exact up to
    2 ** 16 and estimated beyond; ``exact_unique`` counts them exactly, at the price of shuffling a hash of each distinct value."""
    metas = metas or simple_metas(df)
    found = profile_rows(df, metas, exact_unique, histogram)
    schema = T.StructType.fromDDL(PROFILE_SCHEMA)
    rows = []
    for m in metas:
        c = found[m.name] | {"invalid": m.invalid, "invalid_examples": list(m.invalid_examples)}
        rows.append(tuple(c.get(f.name) for f in schema.fields))
    return df.sparkSession.createDataFrame(rows, schema)


@dataclass
class Profile:
    """Collected profile: one small record per column plus dataset counts."""

    rows: int
    metas: list[ColumnMeta]
    columns: dict[str, dict]
    duplicates: int
    inconsistent: dict[str, int]
    unnamed_headers: int = 0
    health: dict = field(default_factory=dict)
    issues: list[dict] = field(default_factory=list)
    roles: dict = field(default_factory=dict)

    def meta(self, name: str) -> ColumnMeta:
        return next(m for m in self.metas if m.name == name)


def _impossible(name: str, negatives: int, rows: int) -> bool:
    named = re.search(NEVER_NEGATIVE_NAME, name, re.I) and not re.search(MAY_BE_NEGATIVE_NAME, name, re.I)
    return bool(negatives and named and negatives / max(1, rows) <= 0.05)


def build_profile(df: DataFrame, metas: list[ColumnMeta] | None = None, unnamed_headers: int = 0, exact_unique: bool = False) -> Profile:
    """Run the profile aggregates and apply the health, issue and role rules to their few result rows. ``exact_unique`` as in profile_frame;
    the rules only ask whether a column has fewer than 31 different values, so estimates do not change them."""
    metas = metas or simple_metas(df)
    dup = duplicate_count(df).first()
    return _judged(dup, metas, profile_rows(df, metas, exact_unique), unnamed_headers)


def refresh_profile(p: Profile, df: DataFrame, metas: list[ColumnMeta], changed: set[str]) -> Profile:
    """The profile after a step that kept all rows and changed only some columns: those are read again, the others are kept."""
    names = {m.name for m in metas}
    columns = {c: x for c, x in p.columns.items() if c in names} | (profile_rows(df, metas, only=changed) if changed & names else {})
    return _judged(duplicate_count(df).first(), metas, columns, p.unnamed_headers)


def _judged(dup, metas: list[ColumnMeta], columns: dict[str, dict], unnamed_headers: int) -> Profile:
    bad = {m.name: columns[m.name]["inconsistent"] for m in metas if m.type == "category" and columns[m.name]["inconsistent"]}
    p = Profile(dup["rows"], metas, columns, dup["duplicates"], bad, unnamed_headers)
    p.health, p.issues, p.roles = health(p), quality_issues(p), roles(p)
    return p


def health(p: Profile) -> dict:
    """Five scores out of 100 and their weighted, rounded total."""
    cells = p.rows * len(p.metas) or 1
    missing = sum(c["missing"] for c in p.columns.values())
    invalid = sum(m.invalid for m in p.metas)
    for name, c in p.columns.items():
        if c["type"] == "number" and _impossible(name, c.get("negatives") or 0, p.rows):
            invalid += c["negatives"]
    unclean = sum(1 for name, c in p.columns.items() if p.inconsistent.get(name) or (c["whitespace"] and c["type"] in ("category", "text", "id")))
    weak = sum(1 for c in p.columns.values() if (c["unique"] == 1 and p.rows > 1) or c["missing_share"] > 0.95) + p.unnamed_headers
    out = {
        "completeness": 100 * (1 - missing / cells),
        "uniqueness": 100 * (1 - min(1, p.duplicates / max(1, p.rows) * 8)),
        "validity": 100 * (1 - invalid / ((cells - missing) or 1)),
        "consistency": max(0, 100 - unclean * 25),
        "structure": 100 * (1 - min(1, weak / max(1, len(p.metas))) * 0.8),
    }
    out["score"] = math.floor(sum(out[k] * w for k, w in HEALTH_WEIGHTS.items()) + 0.5)
    return out


def _issue(kind, severity, count, column=None, op=None, **params) -> dict:
    return {"issue": kind, "column": column, "severity": severity, "count": int(count), "op": op, "params": params}


def quality_issues(p: Profile) -> list[dict]:
    """What is wrong, how badly, and the step that would fix it; worst first."""
    found = []
    n = p.rows
    if p.duplicates:
        found.append(_issue("dup", "warning" if p.duplicates / n > 0.01 else "info", p.duplicates, None, "drop_duplicates"))
    for m in p.metas:
        c, name = p.columns[m.name], m.name
        share = c["missing_share"]
        if c["missing"] and share < 0.95:
            if m.type == "number":
                method = "median" if abs(c["skew"] or 0) > 1 or c.get("whole") else "mean"
            else:
                method = {"date": "ffill", "category": "mode"}.get(m.type)
            severity = "critical" if share > 0.2 else "warning" if share > 0.05 else "info"
            found.append(_issue("miss", severity, c["missing"], name, "fill_missing", col=name, method=method) if method else _issue("miss", severity, c["missing"], name))
        if share >= 0.95:
            found.append(_issue("empty", "warning", c["missing"], name, "drop_column", col=name))
        if m.invalid:
            found.append(_issue("inv", "warning" if m.invalid / n > 0.02 else "info", m.invalid, name))
        if p.inconsistent.get(name):
            found.append(_issue("inc", "warning", p.inconsistent[name], name, "text_clean", col=name, fn="standardize"))
        elif c["whitespace"] and m.type in ("category", "text", "id"):
            found.append(_issue("ws", "info", c["whitespace"], name, "text_clean", col=name, fn="trim"))
        if m.type == "number" and (c.get("n") or 0) > 20:
            count, method = c["extreme"], "iqr"
            if not (count and count / n < 0.01) and (c["skew"] or 0) > 1 and c["min"] > 0 and c.get("log_extreme"):
                count, method = c["log_extreme"], "logiqr"
            if count and count / n < 0.01:
                huge = c["median"] > 0 and c["max"] / c["median"] > 20
                found.append(_issue("out", "warning" if huge else "info", count, name, "outliers", col=name, method=method, action="cap", k=3))
        if m.type == "number" and _impossible(name, c.get("negatives") or 0, n):
            found.append(_issue("neg", "warning", c["negatives"], name, "negative_to_missing", col=name))
        if c["unique"] == 1 and n > 1:
            found.append(_issue("const", "info", n, name, "drop_column", col=name))
        if m.type == "date" and c.get("future"):
            found.append(_issue("fut", "info", c["future"], name))
    return sorted(found, key=lambda i: SEVERITY_RANK[i["severity"]])


def roles(p: Profile) -> dict:
    """Main measure, date, dimensions, numeric and Likert columns."""
    numbers = [m.name for m in p.metas if m.type == "number" and not re.search(NOT_A_MEASURE_NAME, m.name, re.I)]
    strong = [c for c in numbers if re.search(STRONG_MEASURE_NAME, c, re.I)]
    hinted = [c for c in numbers if re.search(MEASURE_NAME, c, re.I) and not re.search("age", c, re.I)]
    by_cv = sorted(numbers, key=lambda c: -(p.columns[c].get("cv") or 0))
    measure = (strong or hinted or by_cv or [None])[0]
    date = next((m.name for m in p.metas if m.type == "date" and p.columns[m.name]["unique"] > 3), None)
    dims = [m.name for m in p.metas if m.type == "category" and not m.likert and 2 <= p.columns[m.name]["unique"] <= 30
            and p.columns[m.name]["missing_share"] < 0.3]
    likert = [m.name for m in p.metas if m.likert]
    stamped = any(re.search("timestamp", m.name, re.I) for m in p.metas)
    survey = len(likert) >= 2 or (stamped and sum(len(m.name) > 30 for m in p.metas) >= 2)
    return {"measure": measure, "date": date, "dims": dims, "numeric": numbers, "likert": likert, "survey": survey}


ISSUE_SCHEMA = "severity string, issue string, column string, count long, op string, params map<string,string>"


def issues_frame(spark: SparkSession, p: Profile) -> DataFrame:
    rows = [(i["severity"], i["issue"], i["column"], i["count"], i["op"], {k: str(v) for k, v in i["params"].items()}) for i in p.issues]
    return spark.createDataFrame(rows, ISSUE_SCHEMA)


def health_frame(spark: SparkSession, p: Profile) -> DataFrame:
    return spark.createDataFrame([(k, float(v)) for k, v in p.health.items()], "part string, score double")


def quality_audit(spark: SparkSession, p: Profile) -> DataFrame:
    """Scores and issues in one table."""
    scores = health_frame(spark, p).select(F.lit("health").alias("section"), F.col("part").alias("item"), F.lit(None).cast("string").alias("column"), "score")
    found = issues_frame(spark, p).select(F.lit("issue").alias("section"), F.col("issue").alias("item"), "column", F.col("count").cast("double").alias("score"))
    return scores.unionByName(found)


def schema_summary(spark: SparkSession, p: Profile) -> DataFrame:
    """One readable line per column, with its role in the data."""
    rows = []
    for m in p.metas:
        c = p.columns[m.name]
        detail = f"{c['unique']} distinct"
        if m.type == "number" and c.get("n"):
            detail = f"min {c['min']:g}, median {c['median']:g}, max {c['max']:g}"
        elif m.type == "date" and c.get("first"):
            detail = f"{c['first']:%Y-%m-%d} to {c['last']:%Y-%m-%d}"
        elif c.get("top"):
            detail += ": " + ", ".join(f"{value} ({n})" for value, n in c["top"][:5])
        part = "measure" if m.name == p.roles["measure"] else "date" if m.name == p.roles["date"] else "dimension" if m.name in p.roles["dims"] else "scale" if m.likert else ""
        rows.append((m.name, m.type, m.unit, int(c["missing"]), part, detail))
    return spark.createDataFrame(rows, "column string, type string, unit string, missing long, role string, detail string")


def health_score(df: DataFrame) -> DataFrame:
    """Health from the values alone, as one lazy query: completeness, uniqueness, consistency and structure inputs."""
    cols = df.columns
    kinds = [c for c in cols if not is_numeric(df, c) and not is_temporal(df, c)]
    facts = value_facts(column_counts(df, cols), kinds)
    dup = duplicate_count(df).agg(F.struct(F.max("rows").alias("rows"), F.max("duplicates").alias("dup")).alias("s")).scalar()
    row = facts.agg(F.sum("missing").alias("missing"), F.count_if((F.col("inconsistent") > 0) | (F.col("whitespace") > 0)).alias("unclean"), F.count_if(((F.col("unique") == 1) & (F.col("rows") > 1)) | (F.col("missing") / F.col("rows") > 0.95)).alias("weak"))
    width = F.lit(len(cols))
    return row.select(
        (100 * (1 - F.col("missing") / (dup["rows"] * width))).alias("completeness"),
        (100 * (1 - F.least(F.lit(1.0), dup["dup"] / dup["rows"] * 8))).alias("uniqueness"),
        F.greatest(F.lit(0), 100 - F.col("unclean") * 25).cast("double").alias("consistency"),
        (100 * (1 - F.least(F.lit(1.0), F.col("weak") / width) * 0.8)).alias("structure"))
