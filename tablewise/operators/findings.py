"""Automatic findings: each finder reduces the data with Spark, the rules read the few rows that remain."""

from __future__ import annotations

import math
import re
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.functions.tails import chi2_upper, f_upper, t_two_sided
from tablewise.operators import series as ts
from tablewise.operators.aggregate import COUNT_NAME, metric_column, non_additive_by_name
from tablewise.operators.cube import Evidence, evidence_cube
from tablewise.operators.moments import pearson
from tablewise.operators.profile import Profile, build_profile
from tablewise.operators.scalars import numeric
from tablewise.operators.survey import cronbach_alpha, survey_summary

# --- fixed values -----------------------------------------------------------
OUTCOME_NAME = r"return|churn|cancel|refund|default|fraud|complain|defect|fail"
POSITIVE_VALUE = r"^(yes|y|true|1)$"
# ----------------------------------------------------------------------------

FINDING_SCHEMA = "rank int, id string, kind string, score double, confidence string, evidence map<string,string>"


def confidence(p: float | None, n: int) -> str:
    if p is None:
        return "Medium"
    return "High" if p < 0.001 and n >= 30 else "Medium" if p < 0.05 else "Low"


def _finding(id_, kind, score, conf, /, **evidence) -> dict:
    return {"id": id_, "kind": kind, "score": float(score), "confidence": conf, "evidence": {k: str(v) for k, v in evidence.items()}}


def dominant_value(df: DataFrame, measure: str) -> DataFrame:
    """Largest positive value, the positive total and its share."""
    v = numeric(F.col(measure))
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.max(F.when(v > 0, v)).alias("largest"), F.sum(F.when(v > 0, v)).alias("total"))
    return row.withColumn("share", F.try_divide("largest", "total"))


def leading_share(df: DataFrame, dim: str, measure: str | None) -> DataFrame:
    """Largest group of a dimension, its share, and the share an even split would give."""
    value = metric_column(measure, "sum") if measure else F.count(F.lit(1)).cast("double")
    groups = df.where(F.col(dim).isNotNull()).groupBy(F.col(dim).cast("string").alias("level")).agg(value.alias("value"))
    row = groups.agg(F.min_by("level", F.struct((-F.col("value")).alias("a"), F.col("level").alias("b"))).alias("level"), F.max("value").alias("value"),
                     F.sum("value").alias("total"), F.count(F.lit(1)).alias("groups"))
    return row.select(F.lit(dim).alias("dim"), "level", "value", F.try_divide("value", "total").alias("share"), "groups",
                      (F.try_divide("value", "total") * F.col("groups")).alias("times_even"))


def unusual_cells(df: DataFrame, outcome: str, positive: str, dims: list[str], minimum: int = 20) -> DataFrame:
    """Outcome rate per cell of every pair of dimensions against the overall rate; all pairs share one group-by."""
    pairs = [F.struct(F.lit(a).alias("dim_a"), F.lit(b).alias("dim_b"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
             for a, b in combinations(dims, 2)]
    rows = df.where(F.col(outcome).isNotNull())
    hit = (F.col(outcome) == positive).cast("int")
    overall = rows.agg(F.avg(hit).alias("r")).scalar()
    cells = rows.select(hit.alias("hit"), F.inline(F.array(*pairs))).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    cells = cells.groupBy("dim_a", "dim_b", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("k")).where(F.col("n") >= minimum)
    rate = F.col("k") / F.col("n")
    return cells.withColumn("rate", rate).withColumn("z", F.try_divide(F.col("rate") - overall, F.sqrt(overall * (1 - overall) / F.col("n"))))


def alpha_finding(row) -> dict | None:
    return None if row["alpha"] is None else _finding("alpha", "Survey", 60, "High", alpha=row["alpha"], items=row["k"], n=row["n"])


def quality_finding(p: Profile) -> dict | None:
    """The data's health, if it is below 90 or anything is worse than a remark."""
    if p.health["score"] >= 90 and all(i["severity"] == "info" for i in p.issues):
        return None
    return _finding("quality", "Quality", 75 if p.health["score"] < 85 else 40, "High", issues=len(p.issues), score=p.health["score"])


def series_facts(values: list[float], periods: list) -> dict:
    """What the finders want to know of one reduced series in time order: its correlation with time, the change between its halves, the
    largest change with whether it stands out, and the rises it ends with. The frame it comes from has one row a calendar bucket."""
    n = len(values)
    y, x = np.array(values, dtype=float), np.arange(n)
    with np.errstate(all="ignore"):
        r = float(np.corrcoef(x, y)[0, 1]) if n > 1 else math.nan
    first, last = (y[: n // 2].mean(), y[n - n // 2:].mean()) if n > 1 else (0.0, 0.0)
    moves = [(b / a - 1 if a else 0.0) for a, b in zip(values, values[1:])]
    jump = max(((abs(m), -i) for i, m in enumerate(moves) if m), default=None)
    change = moves[-jump[1]] if jump else None
    spread = float(np.std(moves, ddof=1)) if len(moves) > 1 else None
    streak = 0
    while streak < n - 1 and values[n - 1 - streak] > values[n - 2 - streak]:
        streak += 1
    return {"n": n, "r": None if math.isnan(r) else r, "change": last / first - 1 if first else None, "jump": change, "jump_period": periods[1 - jump[1]] if jump else None,
            "flagged": bool(jump and spread is not None and abs(change) > 0.15 and abs(change) > 1.8 * spread), "streak": streak}


def series_findings(facts: dict, grain: str, additive: bool) -> list[dict]:
    """Trend, spike and streak of one series of at least four periods."""
    out, n, r, change = [], facts["n"], facts["r"], facts["change"]
    if n < 4:
        return out
    p_value = t_two_sided(r * ((n - 2) / max(1e-12, 1 - r * r)) ** 0.5, n - 2) if r is not None else None
    weak = p_value is not None and p_value > 0.05
    if change is not None and not (weak and abs(change) < 0.05):
        out.append(_finding("trend", "Trend", (55 if weak else 90) + min(10, abs(change) * 20), confidence(p_value, n), grain=grain, r=r, change=change))
    if additive and facts["flagged"]:
        out.append(_finding("spike", "Anomaly", 80 + min(10, abs(facts["jump"]) * 10), "Medium", period=facts["jump_period"], change=facts["jump"]))
    if facts["streak"] >= 3:
        out.append(_finding("streak", "Trend", 70 + facts["streak"], "Medium", periods=facts["streak"]))
    return out


def time_findings(df: DataFrame, date: str, measure: str | None, agg: str, grain: str) -> list[dict]:
    """The findings along time; one aggregate, whose rows are calendar buckets."""
    additive = agg in ("sum", "count")
    rows = sorted((r["period"], r["value"]) for r in ts.period_values(df, date, measure, agg, grain).collect())
    values = [v for _, v in rows]
    if additive and grain != "year" and len(values) > 4 and values[-1] < sum(values[-4:-1]) / 3 * 0.5:  # a last period that is not over yet
        rows, values = rows[:-1], values[:-1]
    return series_findings(series_facts(values, [p for p, _ in rows]), grain, additive)


def findings_frame(spark, found: list[dict]) -> DataFrame:
    """Findings as rows, strongest first."""
    ranked = sorted(found, key=lambda f: -f["score"])
    return spark.createDataFrame([(i + 1, f["id"], f["kind"], f["score"], f["confidence"], f["evidence"]) for i, f in enumerate(ranked)], FINDING_SCHEMA)


def discover(df: DataFrame, metas=None, profile: Profile | None = None, share_dims: int | None = 4, linked_dims: int | None = 5, skewed: int | None = 6) -> DataFrame:
    """Everything worth telling about the data, strongest first.

    Beside the profile it takes three aggregates: the evidence cube (shares, group tests, unusual cells and associations), the series and
    the correlations. share_dims, linked_dims and skewed say how many dimensions and numbers are looked at from the left; None is all."""
    p = profile or build_profile(df, metas)
    measure = p.roles["measure"]
    meta = p.meta(measure) if measure else None
    agg = _measure_agg(p, measure, meta)
    additive = agg in ("sum", "count")
    dims = p.roles["dims"]
    near = [d for d in dims[:linked_dims] if p.columns[d]["unique"] <= 12]
    outcome = next((m.name for m in p.metas if m.type == "category" and p.columns[m.name]["unique"] == 2 and re.search(OUTCOME_NAME, m.name, re.I)), None)
    others = [d for d in dims[:share_dims] if d != outcome] if outcome else []
    out: list[dict] = []
    hit = None
    if outcome:
        values = sorted(v for v, _ in p.columns[outcome]["top"])
        hit = F.col(f"`{outcome}`").cast("string") == next((v for v in values if re.match(POSITIVE_VALUE, v, re.I)), values[0])
    pairs = list(dict.fromkeys([*combinations(others, 2), *combinations(near, 2)]))
    named = list(dict.fromkeys([*dims[:share_dims], *near]))
    evidence = Evidence.of(evidence_cube(df, named, measure, hit, pairs)) if named else Evidence()
    dominant = None
    if measure and agg == "sum" and p.rows >= 30:
        c = p.columns[measure]
        share = c["max"] / c["positive"] if c.get("positive") else None
        if share is not None and share > 0.2:
            dominant = {"share": share, "largest": c["max"]}
    if p.roles["date"]:
        out += time_findings(df, p.roles["date"], measure, agg, p.columns[p.roles["date"]]["grain"])
    for d in dims[:share_dims]:
        if additive:
            row = evidence.leading_share(d, measure is not None)
            if row["groups"] >= 2 and row["share"] is not None and row["times_even"] > 1.3 and row["groups"] <= 30:
                out.append(_finding(f"share_{d}", "Segment", 60 + row["times_even"] * 5, "High", level=row["level"], share=row["share"], groups=row["groups"]))
        if measure and sum(o["id"].startswith("anova_") for o in out) < 2:
            row = evidence.anova(d)
            if row and row["f"] is not None:
                pf = f_upper(row["f"], row["df1"], row["df2"])
                if pf < 0.05 and row["eta2"] >= 0.01:
                    out.append(_finding(f"anova_{d}", "Segment", 55 + row["eta2"] * 150 + (10 if pf < 0.001 else 0), confidence(pf, row["df2"]), f=row["f"], eta2=row["eta2"], p=pf))
    best = evidence.unusual_cell(others) if len(others) >= 2 else None
    if best and best["z"] > 3:
        out.append(_finding("combo", "Anomaly", 88 + min(8, best["z"]), "High" if best["z"] > 4 else "Medium", a=best["a"], b=best["b"], rate=best["rate"], z=best["z"]))
    numbers = [c for c in p.roles["numeric"] if p.columns[c]["unique"] > 5]
    if len(numbers) >= 2:
        told = []
        for row in sorted((r for r in pearson(df, numbers).collect() if 0.2 <= abs(r["r"]) < 0.985 and r["n"] >= 10), key=lambda r: (-abs(r["r"]), r["column_a"], r["column_b"])):
            pr = t_two_sided(row["t"], row["n"] - 2)
            if pr < 0.01:
                told.append((row, pr))
        for i, (row, pr) in enumerate(told[:2]):
            out.append(_finding(f"corr_{i}", "Relationship", 50 + abs(row["r"]) * 40, confidence(pr, row["n"]), a=row["column_a"], b=row["column_b"], r=row["r"]))
    linked = None
    for a, b in combinations(near, 2):
        row = evidence.chi_square(a, b)
        if row["df"] > 0:
            pc = chi2_upper(row["chi2"], row["df"])
            if pc < 0.01 and 0.15 < row["cramers_v"] < 0.95 and (linked is None or row["cramers_v"] > linked[2]["cramers_v"]):
                linked = (a, b, row, pc)
    if linked:
        a, b, row, pc = linked
        out.append(_finding("assoc", "Relationship", 45 + row["cramers_v"] * 60, confidence(pc, row["n"]), a=a, b=b, v=row["cramers_v"]))
    for c in numbers[:skewed]:
        d = p.columns[c]
        if d["n"] >= 30 and d["skew"] is not None and abs(d["skew"]) > 1.5:
            out.append(_finding(f"skew_{c}", "Distribution", 35 + min(15, abs(d["skew"]) * 4), "High", skew=d["skew"], mean=d["mean"], median=d["median"]))
    likert = {c: list(p.meta(c).order) for c in p.roles["likert"]}
    if likert:
        rows = survey_summary(df, likert).orderBy("item").collect()
        top, bottom = max(rows, key=lambda r: r["top_two"]), max(rows, key=lambda r: r["bottom_two"])
        out.append(_finding("likert", "Survey", 85, "High", item=top["item"], top_two=top["top_two"], lowest=bottom["item"], bottom_two=bottom["bottom_two"]))
        if len(likert) >= 3:
            out += [f for f in [alpha_finding(cronbach_alpha(df, likert).first())] if f]
    out += [f for f in [quality_finding(p)] if f]
    for f in out:
        split = re.match(r"^(share_|anova_)(.+)$", f["id"])
        if split and (p.inconsistent.get(split.group(2)) or p.columns[split.group(2)]["whitespace"]):
            f["confidence"] = "Medium" if f["confidence"] == "High" else f["confidence"]
            f["score"] -= 10
    if dominant:
        for f in out:
            if f["id"] in ("trend", "spike", "streak") or re.match(r"^(share_|anova_)", f["id"]):
                f["confidence"], f["score"] = "Low", f["score"] - 30
        out.append(_finding("dominant", "Anomaly", 96, "High", share=dominant["share"], value=dominant["largest"]))
    return findings_frame(df.sparkSession, out)


def _measure_agg(p: Profile, measure: str | None, meta) -> str:
    """The measure's default aggregation, read off the profile: what all lies between 0 and 10 in whole numbers is a rating."""
    if measure is None:
        return "count"
    if non_additive_by_name(measure, meta.unit, meta.likert):
        return "mean"
    c = p.columns[measure]
    rating = bool(c.get("n")) and c["whole"] and c["min"] >= 0 and c["max"] <= 10
    return "mean" if rating and not re.search(COUNT_NAME, measure, re.I) else "sum"
