"""Descriptive statistics and correlations in one or two aggregations."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.functions.tails import p_chi2, p_t
from tablewise.operators.ordered import value_ranks
from tablewise.operators.scalars import correlation_of, numeric

QUANTILE_POINTS = {"p5": 0.05, "q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95}
# Aggregates per pass: keeps generated code within the JIT's limits.
CHUNK = 60


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


DESCRIBED = ("n", "mean", "sd", "min", *QUANTILE_POINTS, "max", "iqr", "skew", "kurt", "cv", "sum", "zeros", "outliers", "se")
COUNTED = ("n", "zeros", "outliers", "negatives", "extreme")


def fences(low: float, high: float, width: float) -> tuple[float, float]:
    return low - width * (high - low), high + width * (high - low)


def log_fences(spots: dict, width: float) -> tuple[float, float]:
    """Fences on the log scale of a positive column, from the neighbouring values of its quartiles."""
    l1, l3 = (math.log(a) + (math.log(b) - math.log(a)) * part for a, b, part in (spots["q1"], spots["q3"]))
    low, high = fences(l1, l3, width)
    return math.exp(low), math.exp(high)


def beyond(v: Column, bounds: tuple[float, float]) -> Column:
    return F.count_if((v < bounds[0]) | (v > bounds[1]))


def described(facts: dict, counts: dict[str, int]) -> dict:
    """One column's record from what its histogram passes found and the counts beyond its fences."""
    from tablewise.operators.narrowing import between

    out = {k: None for k in (*DESCRIBED, "negatives", "whole", "extreme", "positive")} | {"n": facts["n"]} | {k: 0 for k in COUNTED[1:]} | {"whole": True}
    if not facts["n"]:
        return out | counts
    out |= {k: facts[k] for k in ("mean", "sd", "min", "max", "skew", "kurt", "sum", "zeros", "negatives", "positive")} | {k: between(facts["spots"][k]) for k in QUANTILE_POINTS}
    out["spots"] = facts["spots"]
    out["iqr"], out["whole"] = out["q3"] - out["q1"], facts["broken"] == 0
    if out["sd"] is not None and out["mean"] is not None:
        out["se"] = out["sd"] / facts["n"] ** 0.5
        out["cv"] = out["sd"] / abs(out["mean"]) if out["mean"] else None
    return out | counts


def fence_counts(column: str, facts: dict) -> list[tuple[str, Column]]:
    """The counts that need a column's quartiles: beyond 1.5 and 3 IQRs and, for skewed positive columns, beyond 3 on the log scale."""
    from tablewise.operators.narrowing import between

    if not facts["n"]:
        return []
    v = F.col(f"`{column}`")
    q1, q3 = between(facts["spots"]["q1"]), between(facts["spots"]["q3"])
    out = [("outliers", beyond(v, fences(q1, q3, 1.5))), ("extreme", beyond(v, fences(q1, q3, 3.0)) if q3 > q1 else F.count_if(F.lit(False)))]
    if (facts["skew"] or 0) > 1 and facts["min"] > 0:
        low, high = log_fences(facts["spots"], 3.0)
        out.append(("log_extreme", beyond(v, (low, high)) if q3 > q1 else F.count_if(F.lit(False))))
    return out


def describe_rows(df: DataFrame, cols: list[str], histogram: int = 0, also: list[Column] = ()) -> tuple[dict[str, dict], dict]:
    """Every column's record, and the values of the aggregates in ``also`` over the other columns, which ride along with the counts
    beyond the fences."""
    from tablewise.operators.narrowing import column_facts

    numbers = [numeric(F.col(f"`{c}`")).alias(c) for c in cols]
    facts = column_facts(df.select(*numbers), cols, QUANTILE_POINTS, histogram) if cols else {}
    asked = [(c, name, count) for c in cols for name, count in fence_counts(c, facts[c])]
    wanted = [*[count.alias(f"__f{i}") for i, (_, _, count) in enumerate(asked)], *also]
    source = df.select(*numbers, *[F.col(f"`{c}`") for c in df.columns if c not in cols])
    row: dict = {}
    for start in range(0, len(wanted), CHUNK):
        row |= source.agg(*wanted[start:start + CHUNK]).first().asDict()
    counts: dict[str, dict] = {c: {} for c in cols}
    for i, (c, name, _) in enumerate(asked):
        counts[c][name] = row.pop(f"__f{i}")
    return {c: described(facts[c], counts[c]) | ({"histogram": facts[c]["bins"]} if histogram else {}) for c in cols}, row


def describe(df: DataFrame, cols: list[str], quality: bool = False, histogram: int = 0) -> DataFrame:
    """Counts, moments, quantiles and outlier counts, one row per column.

    Histogram passes (at most four, the first of which carries the moments) find the quantiles of all columns at once; one aggregate
    counts what lies beyond the fences. Only bin counts leave the tasks. ``quality`` adds negatives, whole numbers and values beyond
    three IQRs, ``histogram`` that many bin counts."""
    found, _ = describe_rows(df, cols, histogram)
    names = [*DESCRIBED, *(["negatives", "whole", "extreme"] if quality else []), *(["histogram"] if histogram else [])]
    kind = lambda k: "long" if k in COUNTED else "boolean" if k == "whole" else "array<long>" if k == "histogram" else "double"
    return df.sparkSession.createDataFrame([(c, *[found[c][k] for k in names]) for c in cols], ", ".join(["column string", *[f"`{k}` {kind(k)}" for k in names]]))


def jarque_bera(described: DataFrame) -> DataFrame:
    """Normality test from a described frame; needs eight values."""
    jb = F.when(F.col("n") >= 8, F.col("n") / 6 * (F.col("skew") * F.col("skew") + F.col("kurt") * F.col("kurt") / 4))
    return described.select("column", "n", "skew", "kurt", jb.alias("jb"))


def jarque_bera_test(described: DataFrame) -> DataFrame:
    return jarque_bera(described).withColumn("p", p_chi2(F.col("jb"), F.lit(2)))


def correlation_frame(pairs: DataFrame) -> DataFrame:
    """t and the Fisher interval for (column_a, column_b, n, r)."""
    r, n = F.col("r"), F.col("n")
    t = r * F.sqrt((n - 2) / F.greatest(F.lit(1e-12), 1 - r * r))
    z = F.atanh(F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), r)))
    half = 1.96 / F.sqrt(F.greatest(F.lit(1), n - 3))
    return pairs.where(r.isNotNull() & ~F.isnan(r) & (n >= 3)).select(
        "column_a", "column_b", "n", "r", t.alias("t"), F.tanh(z - half).alias("ci_low"), F.tanh(z + half).alias("ci_high"))


def pearson(df: DataFrame, cols: list[str]) -> DataFrame:
    """All pairs, complete cases per pair, in one aggregation per chunk of pairs."""
    values = df.select(*[numeric(F.col(c)).alias(c) for c in cols])
    pairs = list(combinations(cols, 2))
    frames = []
    for i in range(0, len(pairs), CHUNK):
        packed = F.array(*[F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"),
                                    F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("n"),
                                    correlation_of(F.col(a), F.col(b)).alias("r"))
                           for a, b in pairs[i:i + CHUNK]])
        frames.append(values.agg(packed.alias("t")).select(F.inline("t")))
    return correlation_frame(union_all(frames))


def spearman(df: DataFrame, cols: list[str], ranges: int | None = None) -> DataFrame:
    """Rank correlation; ranks are taken within the complete pairs.

    Value pairs are counted first and ranks live on distinct values, so ties cost nothing and no task sorts
    the whole column.
    """
    frames = []
    for a, b in combinations(cols, 2):
        pair = df.select(numeric(F.col(a)).alias("x"), numeric(F.col(b)).alias("y")).dropna()
        counted = pair.groupBy("x", "y").agg(F.count(F.lit(1)).alias("w"))
        rx = value_ranks(counted, "x", weight="w", ranges=ranges).select("x", F.col("midrank").alias("rx"))
        ry = value_ranks(counted, "y", weight="w", ranges=ranges).select("y", F.col("midrank").alias("ry"))
        ranked = counted.join(rx, "x").join(ry, "y")
        # Both rank means are (n + 1) / 2 by construction.
        n = F.sum("w")
        mid = (n + 1) / 2
        sxy = F.sum(F.col("w") * F.col("rx") * F.col("ry")) - n * mid * mid
        sxx = F.sum(F.col("w") * F.col("rx") * F.col("rx")) - n * mid * mid
        syy = F.sum(F.col("w") * F.col("ry") * F.col("ry")) - n * mid * mid
        frames.append(ranked.agg(n.alias("n"), F.try_divide(sxy, F.sqrt(sxx * syy)).alias("r")).select(
            F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), "n", "r"))
    return correlation_frame(union_all(frames))


def correlation(df: DataFrame, cols: list[str], method: str = "pearson", top: int = 15) -> DataFrame:
    """The strongest pairs of all columns, with p-values."""
    made = spearman(df, cols) if method == "spearman" else pearson(df, cols)
    return made.withColumn("p", p_t(F.col("t"), F.col("n") - 2)).orderBy(F.abs("r").desc(), "column_a", "column_b").limit(top)
