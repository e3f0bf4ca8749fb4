"""Least squares with an indicator for every level of wide categories, without forming the indicators.

Taking group means out of the target and the predictors leaves the same slopes as one indicator for each level would (Frisch and Waugh).
For one category the products within groups follow from sums per group, in one pass. For several, means are taken out in turn until
nothing is left to take out; each sweep is written, so that the next one starts from it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.functions.tails import t_two_sided
from tablewise.operators.scalars import numeric
from tablewise.session import cut_lineage

SETTLED, MAX_SWEEPS = 1e-20, 200
COEFFICIENTS = "term string, coef double, se double, t double, p double, n long, df long, r2_within double"


def fit_absorbed(df: DataFrame, target: str, predictors: list[str], absorb: list[str]) -> DataFrame:
    """(term, coef, se, t, p, n, df, r2_within): slopes of numeric predictors with every level of the absorbed columns held fixed.

    Rows with a null in any of the columns take no part. df takes off the slopes and the levels, one level a further column being implied
    by the others. A predictor that does not vary within groups, or follows from the others there, is an error."""
    names = ["y", *[f"x{i}" for i in range(len(predictors))]]
    factors = [f"g{i}" for i in range(len(absorb))]
    rows = df.select(*[F.col(f"`{c}`").cast("string").alias(g) for c, g in zip(absorb, factors, strict=True)], *[numeric(F.col(f"`{c}`")).alias(x) for c, x in zip([target, *predictors], names, strict=True)]).dropna()
    head = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(x) for x in names], *[F.var_pop(x).alias(f"v{x}") for x in names]).first()
    if not head["n"]:
        raise ValueError("No complete rows.")
    rows = rows.select(*factors, *[(F.col(x) - head[x]).alias(x) for x in names])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    if len(factors) == 1:
        sums = rows.groupBy(*factors).agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(x) for x in names], *[F.sum(F.col(a) * F.col(b)).alias(f"{a}{b}") for a, b in pairs])
        found = sums.agg(F.count(F.lit(1)).alias("levels"), *[F.sum(F.col(f"{a}{b}") - F.col(a) * F.col(b) / F.col("n")).alias(f"{a}{b}") for a, b in pairs]).first()
        levels = found["levels"]
    else:
        rows = _swept(rows, factors, names, [head[f"v{x}"] * head["n"] for x in names])
        found = rows.agg(*[F.count_distinct(g).alias(g) for g in factors], *[F.sum(F.col(a) * F.col(b)).alias(f"{a}{b}") for a, b in pairs]).first()
        levels = sum(found[g] for g in factors) - (len(factors) - 1)
    gram = np.zeros((len(names), len(names)))
    for a, b in pairs:
        i, j = names.index(a), names.index(b)
        gram[i, j] = gram[j, i] = found[f"{a}{b}"]
    dof = head["n"] - levels - len(predictors)
    if dof < 1:
        raise ValueError("Too few complete rows for this many levels and predictors.")
    sxx, sxy, syy = gram[1:, 1:], gram[1:, 0], gram[0, 0]
    scale = np.sqrt(np.maximum(0.0, np.diag(sxx)))
    whole = np.sqrt(np.array([head[f"v{x}"] for x in names[1:]]) * head["n"])
    if (scale <= 1e-9 * whole).any() or np.linalg.cond(sxx / np.outer(scale, scale)) > 1e12:
        raise ValueError("A predictor does not vary within the groups, or follows from the others there.")
    inverse = np.linalg.inv(sxx / np.outer(scale, scale)) / np.outer(scale, scale)
    slopes = inverse @ sxy
    sse = max(0.0, float(syy - slopes @ sxy))
    se = np.sqrt(np.maximum(0.0, np.diag(inverse)) * sse / dof)
    out = []
    for term, b, e in zip(predictors, slopes, se, strict=True):
        t = float(b / e) if e > 0 else None
        out.append((term, float(b), float(e), t, None if t is None else t_two_sided(t, dof), head["n"], int(dof), float(1 - sse / syy) if syy > 0 else None))
    return df.sparkSession.createDataFrame(out, COEFFICIENTS)


def _swept(rows: DataFrame, factors: list[str], names: list[str], squares: list[float]) -> DataFrame:
    """Rows without the means of any factor's levels: they are taken out in turn until what a sweep still finds is nothing beside the whole."""
    for _ in range(MAX_SWEEPS):
        for g in factors:
            means = rows.groupBy(g).agg(*[F.avg(x).alias(f"m{x}") for x in names])
            rows = rows.select(*factors, *names).join(means, g).select(*factors, *[(F.col(x) - F.col(f"m{x}")).alias(x) for x in names], *[f"m{x}" for x in names])
            if g == factors[0]:  # after the first sweep its means are what the other factors put back
                rows = cut_lineage(rows)
                taken = rows.agg(*[F.sum(F.col(f"m{x}") * F.col(f"m{x}")).alias(x) for x in names]).first()
        rows = rows.select(*factors, *names)
        if all(taken[x] <= SETTLED * s for x, s in zip(names, squares, strict=True) if s > 0):
            return rows
    raise RuntimeError("group means do not settle")
