"""Group tests: the rows are reduced to group moments or value counts, the rest is arithmetic on a few rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise.functions.tails import normal_cdf, p_chi2, p_f, p_normal, p_t, t_critical
from tablewise.operators.ordered import quantiles, value_ranks
from tablewise.operators.pivots import among, leading_levels
from tablewise.operators.scalars import numeric
from tablewise.session import cut_lineage


def _values(df: DataFrame, measure: str, group: str) -> DataFrame:
    return df.select(F.col(group).alias("g"), numeric(F.col(measure)).alias("v")).dropna()


def group_moments(df: DataFrame, measure: str, group: str) -> DataFrame:
    """Size, mean and variance of every group with at least two values."""
    return _values(df, measure, group).groupBy("g").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.var_samp("v").alias("var")).where(F.col("n") >= 2)


def group_table(df: DataFrame, measure: str, group: str) -> DataFrame:
    """Per group: n, mean, median, sd."""
    m = group_moments(df, measure, group)
    med = quantiles(_values(df, measure, group), "v", {"median": 0.5}, ["g"])
    return m.join(med, "g").select(F.col("g").alias(group), "n", "mean", "median", F.sqrt("var").alias("sd"))


def _pick(a, b, col: str) -> tuple[Column, Column]:
    at = lambda g: F.max(F.when(F.col("g") == F.lit(g), F.col(col)))
    return at(a), at(b)


def welch(df: DataFrame, measure: str, group: str, a, b) -> DataFrame:
    """Unequal-variance t statistic, its degrees of freedom and Cohen's d for two named groups."""
    m = group_moments(df, measure, group)
    cols = {}
    for c in ("n", "mean", "var"):
        cols[f"{c}_a"], cols[f"{c}_b"] = _pick(a, b, c)
    row = m.agg(*[v.alias(k) for k, v in cols.items()]).where(F.col("n_a").isNotNull() & F.col("n_b").isNotNull())
    sa, sb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    diff = F.col("mean_a") - F.col("mean_b")
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / (F.col("n_a") + F.col("n_b") - 2))
    return row.select(
        "n_a", "n_b", "mean_a", "mean_b", diff.alias("diff"), F.sqrt(sa + sb).alias("se"), F.try_divide(diff, F.sqrt(sa + sb)).alias("t"),
        F.try_divide((sa + sb) * (sa + sb), sa * sa / (F.col("n_a") - 1) + sb * sb / (F.col("n_b") - 1)).alias("df"),
        F.when(pooled == 0, 0.0).otherwise(F.try_divide(diff, pooled)).alias("d"))


def welch_test(df: DataFrame, measure: str, group: str, a, b) -> DataFrame:
    row = welch(df, measure, group, a, b)
    row = row.withColumn("p", p_t(F.col("t"), F.col("df"))).withColumn("__c", t_critical(F.lit(0.975), F.col("df")))
    return row.withColumn("ci_low", F.col("diff") - F.col("__c") * F.col("se")).withColumn("ci_high", F.col("diff") + F.col("__c") * F.col("se")).drop("__c")


def paired_t(df: DataFrame, a: str, b: str) -> DataFrame:
    d = df.select((numeric(F.col(a)) - numeric(F.col(b))).alias("d")).dropna()
    row = d.agg(F.count("d").alias("n"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd")).where(F.col("n") >= 2)
    return row.select("n", "mean_diff", (F.col("n") - 1).alias("df"), F.try_divide(F.col("mean_diff"), F.col("sd") / F.sqrt("n")).alias("t"),
                      F.when(F.col("sd") == 0, 0.0).otherwise(F.try_divide("mean_diff", "sd")).alias("d"))


def paired_t_test(df: DataFrame, a: str, b: str) -> DataFrame:
    return paired_t(df, a, b).withColumn("p", p_t(F.col("t"), F.col("df")))


def anova(df: DataFrame, measure: str, group: str) -> DataFrame:
    m = group_moments(df, measure, group)
    grand = m.agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("g")).scalar()
    gap = F.col("mean") - grand
    row = m.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("total"), F.sum(F.col("n") * gap * gap).alias("ssb"),
                F.sum((F.col("n") - 1) * F.col("var")).alias("ssw")).where(F.col("groups") >= 2)
    d1, d2 = F.col("groups") - 1, F.col("total") - F.col("groups")
    return row.select(d1.alias("df1"), d2.alias("df2"), F.try_divide(F.col("ssb") / d1, F.col("ssw") / d2).alias("f"),
                      F.try_divide(F.col("ssb"), F.col("ssb") + F.col("ssw")).alias("eta2"))


def anova_test(df: DataFrame, measure: str, group: str) -> DataFrame:
    return anova(df, measure, group).withColumn("p", p_f(F.col("f"), F.col("df1"), F.col("df2")))


def rank_sums(df: DataFrame, measure: str, group: str, ranges: int | None = None) -> DataFrame:
    """(g, n, rank_sum) over groups with at least two values.

    Rows collapse to (group, value) counts; a value's average rank is looked up once per distinct value. Groups of one row leave by
    (group, value): a join by group would put a whole group in one task.
    """
    v = _values(df, measure, group)
    lone = v.groupBy("g").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("v")).where(F.col("c") == 1).select("g", "v")
    counted = v.groupBy("g", "v").agg(F.count(F.lit(1)).alias("w")).join(lone, ["g", "v"], "left_anti")
    ranks = value_ranks(counted, "v", weight="w", ranges=ranges).select("v", "midrank")
    return counted.join(ranks, "v").groupBy("g").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("midrank")).alias("rank_sum"))


def mann_whitney(df: DataFrame, measure: str, group: str, a, b, ranges: int | None = None) -> DataFrame:
    """U by rank sums with the plain normal approximation (no tie or continuity correction)."""
    two = df.where(F.col(group).isin(a, b))
    sums = rank_sums(two, measure, group, ranges)
    (na, nb), (ra, _) = _pick(a, b, "n"), _pick(a, b, "rank_sum")
    row = sums.agg(na.alias("n_a"), nb.alias("n_b"), ra.alias("__r")).where(F.col("n_a").isNotNull() & F.col("n_b").isNotNull())
    # Doubles: the variance holds the third power of a size, which passes 2^63 at 2.6 million rows.
    n1, n2 = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    u1 = F.col("__r") - n1 * (n1 + 1) / 2
    u = F.least(u1, n1 * n2 - u1)
    z = (u - n1 * n2 / 2) / F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    return row.select("n_a", "n_b", u.alias("u"), z.alias("z"), (2 * normal_cdf(-F.abs(z))).alias("p"),
                      (F.abs(z) / F.sqrt(n1 + n2)).alias("r_effect"))


def kruskal(df: DataFrame, measure: str, group: str, ranges: int | None = None) -> DataFrame:
    """H without tie correction."""
    sums = rank_sums(df, measure, group, ranges)
    row = sums.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("total"),
                   F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("q")).where(F.col("groups") >= 2)
    n = F.col("total").cast("double")
    return row.select((12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)).alias("h"), (F.col("groups") - 1).alias("df"))


def kruskal_test(df: DataFrame, measure: str, group: str) -> DataFrame:
    return kruskal(df, measure, group).withColumn("p", p_chi2(F.col("h"), F.col("df")))


def chi_square_cells(df: DataFrame, a: str, b: str, k: int = 12) -> DataFrame:
    """Observed and expected counts and standardised residuals for every cell, empty ones included.

    The levels come first (at most ``k`` per side), then one pass pivots the counts, which fills empty cells with 0.
    The margins are windows over that grid of at most k x k cells.
    """
    levels = leading_levels(df, [a, b], k)
    rows = df.where(among(df, a, levels[a]) & among(df, b, levels[b])).select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
    names = [f"l{i}" for i in range(len(levels[b]))]
    wide = rows.groupBy("a").agg(*[F.count_if(F.col("b") == v).alias(n) for n, v in zip(names, levels[b])])
    pairs = F.array(*[F.struct(F.lit(v).alias("b"), F.col(n).alias("n")) for n, v in zip(names, levels[b])])
    cells = wide.select("a", F.inline(pairs)) if names else rows.select("a", "b", F.lit(0).cast("long").alias("n"))
    over = lambda *keys: F.sum("n").over(Window.partitionBy(*keys))
    cells = cells.withColumn("col_total", over("b")).withColumn("row_total", over("a")).withColumn("total", over())
    cells = cells.where((F.col("row_total") > 0) & (F.col("col_total") > 0))
    cells = cells.select("a", "b", "n", (F.col("row_total") * F.col("col_total") / F.col("total")).alias("expected"))
    return cells.withColumn("residual", (F.col("n") - F.col("expected")) / F.sqrt("expected"))


HELD_CELLS = 100_000  # a cube of no more cells is evaluated where it is collected
CHI_COLUMNS = "n long, chi2 double, df long, cramers_v double, low_expected double"


def chi_square(df: DataFrame, a: str, b: str, k: int | None = None) -> DataFrame:
    """Chi-square of all levels, or of the top ``k`` of either column.

    One Expand over {a, b}, {a} and {b} counts cells and margins in one scan. A cube of at most HELD_CELLS rows is evaluated on the driver;
    a larger one is written to the shared folder and joined there. Empty cells are never formed: over the cells that hold rows, the sum
    of n^2 / (row total * column total) gives the statistic, and cells of low expectation are counted from the two margins."""
    pairs = df.select(*[F.col(f"`{c}`").cast("string").alias(x) for c, x in ((a, "a"), (b, "b"))])
    pairs = pairs.where(F.col("a").isNotNull() & F.col("b").isNotNull()) if k is None else pairs
    cube = pairs.groupingSets([[F.col("a"), F.col("b")], [F.col("a")], [F.col("b")]], F.col("a"), F.col("b")).agg(F.grouping_id().alias("set"), F.count(F.lit(1)).alias("n"))
    rows = cube.limit(HELD_CELLS + 1).toArrow()
    row = _chi_held(rows.to_pandas(), k) if rows.num_rows <= HELD_CELLS else _chi_written(cut_lineage(cube), k)
    return df.sparkSession.createDataFrame([row], CHI_COLUMNS)


def _chi_row(n: int, q: float | None, r: int, c: int, low: float | None) -> tuple:
    """The result from the sum q, the numbers of levels and the number of cells of low expectation."""
    chi2 = max(0.0, n * (q - 1)) if n else None
    return n, chi2, (r - 1) * (c - 1), (chi2 / (n * max(1, min(r, c) - 1))) ** 0.5 if n else None, low / (r * c) if r and c else None


def _chi_held(cube, k: int | None) -> tuple:
    cells = cube[(cube["set"] == 0) & cube["a"].notna() & cube["b"].notna()]
    for c, at in (("a", 1), ("b", 2)):
        if k is not None:
            margin = cube[(cube["set"] == at) & cube[c].notna()].sort_values(["n", c], ascending=[False, True])
            cells = cells[cells[c].isin(margin[c].iloc[:k])]
    r, c = cells.groupby("a")["n"].sum(), cells.groupby("b")["n"].sum()
    n = int(cells["n"].sum())
    q = float((cells["n"] / cells["a"].map(r) * cells["n"] / cells["b"].map(c)).sum()) if n else None
    low = int(np.searchsorted(np.sort(c.to_numpy()), -(-5 * n // r.to_numpy()), side="left").sum()) if n else None
    return _chi_row(n, q, len(r), len(c), low)


def _chi_written(cube: DataFrame, k: int | None) -> tuple:
    cells = cube.where((F.col("set") == 0) & F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b", "n")
    rows, cols = (cube.where((F.col("set") == at) & F.col(c).isNotNull()).select(c, F.col("n").alias(f"n_{c}")) for c, at in (("a", 1), ("b", 2)))
    if k is not None:  # at most k * k cells, whose margins are sums over them
        for c, margin in (("a", rows), ("b", cols)):
            cells = cells.join(F.broadcast(margin.orderBy(F.col(f"n_{c}").desc(), c).limit(k).select(c)), c, "left_semi")
        rows, cols = (cells.groupBy(c).agg(F.sum("n").alias(f"n_{c}")) for c in "ab")
    held = cells.join(rows, "a").join(cols, "b").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(F.col("n") / F.col("n_a") * F.col("n") / F.col("n_b")).alias("q")).first()
    # A cell is low if n_a * n_b < 5 n. Margins of one size go together: n rows have at most sqrt(2 n) different sizes.
    points = rows.groupBy("n_a").agg(F.count(F.lit(1)).alias("r")).select(F.ceil(F.lit(5 * held["n"]) / F.col("n_a")).alias("at"), "r", F.lit(0).cast("long").alias("c")).union(
        cols.groupBy("n_b").agg(F.count(F.lit(1)).alias("c")).select(F.col("n_b").alias("at"), F.lit(0).cast("long"), "c"))
    under = Window.orderBy("at", F.col("c")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    low = points.withColumn("under", F.sum("c").over(under)).agg(
        *[F.coalesce(x, F.lit(0)) for x in (F.sum("r"), F.sum("c"), F.sum(F.col("r") * F.col("under")))]).first()
    return _chi_row(held["n"], held["q"], *low)


def chi_square_test(df: DataFrame, a: str, b: str, k: int | None = None) -> DataFrame:
    return chi_square(df, a, b, k).withColumn("p", p_chi2(F.col("chi2"), F.col("df")))


RESULT_COLUMNS = ("test", "statistic", "df1", "df2", "p", "effect", "effect_size")


def compare_groups(df: DataFrame, measure: str, group: str) -> DataFrame:
    """Two groups: Welch and Mann-Whitney. More: ANOVA and Kruskal-Wallis."""
    found = [r["g"] for r in group_moments(df, measure, group).select("g").orderBy("g").limit(3).collect()]
    if len(found) < 2:
        raise ValueError("Need at least two groups with two or more values.")
    none = F.lit(None).cast("double")

    def shaped(frame, test, stat, d1, d2, p, kind, size):
        return frame.select(F.lit(test).alias("test"), stat.cast("double").alias("statistic"), d1.cast("double").alias("df1"), d2.cast("double").alias("df2"),
                            p.alias("p"), F.lit(kind).alias("effect"), size.cast("double").alias("effect_size"))

    if len(found) == 2:
        w, m = welch_test(df, measure, group, *found), mann_whitney(df, measure, group, *found)
        return shaped(w, "Welch t", F.col("t"), F.col("df"), none, F.col("p"), "d", F.col("d")).unionByName(
            shaped(m, "Mann-Whitney U", F.col("u"), none, none, F.col("p"), "r", F.col("r_effect")))
    a, k = anova_test(df, measure, group), kruskal_test(df, measure, group)
    return shaped(a, "ANOVA", F.col("f"), F.col("df1"), F.col("df2"), F.col("p"), "eta2", F.col("eta2")).unionByName(
        shaped(k, "Kruskal-Wallis", F.col("h"), F.col("df"), none, F.col("p"), "", none))


# --- fixed values: thresholds for effect words -------------------------------
EFFECT_WORDS = {
    "r": ((0.7, "very strong"), (0.5, "strong"), (0.3, "moderate"), (0.1, "weak")),
    "d": ((0.8, "large"), (0.5, "medium"), (0.2, "small")),
    "eta2": ((0.14, "large"), (0.06, "medium"), (0.01, "small")),
    "v": ((0.5, "strong"), (0.3, "moderate"), (0.1, "weak")),
}
# ----------------------------------------------------------------------------


def effect_label(kind: str, value: Column) -> Column:
    size = F.abs(value)
    (first, word), *rest = EFFECT_WORDS[kind]
    out = F.when(size >= first, word)
    for limit, word in rest:
        out = out.when(size >= limit, word)
    return out.otherwise("negligible")


def _marks(values: DataFrame) -> Column:
    """Mean, spread and 1.5 IQR fences of column ``v`` as one one-row subquery."""
    q = quantiles(values, "v", {"q1": 0.25, "q3": 0.75})
    s = values.agg(F.struct(F.avg("v").alias("m"), F.stddev_samp("v").alias("sd")).alias("s")).scalar()
    iqr = F.col("q3") - F.col("q1")
    facts = q.select((F.col("q1") - 1.5 * iqr).alias("low"), (F.col("q3") + 1.5 * iqr).alias("high"), s.alias("s"))
    return facts.select(F.struct("low", "high", F.col("s.m").alias("m"), F.col("s.sd").alias("sd")).alias("k")).scalar()


def outlier_report(df: DataFrame, col: str, key: str, top: int = 25) -> DataFrame:
    """Rows outside the 1.5 IQR fences, the most extreme z-scores first."""
    v = numeric(F.col(col))
    rows = df.select(key, v.alias("v"), _marks(df.select(v.alias("v"))).alias("k"))
    beyond = rows.where((F.col("v") < F.col("k.low")) | (F.col("v") > F.col("k.high")))
    out = beyond.select(key, F.col("v").alias(col), ((F.col("v") - F.col("k.m")) / F.col("k.sd")).alias("z"))
    return out.orderBy(F.abs("z").desc(), key).limit(top)


def outlier_counts(df: DataFrame, col: str) -> DataFrame:
    """How many values lie outside the fences and beyond three standard deviations."""
    values = df.select(numeric(F.col(col)).alias("v")).dropna()
    rows = values.withColumn("k", _marks(values))
    v = F.col("v")
    return rows.agg(F.count(v).alias("n"), F.count_if((v < F.col("k.low")) | (v > F.col("k.high"))).alias("outside"),
                    F.count_if(F.abs((v - F.col("k.m")) / F.col("k.sd")) > 3).alias("far"), F.max("k.low").alias("low"), F.max("k.high").alias("high"))
