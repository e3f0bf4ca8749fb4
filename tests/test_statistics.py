import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewise.functions import tails
from tablewise.operators import hypothesis as h, moments
from tablewise.operators.survey import cronbach_alpha, survey_summary


def test_tail_values():
    assert tails.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert tails.f_upper(4.0, 2, 27) == pytest.approx(0.0301, abs=1e-4)
    assert tails.chi2_upper(5.991, 2) == pytest.approx(0.05, abs=1e-4)
    assert tails.chi2_upper(0.5, 4) == pytest.approx(math.exp(-0.25) * 1.25, abs=1e-12)
    assert tails.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-6)
    assert tails.t_two_sided(0.0, 5) == pytest.approx(1.0)


def test_normal_and_appended_p(spark):
    df = spark.createDataFrame([(1.96, 10, 3.0), (-1.0, 4, None)], "z double, df int, f double")
    row = df.select(tails.normal_cdf(F.col("z")).alias("p")).collect()
    assert row[0]["p"] == pytest.approx(0.975, abs=1e-5) and row[1]["p"] == pytest.approx(0.158655, abs=1e-5)
    got = tails.add_p_values(df, "t", "z", "df").collect()
    assert got[0]["p"] == pytest.approx(tails.t_two_sided(1.96, 10))
    assert tails.add_p_values(df, "f", "f", "df", "df").collect()[1]["p"] is None


def test_moments(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 2, 9, 4)] + [(None,), (float("nan"),)], "v double")
    row = moments.describe(df, ["v"]).first()
    assert row["n"] == 5 and row["skew"] == pytest.approx(1.660797, abs=1e-6) and row["kurt"] == pytest.approx(2.711848, abs=1e-6)
    small = spark.createDataFrame([(float(v),) for v in (1, 2, 2, 9)], "v double")
    row = moments.describe(small, ["v"]).first()
    assert (row["q1"], row["median"], row["q3"]) == (1.75, 2.0, 3.75)


@pytest.fixture(scope="module")
def groups(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(x)) for g, m in (("a", 0), ("b", 0.6), ("c", 1)) for x in np.round(rng.normal(m, 1, 40), 1)]
    return spark.createDataFrame(rows, "g string, v double"), rows


def test_welch_and_ranks(groups):
    df, rows = groups
    a, b = (np.array([v for g, v in rows if g == k]) for k in "ab")
    row = h.welch_test(df, "v", "g", "a", "b").first()
    se = math.sqrt(a.var(ddof=1) / 40 + b.var(ddof=1) / 40)
    assert row["t"] == pytest.approx((a.mean() - b.mean()) / se)
    assert row["p"] == pytest.approx(tails.t_two_sided(row["t"], row["df"]))
    assert row["ci_low"] < row["diff"] < row["ci_high"]
    wins = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    for ranges in (1, 5):
        u = h.mann_whitney(df, "v", "g", "a", "b", ranges).first()
        assert u["u"] == pytest.approx(min(wins, 1600 - wins))


def test_compare_groups(groups):
    df, _ = groups
    assert [r["test"] for r in h.compare_groups(df, "v", "g").collect()] == ["ANOVA", "Kruskal-Wallis"]
    assert [r["test"] for r in h.compare_groups(df.where("g <> 'c'"), "v", "g").collect()] == ["Welch t", "Mann-Whitney U"]
    with pytest.raises(ValueError):
        h.compare_groups(df.where("g = 'c'"), "v", "g")


def test_correlation_limits(spark):
    df = spark.createDataFrame([(1.0, 1.0, 5.0), (2.0, 4.0, None), (3.0, 9.0, 1.0), (4.0, 16.0, 7.0), (5.0, 25.0, 2.0)], "x double, y double, z double")
    assert moments.correlation(df, ["x", "y"], "spearman").first()["r"] == pytest.approx(1.0)
    got = {(r["column_a"], r["column_b"]): r["n"] for r in moments.correlation(df, ["x", "y", "z"]).collect()}
    assert got[("x", "z")] == 4 and got[("x", "y")] == 5


def test_effect_words(spark):
    df = spark.createDataFrame([(0.75,), (-0.35,), (0.05,)], "v double")
    assert [r[0] for r in df.select(h.effect_label("r", F.col("v"))).collect()] == ["very strong", "moderate", "negligible"]


def test_survey(spark):
    order = ["no", "maybe", "yes"]
    rows = [("yes", "yes"), ("no", "no"), ("maybe", "yes"), ("yes", None)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = {r["item"]: r for r in survey_summary(df, {"a": order, "b": order}).collect()}
    assert got["a"]["n"] == 4 and got["a"]["mean_score"] == 2.25 and got["b"]["n"] == 3
    assert cronbach_alpha(df, {"a": order, "b": order}).first()["n"] == 3


def test_rank_test_of_millions_of_rows(spark):
    """The variance of U holds the third power of a size; here it passes 2^63."""
    n = 2_200_000
    df = spark.range(2 * n).selectExpr("if(id % 2 = 0, 'a', 'b') as g", "if(id % 4 = 1, 0.0d, 1.0d) as v")
    row = h.mann_whitney(df, "v", "g", "a", "b").first()
    assert (row["n_a"], row["n_b"], row["u"]) == (n, n, 0.25 * n * n)
    assert row["z"] == pytest.approx(-0.25 * n * n / math.sqrt(n * n * (2 * n + 1) / 12)) and row["r_effect"] == pytest.approx(abs(row["z"]) / math.sqrt(2 * n))


def test_rank_sums_deal_by_value(spark):
    """Lone groups take no part in the ranks, and no exchange deals rows by the group alone."""
    rows = [("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", 2.0), ("c", 0.0), ("d", 2.0), (None, 5.0), ("b", None)]
    sums = h.rank_sums(spark.createDataFrame(rows, "g string, v double"), "v", "g")
    assert sorted(map(tuple, sums.collect())) == [("a", 2, 5.0), ("b", 2, 5.0)]
    hot = h.rank_sums(spark.range(20_000).selectExpr("0 as g", "cast(id as double) as v"), "v", "g")
    cut = hot._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi, (g" not in cut and hot.first()["rank_sum"] == 20_000 * 20_001 / 2
