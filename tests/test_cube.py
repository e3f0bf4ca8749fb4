"""Evidence cube and chi-square against plain counting, in both forms; label facts in both forms; one-round cleaning against step by step."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewise.meta import ColumnMeta
from tablewise.operators import hypothesis, profile
from tablewise.operators import series as ts
from tablewise.operators.cube import Evidence, evidence_cube
from tablewise.operators.findings import leading_share, series_facts, unusual_cells
from tablewise.operators.hypothesis import anova, chi_square
from tablewise.operators.moments import pearson
from tablewise.operators.profile import build_profile, category_facts, refresh_profile
from tablewise.plans.steps import apply_steps, auto_clean


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(9)
    data = [(None if i % 19 == 0 else str(rng.choice(list("abcd"), p=[.7, .1, .1, .1])), int(rng.integers(0, 5)), None if i % 23 == 0 else str(rng.choice(["x", "y"])),
             None if i % 11 == 0 else float(rng.normal(50, 9)), "Yes" if rng.random() < (0.9 if i % 7 == 0 else 0.1) else "No") for i in range(2000)]
    return data, spark.createDataFrame(data, "g string, h int, k string, v double, churned string").repartition(3)


def test_cube_answers_what_single_queries_answer(rows):
    data, df = rows
    dims = ["g", "h", "k"]
    evidence = Evidence.of(evidence_cube(df, dims, "v", F.col("churned") == "Yes"))
    assert evidence.whole["rows"] == 2000 and evidence.whole["n"] == sum(r[3] is not None for r in data)
    for d in dims:
        want, got = leading_share(df, d, "v").first(), evidence.leading_share(d, True)
        assert (got["level"], got["groups"]) == (want["level"], want["groups"]) and got["share"] == pytest.approx(want["share"])
        want, got = anova(df, "v", d).first(), evidence.anova(d)
        assert (got["df1"], got["df2"]) == (want["df1"], want["df2"]) and got["f"] == pytest.approx(want["f"]) and got["eta2"] == pytest.approx(want["eta2"])
    for a, b in combinations(dims, 2):
        want, got = chi_square(df, a, b).first(), evidence.chi_square(a, b)
        assert (got["n"], got["df"]) == (want["n"], want["df"]) and got["chi2"] == pytest.approx(want["chi2"])
    want = unusual_cells(df, "churned", "Yes", dims).orderBy(F.col("z").desc(), "dim_a", "dim_b", "a", "b").first()
    got = evidence.unusual_cell(dims)
    assert (got["a"], got["b"]) == (want["a"], want["b"]) and got["z"] == pytest.approx(want["z"])
    assert Evidence.of(evidence_cube(df.where("false"), dims, "v")).leading_share("g", True)["groups"] == 0
    assert evidence_cube(df, [], "v").first()["rows"] == 2000


@pytest.mark.parametrize("k", [None, 3])
def test_chi_square_is_the_same_written_or_held(rows, monkeypatch, k):
    data, df = rows
    pairs = [(r[0], r[1]) for r in data]
    count = lambda i: sorted({p[i] for p in pairs if p[i] is not None}, key=lambda x: (-sum(p[i] == x for p in pairs if k or None not in p), str(x)))[:k]
    la, lb = count(0), count(1)
    table = np.array([[sum(p == (a, b) for p in pairs) for b in lb] for a in la], float)
    expected = np.outer(table.sum(1), table.sum(0)) / table.sum()
    for held in (100_000, 0):
        monkeypatch.setattr(hypothesis, "HELD_CELLS", held)
        got = chi_square(df, "g", "h", k).first()
        assert got["n"] == table.sum() and got["df"] == (len(la) - 1) * (len(lb) - 1)
        assert got["chi2"] == pytest.approx(((table - expected) ** 2 / expected).sum()) and got["low_expected"] == pytest.approx((expected < 5).mean())
        assert chi_square(df.where("false"), "g", "h", k).first()["n"] == 0


def test_label_facts_are_the_same_written_or_held(spark, monkeypatch):
    df = spark.createDataFrame([("A b",), ("a-b",), ("A b",), (" c",), (None,), ("d",), ("D",)], "x string").withColumn("y", F.lit("one"))
    held = category_facts(df, ["x", "y"], k=3)
    assert held["x"].pop("rewrites") == {"a-b": "A b", "d": "D"} and held["x"]["inconsistent"] == 2 and held["x"]["unique"] == 5 and held["x"]["top"][0] == ("A b", 2)
    monkeypatch.setattr(profile, "HELD_LABELS", 2)
    assert category_facts(df, ["x", "y"], k=3) == held
    assert category_facts(df, [], ["x"]) == {"x": {"unique": 5}}


def test_profile_after_a_step_equals_a_new_one(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else float(i % 9), "u" if i % 2 else "v") for i in range(200)], "id int, size double, kind string")
    metas = [ColumnMeta("id", "id"), ColumnMeta("size", "number"), ColumnMeta("kind", "category")]
    done = df.fillna(3.0, ["size"])
    fresh, kept = build_profile(done, metas), refresh_profile(build_profile(df, metas), done, metas, {"size"})
    assert kept.columns == fresh.columns and kept.health == fresh.health and kept.issues == fresh.issues


def test_cleaning_by_rounds_is_a_list_of_steps(spark):
    rows = [(i, None if i % 9 == 0 else float(10 + i % 50), ["North", "north ", "South", None][i % 4], 5000.0 if i == 77 else float(i % 30)) for i in range(400)]
    rows += rows[:8]
    df = spark.createDataFrame(rows, "id int, price double, region string, weight double")
    metas = [ColumnMeta("id", "id"), ColumnMeta("price", "number"), ColumnMeta("region", "category"), ColumnMeta("weight", "number")]
    done, steps, _ = auto_clean(df, metas, order_by=["id"])
    assert [s.op for s in steps].count("drop_duplicates") == 1 and {"fill_missing", "text_clean", "outliers"} <= {s.op for s in steps}
    replayed, log = apply_steps(df, steps)
    assert not any(x["error"] for x in log)
    key = lambda r: r["id"]
    a, b = sorted(done.collect(), key=key), sorted(replayed.collect(), key=key)
    assert len(a) == 400 and [(x["price"], x["region"]) for x in a] == [(x["price"], x["region"]) for x in b]
    assert [x["weight"] for x in a] == pytest.approx([x["weight"] for x in b]) and max(x["weight"] for x in a) < 5000


def test_series_facts_equal_the_windows(spark):
    from datetime import datetime

    rng = np.random.default_rng(4)
    for values in ([5.0, 7.0, 30.0, 8.0, 9.0, 10.0, 11.0], rng.normal(10, 1, 24).tolist(), [4.0, 4.0, 4.0, 4.0]):
        periods = [datetime(2020 + i // 12, i % 12 + 1, 1) for i in range(len(values))]
        frame = spark.createDataFrame(list(zip(periods, values, strict=True)), "period timestamp_ntz, value double")
        got = series_facts(values, periods)
        fit, half, jump, streak = ts.trend_fit(frame).first(), ts.half_split_change(frame).first(), ts.largest_jump(frame).first(), ts.growth_streak(frame).first()
        assert got["change"] == pytest.approx(half["change"]) and got["streak"] == streak["streak"] and got["flagged"] == jump["flagged"]
        assert got["jump_period"] == jump["period"] and (got["jump"] is None) == (jump["change"] is None)
        assert got["r"] is None and len(set(values)) == 1 or got["r"] == pytest.approx(fit["r"])


def test_a_column_that_does_not_vary_has_no_correlation(spark):
    df = spark.range(20).select(F.col("id").cast("double").alias("a"), F.lit(3.0).alias("b"), (F.col("id") * 2.0).alias("c"))
    assert [(r["column_a"], r["column_b"], r["r"]) for r in pearson(df, ["a", "b", "c"]).collect()] == [("a", "c", pytest.approx(1.0))]
