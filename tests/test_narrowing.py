"""Quantiles by narrowing histograms against numpy: extremes, ties, nulls, many groups, and frames that are written instead of held."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewise.operators import narrowing
from tablewise.operators.narrowing import column_facts, group_quantiles
from tablewise.operators.ordered import quantiles

PROBS = {"lo": 0.0, "a": 0.1, "b": 0.5, "c": 0.937, "hi": 1.0}


def columns():
    rng = np.random.default_rng(11)
    n = 3000
    return {
        "plain": np.round(rng.normal(100, 20, n), 2),
        "wide": rng.choice([-1, 1], n) * 10.0 ** rng.uniform(-300, 300, n),
        "close": 1.0 + rng.integers(0, 3000, n) * 2.0 ** -52,
        "one": np.full(n, -7.5),
        "mixed": rng.choice([-1e308, -5e-324, 0.0, 5e-324, 1e308, np.nan], n),
        "skewed": np.floor(rng.exponential(3, n)),
        "none": np.full(n, np.nan),
    }


@pytest.mark.parametrize("bins", [1 << 16, 8])
def test_column_facts_equal_numpy(spark, monkeypatch, bins):
    monkeypatch.setattr(narrowing, "BINS", bins)
    monkeypatch.setattr(narrowing, "MAX_PASSES", 40)
    data = columns()
    names = list(data)
    rows = [tuple(None if np.isnan(x) else float(x) for x in r) for r in zip(*data.values(), strict=True)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(3)
    found = column_facts(df, names, PROBS, histogram=5)
    for c, x in data.items():
        x = x[~np.isnan(x)]
        got = found[c]
        assert got["n"] == len(x)
        if not len(x):
            continue
        for name, p in PROBS.items():
            order = np.sort(x)
            at = (len(x) - 1) * p
            assert got["spots"][name][:2] == (order[int(at)], order[min(int(at) + 1, len(x) - 1)])
        assert got["zeros"] == (x == 0).sum() and got["negatives"] == (x < 0).sum() and (got["min"], got["max"]) == (x.min(), x.max()) and sum(got["bins"]) == len(x)
        if c in ("plain", "close", "one", "skewed"):
            m = x - x.mean()
            assert got["mean"] == pytest.approx(x.mean()) and got["sd"] == pytest.approx(x.std(ddof=1), rel=1e-9, abs=1e-18)
            if c in ("plain", "skewed"):
                n, s = len(x), x.std()
                assert got["skew"] == pytest.approx((m ** 3).mean() / s ** 3 * np.sqrt(n * (n - 1)) / (n - 2))
                assert got["kurt"] == pytest.approx((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * ((m ** 4).mean() / s ** 4 - 3) + 6))
                assert got["bins"] == np.histogram(x, 5)[0].tolist()


@pytest.mark.parametrize("held", [50_000, 3])
def test_group_quantiles_equal_numpy(spark, monkeypatch, held):
    monkeypatch.setattr(narrowing, "HELD_ROWS", held)
    data = columns()
    long = [(c if i % 2 else None if c == "plain" else c, i % 2, None if np.isnan(x) else float(x)) for c, xs in data.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(long, "g string, h int, value double").repartition(3)
    got = {(r.g, r.h): r for r in group_quantiles(df, "value", PROBS, ["g", "h"]).collect()}
    want = {}
    for g, h, x in long:
        if x is not None:
            want.setdefault((g, h), []).append(x)
    assert set(got) == set(want)
    for key, xs in want.items():
        if key[0] not in ("wide", "mixed"):
            np.testing.assert_allclose([got[key][p] for p in PROBS], np.quantile(xs, list(PROBS.values())), rtol=1e-14)
        assert got[key]["lo"] == min(xs) and got[key]["hi"] == max(xs)


def test_quantiles_of_nothing_and_without_groups(spark):
    df = spark.range(10).select(F.col("id").cast("double").alias("v"))
    assert tuple(quantiles(df, "v", {"a": 0.25, "b": 0.5}).first()) == (2.25, 4.5)
    assert [tuple(r) for r in quantiles(df.where("false"), "v", {"a": 0.5}).collect()] == [(None,)]  # as any aggregate without groups
    assert quantiles(df, "v", {"a": 0.5}, method="approx").first()["a"] in (4.0, 5.0)
    assert column_facts(df.where("false"), ["v"], PROBS) == {"v": {"n": 0}}
