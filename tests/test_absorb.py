"""Absorbed categories against least squares with one indicator for each level."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewise.operators.absorb import fit_absorbed


@pytest.mark.parametrize("absorb", [["g"], ["g", "h"]])
def test_slopes_equal_indicators(spark, absorb):
    rng = np.random.default_rng(12)
    n = 600
    cols = {"g": np.where(rng.random(n) < 0.4, 0, rng.integers(0, 40, n)), "h": rng.integers(0, 7, n)}  # one level holds two fifths of the rows
    x = rng.normal(0, 1, (n, 2)) + cols["g"][:, None] * 0.1
    y = 1e4 + 3 * x[:, 0] - 2 * x[:, 1] + rng.normal(0, 50, 40)[cols["g"]] + rng.normal(0, 20, 7)[cols["h"]] + rng.normal(0, 1, n)
    design = np.column_stack([x, *[(cols[c][:, None] == np.unique(cols[c])[int(i > 0):]).astype(float) for i, c in enumerate(absorb)]])
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    dof = n - np.linalg.matrix_rank(design)
    se = np.sqrt(np.diag(np.linalg.pinv(design.T @ design))[:2] * ((y - design @ beta) ** 2).sum() / dof)
    rows = [(int(a), int(b), float(u), float(v), float(w)) for a, b, u, v, w in zip(cols["g"], cols["h"], x[:, 0], x[:, 1], y, strict=True)] + [(1, 1, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g int, h int, u double, v double, y double").repartition(3)
    got = fit_absorbed(df, "y", ["u", "v"], absorb).collect()
    assert [r.term for r in got] == ["u", "v"] and {r.n for r in got} == {n} and {r.df for r in got} == {dof}
    assert [r.coef for r in got] == pytest.approx(beta[:2].tolist()) and [r.se for r in got] == pytest.approx(se.tolist())


def test_what_does_not_vary_within_groups(spark):
    df = spark.range(100).select((F.col("id") % 5).alias("g"), (F.col("id") % 5 * 2.0).alias("x"), F.col("id").cast("double").alias("y"))
    with pytest.raises(ValueError):
        fit_absorbed(df, "y", ["x"], ["g"])
    with pytest.raises(ValueError):
        fit_absorbed(df.where("false"), "y", ["x"], ["g"])
