import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewise.operators import models


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    n = 300
    x, z = rng.normal(5, 2, n), rng.normal(0, 1, n)
    g = rng.choice(["a", "b", "c"], n, p=[0.5, 0.3, 0.2])
    y = 1 + 2 * x - z + np.where(g == "b", 3, 0) + rng.normal(0, 0.5, n)
    rows = [(float(a), float(b), str(c), float(d)) for a, b, c, d in zip(x, z, g, y)]
    return spark.createDataFrame(rows + [(None, 1.0, "a", 2.0)], "x double, z double, g string, y double"), x, z, g, y


def test_least_squares(spark, data):
    df, x, z, g, y = data
    model = models.fit_linear(df, "y", ["x", "z", "g"])
    design = np.column_stack([np.ones(len(x)), x, z, g == "b", g == "c"]).astype(float)
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    assert np.allclose(model.coef, beta) and [t.name for t in model.terms] == ["x", "z", "g = b", "g = c"]
    resid = y - design @ beta
    s2 = resid @ resid / (len(y) - 5)
    assert np.allclose(model.se, np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * s2))
    assert model.rmse == pytest.approx(np.sqrt((resid ** 2).mean())) and model.n == 300
    out = models.predict(model, df)
    assert out.count() == 300 and abs(out.agg(F.sum("residual")).first()[0]) < 1e-6


def test_collinear_and_short(data):
    df = data[0].withColumn("w", F.col("x") * 2)
    with pytest.raises(ValueError, match="collinear"):
        models.fit_linear(df, "y", ["x", "w"])
    with pytest.raises(ValueError):
        models.fit_linear(df.limit(2), "y", ["x"])


def test_segments(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(c + rng.normal(0, 0.3)), float(c * 2 + rng.normal(0, 0.3))) for i, c in enumerate([0] * 60 + [10] * 40 + [30] * 20)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    found, facts = models.segment(df, ["a", "b"], keep=["id"])
    sizes = [r["n"] for r in found.groupBy("segment").agg(F.count("*").alias("n")).orderBy("segment").collect()]
    assert facts["k"] == 3 and sizes == [60, 40, 20] and facts["silhouette"] > 0.8
    labelled = models.add_segments(df.withColumn("a", F.when(F.col("id") > 0, F.col("a"))), ["a", "b"], 2)
    assert labelled.where("segment is null").count() == 1 and labelled.count() == 120
    profile = models.segment_profile(labelled, "segment", ["a", "b"]).collect()
    assert [r["segment"] for r in profile] == ["Segment 1", "Segment 2"]


def test_pca(spark, data):
    df, x, z, *_ = data
    scores, share = models.pca2(df, ["x", "z", "y"])
    assert sum(share) <= 1 + 1e-9 and share[0] >= share[1] and scores.count() == 300


@pytest.mark.parametrize("n", [90, 2600])
def test_silhouette_equals_all_distances(spark, n):
    rng = np.random.default_rng(n)
    x, label = rng.normal(0, 1, (n, 3)), rng.integers(0, 4, n)
    label[label == 3] = np.where(np.arange((label == 3).sum()) == 0, 3, 2)  # a segment of one row
    df = spark.createDataFrame([(int(i), int(g), *map(float, v)) for i, (g, v) in enumerate(zip(label, x, strict=True))], "id long, g int, a double, b double, c double")
    step = max(1, n // models.SILHOUETTE_ROWS) if n >= 2 * models.SILHOUETTE_ROWS else 1
    at = np.arange(0, n, step)
    far = np.sqrt(((x[at, None] - x[None, at]) ** 2).sum(-1))
    want = {}
    for i, row in enumerate(at):
        means = {g: far[i][label[at] == g].sum() / ((label[at] == g).sum() - (g == label[row])) for g in set(label[at]) if g != label[row] or (label[at] == g).sum() > 1}
        a, b = means.pop(label[row], 0.0), min(means.values())
        want[int(row)] = (b - a) / max(a, b)
    got = {r.key: r.s for r in models.silhouette_rows(df, ["a", "b", "c"], "g", "id").collect()}
    assert got == pytest.approx(want)
    assert models.silhouette_rows(df.where("g = 0"), ["a", "b", "c"], "g", "id").where("s != 0").count() == 0
