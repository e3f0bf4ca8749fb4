"""Range-cut windows against pandas, for one, a few and very many ranges."""

import numpy as np
import pandas as pd
import pytest

from tablewise.operators.ordered import fill_backward, fill_forward, interpolate, nth_row_sample, quantiles, running_total, value_ranks


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    n = 700
    group = np.where(rng.random(n) < 0.5, "hot", rng.choice(list("abc"), n))  # half of all rows share one group
    pdf = pd.DataFrame({"t": rng.integers(0, 40, n), "id": np.arange(n), "g": group, "v": rng.integers(0, 60, n).astype(float)})
    pdf.loc[rng.random(n) < 0.4, "v"] = np.nan
    pdf["g"] = pdf["g"].where(pdf["id"] % 50 != 0, None)
    rows = [(int(t), int(i), g, None if np.isnan(v) else float(v)) for t, i, g, v in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, "t int, id int, g string, v double").repartition(3), pdf.sort_values(["t", "id"]).reset_index(drop=True)


def ordered(df):
    out = df.toPandas().sort_values(["t", "id"]).reset_index(drop=True)
    out["v"] = out["v"].astype(float)
    return out


@pytest.mark.parametrize("ranges", [1, 5, 300])
def test_fills(frame, ranges):
    df, pdf = frame
    pd.testing.assert_series_equal(ordered(fill_forward(df, "v", ["t", "id"], ranges=ranges))["v"], pdf["v"].ffill())
    pd.testing.assert_series_equal(ordered(fill_backward(df, "v", ["t", "id"], ranges=ranges))["v"], pdf["v"].bfill())
    grouped = pdf.groupby("g", dropna=False)["v"].ffill()
    pd.testing.assert_series_equal(ordered(fill_forward(df, "v", ["t", "id"], ["g"], ranges))["v"], grouped)


@pytest.mark.parametrize("ranges", [1, 7])
def test_interpolate(frame, ranges):
    df, pdf = frame
    pd.testing.assert_series_equal(ordered(interpolate(df, "v", ["t", "id"], ranges=ranges))["v"], pdf["v"].interpolate(limit_direction="both"))


@pytest.mark.parametrize("ranges", [1, 6, 200])
def test_ranks_and_quantiles(frame, ranges):
    df, pdf = frame
    want = pdf.assign(midrank=pdf["v"].rank()).dropna(subset=["v"]).drop_duplicates("v").set_index("v")["midrank"].sort_index()
    got = value_ranks(df, "v", ranges=ranges).toPandas().set_index("v")["midrank"].astype(float).sort_index()
    pd.testing.assert_series_equal(got, want)
    q = quantiles(df, "v", {"a": 0.1, "b": 0.5}, ["g"]).toPandas().set_index("g").sort_index()
    expected = pdf.groupby("g", dropna=False)["v"].quantile([0.1, 0.5]).unstack().set_axis(["a", "b"], axis=1)
    for g in ("hot", "a", "b", "c"):
        assert np.allclose(q.loc[g].astype(float), expected.loc[g])


@pytest.mark.parametrize("ranges", [1, 4])
def test_running_total_and_sample(frame, ranges):
    df, pdf = frame
    got = running_total(df, "id", ["t", "id"], ["g"], "before", "total", ranges).toPandas().sort_values(["t", "id"]).reset_index(drop=True)
    by = pdf.groupby("g", dropna=False)["id"]
    assert (got["before"].astype(int) == by.cumsum() - pdf["id"]).all()
    assert (got["total"].astype(int) == by.transform("sum")).all()
    kept = nth_row_sample(df, 9, ["t", "id"], ranges).toPandas()["id"]
    assert set(kept) == set(pdf["id"].iloc[::9])


def test_ranges_follow_the_rows(spark, monkeypatch):
    """A frame whose files are small may hold many rows; the ranges asked for are the fewest."""
    from tablewise.operators import ordered

    df = spark.range(5000).selectExpr("id", "if(id % 3 = 0, null, cast(id as double)) as v")
    assert ordered.range_count(df) == 1
    monkeypatch.setattr(ordered, "COUNTED_BYTES", 1 << 10)
    monkeypatch.setattr(ordered, "ROWS_PER_RANGE", 400)
    assert (ordered.range_count(df), ordered.range_count(df, 6), ordered.range_count(df, 20), ordered.range_count(df, 1)) == (13, 13, 20, 1)
    assert ordered.with_ranges(df, ["id"]).groupBy(ordered.RANGE).count().agg({"count": "max"}).first()[0] < 1500
    got = [r["v"] for r in interpolate(df, "v", ["id"]).orderBy("id").collect()]
    assert got == [1.0, *map(float, range(1, 5000))]


def test_slices_follow_the_bytes(spark, tmp_path, monkeypatch):
    from tablewise.operators import ordered
    from tablewise.operators.text import bigrams

    spark.range(900).selectExpr("id as doc_id", "concat('green apples ', sha2(cast(id as string), 256), ' ripe pears') as text").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    monkeypatch.setattr(ordered, "SLICE_BYTES", 2 << 10)
    dealt = ordered.sliced(docs)
    assert dealt.columns == docs.columns and sorted(dealt.collect()) == sorted(docs.collect())
    assert "RepartitionByExpression [__slice" in dealt._jdf.queryExecution().logical().toString()
    assert [tuple(r) for r in bigrams(docs, doc=None).collect()] == [("green apples", 900), ("ripe pears", 900)]
