import numpy as np
import pytest

from tablewise.operators import forecast as real
from tests import plain_forecast as fc


@pytest.mark.parametrize("season", [None, 4])
def test_folds_equal_plain_models(spark, season):
    rng = np.random.default_rng(6)
    series = [rng.normal(50, 9, n).tolist() for n in (6, 7, 11, 13, 30)] + [(np.tile([9.0, 2, 5, 4], 8) + np.arange(32) + rng.normal(0, .2, 32)).tolist(), (3 + 2.0 * np.arange(20)).tolist(), [4.0] * 9,
              [0.0, 0.0, 3.0, 0.0, 5.0, 0.0, 0.0, 2.0], (np.arange(12) % 2 * -3.0).tolist()]
    for horizon in (1, 6):
        frame = spark.createDataFrame([(i, y) for i, y in enumerate(series)], "i int, y array<double>")
        for row in real.fit_arrays(frame, horizon, season).collect():
            want = fc.fit_series(series[row.i], horizon, season)
            assert [c.method for c in row.rated] == [c[0] for c in want["comparison"]] or sorted(c.rmse for c in row.rated) == pytest.approx(sorted(c[1] for c in want["comparison"]), abs=1e-9)
            errors = {c[0]: c[1:] for c in want["comparison"]}
            assert {c.method: c.rmse for c in row.rated} == pytest.approx({k: v[0] for k, v in errors.items()}, abs=1e-9)
            assert {c.method: c.mape for c in row.rated if c.mape is not None} == pytest.approx({k: v[1] for k, v in errors.items() if v[1] is not None}, abs=1e-9)
            if row.method == want["method"]:
                assert row.ahead == pytest.approx(want["forecast"].tolist(), abs=1e-8) and row.sigma == pytest.approx(want["sigma"], abs=1e-8)
            else:  # a tie that rounding decides
                assert errors[row.method][0] == pytest.approx(errors[want["method"]][0], abs=1e-9)


def test_line_is_continued():
    y = 3.0 + 2.0 * np.arange(20)
    out = fc.fit_series(y, 4, 12)
    assert out["method"] in (fc.TREND, fc.HOLT)
    assert np.allclose(out["forecast"], 3 + 2 * np.arange(20, 24))


def test_season_is_found():
    season = np.array([5, 1, 0, 2, 9, 3, 4, 8, 7, 6, 2, 1], dtype=float)
    y = np.tile(season, 4) + np.arange(48) * 0.5 + 20
    out = fc.fit_series(y, 6, 12)
    assert out["method"] == fc.HOLT_WINTERS
    assert [c[0] for c in out["comparison"]][0] == fc.HOLT_WINTERS and len(out["comparison"]) == 5


def test_bands():
    y = np.array([5, 0, 6, 1, 0, 7, 2, 0, 5, 1], dtype=float)
    out = fc.fit_series(y, 3, None)
    assert (out["lo80"] >= 0).all() and (out["lo95"] >= 0).all() and (out["hi95"] > out["hi80"]).all()
    assert np.allclose(out["hi95"] - out["forecast"], 1.96 * out["sigma"] * np.sqrt([1, 2, 3]))
    assert (fc.fit_series(y - 3, 3, None)["lo95"] < 0).any()


def holt_plain(y, a, b):
    level, trend, fit = y[0], y[1] - y[0], [y[0]]
    for v in y[1:]:
        fit.append(level + trend)
        new = a * v + (1 - a) * (level + trend)
        trend, level = b * (new - level) + (1 - b) * trend, new
    return np.array(fit), level, trend


def test_holt_grid_against_a_plain_loop():
    y = np.random.default_rng(3).normal(10, 3, 30)
    best = min(((((y - holt_plain(y, a, b)[0]) ** 2).sum(), a, b) for a in fc.HOLT_ALPHA for b in fc.HOLT_BETA))
    fit, level, trend = holt_plain(y, *best[1:])
    got_fit, ahead = fc._holt(y, 3, 0)
    assert np.allclose(got_fit, fit) and np.allclose(ahead, level + trend * np.arange(1, 4))


def test_moving_average_fit():
    fit, ahead = fc._average(np.array([1.0, 2, 3, 4, 8]), 2, 0)
    assert np.allclose(fit, [1, 2, 3, 2, 3]) and np.allclose(ahead, [5, 5])


def test_many_series(spark):
    rows = [(s, f"2024-{m:02d}-15", float(s * 10 + m)) for s in range(5) for m in range(1, 13)] + [(9, "2024-01-01", 1.0)]
    df = spark.createDataFrame(rows, "s int, d string, v double").selectExpr("s", "to_timestamp_ntz(d) as d", "v")
    out = real.forecast(df, "d", "v", 3, "month", ["s"], "sum").orderBy("s", "step").collect()
    assert len(out) == 15 and {r["s"] for r in out} == set(range(5))  # one period is too few to fit
    assert out[0]["period"].isoformat() == "2025-01-01T00:00:00" and out[0]["yhat"] == pytest.approx(13.0)
