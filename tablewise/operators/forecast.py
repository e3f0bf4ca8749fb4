"""Forecasts for many series at once, all on the JVM: a series is one array in time order, and smoothing is a fold over it.

Every choice of smoothing parameters is a lane of a fold that carries level, trend, season and squared error; the lane of the smallest
error gives the model. All candidates are rated on a held-out tail, and the best one is fitted again on the whole series. A series has one
value a calendar bucket, so its array never outgrows its calendar, however many rows there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.operators.aggregate import auto_grain, default_agg
from tablewise.operators.series import drop_partial_tail, indexed, period_values, step_periods

# --- fixed values -----------------------------------------------------------
SEASON = {"day": 7, "week": 52, "month": 12, "quarter": 4}
HOLT_ALPHA = (0.1, 0.3, 0.5, 0.7, 0.9)
HOLT_BETA = (0.05, 0.1, 0.2, 0.3)
HW_ALPHA = (0.2, 0.4, 0.6)
HW_BETA = (0.05, 0.15)
HW_GAMMA = (0.1, 0.3, 0.5)
Z80, Z95 = 1.2816, 1.96
MIN_PERIODS = 6
NAIVE, AVERAGE, TREND, HOLT, HOLT_WINTERS = (
    "Naive (last value)", "Moving average (3)", "Linear trend", "Holt's exponential smoothing", "Holt-Winters (seasonal)")
# ----------------------------------------------------------------------------


# The models are SQL text over an array of doubles, with lambdas: one expression to parse instead of thousands of calls to build it.


def let(name: str, value: str, use: str) -> str:
    """use, in which name stands for the value computed once."""
    return f"transform(array({value}), {name} -> {use})[0]"


def _held(df: DataFrame, **columns: str) -> DataFrame:
    """Columns computed in a step of their own: the optimizer cannot write their expressions into every place that reads them."""
    fields = ", ".join(f"'{name}', {sql}" for name, sql in columns.items())
    return df.select("*", F.expr(f"inline(array(named_struct({fields})))"))


def _total(a: str) -> str:
    return f"aggregate({a}, 0D, (sum_, x_) -> sum_ + x_)"


def _mean(a: str) -> str:
    return f"{_total(a)} / size({a})"


def _root_mean(errors: str) -> str:
    return let("err_", errors, f"if(size(err_) > 0, sqrt({_total('transform(err_, e_ -> e_ * e_)')} / size(err_)), 0D)")


def _model(ahead: str, rms: str) -> str:
    """Values ahead, and the root mean square of the fit's misses on the series itself, without its first steps."""
    return f"named_struct('ahead', {ahead}, 'rms', {rms})"


def _later(y: str) -> str:
    return f"slice({y}, 2, size({y}) - 1)"


def _naive(y: str, h: str) -> str:
    return _model(f"array_repeat(element_at({y}, -1), {h})", _root_mean(f"zip_with({_later(y)}, slice({y}, 1, size({y}) - 1), (v, w) -> v - w)"))


def _average(y: str, h: str) -> str:
    # The first three values stand for themselves; of those the first is no miss to count.
    misses = f"transform(sequence(1, size({y}) - 1), i -> if(i < 3, 0D, {y}[i] - (get({y}, i - 1) + get({y}, i - 2) + get({y}, i - 3)) / 3))"
    return _model(f"array_repeat({let('tail', f'slice({y}, greatest(size({y}) - 2, 1), 3)', _mean('tail'))}, {h})", _root_mean(misses))


def _trend(y: str, h: str) -> str:
    middle, places = f"(size({y}) - 1) / 2D", f"sequence(0, size({y}) - 1)"
    together = _total(f"zip_with({places}, {y}, (x, v) -> (x - {middle}) * (v - m))")
    apart = _total(f"transform({places}, x -> (x - {middle}) * (x - {middle}))")
    misses = f"zip_with({places}, {y}, (x, v) -> v - m - b * (x - {middle}))"
    made = _model(f"transform(sequence(1, {h}), k -> m + b * (size({y}) - 1 + k - {middle}))", _root_mean(let("all_", misses, _later("all_"))))
    return let("m", _mean(y), let("b", f"coalesce(try_divide({together}, {apart}), 0D)", made))


def _lanes(grid: list[tuple]) -> str:
    fields = lambda p: ", ".join(f"'{n}', {x}D" for n, x in zip("abg", p))
    return f"array({', '.join(f"named_struct('i', {i}, {fields(p)})" for i, p in enumerate(grid))})"


def _best(grid: list[tuple], values: str, start: str, level: str, season: str, expected: str) -> str:
    """The state at the end of the lane of the smallest squared error, the first among equals. A step sees the lane p, the state s (level l,
    trend t, season q, error e) and the next value v."""
    step = (f"named_struct('l', {level}, 't', p.b * ({level} - s.l) + (1 - p.b) * s.t, 'q', {season}, 'e', s.e + (v - {expected}) * (v - {expected}))")
    folded = let("s", f"aggregate({values}, {start}, (s, v) -> {step})", "named_struct('e', s.e, 'i', p.i, 'l', s.l, 't', s.t, 'q', s.q)")
    return f"array_min(transform({_lanes(grid)}, p -> {folded}))"


def _holt(y: str, h: str) -> str:
    none = "cast(array() as array<double>)"
    best = _best([(a, b) for a in HOLT_ALPHA for b in HOLT_BETA], _later(y), f"named_struct('l', {y}[0], 't', {y}[1] - {y}[0], 'q', {none}, 'e', 0D)",
                 "(p.a * v + (1 - p.a) * (s.l + s.t))", none, "(s.l + s.t)")
    return let("z", best, _model(f"transform(sequence(1, {h}), k -> z.l + k * z.t)", f"sqrt(z.e / (size({y}) - 1))"))


def _holt_winters(y: str, h: str, m: int) -> str:
    """The season's terms are a queue: the one in front belongs to the next value and goes to the back renewed."""
    first, second = (f"{_total(f'slice({y}, {at}, {m})')} / {m}" for at in (1, m + 1))
    begin = f"named_struct('l', f_, 't', ({second} - f_) / {m}, 'q', transform(slice({y}, 1, {m}), w -> w - f_), 'e', 0D)"
    level = "(p.a * (v - s.q[0]) + (1 - p.a) * (s.l + s.t))"
    best = _best([(a, b, g) for a in HW_ALPHA for b in HW_BETA for g in HW_GAMMA], f"slice({y}, {m + 1}, size({y}) - {m})", "o", level,
                 f"concat(slice(s.q, 2, {m - 1}), array(p.g * (v - {level}) + (1 - p.g) * s.q[0]))", "(s.l + s.t + s.q[0])")
    # The first season is copied; of shorter series more is left out of the misses, but those have no seasonal model.
    made = _model(f"transform(sequence(1, {h}), k -> z.l + k * z.t + z.q[(k - 1) % {m}])", f"sqrt(z.e / (size({y}) - {m}))")
    return let("o", let("f_", first, begin), let("z", best, made))


def _candidates(season: int | None) -> list[tuple]:
    """(name, model, shortest series it can be fitted on) in their order."""
    models = [(NAIVE, _naive, 1), (AVERAGE, _average, 1), (TREND, _trend, 1), (HOLT, _holt, 2)]
    return models + ([(HOLT_WINTERS, lambda y, h: _holt_winters(y, h, season), 2 * season)] if season else [])


def _quoted(name: str) -> str:
    return "'" + name.replace("'", "\\'") + "'"


def _rated(frame: DataFrame, horizon: int, season: int | None) -> DataFrame:
    """frame (y: the series) with ``rated``: (rmse, i, method, mape) of every candidate on the held-out tail, best first."""
    parts = _held(frame, __hold=f"greatest(1, least({horizon}, int(floor(size(y) / 4))))")
    parts = _held(parts, __train="slice(y, 1, size(y) - __hold)", __test="slice(y, size(y) - __hold + 1, __hold)")
    rows = []
    for i, (name, model, least) in enumerate(_candidates(season)):
        shares = "zip_with(__test, made.ahead, (v, x) -> if(v != 0, abs((v - x) / v), 0D))"
        score = let("made", model("__train", "__hold"), f"named_struct('rmse', {_root_mean('zip_with(__test, made.ahead, (v, x) -> v - x)')}, 'i', {i}, 'method', {_quoted(name)}, 'mape', {_mean(shares)})")
        row = f"if(size(__train) >= {max(3, least)}, {score}, named_struct('rmse', double('infinity'), 'i', {i}, 'method', {_quoted(name)}, 'mape', cast(null as double)))"
        rows.append(row if name != HOLT_WINTERS else f"if(size(y) >= {2 * season + max(3, horizon)}, {row}, null)")
    held = _held(parts, __rated=f"array({', '.join(rows)})").withColumn("rated", F.expr("sort_array(filter(__rated, x -> x is not null))"))
    return held.drop("__hold", "__train", "__test", "__rated")


def _series(df: DataFrame, date: str, measure: str | None, agg: str, grain: str, by) -> DataFrame:
    """(by..., last, y): the values of every series that is long enough to fit, in time order, without a partial last period."""
    frame = period_values(df, date, measure, agg, grain, by)
    frame = frame if agg == "mean" else drop_partial_tail(frame, by, longer_than=6)
    rows = frame.groupBy(*by).agg(F.max("period").alias("last"), F.sort_array(F.collect_list(F.struct("period", "value"))).alias("y"))
    return rows.withColumn("y", F.col("y.value")).where(F.size("y") >= MIN_PERIODS)


def _prepared(df: DataFrame, date: str, measure, grain, by, agg) -> tuple[DataFrame, str]:
    grain = grain or auto_grain(df, date)
    return _series(df, date, measure, agg or default_agg(df, measure), grain, list(by)), grain


def fit_arrays(frame: DataFrame, horizon: int = 6, season: int | None = None) -> DataFrame:
    """frame (y: array of doubles in time order, at least six) with ``rated``, ``method``, ``sigma`` and ``ahead``: the best candidate of the
    holdout fitted on everything, and the spread its bands are drawn with, which is never under its error on the holdout."""
    rated = _held(_rated(frame, horizon, season), method="rated[0].method", __rmse="rated[0].rmse")
    choice = " ".join(f"when {_quoted(name)} then {model('y', str(horizon))}" for name, model, _ in _candidates(season))
    fitted = _held(rated, __fit=f"case method {choice} end")
    wide = F.expr("greatest(__fit.rms, if(__rmse < double('infinity'), __rmse, 0D))")
    spread = F.expr(f"sqrt({let('m', _mean('y'), _total('transform(y, v -> (v - m) * (v - m))'))} / (size(y) - 1)) * 0.1D")
    return fitted.withColumn("sigma", F.when(wide > 0, wide).otherwise(spread)).withColumn("ahead", F.col("__fit.ahead")).drop("__fit", "__rmse")


def forecast(df: DataFrame, date: str, measure: str | None = None, horizon: int = 6, grain: str | None = None, by=(),
             agg: str | None = None) -> DataFrame:
    """(by..., period, step, method, yhat, bands) for every series with at least six periods.

    Rows are reduced to one value per calendar bucket before a series becomes an array, so it never outgrows its calendar; without ``by``
    there is one series.
    """
    by = list(by)
    frame, grain = _prepared(df, date, measure, grain, by, agg)
    fitted = fit_arrays(frame, horizon, SEASON.get(grain))
    rows = fitted.select(*by, "last", "method", "sigma", F.forall("y", lambda v: v >= 0).alias("__up"), F.posexplode("ahead").alias("__k", "yhat")).withColumn("step", (F.col("__k") + 1).cast("int"))
    width = F.col("sigma") * F.sqrt("step")
    low = lambda z: F.when(F.col("__up"), F.greatest(F.lit(0.0), F.col("yhat") - z * width)).otherwise(F.col("yhat") - z * width)
    return rows.select(*by, step_periods(F.col("last"), F.col("step"), grain).alias("period"), "step", "method", "yhat", low(Z80).alias("lo80"), (F.col("yhat") + Z80 * width).alias("hi80"),
                       low(Z95).alias("lo95"), (F.col("yhat") + Z95 * width).alias("hi95"))


def compare_models(df: DataFrame, date: str, measure: str | None = None, horizon: int = 6, grain: str | None = None, by=(),
                   agg: str | None = None) -> DataFrame:
    """Holdout error of every candidate, per series, the best first."""
    by = list(by)
    frame, grain = _prepared(df, date, measure, grain, by, agg)
    rated = _rated(frame, horizon, SEASON.get(grain))
    return rated.select(*by, F.posexplode("rated").alias("__k", "c")).select(*by, (F.col("__k") + 1).cast("int").alias("rank"), "c.method", "c.rmse", "c.mape")


def simple_forecasts(frame: DataFrame, horizon: int = 6, by=()) -> DataFrame:
    """The closed-form candidates (last value, mean of three, line) as plain aggregates over (by..., period, value)."""
    rows = indexed(frame, by).withColumn("x", F.col("i").cast("double"))
    fits = rows.groupBy(*by).agg(
        F.max("len").alias("len"), F.max_by("value", "i").alias("naive"),
        F.avg(F.when(F.col("i") >= F.col("len") - 3, F.col("value"))).alias("average3"),
        F.coalesce(F.regr_slope("value", "x"), F.lit(0.0)).alias("__b"), F.coalesce(F.regr_intercept("value", "x"), F.avg("value")).alias("__a"))
    steps = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")
    return fits.select(*by, steps, "len", "naive", "average3", "__a", "__b").select(
        *by, "step", "naive", "average3", (F.col("__a") + F.col("__b") * (F.col("len") + F.col("step") - 1)).alias("trend"))
