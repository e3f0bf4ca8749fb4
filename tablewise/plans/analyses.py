"""The fifteen named analyses with profile-based defaults, and packages that run several of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.meta import ColumnMeta
from tablewise.operators import change, forecast, hypothesis, models, moments, pivots, series, survey
from tablewise.operators.aggregate import default_agg, group_summary, non_additive_by_name
from tablewise.operators.profile import Profile, build_profile, quality_audit


@dataclass(frozen=True)
class Context:
    df: DataFrame
    profile: Profile
    params: dict

    def get(self, name: str, default=None):
        given = self.params.get(name)
        return default if given is None else given

    @property
    def roles(self) -> dict:
        return self.profile.roles

    def need(self, name: str, default=None) -> str:
        column = self.get(name, default)
        if column is None:
            raise ValueError(f"No column for '{name}'.")
        if column not in self.df.columns:
            raise ValueError(f"Column not found: {column}")
        return column

    def dim(self, i: int):
        return self.roles["dims"][i] if len(self.roles["dims"]) > i else None

    def measure(self):
        return self.params["measure"] if "measure" in self.params else self.roles["measure"]

    def agg(self, measure):
        meta = self.profile.meta(measure) if measure else None
        return self.get("agg") or default_agg(self.df, measure, meta.unit if meta else None, bool(meta and meta.likert))


def _describe(c: Context) -> DataFrame:
    return moments.describe(c.df, c.get("cols") or c.roles["numeric"])


def _distribution(c: Context) -> DataFrame:
    return moments.jarque_bera_test(moments.describe(c.df, [c.need("col", c.roles["measure"])]))


def _outliers(c: Context) -> DataFrame:
    return hypothesis.outlier_counts(c.df, c.need("col", c.roles["measure"]))


def _group(c: Context) -> DataFrame:
    measure = c.measure()
    return group_summary(c.df, c.need("by", c.dim(0)), measure, c.agg(measure) if measure else None, c.get("grain"))


def _compare(c: Context) -> DataFrame:
    return hypothesis.compare_groups(c.df, c.need("measure", c.roles["measure"]), c.need("group", c.dim(0)))


def _crosstab(c: Context) -> DataFrame:
    return hypothesis.chi_square_test(c.df, c.need("a", c.dim(0)), c.need("b", c.dim(1)))


def _paired(c: Context) -> DataFrame:
    return hypothesis.paired_t_test(c.df, c.need("a"), c.need("b"))


def _correlation(c: Context) -> DataFrame:
    return moments.correlation(c.df, c.get("cols") or c.roles["numeric"], c.get("method", "pearson"))


def _regression(c: Context) -> DataFrame:
    target = c.need("target", c.roles["measure"])
    predictors = c.get("predictors") or [n for n in c.roles["numeric"] if n != target][:5]
    return models.coefficient_frame(c.df.sparkSession, models.fit_linear(c.df, target, predictors))


def _timeseries(c: Context) -> DataFrame:
    measure = c.measure()
    return series.time_series(c.df, c.need("date", c.roles["date"]), measure, c.get("grain"), c.agg(measure))


def _forecast(c: Context) -> DataFrame:
    measure = c.measure()
    return forecast.forecast(c.df, c.need("date", c.roles["date"]), measure, int(c.get("horizon", 6)), c.get("grain"), c.get("by", ()), c.agg(measure))


def _change(c: Context) -> DataFrame:
    measure = c.measure()
    wide = [d for d in c.roles["dims"] if c.profile.columns[d]["unique"] > 2]
    dims = c.get("dims") or (wide or c.roles["dims"])[:5]
    meta = c.profile.meta(measure) if measure else None
    agg = "mean" if measure and (non_additive_by_name(measure, meta.unit, meta.likert) or default_agg(c.df, measure) == "mean") else "sum"
    return change.explain_change(c.df, c.need("date", c.roles["date"]), measure, dims, c.get("grain"), agg, c.get("period"))


def _clusters(c: Context) -> DataFrame:
    cols = c.get("cols") or c.roles["numeric"][:4]
    found, _ = models.segment(c.df, cols, c.get("k"))
    raw = found.select("segment", *[F.col(f"raw_{n}").alias(n) for n in cols])
    return models.segment_profile(raw, "segment", cols)


def _survey(c: Context) -> DataFrame:
    ordered = {m.name: list(m.order) for m in c.profile.metas if m.order and (not c.get("cols") or m.name in c.get("cols"))}
    likert = {n: o for n, o in ordered.items() if c.profile.meta(n).likert}
    if not ordered:
        raise ValueError("No Likert or ordered-scale columns were detected.")
    return survey.survey_summary(c.df, likert or ordered)


def _quality(c: Context) -> DataFrame:
    return quality_audit(c.df.sparkSession, c.profile)


ANALYSES: dict[str, Callable[[Context], DataFrame]] = {
    "describe": _describe, "distribution": _distribution, "outliers": _outliers, "group": _group, "compare": _compare, "crosstab": _crosstab,
    "paired": _paired, "correlation": _correlation, "regression": _regression, "timeseries": _timeseries, "forecast": _forecast,
    "change": _change, "clusters": _clusters, "survey": _survey, "quality": _quality,
}


def register_analysis(name: str, fn: Callable[[DataFrame, dict], DataFrame]) -> None:
    """Add an analysis of your own: ``fn(df, params) -> DataFrame``."""
    ANALYSES[name] = lambda c: fn(c.df, c.params)


def run(df: DataFrame, name: str, params: dict | None = None, metas: list[ColumnMeta] | None = None, profile: Profile | None = None) -> DataFrame:
    """One analysis by name; missing parameters come from the profile."""
    if name not in ANALYSES:
        raise ValueError(f"Unknown analysis: {name}")
    return ANALYSES[name](Context(df, profile or build_profile(df, metas), params or {}))


def package_members(name: str, p: Profile) -> list[str]:
    """Analyses of a package that apply to this dataset."""
    r = p.roles
    pair, dims = len(r["numeric"]) >= 2, r["dims"]
    wanted = {
        "eda": [("describe", True), ("quality", True), ("distribution", r["measure"]), ("correlation", pair), ("group", dims), ("timeseries", r["date"]), ("survey", r["likert"])],
        "trend": [("timeseries", r["date"]), ("change", r["date"]), ("forecast", r["date"])],
        "stats": [("compare", dims and r["measure"]), ("crosstab", len(dims) >= 2), ("correlation", pair), ("regression", pair)],
        "survey": [("survey", r["likert"]), ("compare", dims and r["measure"]), ("crosstab", len(dims) >= 2)],
        "segments": [("clusters", pair)],
    }
    if name not in wanted:
        raise ValueError(f"Unknown package: {name}")
    return [a for a, applies in wanted[name] if applies]


def run_package(df: DataFrame, name: str, metas: list[ColumnMeta] | None = None) -> dict[str, DataFrame | str]:
    """Result frame per analysis; one that cannot run leaves its message instead.

    Frames are lazy: a caller who wants the analyses to share one read persists df, and releases it when they are done.
    """
    p = build_profile(df, metas)
    out: dict[str, DataFrame | str] = {}
    for analysis in package_members(name, p):
        try:
            out[analysis] = run(df, analysis, {}, metas, p)
        except (ValueError, PySparkException) as problem:
            out[analysis] = str(problem).splitlines()[0]
    return out
