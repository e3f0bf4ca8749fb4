"""Least squares, segmentation and projection."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.functions.tails import f_upper, p_t
from tablewise.meta import is_numeric
from tablewise.operators.filters import systematic_sample
from tablewise.operators.moments import union_all
from tablewise.operators.ordered import value_ranks
from tablewise.operators.scalars import correlation_of, numeric

MAX_LEVELS = 12  # indicators of one column; rarer levels share the indicator OTHER
OTHER = "(other)"
SEED = 7
PASS_WIDTH = 120


@dataclass(frozen=True)
class Term:
    """One design column: a numeric column, the indicator of one level, or of all levels outside ``known``."""

    name: str
    column: str
    level: str | None = None
    known: tuple = ()

    def expr(self) -> Column:
        if self.known:
            return (~F.col(self.column).isin(*self.known)).cast("double")
        if self.level is None:
            return numeric(F.col(self.column))
        return (F.col(self.column) == F.lit(self.level)).cast("double")


@dataclass(frozen=True)
class LinearModel:
    target: str
    predictors: tuple[str, ...]
    terms: tuple[Term, ...]
    levels: dict[str, tuple]
    coef: tuple[float, ...]
    se: tuple[float, ...]
    std_coef: tuple[float | None, ...]
    n: int
    r2: float
    adj_r2: float
    rmse: float
    f: float
    p_f: float
    extra: dict = field(default_factory=dict)

    @property
    def df_residual(self) -> int:
        return self.n - len(self.coef)


def linear_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """Slope, intercept and r over complete pairs; a flat x gives slope 0."""
    a, b = numeric(F.col(x)), numeric(F.col(y))
    both = df.select(a.alias("x"), b.alias("y")).dropna()
    return both.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.regr_slope("y", "x"), F.lit(0.0)).alias("slope"),
                    F.coalesce(F.regr_intercept("y", "x"), F.avg("y")).alias("intercept"), correlation_of(F.col("x"), F.col("y")).alias("r"))


def top_predictors(df: DataFrame, target: str, candidates: list[str], k: int = 4) -> DataFrame:
    """Numeric columns most correlated with the target, in one aggregation."""
    y = numeric(F.col(target))
    packed = F.array(*[F.struct(F.lit(c).alias("column"), correlation_of(numeric(F.col(c)), y).alias("r")) for c in candidates])
    return df.agg(packed.alias("t")).select(F.inline("t")).where(F.col("r").isNotNull()).orderBy(F.abs("r").desc(), "column").limit(k)


def _levels(df: DataFrame, col: str, order=None) -> tuple[list, bool]:
    """The most frequent levels, in the given order where there is one, and whether there are more."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    found = [r[0] for r in counts.orderBy(F.col("n").desc(), F.col(col)).limit(MAX_LEVELS + 1).collect()]
    kept = found[:MAX_LEVELS]
    place = {v: i for i, v in enumerate(order or [])}
    return sorted(kept, key=lambda v: place.get(v, len(place))), len(found) > len(kept)


def _of_levels(df: DataFrame, terms, levels: dict[str, tuple]) -> DataFrame:
    """Rows whose levels the terms know: all but nulls where a column has an indicator for other levels."""
    open_ = {t.column for t in terms if t.known}
    for p, found in levels.items():
        df = df.where(F.col(p).isNotNull() if p in open_ else F.col(p).isin(*found))
    return df


def fit_linear(df: DataFrame, target: str, predictors: list[str], orders: dict | None = None) -> LinearModel:
    """Ordinary least squares from one pass of centred cross-products.

    Executors add up the products; the driver only solves a system as wide as the model.
    """
    terms, levels = [], {}
    for p in predictors:
        if is_numeric(df, p):
            terms.append(Term(p, p))
        else:
            found, more = _levels(df, p, (orders or {}).get(p))
            levels[p] = tuple(found)
            terms += [Term(f"{p} = {v}", p, v) for v in found[1:]]
            if more:
                terms.append(Term(f"{p} = {OTHER}", p, known=levels[p]))
    rows = _of_levels(df, terms, levels)
    width = len(terms)
    xs = [f"x{i}" for i in range(width)]
    design = rows.select(numeric(F.col(target)).alias("y"), *[t.expr().alias(x) for t, x in zip(terms, xs)]).dropna()
    head = design.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ["y", *xs]]).first()
    n, k = head["n"], width + 1
    if n <= k + 1:
        raise ValueError("Too few complete rows for this many predictors.")
    names = ["y", *xs]
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    gram = np.zeros((k, k))
    for start in range(0, len(cells), PASS_WIDTH):
        part = cells[start:start + PASS_WIDTH]
        sums = design.agg(*[F.sum((F.col(names[i]) - head[names[i]]) * (F.col(names[j]) - head[names[j]])).alias(f"s{m}")
                            for m, (i, j) in enumerate(part)]).first()
        for m, (i, j) in enumerate(part):
            gram[i, j] = gram[j, i] = sums[m]
    sst, sxy, sxx = gram[0, 0], gram[1:, 0], gram[1:, 1:]
    scale = np.sqrt(np.diag(sxx))
    if (scale == 0).any() or np.linalg.cond(sxx / np.outer(scale, scale)) > 1e12:
        raise ValueError("Predictors are perfectly collinear. Remove one and try again.")
    inverse = np.linalg.inv(sxx / np.outer(scale, scale)) / np.outer(scale, scale)
    slopes = inverse @ sxy
    means = np.array([head[x] for x in xs])
    sse = float(sst - slopes @ sxy)
    dof = n - k
    s2 = sse / dof
    intercept = head["y"] - slopes @ means
    se = np.sqrt(np.maximum(0, np.diag(inverse) * s2))
    se0 = float(np.sqrt(max(0.0, s2 * (1 / n + means @ inverse @ means))))
    r2 = 1 - sse / sst
    f = (sst - sse) / (k - 1) / s2
    return LinearModel(
        target, tuple(predictors), tuple(terms), levels, (float(intercept), *map(float, slopes)), (se0, *map(float, se)),
        (None, *[float(b * np.sqrt(v / sst)) for b, v in zip(slopes, np.diag(sxx))]), n, float(r2), float(1 - (1 - r2) * (n - 1) / dof),
        float(np.sqrt(sse / n)), float(f), f_upper(float(f), k - 1, dof))


def coefficient_frame(spark, model: LinearModel) -> DataFrame:
    names = ["(Intercept)", *[t.name for t in model.terms]]
    rows = list(zip(names, model.coef, model.se, model.std_coef))
    frame = spark.createDataFrame(rows, "term string, coef double, se double, std_coef double")
    frame = frame.withColumn("t", F.try_divide("coef", "se"))
    return frame.withColumn("p", p_t(F.col("t"), F.lit(model.df_residual))).select("term", "coef", "se", "t", "p", "std_coef")


def fit_frame(spark, model: LinearModel) -> DataFrame:
    return spark.createDataFrame([(model.target, model.n, model.r2, model.adj_r2, model.rmse, model.f, model.p_f)],
                                 "target string, n long, r2 double, adj_r2 double, rmse double, f double, p_f double")


def predict(model: LinearModel, df: DataFrame) -> DataFrame:
    """Fitted value and residual of every complete row, as one linear expression."""
    rows = _of_levels(df, model.terms, model.levels)
    fitted = F.lit(model.coef[0])
    for term, b in zip(model.terms, model.coef[1:]):
        fitted = fitted + F.lit(b) * term.expr()
    out = rows.withColumn("fitted", fitted).withColumn("residual", numeric(F.col(model.target)) - F.col("fitted"))
    return out.where(F.col("fitted").isNotNull() & F.col("residual").isNotNull())


def _moments(values: DataFrame, cols: list[str]) -> Column:
    """Means and standard deviations of all columns as one one-row subquery; no spread counts as one."""
    sd = lambda c: F.when(F.stddev_samp(c) > 0, F.stddev_samp(c)).otherwise(1.0)
    facts = [F.struct(F.avg(c).alias("m"), sd(c).alias("sd")).alias(f"c{i}") for i, c in enumerate(cols)]
    return values.agg(F.struct(*facts).alias("s")).scalar()


def standardize(df: DataFrame, cols: list[str], keep: list[str] = ()) -> DataFrame:
    """z-scores of complete rows; a column without spread keeps its centred values."""
    values = df.select(*keep, *[numeric(F.col(c)).alias(c) for c in cols])
    rows = values.withColumn("__s", _moments(values, cols)).dropna(subset=list(cols))
    return rows.select(*keep, *[((F.col(c) - F.col(f"__s.c{i}.m")) / F.col(f"__s.c{i}.sd")).alias(c) for i, c in enumerate(cols)])


def winsorize(df: DataFrame, cols: list[str], tail: float = 0.01, ranges: int | None = None) -> DataFrame:
    """Clip to the observed values at the lower and upper tail positions, so one wild row cannot form a segment.

    The two cut values per column are found by rank and enter the plan as literals.
    """
    found = []
    for c in cols:
        ranked = value_ranks(df.select(numeric(F.col(c)).alias("v")), "v", ranges=ranges)
        inside = lambda r: (F.col("before") <= r) & (r < F.col("before") + F.col("cnt"))
        last = F.col("total") - 1
        found.append(ranked.agg(F.lit(c).alias("c"), F.max(F.when(inside(F.floor(last * tail)), F.col("v"))).alias("lo"),
                                F.max(F.when(inside(F.ceil(last * (1 - tail))), F.col("v"))).alias("hi")))
    cuts = {row["c"]: row for row in union_all(found).collect()}
    clip = lambda c: F.when(numeric(F.col(c)).isNotNull(), F.greatest(F.lit(cuts[c]["lo"]), F.least(F.lit(cuts[c]["hi"]), numeric(F.col(c)))))
    return df.withColumns({c: clip(c) for c in cols})


def _features(df: DataFrame, cols: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=cols, outputCol="features").transform(df)


def _kmeans(k: int):
    from pyspark.ml.clustering import KMeans

    return KMeans(k=k, seed=SEED, maxIter=60, featuresCol="features", predictionCol="__label")


def _relabel(model) -> Column:
    """Segment numbers by falling size, so names do not depend on the run."""
    sizes = list(model.summary.clusterSizes)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    numbers = F.create_map(*[x for rank, i in enumerate(order) for x in (F.lit(i), F.lit(rank + 1))])
    return numbers[F.col("__label")]


SILHOUETTE_ROWS = 600  # about so many rows stand for all of them; up to twice as many are all taken
BLOCK_POINTS = 256


def silhouette_rows(df: DataFrame, cols: list[str], label: str, key: str, rows: int | None = None, most: int = SILHOUETTE_ROWS) -> DataFrame:
    """(key, label, a, b, s) of the rows of a systematic sample: mean Euclidean distance to the sample's other rows of the own label, the
    smallest such mean over the other labels, and the silhouette; 0 where there is no other label.

    key is an integer that tells rows apart. The sample is every step-th key, step being rows // most, so it holds every row of a small
    frame. Its points go in blocks of a label, of bounded size; a row meets each block once and folds over it, so no pairs are formed."""
    n = df.count() if rows is None else rows
    picked = systematic_sample(df, key, max(1, n // most)) if n >= 2 * most else df
    sample = picked.select(F.col(key).alias("key"), F.col(label).alias("label"), F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))
    parts = max(1, -(-2 * most // BLOCK_POINTS))
    blocks = sample.groupBy(F.col("label").alias("other"), F.pmod(F.xxhash64("key"), F.lit(parts)).alias("part")).agg(F.collect_list("x").alias("points"))
    far = F.aggregate("points", F.lit(0.0), lambda t, p: t + F.sqrt(F.aggregate(F.zip_with("x", p, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, d: s + d)))
    labels = blocks.agg(F.collect_set(F.struct("other", "part")).alias("b")).scalar()  # one entry a block: the sample's size bounds them
    met = sample.withColumn("m", F.explode(labels)).select("key", "label", "x", "m.other", "m.part").join(F.broadcast(blocks), ["other", "part"])
    per = met.groupBy("key", "label", "other").agg(F.sum(far).alias("d"), F.sum(F.size("points")).alias("n"))
    own = F.col("label") == F.col("other")
    sides = per.groupBy("key", "label").agg(F.coalesce(F.max(F.when(own & (F.col("n") > 1), F.col("d") / (F.col("n") - 1))), F.lit(0.0)).alias("a"), F.min(F.when(~own, F.col("d") / F.col("n"))).alias("b"))
    return sides.withColumn("s", F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))


def silhouette(predicted: DataFrame, cols: list[str], label: str = "__label", key: str = "__row", rows: int | None = None) -> float:
    """Mean silhouette of a systematic sample."""
    return silhouette_rows(predicted, cols, label, key, rows).agg(F.avg("s")).first()[0]


def segment(df: DataFrame, cols: list[str], k: int | None = None, keep: list[str] = ()) -> tuple[DataFrame, dict]:
    """k-means on winsorised z-scores; without ``k`` the best silhouette among 2 to 6 with no tiny segment."""
    if len(cols) < 2:
        raise ValueError("Choose at least two numeric columns.")
    raw = df.select(*keep, *[F.col(c) for c in cols], *[numeric(F.col(c)).alias(f"raw_{c}") for c in cols])
    z = standardize(winsorize(raw, cols), cols, [*keep, *[f"raw_{c}" for c in cols]])
    data = _features(z, cols).withColumn("__row", F.monotonically_increasing_id()).persist()
    n = data.count()
    if n < 20:
        data.unpersist()
        raise ValueError("Too few complete rows.")
    smallest = max(5, round(0.03 * n))
    tried, best = [], None
    for candidate in ([k] if k else range(2, 7)):
        model = _kmeans(candidate).fit(data)
        if not k and min(model.summary.clusterSizes) < smallest:
            tried.append((candidate, None))
            continue
        score = silhouette(model.transform(data), cols, rows=n)
        tried.append((candidate, score))
        if best is None or score > best[1]:
            best = (model, score, candidate)
    if best is None:
        data.unpersist()
        raise ValueError(f"No clear segments: every split leaves a group with fewer than {smallest} rows.")
    model, score, chosen = best
    data.unpersist()
    out = model.transform(data).drop("__row").withColumn("segment", _relabel(model))
    return out, {"k": chosen, "silhouette": score, "tried": tried, "inertia": model.summary.trainingCost, "model": model}


def add_segments(df: DataFrame, cols: list[str], k: int, name: str = "segment") -> DataFrame:
    """Segment label per row, null where an input is missing; no winsorising, as a replayable step."""
    values = df.select(*[numeric(F.col(c)).alias(c) for c in cols])
    zs = [f"__z{i}" for i in range(len(cols))]
    placed = df.withColumn("__s", _moments(values, cols))
    scored = placed.select(*df.columns, *[((numeric(F.col(c)) - F.col(f"__s.c{i}.m")) / F.col(f"__s.c{i}.sd")).alias(z) for i, (c, z) in enumerate(zip(cols, zs))])
    model = _kmeans(k).fit(_features(scored.select(*zs).dropna(), zs))
    from pyspark.ml.feature import VectorAssembler

    complete = F.lit(True)
    for z in zs:
        complete = complete & F.col(z).isNotNull()
    ready = scored.withColumn("__ok", complete).fillna(0.0, subset=zs)
    labelled = model.transform(VectorAssembler(inputCols=zs, outputCol="features").transform(ready))
    named = labelled.withColumn(name, F.when(F.col("__ok"), F.concat(F.lit("Segment "), _relabel(model))))
    return named.select(*[c for c in df.columns if c != name], name)


def segment_profile(df: DataFrame, segment_col: str, cols: list[str]) -> DataFrame:
    """Size, raw means and the two largest relative differences from the overall mean."""
    values = df.select(F.col(segment_col).alias("segment"), *[numeric(F.col(c)).alias(c) for c in cols])
    facts = F.struct(*[F.avg(c).alias(f"o{i}") for i, c in enumerate(cols)])
    overall = values.agg(facts.alias("s")).scalar()
    means = values.where(F.col("segment").isNotNull()).groupBy("segment").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in cols])
    means = means.withColumn("__o", overall)
    gap = lambda i, c: F.coalesce(F.try_divide(F.col(c), F.col(f"__o.o{i}")) - 1, F.lit(0.0))
    # Sorted by size of the gap, earlier columns first among equals.
    ranked = F.sort_array(F.array(*[F.struct((-F.abs(gap(i, c))).alias("size"), F.lit(i).alias("i"), gap(i, c).alias("gap"), F.lit(c).alias("column")) for i, c in enumerate(cols)]))
    out = means.withColumn("__g", ranked)
    pick = lambda i: [F.col("__g")[i]["column"].alias(f"differs_{i + 1}"), F.col("__g")[i]["gap"].alias(f"gap_{i + 1}")]
    extra = pick(0) + (pick(1) if len(cols) > 1 else [])
    return out.select("segment", "n", *cols, *extra).orderBy("segment")


def pca2(df: DataFrame, cols: list[str], keep: list[str] = ()) -> tuple[DataFrame, list[float]]:
    """Scores on the first two principal components of the standardised columns, and their variance shares."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    data = _features(standardize(df, cols, keep), cols)
    model = PCA(k=min(2, len(cols)), inputCol="features", outputCol="__pc").fit(data)
    arr = vector_to_array("__pc")
    out = model.transform(data).select(*keep, arr[0].alias("pc1"), *([arr[1].alias("pc2")] if len(cols) > 1 else []))
    return out, [float(v) for v in model.explainedVariance]
