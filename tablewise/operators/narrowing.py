"""Exact order statistics by narrowing histograms.

The value of a given rank is found without sorting: a histogram of a fixed number of bins tells which bin holds the rank, the next pass
cuts the values of that bin into a histogram of its own, and so on until the bin holds one value. The first bins follow the logarithm of
the value (a sixteenth of a doubling each), the later ones cut the span between a bin's smallest and largest value evenly, so a double
is found in four passes whatever the data look like; a bin that holds no more rows than a histogram has bins is listed value by value,
which mostly makes it two or three. Only bin counts are shuffled, and each pass serves all columns, groups and ranks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise.session import cut_lineage

BINS = 1 << 16  # of one bracket in one pass
PER_DOUBLING = 16
ZERO = 20_000  # beyond the first code of any magnitude: 16 * 1,074 doublings below one
MAX_PASSES = 8
HELD_ROWS = 50_000  # found ranks that go on as a local frame; more are written


def coarse(v: Column) -> Column:
    """Bin of the first pass: rises with v, at most 67,200 different ones."""
    size = F.floor(F.log2(F.abs(v)) * PER_DOUBLING) + ZERO
    return F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("int")


def fine(v: Column, low, high) -> Column:
    """Bin of a later pass, from 0, between a bracket's smallest and largest value."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    # Halves first: the span of two large values may not be a double.
    part = (v / 2 - low / 2) / (high / 2 - low / 2)
    return F.least(F.floor(part * BINS), F.lit(BINS - 1)).cast("int")


def _edge(code: Column) -> Column:
    """A value near those of a first bin."""
    return F.when(code == 0, F.lit(0.0)).otherwise(F.signum(code) * F.pow(F.lit(2.0), (F.abs(code) - ZERO) / PER_DOUBLING))


def _power_sums(v: Column) -> list[Column]:
    """Sums of powers of the distance to the bin's edge, which is a few percent of the value at most."""
    d = v - _edge(F.col("bin"))
    return [F.count(F.lit(1)).alias("n"), F.sum(v).alias("sum"), F.sum(d).alias("s1"), F.sum(d * d).alias("s2"), F.sum(d * d * d).alias("s3"), F.sum(d * d * d * d).alias("s4"),
            F.count_if(v != F.floor(v)).alias("broken"), F.min(v).alias("lo"), F.max(v).alias("hi")]


def _sum(x: np.ndarray) -> float:
    return math.fsum(x) if np.isfinite(x).all() else float(x.sum())


def _merged(bins: dict[str, np.ndarray]) -> dict:
    """Moments and counts of all bins together; what overflows is None."""
    with np.errstate(all="ignore"):
        out = _moments(bins)
    return {k: None if isinstance(x, float) and not math.isfinite(x) else x for k, x in out.items()}


def _moments(bins: dict[str, np.ndarray]) -> dict:
    n, code = bins["n"].astype(float), bins["bin"].astype(float)
    edge = np.where(code == 0, 0.0, np.sign(code) * 2.0 ** ((np.abs(code) - ZERO) / PER_DOUBLING))
    total = float(n.sum())
    e = bins["s1"] / n  # of each bin about its own mean
    b2 = np.maximum(0.0, bins["s2"] - n * e ** 2)
    b3 = bins["s3"] - 3 * e * bins["s2"] + 2 * n * e ** 3
    b4 = np.maximum(0.0, bins["s4"] - 4 * e * bins["s3"] + 6 * e ** 2 * bins["s2"] - 3 * n * e ** 4)
    same = bins["lo"] == bins["hi"]
    mean = np.where(same, bins["lo"], edge + e)
    b2, b3, b4 = (np.where(same, 0.0, x) for x in (b2, b3, b4))
    centre = _sum(n * mean) / total
    d = mean - centre
    m2 = float((b2 + n * d ** 2).sum())
    m3 = float((b3 + 3 * d * b2 + n * d ** 3).sum())
    m4 = float((b4 + 4 * d * b3 + 6 * d ** 2 * b2 + n * d ** 4).sum())
    out = {"n": int(total), "mean": centre, "sum": _sum(bins["sum"]), "positive": _sum(bins["sum"][code > 0]), "min": float(bins["lo"].min()), "max": float(bins["hi"].max())}
    out |= {"zeros": int(n[code == 0].sum()), "negatives": int(n[code < 0].sum()), "broken": int(bins["broken"].sum())}
    out["sd"] = math.sqrt(m2 / (total - 1)) if total > 1 else None
    flat = out["sd"] == 0
    g1 = 0.0 if m2 <= 0 else math.sqrt(total) * m3 / m2 ** 1.5
    g2 = 0.0 if m2 <= 0 else total * m4 / m2 ** 2 - 3
    out["skew"] = None if total < 3 else 0.0 if flat else g1 * math.sqrt(total * (total - 1)) / (total - 2)
    out["kurt"] = None if total < 4 else 0.0 if flat else (total - 1) / ((total - 2) * (total - 3)) * ((total + 1) * g2 + 6)
    return out


class _Search:
    """The ranks looked for in one column and the brackets they are in, on the driver: two ranks a quantile."""

    def __init__(self, probs: dict[str, float], n: int):
        self.ranks: dict[int, list] = {}  # rank -> [rank inside its bracket, low, high, rows of the bracket]
        self.spots = {}
        for name, p in probs.items():
            spot = (n - 1) * p
            low = math.floor(spot)
            self.spots[name] = (low, min(low + 1, n - 1), spot - low)
            for r in self.spots[name][:2]:
                self.ranks[r] = [r, -math.inf, math.inf, n]

    def open(self) -> list[tuple[float, float, int]]:
        return sorted({(lo, hi, n) for _, lo, hi, n in self.ranks.values() if lo < hi})

    def narrow(self, low: float, high: float, n: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        """Put the ranks of a bracket into its bins, given in order."""
        upto = np.cumsum(n)
        for state in self.ranks.values():
            if (state[1], state[2]) == (low, high):
                b = int(np.searchsorted(upto, state[0], side="right"))
                state[:] = [state[0] - int(upto[b] - n[b]), float(lo[b]), float(hi[b]), int(n[b])]

    def values(self) -> dict[str, tuple[float, float, float]]:
        return {name: (self.ranks[a][1], self.ranks[b][1], part) for name, (a, b, part) in self.spots.items()}


def column_facts(values: DataFrame, cols: list[str], probs: dict[str, float], histogram: int = 0) -> dict[str, dict]:
    """Per numeric column (double, no NaN): moments, counts, ``spots`` (for each quantile its two neighbouring values and the part between
    them) and, with ``histogram``, that many bin counts. Columns without values give n = 0 alone.

    Every pass is one aggregate over (column, bin); at most 67,200 small rows a column reach the driver."""
    v = lambda c: F.col(f"`{c}`")
    long = values.select(F.inline(F.array(*[F.struct(F.lit(i).alias("c"), coarse(v(c)).alias("bin"), v(c).alias("v")) for i, c in enumerate(cols)]))).where(F.col("v").isNotNull())
    rows = long.groupBy("c", "bin").agg(*_power_sums(F.col("v"))).toPandas()
    out: dict[str, dict] = {c: {"n": 0} for c in cols}
    searches: dict[int, _Search] = {}
    for i, part in rows.sort_values(["c", "bin"]).groupby("c"):
        out[cols[i]] = _merged({k: part[k].to_numpy() for k in part.columns})
        searches[i] = _Search(probs, out[cols[i]]["n"])
        searches[i].narrow(-math.inf, math.inf, part["n"].to_numpy(), part["lo"].to_numpy(), part["hi"].to_numpy())
    if histogram:
        for c in cols:
            out[c]["bins"] = [0] * (1 if out[c].get("min") == out[c].get("max") else histogram) if out[c]["n"] else []
    charted = [i for i in searches if histogram]
    for _ in range(MAX_PASSES):
        brackets = {i: s.open() for i, s in searches.items() if s.open()}
        if not brackets and not charted:
            break
        cells = []
        for i, spans in brackets.items():
            code, listed = F.lit(None).cast("int"), F.lit(None).cast("double")
            for k, (lo, hi, n) in reversed(list(enumerate(spans))):
                inside = v(cols[i]).between(lo, hi)
                code = F.when(inside, F.lit(k * BINS) + (F.lit(0) if n <= BINS else fine(v(cols[i]), lo, hi))).otherwise(code)
                listed = F.when(inside, v(cols[i])).otherwise(listed) if n <= BINS else listed
            cells.append(F.struct(F.lit(i).alias("c"), code.alias("bin"), listed.alias("w"), v(cols[i]).alias("v")))
        for i in charted:
            lo, hi = out[cols[i]]["min"], out[cols[i]]["max"]
            place = F.lit(0) if lo == hi else F.least(F.floor((v(cols[i]) - lo) / ((hi - lo) / histogram)), F.lit(histogram - 1))
            cells.append(F.struct(F.lit(-1 - i).alias("c"), F.when(v(cols[i]).isNotNull(), place).cast("int").alias("bin"), F.lit(None).cast("double").alias("w"), v(cols[i]).alias("v")))
        long = values.select(F.inline(F.array(*cells))).where(F.col("bin").isNotNull())
        rows = long.groupBy("c", "bin", "w").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).toPandas().sort_values(["c", "bin", "lo"])
        for i, part in rows.groupby("c"):
            if i < 0:
                for b, n in zip(part["bin"], part["n"], strict=True):
                    out[cols[-1 - i]]["bins"][b] = int(n)
                continue
            bracket = part["bin"].to_numpy() // BINS
            for k in np.unique(bracket):
                at = bracket == k
                searches[i].narrow(*brackets[i][k][:2], part["n"].to_numpy()[at], part["lo"].to_numpy()[at], part["hi"].to_numpy()[at])
        charted = []
    else:
        raise RuntimeError("a quantile is not found after eight passes")
    for i, s in searches.items():
        out[cols[i]]["spots"] = s.values()
    return out


def between(spot: tuple[float, float, float]) -> float:
    """The linearly interpolated (type 7) quantile of a spot."""
    low, high, part = spot
    return low + (high - low) * part


def _kept(found: DataFrame) -> tuple[DataFrame, bool, bool]:
    """The frame as local rows while they are few, else written once to the shared folder; whether it is local, and whether a bracket
    is still open."""
    rows = found.limit(HELD_ROWS + 1).toArrow()
    if rows.num_rows <= HELD_ROWS:
        return found.sparkSession.createDataFrame(rows), True, bool(pc.any(pc.less(rows["lo"], rows["hi"])).as_py())
    written = cut_lineage(found)
    return written, False, not written.where("lo < hi").isEmpty()


def group_quantiles(df: DataFrame, value: str, probs: dict[str, float], by: list[str]) -> DataFrame:
    """(by..., one column for each quantile): type 7 quantiles of ``value`` in every group, null keys being keys of their own."""
    keys = [f"__k{i}" for i in range(len(by))]
    rows = df.select(*[F.col(f"`{b}`").alias(k) for b, k in zip(by, keys, strict=True)], F.col(f"`{value}`").cast("double").alias("v")).where(F.col("v").isNotNull())
    counted = [F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")]
    hist = rows.groupBy(*keys, coarse(F.col("v")).alias("bin")).agg(*counted)
    total = F.sum("n").over(Window.partitionBy(*keys))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("bin"))
    spot = lambda p: (F.col("total") - 1) * F.lit(float(p))
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), r.cast("long").alias("r")) for i, p in enumerate(probs.values()) for r in (F.floor(spot(p)), F.least(F.floor(spot(p)) + 1, F.col("total") - 1))])
    placed = hist.withColumn("total", total).withColumn("upto", upto)
    inside = lambda x: (x["r"] >= F.col("upto") - F.col("n")) & (x["r"] < F.col("upto"))
    found = placed.select(*keys, "total", "upto", "n", "lo", "hi", F.inline(F.filter(wanted, inside)))
    found, small, more = _kept(found.select(*keys, "total", "i", "r", (F.col("r") - F.col("upto") + F.col("n")).alias("at"), "lo", "hi", "n"))
    done = []
    for _ in range(MAX_PASSES):
        done.append(found.where("lo = hi"))
        if not more:
            break
        left = found.where("lo < hi")
        spans = left.select(*[F.col(k).alias(f"b{k}") for k in keys], F.col("lo").alias("from"), F.col("hi").alias("to"), (F.col("n") <= BINS).alias("few")).distinct()
        on = [F.col(k).eqNullSafe(F.col(f"b{k}")) for k in keys]
        held = rows.join(F.broadcast(spans) if small else spans, [*on, F.col("v").between(F.col("from"), F.col("to"))] if on else F.col("v").between(F.col("from"), F.col("to")))
        place = F.when(F.col("few"), F.lit(0)).otherwise(fine(F.col("v"), F.col("from"), F.col("to")))
        bins = held.groupBy(*keys, "from", place.alias("bin"), F.when(F.col("few"), F.col("v")).alias("w")).agg(*counted)
        bins = bins.withColumn("upto", F.sum("n").over(Window.partitionBy(*keys, "from").orderBy("bin", "lo")))
        asked = left.select(*[F.col(k).alias(f"b{k}") for k in keys], "total", "i", "r", "at", F.col("lo").alias("was"))
        hit = bins.join(F.broadcast(asked) if small else asked, [*on, F.col("from") == F.col("was"), F.col("at") >= F.col("upto") - F.col("n"), F.col("at") < F.col("upto")])
        found, small, more = _kept(hit.select(*keys, "total", "i", "r", (F.col("at") - F.col("upto") + F.col("n")).alias("at"), "lo", "hi", "n"))
    else:
        raise RuntimeError("a quantile is not found after eight passes")
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    picked = []
    for i, (name, p) in enumerate(probs.items()):
        mine = lambda x, i=i: F.when(F.col("i") == i, x)
        low, high = F.min(mine(F.col("lo"))), F.max(mine(F.col("lo")))
        where = F.max(spot(p))
        picked.append((low + (high - low) * (where - F.floor(where))).alias(name))
    out = every.groupBy(*keys).agg(*picked)
    return out.select(*[F.col(k).alias(b) for b, k in zip(by, keys, strict=True)], *probs)
