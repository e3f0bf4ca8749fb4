"""Evidence cube: what shares, group tests, associations and unusual cells are read from, counted in one scan.

One Expand writes each row once per grouping set (the whole, every dimension, every asked pair of dimensions), and one partial aggregate
keeps rows, the measure's count, mean and squared deviations, and the hits of an outcome per cell. Dimensions of few levels give a few
thousand cells, whatever the rows."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.operators.scalars import numeric

CELL = ("rows", "n", "mean", "m2", "total", "known", "hits")


def evidence_cube(df: DataFrame, dims: list[str], measure: str | None = None, hit: Column | None = None, pairs: Iterable[tuple[str, str]] | None = None) -> DataFrame:
    """(dim_a, dim_b, a, b, rows, n, mean, m2, total, known, hits): dim_a and dim_b are null in the row of the whole, dim_b in rows of one
    dimension. rows counts rows, n, mean, m2 and total describe the measure, known and hits count rows where ``hit`` is known and true.
    Rows with a null in a set's dimension are not in it. All pairs are taken unless ``pairs`` names some."""
    pairs = list(combinations(dims, 2)) if pairs is None else list(pairs)
    v = numeric(F.col(f"`{measure}`")) if measure else F.lit(None).cast("double")
    levels = [f"l{i}" for i in range(len(dims))]
    rows = df.select(*[F.col(f"`{d}`").cast("string").alias(x) for d, x in zip(dims, levels, strict=True)], v.alias("v"), (hit.cast("int") if hit is not None else F.lit(None).cast("int")).alias("hit"))
    place = dict(zip(dims, levels, strict=True))
    sets = [[], *[[x] for x in levels], *[[place[a], place[b]] for a, b in pairs]]
    facts = [F.count(F.lit(1)).alias("rows"), F.count("v").alias("n"), F.avg("v").alias("mean"), (F.var_pop("v") * F.count("v")).alias("m2"), F.sum("v").alias("total"), F.count("hit").alias("known"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits")]
    if not dims:
        return rows.agg(*facts).select(*[F.lit(None).cast("string").alias(c) for c in ("dim_a", "dim_b", "a", "b")], *CELL)
    # Bit i from the left of the grouping id is 1 where a set leaves dimension i out.
    code = lambda s: sum(1 << (len(levels) - 1 - i) for i, x in enumerate(levels) if x not in s)
    told = {code([]): (None, None)} | {code([place[d]]): (d, None) for d in dims} | {code([place[a], place[b]]): (a, b) for a, b in pairs}
    cells = rows.groupingSets([[F.col(x) for x in s] for s in sets], *[F.col(x) for x in levels]).agg(F.grouping_id().alias("set"), *facts)
    named, level = [], []
    for side in (0, 1):
        name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
        for at, dim in ((k, d[side]) for k, d in told.items() if d[side]):
            name, value = F.when(F.col("set") == at, F.lit(dim)).otherwise(name), F.when(F.col("set") == at, F.col(place[dim])).otherwise(value)
        named.append(name)
        level.append(value)
    out = cells.select(named[0].alias("dim_a"), named[1].alias("dim_b"), level[0].alias("a"), level[1].alias("b"), *CELL)
    return out.where((F.col("dim_a").isNull() | F.col("a").isNotNull()) & (F.col("dim_b").isNull() | F.col("b").isNotNull()))


@dataclass
class Evidence:
    """The cells of a cube of few levels, on the driver, and what is read off them."""

    whole: dict = field(default_factory=dict)
    single: dict[str, dict[str, dict]] = field(default_factory=dict)
    pair: dict[tuple[str, str], dict[tuple[str, str], dict]] = field(default_factory=dict)

    @classmethod
    def of(cls, cube: DataFrame) -> Evidence:
        out = cls()
        for row in cube.collect():
            cell = {k: row[k] for k in CELL}
            if row["dim_b"] is not None:
                out.pair.setdefault((row["dim_a"], row["dim_b"]), {})[row["a"], row["b"]] = cell
            elif row["dim_a"] is not None:
                out.single.setdefault(row["dim_a"], {})[row["a"]] = cell
            else:
                out.whole = cell
        return out

    def leading_share(self, dim: str, measured: bool) -> dict:
        """Largest group, its share and how many times an even share that is."""
        values = {level: (c["total"] or 0.0) if measured else float(c["rows"]) for level, c in self.single.get(dim, {}).items()}
        if not values:
            return {"groups": 0, "share": None}
        level = min(values, key=lambda x: (-values[x], x))
        total = math.fsum(values.values())
        share = values[level] / total if total else None
        return {"level": level, "value": values[level], "share": share, "groups": len(values), "times_even": None if share is None else share * len(values)}

    def anova(self, dim: str) -> dict | None:
        """F, its degrees of freedom and eta squared over the groups with at least two values."""
        groups = [c for c in self.single.get(dim, {}).values() if c["n"] >= 2]
        if len(groups) < 2:
            return None
        n = sum(c["n"] for c in groups)
        grand = math.fsum(c["n"] * c["mean"] for c in groups) / n
        between = math.fsum(c["n"] * (c["mean"] - grand) ** 2 for c in groups)
        within = math.fsum(c["m2"] for c in groups)
        d1, d2 = len(groups) - 1, n - len(groups)
        return {"df1": d1, "df2": d2, "f": between / d1 / (within / d2) if within and d2 else None, "eta2": between / (between + within) if between + within else None}

    def chi_square(self, a: str, b: str) -> dict:
        """Chi-square of two dimensions over all their levels, empty cells included."""
        cells = {k: c["rows"] for k, c in self.pair.get((a, b), {}).items()}
        rows, cols = Counter(), Counter()
        for (x, y), n in cells.items():
            rows[x] += n
            cols[y] += n
        n = sum(cells.values())
        df = (len(rows) - 1) * (len(cols) - 1)
        if not n:
            return {"n": 0, "df": 0, "chi2": None, "cramers_v": None}
        chi2 = math.fsum((cells.get((x, y), 0) - rows[x] * cols[y] / n) ** 2 / (rows[x] * cols[y] / n) for x in rows for y in cols)
        return {"n": n, "df": df, "chi2": chi2, "cramers_v": math.sqrt(chi2 / (n * max(1, min(len(rows), len(cols)) - 1)))}

    def unusual_cell(self, dims: list[str], minimum: int = 20) -> dict | None:
        """The cell of any pair whose hit rate lies furthest above the overall one."""
        overall = self.whole["hits"] / self.whole["known"] if self.whole["known"] else 0.0
        best = None
        for a, b in combinations(dims, 2):
            for (x, y), c in self.pair.get((a, b), {}).items():
                spread = math.sqrt(overall * (1 - overall) / c["known"]) if c["known"] >= minimum else 0.0
                if spread:
                    z = (c["hits"] / c["known"] - overall) / spread
                    if best is None or (-z, a, b, x, y) < (-best["z"], best["dim_a"], best["dim_b"], best["a"], best["b"]):
                        best = {"dim_a": a, "dim_b": b, "a": x, "b": y, "rate": c["hits"] / c["known"], "z": z}
        return best
