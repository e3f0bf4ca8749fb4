"""Joining tables and finding which columns relate them."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.functions.parsing import number_text
from tablewise.meta import is_numeric, is_string


def _key(df: DataFrame, col: str, numeric_both: bool) -> Column:
    c = df[col]
    if numeric_both or is_string(df, col):
        return c
    return number_text(c) if is_numeric(df, col) else c.cast("string")


def hot_keys(df: DataFrame, key: Column, share: float) -> list:
    """Keys that hold at least ``share`` of all rows: never more than 1/share of them."""
    counts = df.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t")).scalar()
    return [r["k"] for r in counts.where(F.col("k").isNotNull() & (F.col("n") >= total * share)).select("k").collect()]


def join_tables(a: DataFrame, b: DataFrame, col_a: str, col_b: str, how: str = "left", b_name: str = "b",
                salt_share: float | None = None, salts: int = 64) -> DataFrame:
    """Inner or left join on the text form of the key (numeric when both are); the right key is dropped.

    AQE splits a skewed sort-merge partition on its own.  With ``salt_share`` the hot keys are also spread over
    ``salts`` sub-keys, which helps when one key outgrows what run-time splitting can balance.
    """
    if how not in ("inner", "left"):
        raise ValueError("Only inner and left joins are offered")
    both = is_numeric(a, col_a) and is_numeric(b, col_b)
    left = a.select(*a.columns, _key(a, col_a, both).alias("__ka"))
    keep_b = [c for c in b.columns if c != col_b]
    names = {c: (f"{c}_{b_name}" if c in a.columns else c) for c in keep_b}
    right = b.select(_key(b, col_b, both).alias("__kb"), *[F.col(c).alias(names[c]) for c in keep_b]).where(F.col("__kb").isNotNull())
    on = F.col("__ka") == F.col("__kb")
    hot = hot_keys(a, _key(a, col_a, both), salt_share) if salt_share else []
    if hot:
        is_hot = lambda c: F.coalesce(c.isin(*hot), F.lit(False))
        # The salt is a hash of the row and its place, so equal rows spread and a recomputed task salts the same way.
        place = F.xxhash64(*a.columns, F.monotonically_increasing_id())
        left = left.withColumn("__salt", F.when(is_hot(F.col("__ka")), F.pmod(place, F.lit(salts))).otherwise(0))
        copies = F.when(is_hot(F.col("__kb")), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
        right = right.withColumn("__salt_b", F.explode(copies))
        on = on & (F.col("__salt") == F.col("__salt_b"))
    out = left.join(right, on, how)
    return out.select(*a.columns, *names.values())


def normalise_name(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def candidate_pairs(tables: dict[str, DataFrame], types: dict[str, dict[str, str]] | None = None,
                    normalise: Callable[[str], str] = normalise_name) -> list[tuple[str, str, str, str]]:
    """Column pairs whose names say they may relate: equal names, or ``xid`` in the first against ``x`` in the second."""
    usable = ("id", "category", "number")

    def kind(t, c):
        if types and t in types and c in types[t]:
            return types[t][c]
        return "category" if is_string(tables[t], c) else "number" if is_numeric(tables[t], c) else "date"

    names = list(tables)
    pairs = []
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            for ca in tables[a].columns:
                for cb in tables[b].columns:
                    na, nb = normalise(ca), normalise(cb)
                    named = na == nb or (na.endswith("id") and nb == na[:-2])
                    if named and kind(a, ca) in usable and kind(b, cb) in usable:
                        pairs.append((a, ca, b, cb))
    return pairs


RELATION_SCHEMA = "table_a string, column_a string, table_b string, column_b string, overlap double, kind string"


SKETCH = 14  # a sketch holds up to 2 ** 14 distinct hashes; up to that number its counts are exact
SURE = 5.0  # standard deviations by which a sketched overlap must lie under the minimum to be left unchecked


def _text(df: DataFrame, c: str) -> Column:
    return number_text(F.col(f"`{c}`")) if is_numeric(df, c) else F.col(f"`{c}`").cast("string")


def key_sketches(tables: dict[str, DataFrame], pairs: list[tuple[str, str, str, str]]) -> dict[tuple[str, str], tuple[int, bytes]]:
    """Rows and a theta sketch of the distinct values of every column that a pair names: one aggregate, so one pass, a table."""
    named: dict[str, list[str]] = {}
    for a, ca, b, cb in pairs:
        for t, c in ((a, ca), (b, cb)):
            if c not in named.setdefault(t, []):
                named[t].append(c)
    out = {}
    for t, cols in named.items():
        hashed = tables[t].select(*[F.when(_text(tables[t], c).isNotNull(), F.xxhash64(_text(tables[t], c))).alias(f"c{i}") for i, c in enumerate(cols)])
        row = hashed.agg(F.count(F.lit(1)).alias("rows"), *[F.theta_sketch_agg(f"c{i}", SKETCH).alias(f"s{i}") for i in range(len(cols))]).first()
        out |= {(t, c): (row["rows"], bytes(row[f"s{i}"])) for i, c in enumerate(cols)}
    return out


def _sketched_overlaps(spark, pairs: list, sketches: dict) -> list:
    """Per pair the estimated numbers of distinct values of either side and of both; local rows, so no job reads a table."""
    rows = [(i, bytearray(sketches[a, ca][1]), bytearray(sketches[b, cb][1])) for i, (a, ca, b, cb) in enumerate(pairs)]
    est = F.theta_sketch_estimate
    frame = spark.createDataFrame(rows, "i int, a binary, b binary").select("i", est("a").alias("da"), est("b").alias("db"), est(F.theta_intersection("a", "b")).alias("both"))
    return sorted(frame.collect())


def find_relationships(tables: dict[str, DataFrame], types=None, normalise=normalise_name, minimum: float = 0.3) -> DataFrame:
    """Overlap of distinct keys for every candidate pair, with the kind of relationship.

    Whole tables may be given: one pass a table sketches all columns that may relate to another table's. Pairs whose overlap lies under the
    minimum beyond doubt go; those whose sketches hold every value are settled, and the others are counted exactly, so whatever is
    reported is exact."""
    spark = next(iter(tables.values())).sparkSession
    pairs = candidate_pairs(tables, types, normalise)
    if not pairs:
        return spark.createDataFrame([], RELATION_SCHEMA)
    sketches = key_sketches(tables, pairs)
    settled, frames = [], []
    for (a, ca, b, cb), row in zip(pairs, _sketched_overlaps(spark, pairs, sketches), strict=True):
        da, db, both = row["da"], row["db"], row["both"]
        if not da or not db:
            continue
        if max(da, db) <= 1 << SKETCH:
            settled.append((a, ca, b, cb, both / min(da, db), da / sketches[a, ca][0], db / sketches[b, cb][0]))
            continue
        # The values of the smaller side that both sketches could hold are a sample of it of about this size.
        sample = min(da, db) * min(1.0, (1 << SKETCH) / max(da, db))
        share = both / min(da, db)
        doubt = SURE * math.sqrt(max(share * (1 - share), 1 / sample) / sample) if sample >= 1 else 1.0
        if share + doubt >= minimum:
            frames.append(_counted_overlap(tables, a, ca, b, cb))
    out = spark.createDataFrame(settled, "table_a string, column_a string, table_b string, column_b string, overlap double, ua double, ub double")
    for f in frames:
        out = out.unionByName(f)
    return out.where(F.col("overlap") >= minimum).select("table_a", "column_a", "table_b", "column_b", "overlap", relationship_kind(F.col("ua"), F.col("ub")).alias("kind")).orderBy(
        F.col("overlap").desc(), "table_a", "column_a", "table_b", "column_b")


def _counted_overlap(tables: dict[str, DataFrame], a: str, ca: str, b: str, cb: str) -> DataFrame:
    """The exact counts of one pair: rows per value and side, then everything the pair needs in a single aggregate."""
    side = lambda t, c: tables[t].select(_text(tables[t], c).alias("v"), F.lit(t == a).alias("left"))
    per = side(a, ca).unionByName(side(b, cb)).groupBy("v").agg(F.count_if("left").alias("na"), F.count_if(~F.col("left")).alias("nb"))
    known, here, there = F.col("v").isNotNull(), F.col("na") > 0, F.col("nb") > 0
    facts = per.agg(F.count_if(known & here).alias("da"), F.count_if(known & there).alias("db"), F.count_if(known & here & there).alias("both"), F.sum("na").alias("ra"), F.sum("nb").alias("rb"))
    return facts.select(F.lit(a).alias("table_a"), F.lit(ca).alias("column_a"), F.lit(b).alias("table_b"), F.lit(cb).alias("column_b"),
                        F.try_divide("both", F.least("da", "db")).alias("overlap"), F.try_divide("da", "ra").alias("ua"), F.try_divide("db", "rb").alias("ub"))


def relationship_kind(unique_a: Column, unique_b: Column) -> Column:
    return (
        F.when((unique_a > 0.95) & (unique_b < 0.95), "one-to-many")
        .when((unique_b > 0.95) & (unique_a < 0.95), "many-to-one")
        .when((unique_a > 0.95) & (unique_b > 0.95), "one-to-one")
        .otherwise("many-to-many")
    )
