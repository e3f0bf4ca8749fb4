"""Mixing sources to target token weights by entropy balancing, all in DataFrame functions.

The document rates closest to equal ones (in relative entropy) that meet each source's token target are exponentially tilted:
rate = exp(lambda * size / mean size), cut at the allowed repeats. lambda is found per source by Newton steps on the convex dual, kept
inside a shrinking bracket. The dual needs only the counts of (source, size) cells, so texts are read once to be counted and once to
be taken, and each Newton step runs over the cells. Rates become whole copies by systematic rounding along sizes; what rounding leaves
over is settled on the smallest documents. Sums are decimal, so that reruns agree whatever order the rows come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise.llm.shared import aside, bounded_broadcast, stash

WEIGHTS = (5, 2, 1)
MAX_STEPS, TOLERANCE = 80, 1e-10
CELL = 4096  # documents of a cell that are ranked together; larger cells are split by hash
SOURCE = ["_none", "_src"]
MADE = ["size", "source_size", "target", "copies"]


def _exact(c: Column) -> Column:
    return F.sum(c.cast("decimal(38,12)")).cast("double")


def targets(cells: DataFrame, share: float, repeats: float, weights: tuple[int, ...]) -> DataFrame:
    """Per source its size, its target and its mean size. Sources in code point order (null last) take the weights in turn; together
    they get share times all sizes. A target stops at repeats times its source's size; the excess goes to the others by weight."""
    s = cells.groupBy(*SOURCE).agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    every = Window.partitionBy()
    place = F.row_number().over(Window.partitionBy().orderBy(*SOURCE)) - 1
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights)) + 1)).withColumn("cap", F.col("source_size") * repeats)
    s = s.withColumn("ratio", F.col("cap") / F.col("w"))
    before = Window.partitionBy().orderBy("ratio", *SOURCE).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    s = s.withColumn("level", left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    # Sources under their cap all stand at one level: the first one, by ratio, that does not exceed its own.
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", *SOURCE, "level"))).over(every)["level"]
    return s.withColumn("target", F.least("cap", F.coalesce(level, F.lit(0.0)) * F.col("w"))).withColumn("mean", F.greatest(F.col("source_size") / F.col("docs"), F.lit(1e-9))).select(
        *SOURCE, "source_size", "target", "mean")


def solve(cells: DataFrame, wanted: DataFrame, repeats: float) -> DataFrame:
    """(source, lambda): Newton steps on the dual of all sources at once; one job over the cells for each step."""
    cap = F.log(F.lit(repeats))
    # All rates are at the cap from the smallest document's log(repeats) * mean on; they vanish far below zero.
    state = stash(wanted.withColumn("lam", F.lit(0.0)).withColumn("lo", F.lit(-1e9)).withColumn("hi", cap * F.col("mean")).withColumn("gap", F.lit(1.0)), "dual")
    for _ in range(MAX_STEPS):
        x = F.col("size") / F.col("mean")
        rate = F.exp(F.least(F.col("lam") * x, cap))
        slope = F.when(F.col("lam") * x < cap, F.col("n") * F.col("size") * x * rate).otherwise(F.lit(0.0))
        at = cells.join(bounded_broadcast(state), SOURCE).groupBy(*SOURCE).agg(_exact(F.col("n") * F.col("size") * rate).alias("mass"), _exact(slope).alias("slope"))
        over = F.col("mass") - F.col("target")
        step = F.col("lam") - over / F.col("slope")
        lo, hi = F.when(over > 0, F.col("lo")).otherwise(F.col("lam")), F.when(over > 0, F.col("lam")).otherwise(F.col("hi"))
        inside = F.coalesce((step > F.col("lo")) & (step < F.col("hi")), F.lit(False))
        gap = F.abs(over) / F.greatest("target", F.lit(1.0))
        held = F.least(F.col("target") / F.greatest(F.col("source_size").cast("double"), F.lit(1e-9)), F.lit(repeats)) >= repeats
        state = state.join(at, SOURCE).select(*SOURCE, "source_size", "target", "mean", lo.alias("lo"), hi.alias("hi"), F.when(held, 0.0).otherwise(gap).alias("gap"),
            F.when(held, cap * F.col("mean")).when(gap <= TOLERANCE, F.col("lam")).when(inside, step).otherwise((lo + hi) / 2).alias("lam"))
        state = stash(state, "dual")
        if (state.agg(F.max("gap")).first()[0] or 0.0) <= TOLERANCE:
            break
    return state.select(*SOURCE, "source_size", "target", "mean", "lam")


def mix_sources(docs: DataFrame, size: Column, share: float = 1.5, repeats: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """docs with size, source_size, target (its source's) and copies (0 to repeats); taken words are copies * size.

    docs needs doc_id and source; other columns pass through, columns that bear one of the new names are replaced. size: the words of a
    row (null counts as 0). Documents of size 0 are taken once. Repeated rows are documents of their own; which of several equal ones
    is copied is decided by a hash of doc_id, and between rows of one doc_id it does not matter. A null source is a source, last in
    order. An empty table gives an empty result. Reruns agree."""
    docs, back = aside(docs.withColumn("size", F.coalesce(size, F.lit(0)).cast("long")).drop(*MADE[1:]), {*SOURCE, "_part", "_parts", "base", "due"})
    docs = docs.withColumn("_none", F.col("source").isNull()).withColumn("_src", F.coalesce("source", F.lit("")))
    cells = stash(docs.groupBy(*SOURCE, "size").agg(F.count(F.lit(1)).alias("n")), "cells")
    dual = stash(solve(cells, stash(targets(cells, share, float(repeats), weights), "targets"), float(repeats)), "tilts")
    rate = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.log(F.lit(float(repeats))))))
    rated = cells.join(bounded_broadcast(dual), SOURCE).withColumn("rate", F.round(rate, 9)).withColumn("base", F.least(F.floor("rate"), F.lit(repeats)))
    # Systematic rounding: along a source's sizes, the running sum of the fractions is rounded; a cell gets the difference.
    along = Window.partitionBy(*SOURCE).orderBy(F.desc("size"))
    part = (F.col("n") * (F.col("rate") - F.col("base"))).cast("decimal(38,12)")
    rated = rated.withColumn("run", F.sum(part).over(along)).withColumn("extra", F.floor(F.col("run") + 0.5) - F.floor(F.col("run") - part + 0.5))
    # What that leaves of the target is added to, or taken from, the smallest documents.
    whole = Window.partitionBy(*SOURCE)
    rest = F.col("target") - F.sum((F.col("n") * F.col("base") + F.col("extra")) * F.col("size")).over(whole)
    rated = rated.withColumn("rest", rest)
    room = F.when(F.col("size") == 0, F.lit(0)).when(F.col("rest") < 0, F.col("extra")).when(F.col("base") < repeats, F.col("n") - F.col("extra")).otherwise(F.lit(0))
    rated = rated.withColumn("room", room.cast("long"))
    up = Window.partitionBy(*SOURCE).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.col("room") * F.col("size")).over(up), F.lit(0))
    more = F.greatest(F.lit(0), F.least(F.col("room"), F.floor((F.abs("rest") - used) / F.col("size") + 0.5)))
    rated = stash(rated.withColumn("m", (F.col("extra") + F.when(F.col("size") == 0, F.lit(0)).otherwise(F.signum("rest") * more)).cast("long")).select(
        *SOURCE, "size", "n", "base", "m", "source_size", "target"), "rated")
    # Cells are split by hash, so that no cell, however many copies it holds, is ranked in one task.
    key = [*SOURCE, "size"]
    big = rated.where(F.col("n") > CELL).select(*key, F.ceil(F.col("n") / CELL).alias("_parts"))
    if not big.isEmpty():
        docs = docs.join(bounded_broadcast(big), key, "left").withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.coalesce("_parts", F.lit(1)))).drop("_parts")
    else:
        docs = docs.withColumn("_part", F.lit(0).cast("long"))
    parts = docs.groupBy(*key, "_part").agg(F.count(F.lit(1)).alias("k"))
    upto = F.sum("k").over(Window.partitionBy(*key).orderBy("_part"))
    shared = parts.join(rated, key).withColumn("upto", upto)
    due = F.floor(F.col("m") * F.col("upto") / F.col("n")) - F.floor(F.col("m") * (F.col("upto") - F.col("k")) / F.col("n"))
    shared = shared.select(*key, "_part", "base", due.alias("due"), "source_size", "target")
    order = Window.partitionBy(*key, "_part").orderBy(F.xxhash64(F.col("doc_id"), F.lit("copies")), "doc_id")
    out = docs.join(shared, [*key, "_part"]).withColumn("copies", (F.col("base") + (F.row_number().over(order) <= F.col("due")).cast("long")).cast("long"))
    return out.select(*back, *MADE[1:])
