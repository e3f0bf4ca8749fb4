"""Relationships by sketches against counted sets, with sketches too small for the keys."""

import pytest
from pyspark.sql import functions as F

from tablewise.operators import joins
from tablewise.operators.joins import find_relationships


@pytest.mark.parametrize("sketch", [14, 5])
def test_reported_overlaps_are_exact(spark, monkeypatch, sketch):
    monkeypatch.setattr(joins, "SKETCH", sketch)
    a = spark.range(600).select((F.col("id") % 300).alias("k"), F.col("id").alias("serial"), F.lit(None).cast("string").alias("none"), (F.col("id") * 2).alias("even"), F.when(F.col("id") % 3 == 0, "x").alias("mark"))
    b = spark.range(400).select((F.col("id") + 150).alias("k"), F.col("id").cast("string").alias("serial"), F.lit("z").alias("none"), (F.col("id") * 2 + 1).alias("even"), F.lit("x").alias("mark"))
    got = {(r.column_a, r.column_b): (r.overlap, r.kind) for r in find_relationships({"a": a, "b": b}).collect()}
    assert got == {("k", "k"): (0.5, "many-to-one"), ("serial", "serial"): (1.0, "one-to-one"), ("mark", "mark"): (1.0, "many-to-many")}
    assert find_relationships({"a": a.select("k"), "b": b.select("serial")}).count() == 0
