"""Results that used to depend on size or kind of a column."""

from pyspark.sql import functions as F

from tablewise.operators import aggregate
from tablewise.operators.aggregate import AggSpec
from tablewise.operators.joins import join_tables
from tablewise.operators.pivots import chart_series, duplicate_count
from tablewise.operators.text import key_sentences
from tablewise.sources.nested import flatten_json_strings

SF = "/root/testdata/sf0.001"


def test_global_median_equals_percentile(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    want = lines.agg(F.sum("l_quantity").cast("double").alias("s"), F.percentile("l_quantity", 0.5).alias("m")).first()
    both = aggregate._groups(lines, AggSpec(by=(), metrics=(("l_quantity", "sum"), ("l_quantity", "median"))))
    assert both.columns == ["sum_l_quantity", "median_l_quantity"] and tuple(both.first()) == tuple(want)
    only = aggregate._groups(lines, AggSpec(by=(), metrics=(("l_quantity", "median"),)))
    assert only.first()[0] == want["m"]


def test_chart_series_keeps_every_month(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    months = orders.select(F.date_trunc("month", "o_orderdate")).distinct().count()
    assert chart_series(orders, "o_orderdate", "o_orderstatus", grain="month").select("o_orderdate").distinct().count() == months > 15


def test_salt_splits_equal_rows(spark):
    left, right = spark.range(1000).select(F.lit(1).alias("k")), spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert join_tables(left, right, "k", "k", salt_share=0.1).count() == 1000


def test_json_keys_that_look_like_types(spark):
    rows = spark.createDataFrame([('{"VOIDED": null, "a": 1, "OBJECT": {"b": null}}',)], "j string")
    assert set(flatten_json_strings(rows, "j").columns) == {"j.VOIDED", "j.a", "j.OBJECT.b"} or any("VOIDED" in c for c in flatten_json_strings(rows, "j").columns)


def test_duplicate_count_tells_nulls_and_nested_values_apart(spark):
    rows = spark.createDataFrame([(None, "a", [1]), ("a", None, [1]), ("a", None, [1]), ("a", "a", [None, 1]), ("a", "a", [1, None]), (None, None, None)], "x string, y string, z array<int>")
    assert duplicate_count(rows).first().asDict() == {"rows": 6, "distinct_rows": 5, "duplicates": 1}
    assert duplicate_count(rows, ["x"]).first()["distinct_rows"] == 2
    assert duplicate_count(rows.where("false")).first().asDict() == {"rows": 0, "distinct_rows": 0, "duplicates": 0}


def test_key_sentences_of_odd_documents(spark):
    long = "Lamp lamp table. " + "word " * 30_000 + "end. " + "Table lamp! " * 3_000
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "12 34. 56 78."), (4, "Lamp the lamp. Chair of wood. Lamp and chair."), (5, long), (None, "Lamp the lamp.")], "doc_id int, text string")
    found = key_sentences(docs, 2).collect()
    assert {r.doc_id for r in found} == {3, 4, 5, None}
    four = sorted((r["rank"], r.position, round(r.score, 4)) for r in found if r.doc_id == 4)
    assert four == [(1, 0, round(6 / 3 / 3 ** 0.5, 4)), (2, 2, round(5 / 3 / 3 ** 0.5, 4))]
    assert [r.score for r in found if r.doc_id == 3] == [0.0, 0.0]
    assert key_sentences(docs, 2, max_chars=15).where("doc_id = 5").first()["sentence"] == "Table lamp!"
