import json

import pytest

from tablewise.sources.delimited import clean_headers, header_index, read_delimited, sniff_separator, write_csv_safe, write_json
from tablewise.sources.markup import extract_html_tables, extract_markdown_tables, html_to_text
from tablewise.sources.nested import read_geojson, read_json, read_xml
from tablewise.sources.store import detect_delimited_text, flag_binary_text, load_dataset, load_many, save_dataset


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_delimited(spark, tmp_path):
    path = write(tmp_path / "sales.csv", "﻿Quarterly report,,,\n\nregion,revenue,,region\nNorth,10,,x\nregion,revenue,,region\n\"So, uth\",5,,y\nn/a,-,,\nNorth,7,,z\n")
    df = read_delimited(spark, path)
    assert df.columns == ["region", "revenue", "region_2"]
    assert [tuple(r) for r in df.collect()] == [("North", "10", "x"), ("So, uth", "5", "y"), ("North", "7", "z")]


def test_separators(spark, tmp_path):
    assert sniff_separator(["a;b;c", "1;2;3"]) == ";" and sniff_separator(["a|b"], "x.psv") == "|" and sniff_separator(["x"], "f.tsv") == "\t"
    tsv = read_delimited(spark, write(tmp_path / "t.tsv", "k\tv\n1\ta,b\n"))
    assert [tuple(r) for r in tsv.collect()] == [("1", "a,b")]
    assert clean_headers(["a", None, "a", " "]) == ["a", "column_2", "a_2", "column_4"]
    assert header_index([["Title", ""], ["name", "age"], ["x", "1"]]) == 1


def test_json_shapes(spark, tmp_path):
    path = write(tmp_path / "a.json", json.dumps([{"a": 1, "b": {"c": 2}, "t": ["x", "y"], "o": [{"p": 1}]}, {"a": 3}]))
    rows = read_json(spark, path)["rows"]
    assert rows.columns == ["a", "b.c", "o", "t"]
    assert [tuple(r) for r in rows.orderBy("a").collect()] == [(1, 2, '[{"p":1}]', "x, y"), (3, None, None, None)]
    lines = read_json(spark, write(tmp_path / "a.jsonl", '{"a": 1}\n{"a": 2}\n'))["rows"]
    assert lines.count() == 2
    two = read_json(spark, write(tmp_path / "b.json", json.dumps({"x": [{"a": 1}, {"a": 2}], "y": [{"b": 1}]})))
    assert sorted(two) == ["x", "y"] and two["x"].count() == 2
    geo = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"n": "p"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}
    assert [tuple(r) for r in read_geojson(spark, write(tmp_path / "g.geojson", json.dumps(geo))).collect()] == [("p",)]


def test_xml(spark, tmp_path):
    path = write(tmp_path / "r.xml", "<root><meta><v>1</v></meta>" + "".join(f'<row id="{i}"><a>x{i}</a><b><c>q</c><d>r</d></b></row>' for i in range(3)) + "</root>")
    df = read_xml(spark, path)
    assert sorted(df.columns) == ["@id", "a", "b"]
    assert [(r["@id"], r["a"], r["b"]) for r in df.orderBy("@id").collect()] == [(str(i), f"x{i}", "qr") for i in range(3)]


def test_markup(spark):
    html = "<p>Hi<script>x</script> <b>you</b></p><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table><table><tr><td>h</td></tr><tr><td>1</td></tr></table>"
    pages = spark.createDataFrame([(1, html)], "page_id int, html string")
    assert [(r["table_no"], r["row_no"], r["cells"]) for r in extract_html_tables(pages).orderBy("row_no").collect()] == [(1, 0, ["a", "b"]), (1, 1, ["1", "2"]), (1, 2, ["3", "4"])]
    assert html_to_text(pages).first()["text"].startswith("Hi you\n")
    docs = spark.createDataFrame([(1, "t\n| a | b |\n|---|---|\n| 1 | 2 |\n\n| c |\n| -- |\n| 9 |\n| 8 |\nend")], "doc_id int, text string")
    got = [(r["table_no"], r["row_no"], r["cells"]) for r in extract_markdown_tables(docs).orderBy("table_no", "row_no").collect()]
    assert got == [(1, 0, ["a", "b"]), (1, 1, ["1", "2"]), (2, 0, ["c"]), (2, 1, ["9"]), (2, 2, ["8"])]


def test_text_checks(spark):
    docs = spark.createDataFrame([(1, "a,b\n1,2\n3,4"), (2, "a,b\n1,2"), (3, "a;b\n1;2\n\n3;4\n5"), (4, "x\x00\x01y")], "doc_id int, text string")
    found = {r["doc_id"]: r["delimiter"] for r in detect_delimited_text(docs).collect()}
    assert found == {1: ",", 2: None, 3: None, 4: None}
    assert {r["doc_id"]: r["delimiter"] for r in detect_delimited_text(docs, max_lines=3).collect()}[3] == ";"
    assert {r["doc_id"]: r["binary"] for r in flag_binary_text(docs).collect()} == {1: False, 2: False, 3: False, 4: True}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "=cmd", None), (2, "x", 2.5)], "a int, b string, c double").selectExpr("*", "timestamp_ntz'2024-01-02 03:04:05' as t")
    write_csv_safe(df.coalesce(1), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*.csv")))
    assert text.splitlines() == ["a,b,c,t", "1,'=cmd,,2024-01-02 03:04:05", "2,x,2.5,2024-01-02 03:04:05"]
    write_json(df.drop("t").coalesce(1), str(tmp_path / "js"))
    assert json.loads(next((tmp_path / "js").glob("part-*")).read_text().splitlines()[0]) == {"a": 1, "b": "=cmd", "c": None}
    save_dataset(df, str(tmp_path), "u", "d")
    assert load_dataset(spark, str(tmp_path), "u", "d").count() == 2


def test_load_many(spark, tmp_path):
    good, bad = write(tmp_path / "g.csv", "a,b\n1,2\n"), write(tmp_path / "b.xyz", "?")
    tables, errors = load_many(spark, [good, bad, str(tmp_path / "none.csv")])
    assert list(tables) == ["g.csv"] and sorted(r["name"] for r in errors.collect()) == ["b.xyz", "none.csv"]


def test_delimited_loses_no_field(spark, tmp_path):
    late = "a,b\n" + "".join(f"{i},x\n" for i in range(80)) + "80,y,EXTRA\n" + '81,"two\nlines, ""quoted"""\n'
    df = read_delimited(spark, write(tmp_path / "late.csv", late))
    rows = {r["a"]: (r["b"], r["column_3"]) for r in df.collect()}
    assert len(rows) == 82 and rows["80"] == ("y", "EXTRA") and rows["81"] == ('two\nlines, "quoted"', None)
    wide = read_delimited(spark, write(tmp_path / "wide.csv", 'a,b,c\n1,"7\n8",5\n2,6\n3,"1\n","2\n","3\n","4\n",5\n'))
    assert {r["a"]: r[-1] for r in wide.collect()}["3"] == "5" and wide.count() == 3


def test_json_lines_under_any_name(spark, tmp_path):
    assert read_json(spark, write(tmp_path / "l.json", '{"a": 1}\n\n{"a": 2}\n{"a": 3}\n'))["rows"].count() == 3


def test_html_text_reads_references_attributes_and_hidden_parts(spark):
    html = ("<head><title>no</title></head><!-- <p>no --><p title=\"a > b\">A&amp;lt; &eacute;&#233;&#xE9;&#128;&#0;</p>x<SCRIPT>if (a<b) '</p>'</SCRIPT >y"
            "<br/>1 < 2 & 3 &nosuch; &amp<header>top</header>\u00a0\u3000 a\t b\n\n<template>no")
    rows = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<p" + " a='b'" * 50_000 + ">z" + "&amp;" * 50_000)], "page_id int, html string")
    found = {r.page_id: r.text for r in html_to_text(rows).collect()}
    assert found[1] == "A&lt; ééé€\ufffd\nxy\n1 < 2 & 3 &nosuch; &amp\ntop\na b"
    assert found[2] == found[3] == "" and found[4] == "z" + "&" * 50_000


def test_markdown_tables_inside_a_row(spark):
    """No lines are shuffled or windowed; copies of a doc number their lines together, loose dashes and lone headers open nothing."""
    table, loose = "x\n| f | v |\n|---|---|\n| s | 1 |\nend\n| g |\n| -- |", "| a |\n--\n| b |\n\n|---|---|"
    docs = spark.createDataFrame([(1, table), (2, table), (2, table), (3, loose), (4, None), (5, "| h |\n|:--|\n" + "| 1 |\n" * 20_000)], "doc_id int, text string")
    found = extract_markdown_tables(docs)
    got = sorted((r["doc_id"], r["table_no"], r["row_no"], r["cells"]) for r in found.where("doc_id < 5").collect())
    header, row = ["f", "v"], ["s", "1"]
    assert got == [(1, 1, 0, header), (1, 1, 1, row), (2, 1, 0, header), (2, 1, 1, header), (2, 1, 2, row), (2, 1, 3, row)]
    assert found.where("doc_id = 5").count() == 20_001 and "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
