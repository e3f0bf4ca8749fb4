"""Sources and sinks (IO)."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import dirty, dirty_sql, load, query
from tablewise.session import scratch
from tablewise.sources.delimited import drop_blank, drop_repeated_headers, guarded, read_delimited, write_csv_safe, write_json
from tablewise.sources.markup import BLOCK_TAGS, HIDDEN_TAGS, extract_html_tables, extract_markdown_tables, html_to_text
from tablewise.sources.nested import flatten, flatten_json_strings, read_json, read_xml
from tablewise.sources.store import detect_delimited_text, flag_binary_text, load_dataset, load_many, save_dataset

EXPORT = {
    "key_text": "case when o_orderkey % 29 = 0 then 'key_text' when o_orderkey % 31 = 0 then 'N/A' else cast(o_orderkey as string) end",
    "status_text": "case when o_orderkey % 29 = 0 then 'status_text' when o_orderkey % 31 = 0 then ' - ' else o_orderstatus end",
    "empty_text": "case when o_orderkey % 29 = 0 then 'empty_text' else '' end",
}


NOTED = ("o_orderkey as order_key", "concat(o_orderpriority, ', ', o_orderstatus, chr(10), 'second \"line\"') as note", "o_orderstatus as status")


@query("io01_read_delimited", f"select cast(order_key as varchar) as order_key, note, status from (select {', '.join(NOTED)} from orders)")
def io01(spark, sf):
    path = f"{scratch(spark)}/orders.csv"
    write_csv_safe(load(spark, sf, "orders").selectExpr(*NOTED), path)
    return read_delimited(spark, path)


@query("io01_ragged_rows", """
    select cast(o_orderkey as varchar) as "k", o_orderstatus as "s", case when o_orderkey % 97 = 0 then cast(o_custkey as varchar) end as "column_3" from orders""")
def io01b(spark, sf):
    path = f"{scratch(spark)}/ragged.txt"
    lines = load(spark, sf, "orders").selectExpr("concat(o_orderkey, ';', o_orderstatus, case when o_orderkey % 97 = 0 then concat(';', o_custkey) else '' end) as value")
    lines.withColumnRenamed("value", "k;s").write.csv(path, header=True, sep="\u0001", quote="\u0000")
    return read_delimited(spark, path)


@query("io02_detect_header", """
    select cast(o_orderkey as varchar) as "order key", o_orderstatus as status, o_orderpriority as priority, cast(o_custkey as varchar) as customer from orders""")
def io02(spark, sf):
    """Every file begins with two lines that are no header: a title in one field, and a line of mostly empty fields."""
    path = f"{scratch(spark)}/titled.txt"
    rows = load(spark, sf, "orders").selectExpr("concat_ws(';', o_orderkey, o_orderstatus, o_orderpriority, o_custkey) as value").coalesce(1)
    head = spark.createDataFrame([("Orders of the year;;;",), (";;made by hand;",), ("order key;status;priority;customer",)], "value string").coalesce(1)
    head.union(rows).coalesce(1).write.text(path)
    return read_delimited(spark, path)


@query("io04_clean_headers", """
    select cast(o_orderkey as varchar) as k, o_orderstatus as column_2, o_orderpriority as k_2, cast(o_custkey as varchar) as note, o_orderstatus as k_3 from orders""")
def io04(spark, sf):
    """Blank and repeated names in the header."""
    path = f"{scratch(spark)}/named.csv"
    lines = load(spark, sf, "orders").selectExpr("concat_ws(',', o_orderkey, o_orderstatus, o_orderpriority, o_custkey, o_orderstatus) as value")
    lines.withColumnRenamed("value", "k,,k,note,k").write.csv(path, header=True, sep="\u0001", quote="\u0000")
    return read_delimited(spark, path)


@query("io03_drop_repeated_headers", """
    select cast(o_orderkey as varchar) as key_text, o_orderstatus as status_text from orders
    where o_orderkey % 29 <> 0 and o_orderkey % 31 <> 0""")
def io03(spark, sf):
    raw = load(spark, sf, "orders").selectExpr(*[f"{e} as {c}" for c, e in EXPORT.items()])
    return drop_blank(drop_repeated_headers(raw))


@query("io05_json_lines", "select event_id, cast(json_extract(props, '$.k') as bigint) as props_k from events")
def io05(spark, sf):
    return flatten_json_strings(load(spark, sf, "events"), "props", keep=["event_id"]).withColumnRenamed("props.k", "props_k")


@query("io05_read_json_content", "select o_orderkey as k, o_orderstatus as s from orders")
def io05b(spark, sf):
    path = f"{scratch(spark)}/orders.json"
    load(spark, sf, "orders").selectExpr("to_json(struct(o_orderkey as k, o_orderstatus as s)) as value").write.text(path)
    return read_json(spark, path)["rows"]


@query("io06_flatten", """
    select o_orderkey, o_orderstatus as detail_status, o_totalprice as detail_money_price,
           concat(o_orderstatus, ', ', o_orderpriority) as tags,
           concat('[{"p":"', o_orderpriority, '"}]') as parts from orders""")
def io06(spark, sf):
    nested = load(spark, sf, "orders").select(
        "o_orderkey",
        F.struct(F.col("o_orderstatus").alias("status"), F.struct(F.col("o_totalprice").alias("price")).alias("money")).alias("detail"),
        F.array("o_orderstatus", "o_orderpriority").alias("tags"),
        F.array(F.struct(F.col("o_orderpriority").alias("p"))).alias("parts"))
    flat = flatten(nested)
    return flat.toDF(*[c.replace(".", "_") for c in flat.columns])


ORDER_PAGE = ("concat('<html><body><p>Order</p><table><tr><th>field</th><th>value</th></tr><tr><td>status</td><td>', o_orderstatus, "
              "'</td></tr><tr><td> priority </td><td><b>', o_orderpriority, '</b></td></tr></table><table><tr><td>a</td></tr><tr><td>b</td></tr></table></body></html>')")


@query("sc05_arrays_and_json", """
    select o_orderkey, concat(o_orderstatus, '; ', o_orderpriority) as joined, cast(2 as integer) as size, upper(o_orderpriority) as second,
           concat('{"s":"', o_orderstatus, '","n":', o_custkey, '}') as json, o_custkey + 1 as n from orders""")
def sc05(spark, sf):
    """The array and JSON functions that flattening is made of."""
    tags = F.array("o_orderstatus", "o_orderpriority")
    text = F.to_json(F.struct(F.col("o_orderstatus").alias("s"), F.col("o_custkey").alias("n")))
    return load(spark, sf, "orders").select("o_orderkey", F.array_join(tags, "; ").alias("joined"), F.size(tags).alias("size"), F.get(F.transform(tags, F.upper), F.lit(1)).alias("second"), text.alias("json"),
                                            (F.from_json(text, "s string, n bigint")["n"] + 1).alias("n"))


@query("io07_read_geojson", "select o_orderkey as k, o_orderstatus as s, concat(o_orderstatus, ', ', o_orderpriority) as tags from orders")
def io07(spark, sf):
    """A FeatureCollection for each customer's orders; geometry is left out."""
    path = f"{scratch(spark)}/orders.geojson"
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(F.lit(1.0), F.lit(2.0)).alias("coordinates")).alias("geometry"),
                       F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.array("o_orderstatus", "o_orderpriority").alias("tags")).alias("properties"))
    files = load(spark, sf, "orders").groupBy("o_custkey").agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))).alias("value"))
    files.select("value").write.text(path)
    return read_json(spark, path, lines=True)["features"]


XML_ORDER = "concat('<order key=\"', o_orderkey, '\"\\n><status>', o_orderstatus, '</status><priority>', o_orderpriority, '</priority><who><cust>', o_custkey, '</cust></who><gift/></order>')"


XML_FILE = 500_000  # orders of one file


@query("io08_read_xml", "select cast(o_orderkey as varchar) as \"@key\", o_orderstatus as status, o_orderpriority as priority, cast(o_custkey as varchar) as who from orders")
def io08(spark, sf):
    """Files of a year's orders, whose rows begin after 2,500 lines of notes; start tags run over two lines."""
    path = f"{scratch(spark)}/orders.xml"
    notes = "array_join(transform(sequence(1, 2500), i -> concat('<note>', i, '</note>')), '\\n')"
    orders = load(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    files = -(-max([r["count"] for r in orders.groupBy("year").count().collect()], default=1) // XML_FILE)  # of a year
    dealt = orders.select("year", F.pmod(F.xxhash64("o_orderkey"), F.lit(files)).cast("int").alias("file"), F.lit(1).alias("part"), "o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey")
    ends = dealt.select("year", "file").distinct().select("year", "file", F.explode(F.array(F.lit(0), F.lit(2))).alias("part"))
    # A file is the rows of one task between its two ends: sorted by these short columns, and written as it comes.
    rows = dealt.unionByName(ends, allowMissingColumns=True).repartition("year", "file").sortWithinPartitions("year", "file", "part")
    value = f"""case part when 0 then concat('<?xml version=\"1.0\"?>\\n<!-- made > here --><export><head>', {notes}, '</head>\\n<orders>') when 1 then {XML_ORDER} else '</orders></export>' end"""
    rows.selectExpr("year", "file", f"{value} as value").where("value is not null").write.partitionBy("year", "file").text(path)
    return read_xml(spark, f"{path}/*/*").drop("gift")


@query("io09_html_tables", """
    select o_orderkey as page_id, 1 as table_no, 0 as row_no, 'field|value' as cells from orders
    union all select o_orderkey, 1, 1, concat('status|', o_orderstatus) from orders
    union all select o_orderkey, 1, 2, concat('priority|', o_orderpriority) from orders""")
def io09(spark, sf):
    pages = load(spark, sf, "orders").selectExpr("o_orderkey as page_id", f"{ORDER_PAGE} as html")
    return extract_html_tables(pages).select("page_id", "table_no", "row_no", F.array_join("cells", "|").alias("cells"))


@query("io10_markdown_tables", """
    select o_orderkey as doc_id, 1 as table_no, 0 as row_no, 'field/value' as cells from orders
    union all select o_orderkey, 1, 1, concat('status/', o_orderstatus) from orders
    union all select o_orderkey, 1, 2, concat('priority/', o_orderpriority) from orders""")
def io10(spark, sf):
    text = r"concat('Intro\n| loose | line |\n\n| field | value |\n|---|---|\n| status | ', o_orderstatus, ' |\n| priority | ', o_orderpriority, ' |\nend')"
    docs = load(spark, sf, "orders").selectExpr("o_orderkey as doc_id", f"{text} as text")
    return extract_markdown_tables(docs).select("doc_id", "table_no", "row_no", F.array_join("cells", "/").alias("cells"))


@query("io11_detect_delimited", r"""
    with lines as (select doc_id, list_filter(string_split(replace(text, chr(13), ''), chr(10)), lambda x: trim(x, ' ' || chr(9)) <> '') as l from documents
                   union all select -1 - o_orderkey, [concat('k;s;', o_orderstatus), concat(o_orderkey, ';1;2'), concat('9;8;', o_orderpriority)] from orders),
    c as (select doc_id, l, list_transform(l, lambda x: length(x) - length(replace(x, ',', ''))) as c1,
                 list_transform(l, lambda x: length(x) - length(replace(x, chr(9), ''))) as c2,
                 list_transform(l, lambda x: length(x) - length(replace(x, ';', ''))) as c3,
                 list_transform(l, lambda x: length(x) - length(replace(x, '|', ''))) as c4 from lines)
    select doc_id, cast(len(l) as integer) as lines,
           case when len(l) < 3 then null
                when list_min(c1) > 0 and list_min(c1) = list_max(c1) then ','
                when list_min(c2) > 0 and list_min(c2) = list_max(c2) then chr(9)
                when list_min(c3) > 0 and list_min(c3) = list_max(c3) then ';'
                when list_min(c4) > 0 and list_min(c4) = list_max(c4) then '|' end as delimiter from c""")
def io11(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "text")
    made = load(spark, sf, "orders").selectExpr(
        "-1 - o_orderkey as doc_id", r"concat('k;s;', o_orderstatus, '\n', o_orderkey, ';1;2\n\n', '9;8;', o_orderpriority) as text")
    return detect_delimited_text(docs.unionByName(made))


# DuckDB's engine has no back-references: each hidden element is spelled out.
HIDDEN_HTML = "|".join(["<!--.*?-->", *[rf"<{t}(?:[\s/][^>]*)?>.*?</{t}\s*>" for t in HIDDEN_TAGS]])
BLOCK_HTML = rf"</?(?:{'|'.join(sorted(BLOCK_TAGS))})(?:[\s/][^>]*)?>"


@query("io12_html_text", rf"""
    with v as (select page_id, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is){HIDDEN_HTML}', '', 'g'), '(?i){BLOCK_HTML}', chr(10), 'g'), '<[A-Za-z/!?][^>]*>', '', 'g') as t from pages),
    d as (select page_id, replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', chr(160)), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;', '&') as t from v)
    select page_id, trim(regexp_replace(regexp_replace(t, '[^\S\n]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) as text from d""")
def io12(spark, sf):
    return html_to_text(load(spark, sf, "pages"))


@query("io13_dataset_read", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders")
def io13(spark, sf):
    return load(spark, sf, "orders")


@query("io13_dataset_store", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders")
def io13b(spark, sf):
    """Saved under a user's name and loaded again."""
    base = scratch(spark)
    save_dataset(load(spark, sf, "orders"), base, "ann", "orders")
    return load_dataset(spark, base, "ann", "orders")


@query("io14_csv_guard", """
    select o_orderkey, case when o_orderkey % 13 = 0 then concat('''=', o_orderstatus) when o_orderkey % 13 = 1 then concat('''@', o_orderstatus)
        when o_orderkey % 13 = 2 then '-5' when o_orderkey % 13 = 3 then concat('''-', o_orderstatus) else o_orderstatus end as status from orders""")
def io14(spark, sf):
    risky = load(spark, sf, "orders").selectExpr("o_orderkey", """case o_orderkey % 13 when 0 then concat('=', o_orderstatus) when 1 then concat('@', o_orderstatus)
        when 2 then '-5' when 3 then concat('-', o_orderstatus) else o_orderstatus end as status""")
    return guarded(risky)


@query("io17_binary_text", r"""
    with t as (select doc_id, text from documents
               union all select -1 - o_orderkey, case when o_orderkey % 3 = 0 then concat(chr(1), chr(2), o_orderpriority, chr(65533)) else o_orderpriority end from orders),
    b as (select doc_id, text, length(regexp_replace(text, '[^\x00-\x08\x0B\x0E-\x1F\x{FFFD}]', '', 'g')) as bad_chars from t)
    select doc_id, cast(bad_chars as integer) as bad_chars, (round(coalesce(bad_chars / nullif(length(text), 0), 0), 6) + 0.0) as bad_share,
           coalesce(bad_chars / nullif(length(text), 0), 0) > 0.02 as "binary" from b""")
def io17(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "text")
    made = load(spark, sf, "orders").selectExpr(
        "-1 - o_orderkey as doc_id", "case when o_orderkey % 3 = 0 then concat(chr(1), chr(2), o_orderpriority, decode(unhex('EFBFBD'), 'UTF-8')) else o_orderpriority end as text")
    return flag_binary_text(docs.unionByName(made)).withColumn("bad_share", F.round("bad_share", 6))


@query("io15_write_json", "select o_orderkey, o_orderstatus, case when o_orderkey % 17 = 0 then null else o_totalprice end as price from orders")
def io15(spark, sf):
    path = f"{scratch(spark)}/orders.jsonl"
    write_json(load(spark, sf, "orders").selectExpr("o_orderkey", "o_orderstatus", "case when o_orderkey % 17 = 0 then null else o_totalprice end as price"), path)
    return read_json(spark, path)["rows"].select("o_orderkey", "o_orderstatus", "price")


@query("io16_load_many", """
    select 'events.csv' as name, count(*) as n from events union all select 'events.jsonl', count(*) from events union all select 'events.zip', 0""")
def io16(spark, sf):
    base = scratch(spark)
    events = load(spark, sf, "events").select("event_id", "event_type")
    write_csv_safe(events, f"{base}/events.csv")
    write_json(events, f"{base}/events.jsonl")
    tables, errors = load_many(spark, [f"{base}/events.csv", f"{base}/events.jsonl", f"{base}/events.zip"])
    counts = [df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name, df in tables.items()]
    return counts[0].union(counts[1]).union(errors.select("name", F.lit(0).cast("long")))
