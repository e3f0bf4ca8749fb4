"""Typing and parsing (TY), formats (SC)."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import dirty, load, query, r, rounded
from tablewise.functions.formats import compact, period_label, percent, thousands
from tablewise.functions.parsing import currency_symbol, date_order_votes, is_missing_token, parse_date, parse_number
from tablewise.functions.text import keep_plain, label_key, squish, title_case
from tablewise.operators.aggregate import rating_like
from tablewise.operators.infer import infer_schema, type_evidence, unit_of, value_counts
from tablewise.meta import meta_frame

TOKENS = ("''", "'NA'", "' n/a '", "'NULL'", "'None'", "'-'", "'?'", "'NaN'", "'#N/A'", "'nil'", "'Missing'", "'undefined'", "'#VALUE!'", "'#DIV/0!'")
TOKEN_CASE = "case o_orderkey % 20 " + " ".join(f"when {i} then {t}" for i, t in enumerate(TOKENS)) + " when 14 then null else o_orderstatus end"


@query("ty01_missing_token", "select o_orderkey, o_orderkey % 20 < 15 as missing from orders")
def ty01(spark, sf):
    return load(spark, sf, "orders").selectExpr("o_orderkey", f"{TOKEN_CASE} as v").select("o_orderkey", is_missing_token(F.col("v")).alias("missing"))


# The same price written eight ways; the last cannot be read.
PRICE_TEXT = """case o_orderkey % 8
    when 0 then concat('$', format_number(floor(o_totalprice), 0)) when 1 then concat('(', cast(cast(floor(o_totalprice) as bigint) as string), ')')
    when 2 then concat('AUD ', cast(cast(floor(o_totalprice) as bigint) as string)) when 3 then concat(cast(cast(floor(o_totalprice) as bigint) as string), '%')
    when 4 then concat(' -€', cast(cast(floor(o_totalprice) as bigint) as string), '.50 ') when 5 then concat(cast(cast(floor(o_totalprice) as bigint) as string), 'e2')
    when 6 then 'n/a' else concat(cast(cast(floor(o_totalprice) as bigint) as string), ' units') end"""


@query("ty02_parse_number", """
    select o_orderkey, case o_orderkey % 8 when 0 then floor(o_totalprice) when 1 then -floor(o_totalprice) when 2 then floor(o_totalprice)
        when 3 then floor(o_totalprice) when 4 then -(floor(o_totalprice) + 0.5) when 5 then floor(o_totalprice) * 100 end as number from orders""")
def ty02(spark, sf):
    return load(spark, sf, "orders").selectExpr("o_orderkey", f"{PRICE_TEXT} as v").select("o_orderkey", parse_number(F.col("v")).alias("number"))


@query("ty02_decimal_comma", "select o_orderkey, floor(o_totalprice) + 0.25 as number from orders")
def ty02b(spark, sf):
    text = "concat(translate(format_number(floor(o_totalprice), 0), ',', '.'), ',25') as v"
    return load(spark, sf, "orders").selectExpr("o_orderkey", text).select("o_orderkey", parse_number(F.col("v"), True).alias("number"))


DATE_TEXT = """case o_orderkey % 9
    when 0 then date_format(o_orderdate, 'dd/MM/yyyy') when 1 then date_format(o_orderdate, "yyyy-MM-dd'T'HH:mm:ss'Z'") when 2 then date_format(o_orderdate, 'd MMM yyyy')
    when 3 then date_format(o_orderdate, 'EEE, MMMM d, yyyy') when 4 then date_format(o_orderdate, 'MMM yyyy') when 5 then date_format(o_orderdate, 'yyyy-MM')
    when 6 then concat(year(o_orderdate), ' Q', quarter(o_orderdate)) when 7 then date_format(o_orderdate, 'yyyy/M/d h:mm a') else '31/02/2026' end"""


@query("ty03_parse_date", """
    select o_orderkey, cast(case o_orderkey % 9 when 4 then date_trunc('month', o_orderdate) when 5 then date_trunc('month', o_orderdate)
        when 6 then date_trunc('quarter', o_orderdate) when 8 then null else date_trunc('day', o_orderdate) end as date) as day from orders""")
def ty03(spark, sf):
    return load(spark, sf, "orders").selectExpr("o_orderkey", f"{DATE_TEXT} as v").select("o_orderkey", parse_date(F.col("v")).cast("date").alias("day"))


MESSY = {"amount": PRICE_TEXT, "placed": DATE_TEXT, "status": "case when o_orderkey % 23 = 0 then 'N/A' else o_orderstatus end"}


def messy(spark, sf):
    return load(spark, sf, "orders").selectExpr(*[f"{e} as {c}" for c, e in MESSY.items()])


@query("ty04_type_evidence", """
    select 'amount' as "column", count(*) as "rows", count_if(o_orderkey % 8 <> 6) as present, count_if(o_orderkey % 8 < 6) as number_ok, 0 as date_ok from orders
    union all select 'placed', count(*), count(*), 0, count_if(o_orderkey % 9 <> 8) from orders
    union all select 'status', count(*), count_if(o_orderkey % 23 <> 0), 0, 0 from orders""")
def ty04(spark, sf):
    return type_evidence(messy(spark, sf), list(MESSY)).select("column", "rows", "present", "number_ok", "date_ok")


@query("ty04_infer_schema", """
    select 'amount' as name, case when (select count_if(o_orderkey % 8 < 6) * 1.0 / count_if(o_orderkey % 8 <> 6) from orders) >= 0.9 then 'number' else 'id' end as type
    union all select 'placed', 'date' union all select 'status', 'category'""")
def ty04b(spark, sf):
    return meta_frame(spark, infer_schema(messy(spark, sf))).select("name", "type")


@query("ty04_distinct_values", """
    select 'status' as "column", count(distinct case when o_orderkey % 23 <> 0 then o_orderstatus end) as distinct_values from orders
    union all select 'priority', count(distinct o_orderpriority) from orders""")
def ty04c(spark, sf):
    df = load(spark, sf, "orders").selectExpr(f"{MESSY['status']} as status", "o_orderpriority as priority")
    return value_counts(df, ["status", "priority"]).groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values"))


@query("ty05_date_order", """
    select count_if(day(o_orderdate) > 12) as mdy_votes, count_if(month(o_orderdate) > 12) as dmy_votes from orders""")
def ty05(spark, sf):
    dmy, mdy = date_order_votes(F.date_format("o_orderdate", "MM/dd/yyyy"))
    return load(spark, sf, "orders").agg(F.count_if(mdy).alias("mdy_votes"), F.count_if(dmy).alias("dmy_votes"))


@query("ty06_unit", """
    select symbol, count(*) as n from (select case when o_orderkey % 8 = 0 then '$' when o_orderkey % 8 = 4 then '€' end as symbol from orders) group by symbol""")
def ty06(spark, sf):
    rows = load(spark, sf, "orders").selectExpr(f"{PRICE_TEXT} as v").select(currency_symbol(F.col("v")).alias("symbol"))
    return rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("ty07_scale_levels", """
    select 'q1' as name, 'Strongly disagree|Disagree|Neutral|Agree|Strongly agree' as levels, true as likert""")
def ty07(spark, sf):
    metas = infer_schema(dirty(spark, sf, "q1"))
    return meta_frame(spark, metas).select("name", F.array_join("order", "|").alias("levels"), "likert")


@query("ty08_rating_like", """
    select 'l_linenumber' as "column", min(l_linenumber) >= 0 and max(l_linenumber) <= 10 as rating_like from lineitem
    union all select 'l_quantity', count_if(l_quantity <> floor(l_quantity)) = 0 and min(l_quantity) >= 0 and max(l_quantity) <= 10 from lineitem
    union all select 'l_extendedprice', count_if(l_extendedprice <> floor(l_extendedprice)) = 0 and min(l_extendedprice) >= 0 and max(l_extendedprice) <= 10 from lineitem""")
def ty08(spark, sf):
    return rating_like(load(spark, sf, "lineitem"), ["l_linenumber", "l_quantity", "l_extendedprice"])


@query("sc01_string_functions", r"""
    select p_partkey, trim(regexp_replace(concat('  ', p_name, '   x '), '\s+', ' ', 'g')) as squished, lower(p_name) as low, upper(p_name) as up,
           regexp_replace(lower(p_type), '[^\p{L}\p{N}]+', '', 'g') as label, regexp_replace(concat(p_brand, '!(', p_type, ')'), '[^\p{L}\p{N}\s.\-]', '', 'g') as plain from part""")
def sc01(spark, sf):
    p = load(spark, sf, "part")
    return p.select("p_partkey", squish(F.concat(F.lit("  "), "p_name", F.lit("   x "))).alias("squished"), F.lower("p_name").alias("low"), F.upper("p_name").alias("up"),
                    label_key(F.col("p_type")).alias("label"), keep_plain(F.concat("p_brand", F.lit("!("), "p_type", F.lit(")"))).alias("plain"))


@query("sc02_period_labels", """
    select o_orderkey, cast(year(o_orderdate) as varchar) as y, concat(year(o_orderdate), ' Q', quarter(o_orderdate)) as q,
           strftime(o_orderdate, '%b %Y') as m, concat(day(o_orderdate), ' ', strftime(o_orderdate, '%b %Y')) as d from orders""")
def sc02(spark, sf):
    c = F.col("o_orderdate")
    return load(spark, sf, "orders").select("o_orderkey", *[period_label(c, g).alias(g[0]) for g in ("year", "quarter", "month", "day")])


@query("sc03_compact_numbers", """
    with v as (select p_partkey, floor(p_retailprice) * power(10, p_partkey % 8) as x from part)
    select p_partkey, case when x >= 1e10 then concat(printf('%.1f', x / 1e9), 'B') when x >= 1e9 then concat(printf('%.2f', x / 1e9), 'B')
        when x >= 1e7 then concat(printf('%.1f', x / 1e6), 'M') when x >= 1e6 then concat(printf('%.2f', x / 1e6), 'M')
        when x >= 1e5 then concat(printf('%.0f', x / 1e3), 'K') when x >= 1e4 then concat(printf('%.1f', x / 1e3), 'K')
        else format('{:,}', cast(x as bigint)) end as compact from v""")
def sc03(spark, sf):
    x = F.floor("p_retailprice").cast("double") * F.pow(F.lit(10.0), F.col("p_partkey") % 8)
    return load(spark, sf, "part").select("p_partkey", compact(x).alias("compact"))


@query("sc04_math", f"""
    select l_orderkey, l_linenumber, {r('ln(l_extendedprice)')} as log_price, {r('sqrt(l_quantity)')} as root, {r('abs(l_discount - 0.05)')} as gap,
           floor(l_extendedprice * 10 + 0.5) / 10 as half_up from lineitem""")
def sc04(spark, sf):
    from tablewise.functions.parsing import js_round

    rows = load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.log("l_extendedprice").alias("log_price"), F.sqrt("l_quantity").alias("root"),
        F.abs(F.col("l_discount") - 0.05).alias("gap"), js_round(F.col("l_extendedprice"), 1).alias("half_up"))
    return rounded(rows)
