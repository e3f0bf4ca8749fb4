"""Cleaning steps (CL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import LIKERT, dirty, dirty_sql, gappy, gappy_sql, load, query, r, rounded
from tablewise.meta import ColumnMeta
from tablewise.operators import clean
from tablewise.plans.steps import Step, apply_steps, auto_clean, changed_values, lineage_table, preview_step

KV = ("o_orderkey", "price")


def half_up(expr):
    return f"(floor(({expr}) * 100 + 0.5) / 100)"


@query("cl01_fill_mean", f"select o_orderkey, coalesce(price, {half_up(f'select avg(price) from {dirty_sql()}')}) as price from {dirty_sql()}")
def cl01(spark, sf):
    return clean.fill_missing(dirty(spark, sf, *KV), "price", "mean")


@query("cl02_fill_median", f"select o_orderkey, coalesce(price, {half_up(f'select median(price) from {dirty_sql()}')}) as price from {dirty_sql()}")
def cl02(spark, sf):
    return clean.fill_missing(dirty(spark, sf, *KV), "price", "median")


@query("cl03_fill_mode", f"""
    select o_orderkey, coalesce(status, (select status from {dirty_sql()} where status is not null group by 1 order by count(*) desc, 1 limit 1)) as status from {dirty_sql()}""")
def cl03(spark, sf):
    return clean.fill_missing(dirty(spark, sf, "o_orderkey", "status"), "status", "mode")


@query("cl04_fill_value", f"select o_orderkey, coalesce(price, 1234.5) as price from {dirty_sql()}")
def cl04(spark, sf):
    return clean.fill_missing(dirty(spark, sf, *KV), "price", "value", "$1,234.50")


def _fill_sql(method, part=""):
    over = f"over ({part} order by ts, event_id rows between"
    if method == "ffill":
        return f"last_value(value ignore nulls) {over} unbounded preceding and current row)"
    return f"first_value(value ignore nulls) {over} current row and unbounded following)"


@query("cl05_ffill", f"select event_id, {_fill_sql('ffill')} as value from {gappy_sql()}")
def cl05(spark, sf):
    return clean.fill_missing(gappy(spark, sf), "value", "ffill", order_by=["ts", "event_id"]).select("event_id", "value")


@query("cl05_ffill_by_group", f"select event_id, {_fill_sql('ffill', 'partition by event_type')} as value from {gappy_sql()}")
def cl05b(spark, sf):
    return clean.fill_missing(gappy(spark, sf), "value", "ffill", order_by=["ts", "event_id"], partition_by=["event_type"]).select("event_id", "value")


@query("cl05_ffill_ranges", f"select event_id, {_fill_sql('ffill')} as value from {gappy_sql()}")
def cl05c(spark, sf):
    """The many-range plan that large tables take, forced on the test data."""
    from tablewise.operators.ordered import fill_forward

    return fill_forward(gappy(spark, sf), "value", ["ts", "event_id"], ranges=8).select("event_id", "value")


@query("cl06_bfill", f"select event_id, {_fill_sql('bfill')} as value from {gappy_sql()}")
def cl06(spark, sf):
    return clean.fill_missing(gappy(spark, sf), "value", "bfill", order_by=["ts", "event_id"]).select("event_id", "value")


@query("cl07_interpolate", f"""
    with p as (select *, row_number() over (order by ts, event_id) as i from {gappy_sql()}),
    n as (select *, last_value(case when value is not null then i end ignore nulls) over (order by i rows between unbounded preceding and current row) as i0,
                    last_value(value ignore nulls) over (order by i rows between unbounded preceding and current row) as v0,
                    first_value(case when value is not null then i end ignore nulls) over (order by i rows between current row and unbounded following) as i1,
                    first_value(value ignore nulls) over (order by i rows between current row and unbounded following) as v1 from p)
    select event_id, {r('case when value is not null then value when v0 is not null and v1 is not null then v0 + (v1 - v0) * (i - i0) / (i1 - i0) else coalesce(v0, v1) end')} as value from n""")
def cl07(spark, sf):
    from tablewise.operators.ordered import interpolate

    return rounded(interpolate(gappy(spark, sf), "value", ["ts", "event_id"]).select("event_id", "value"))


@query("cl08_drop_missing", f"select o_orderkey, price, status from {dirty_sql()} where price is not null and status is not null")
def cl08(spark, sf):
    return clean.drop_missing(dirty(spark, sf, "o_orderkey", "price", "status"))


@query("cl09_drop_duplicates_first", """
    select l_orderkey, l_linenumber, l_partkey, l_extendedprice from (select *, row_number() over (partition by l_orderkey, l_linenumber
        order by l_shipdate, l_partkey, l_suppkey, l_extendedprice) as rn from lineitem) where rn = 1""")
def cl09(spark, sf):
    kept = clean.drop_duplicates(load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], order_by=["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"])
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("cl09_drop_duplicate_rows", "select distinct p_brand, p_type, p_size from part")
def cl09b(spark, sf):
    return clean.drop_duplicates(load(spark, sf, "part").select("p_brand", "p_type", "p_size"))


@query("cl10_drop_near_duplicates", f"""
    select o_orderkey, priority from (select *, row_number() over (partition by regexp_replace(lower(priority), '[^\\p{{L}}\\p{{N}}]+', '', 'g') order by o_orderkey) as rn from {dirty_sql()}) where rn = 1""")
def cl10(spark, sf):
    return clean.drop_duplicates(dirty(spark, sf, "o_orderkey", "priority"), ["priority"], fuzzy=True, order_by=["o_orderkey"])


@query("cl11_convert_number", """
    select o_orderkey, case when o_orderkey % 5 = 0 then null else floor(o_totalprice) end as amount from orders""")
def cl11(spark, sf):
    text = "case when o_orderkey % 5 = 0 then 'unknown' else concat('$', cast(cast(floor(o_totalprice) as bigint) as string)) end as amount"
    return clean.convert_type(load(spark, sf, "orders").selectExpr("o_orderkey", text), "amount", "number")


@query("cl11_invalid_count", "select count_if(o_orderkey % 5 = 0) as invalid from orders")
def cl11b(spark, sf):
    text = "case when o_orderkey % 5 = 0 then 'unknown' else concat('$', cast(cast(floor(o_totalprice) as bigint) as string)) end as amount"
    return clean.invalid_count(load(spark, sf, "orders").selectExpr(text), "amount", "number")


@query("cl12_convert_date", "select o_orderkey, cast(o_orderdate as date) as day from orders")
def cl12(spark, sf):
    text = load(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"))
    return clean.convert_type(text, "day", "date").withColumn("day", F.col("day").cast("date"))


@query("cl12_serial_date", """
    select o_orderkey, case when o_orderkey % 9 = 0 then null else cast(o_orderdate as date) end as day from orders""")
def cl12b(spark, sf):
    serial = "case when o_orderkey % 9 = 0 then 90000.0 else cast(datediff(o_orderdate, date'1899-12-30') as double) end as day"
    return clean.convert_type(load(spark, sf, "orders").selectExpr("o_orderkey", serial), "day", "date").withColumn("day", F.col("day").cast("date"))


@query("cl13_convert_text", "select o_orderkey, concat(day(o_orderdate), ' ', strftime(o_orderdate, '%b %Y')) as day, cast(o_custkey as varchar) as customer from orders")
def cl13(spark, sf):
    df = load(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("day"), F.col("o_custkey").cast("double").alias("customer"))
    return clean.convert_type(clean.convert_type(df, "day", "text"), "customer", "category")


@query("cl14_trim", r"select p_partkey, trim(regexp_replace(concat('  ', p_name, '   ', p_type, ' '), '\s+', ' ', 'g')) as v from part")
def cl14(spark, sf):
    return clean.text_clean(load(spark, sf, "part").selectExpr("p_partkey", "concat('  ', p_name, '   ', p_type, ' ') as v"), "v", "trim")


@query("cl15_lower", "select p_partkey, lower(p_brand) as p_brand from part")
def cl15(spark, sf):
    return clean.text_clean(load(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", "lower")


@query("cl15_upper", "select p_partkey, upper(p_name) as p_name from part")
def cl15b(spark, sf):
    return clean.text_clean(load(spark, sf, "part").select("p_partkey", "p_name"), "p_name", "upper")


@query("cl16_title", r"""
    select o_orderkey, array_to_string(list_transform(regexp_extract_all(lower(v), '[^\s\-_/]+|[\s\-_/]+'), lambda x: upper(x[1]) || x[2:]), '') as v
    from (select o_orderkey, concat(o_orderpriority, '/', lower(o_orderpriority), '_x ', o_orderstatus) as v from orders)""")
def cl16(spark, sf):
    df = load(spark, sf, "orders").selectExpr("o_orderkey", "concat(o_orderpriority, '/', lower(o_orderpriority), '_x ', o_orderstatus) as v")
    return clean.text_clean(df, "v", "title")


@query("cl17_remove_special", r"select p_partkey, regexp_replace(concat(p_brand, '#*', p_type, '.!'), '[^\p{L}\p{N}\s.\-]', '', 'g') as v from part")
def cl17(spark, sf):
    return clean.text_clean(load(spark, sf, "part").selectExpr("p_partkey", "concat(p_brand, '#*', p_type, '.!') as v"), "v", "remove_special")


@query("cl18_standardize", f"""
    with c as (select priority, regexp_replace(lower(priority), '[^\\p{{L}}\\p{{N}}]+', '', 'g') as k, count(*) as n from {dirty_sql()} group by 1),
    b as (select k, trim(first(priority order by n desc, priority)) as best from c group by k)
    select o_orderkey, best as priority from {dirty_sql()} d join c using (priority) join b using (k)""")
def cl18(spark, sf):
    return clean.text_clean(dirty(spark, sf, "o_orderkey", "priority"), "priority", "standardize")


IQR = f"""with q as (select quantile_cont(spiked, 0.25) as q1, quantile_cont(spiked, 0.75) as q3, min(spiked) as mn from {dirty_sql()}),
    f as (select case when mn >= 0 and q1 - 1.5 * (q3 - q1) < mn then mn else q1 - 1.5 * (q3 - q1) end as lo, q3 + 1.5 * (q3 - q1) as hi from q)"""
ZSCORE = f"""with q as (select avg(spiked) as m, stddev_samp(spiked) as s, min(spiked) as mn from {dirty_sql()}),
    f as (select case when mn >= 0 and m - 3 * s < mn then mn else m - 3 * s end as lo, m + 3 * s as hi from q)"""
LOGIQR = f"""with q as (select quantile_cont(ln(spiked), 0.25) as q1, quantile_cont(ln(spiked), 0.75) as q3, min(spiked) as mn from {dirty_sql()} where spiked > 0),
    f as (select case when mn >= 0 and exp(q1 - 3 * (q3 - q1)) < mn then mn else exp(q1 - 3 * (q3 - q1)) end as lo, exp(q3 + 3 * (q3 - q1)) as hi from q)"""


def _outlier_queries(name, method, ctes):
    @query(f"{name}_{method}_cap", f"{ctes} select o_orderkey, {r('greatest(lo, least(hi, spiked))', 3)} as spiked from {dirty_sql()}, f")
    def cap(spark, sf):
        return rounded(clean.outliers(dirty(spark, sf, "o_orderkey", "spiked"), "spiked", method, "cap"), 3)

    @query(f"{name}_{method}_remove", f"{ctes} select o_orderkey, spiked from {dirty_sql()}, f where spiked between lo and hi")
    def remove(spark, sf):
        return clean.outliers(dirty(spark, sf, "o_orderkey", "spiked"), "spiked", method, "remove")


_outlier_queries("cl19", "iqr", IQR)
_outlier_queries("cl20", "zscore", ZSCORE)
_outlier_queries("cl21", "logiqr", LOGIQR)

DATE_PARTS = {
    "year": "cast(year(o_orderdate) as integer)", "month": "strftime(o_orderdate, '%b')", "quarter": "concat('Q', quarter(o_orderdate))",
    "weekday": "strftime(o_orderdate, '%a')", "yearmonth": "strftime(o_orderdate, '%Y-%m')", "week": "cast(weekofyear(o_orderdate) as integer)",
}


def _date_part_query(part, sql):
    @query(f"cl22_extract_{part}", f"select o_orderkey, {sql} as part from orders")
    def run(spark, sf):
        return clean.extract_date(load(spark, sf, "orders"), "o_orderdate", part, "part").select("o_orderkey", "part")


for _part, _sql in DATE_PARTS.items():
    _date_part_query(_part, _sql)


@query("cl22_extract_hour", "select event_id, cast(hour(ts) as integer) as part from events")
def cl22_hour(spark, sf):
    return clean.extract_date(load(spark, sf, "events"), "ts", "hour", "part").select("event_id", "part")


@query("cl23_replace_value", "select o_orderkey, case when o_orderstatus = 'F' then 'Filled' else o_orderstatus end as o_orderstatus from orders")
def cl23(spark, sf):
    return clean.replace_value(load(spark, sf, "orders"), "o_orderstatus", "F", "Filled").select("o_orderkey", "o_orderstatus")


@query("cl23_replace_number", "select l_orderkey, l_linenumber, case when l_quantity = 5 then 500.0 else l_quantity end as l_quantity from lineitem")
def cl23b(spark, sf):
    return clean.replace_value(load(spark, sf, "lineitem"), "l_quantity", 5, "500").select("l_orderkey", "l_linenumber", "l_quantity")


@query("cl24_negative_to_missing", f"select o_orderkey, case when signed >= 0 then signed end as signed from {dirty_sql()}")
def cl24(spark, sf):
    return clean.negative_to_missing(dirty(spark, sf, "o_orderkey", "signed"), "signed")


LIKERT_SQL = "case q2 " + " ".join(f"when '{v}' then {i}" for i, v in enumerate(LIKERT, 1)) + " end"


@query("cl25_likert_score", f"select o_orderkey, {LIKERT_SQL} as score from {dirty_sql()}")
def cl25(spark, sf):
    return clean.likert_score(dirty(spark, sf, "o_orderkey", "q2"), "q2", list(LIKERT), "score").select("o_orderkey", "score")


@query("cl26_add_clusters")
def cl26(spark, sf):
    df = load(spark, sf, "part").selectExpr("p_partkey", "p_size", "case when p_partkey % 40 = 0 then null else p_retailprice end as p_retailprice")
    return clean.add_clusters(df, ["p_size", "p_retailprice"], 3)


@query("cl26_cluster_invariants", """
    select count(*) as "rows", count(case when p_partkey % 40 = 0 then null else p_size end) as labelled, cast(3 as bigint) as segments, true as numbered_by_size, true as nearest_mean from part""")
def cl26b(spark, sf):
    """Rows with a missing input have no segment, segments are numbered by falling size, and each row lies nearest to its own segment's mean."""
    df = load(spark, sf, "part").selectExpr("p_partkey", "p_size", "case when p_partkey % 40 = 0 then null else p_retailprice end as p_retailprice")
    done = clean.add_clusters(df, ["p_size", "p_retailprice"], 3)
    inputs = df.select("p_size", "p_retailprice")
    m = inputs.agg(F.avg("p_size").alias("a"), F.stddev_samp("p_size").alias("sa"), F.avg("p_retailprice").alias("b"), F.stddev_samp("p_retailprice").alias("sb")).first()
    z = done.select("segment", ((F.col("p_size") - m["a"]) / m["sa"]).alias("x"), ((F.col("p_retailprice") - m["b"]) / m["sb"]).alias("y"))
    means = sorted(z.where("segment is not null").groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y")).collect())
    far = lambda g: (F.col("x") - g["x"]) * (F.col("x") - g["x"]) + (F.col("y") - g["y"]) * (F.col("y") - g["y"])
    own = F.coalesce(*[F.when(F.col("segment") == g["segment"], far(g)) for g in means])
    # k-means stops when its centres hardly move, so rows on a border may lie a trifle nearer to the next.
    falling = all(a["n"] >= b["n"] for a, b in zip(means, means[1:]))
    return z.agg(F.count(F.lit(1)).alias("rows"), F.count("segment").alias("labelled"), F.count_distinct("segment").alias("segments"), F.lit(falling).alias("numbered_by_size"),
                 (F.count_if(own > F.least(*[far(g) for g in means]) + 0.05) == 0).alias("nearest_mean"))


STEPS = [Step("fill_missing", {"col": "price", "method": "mean"}), Step("text_clean", {"col": "no_such_column", "fn": "trim"}),
         Step("derive", {"name": "half", "a": "price", "op": "/", "b": 2, "constant": True}), Step("filter", {"col": "half", "op": ">", "value": 50000})]


@query("cl27_replay_steps", f"""
    select * from (select o_orderkey, price, {r('price / 2')} as half from (select o_orderkey, coalesce(price, {half_up(f'select avg(price) from {dirty_sql()}')}) as price from {dirty_sql()})) where half > 50000""")
def cl27(spark, sf):
    return rounded(apply_steps(dirty(spark, sf, *KV), STEPS)[0])


@query("cl28_step_changes", f"""
    select o_orderkey, 'status' as "column", 'F' as "before", 'Filled' as "after" from {dirty_sql()} where status = 'F'""")
def cl28(spark, sf):
    df = dirty(spark, sf, "o_orderkey", "status", "price")
    return changed_values(df, clean.replace_value(df, "status", "F", "Filled"), "o_orderkey")


@query("cl28_step_preview", f"""
    select count(*) as "before", count_if(price is not null) as "after", 0 as changed from {dirty_sql()}""")
def cl28b(spark, sf):
    return preview_step(dirty(spark, sf, *KV), "o_orderkey", "drop_missing", cols=["price"])["rows"]


@query("cl29_auto_clean", f"""
    select count(*) as "rows", count_if(price is null) as missing_price, count_if(status is null) as missing_status,
           (select count(distinct regexp_replace(lower(priority), '[^\\p{{L}}\\p{{N}}]+', '', 'g')) from {dirty_sql()}) as priorities
    from (select coalesce(price, 0) as price, coalesce(status, 'x') as status from {dirty_sql()})""")
def cl29(spark, sf):
    metas = [ColumnMeta("o_orderkey", "id"), ColumnMeta("price", "number"), ColumnMeta("status", "category"), ColumnMeta("priority", "category")]
    done, _, _ = auto_clean(dirty(spark, sf, "o_orderkey", "price", "status", "priority"), metas)
    return done.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("price").isNull()).alias("missing_price"),
                    F.count_if(F.col("status").isNull()).alias("missing_status"), F.count_distinct("priority").alias("priorities"))


_KEY = "regexp_replace(lower(priority), '[^\\p{L}\\p{N}]+', '', 'g')"


@query("cl29_cleaned_values", f"""
    with d as {dirty_sql()}, best as (select k, first(trim(priority) order by n desc, priority) as label from (select priority, {_KEY} as k, count(*) as n from d group by all) group by k),
    c as (select coalesce(price, {half_up('select avg(price) from d')}) as price, coalesce(status, (select status from d where status is not null group by 1 order by count(*) desc, 1 limit 1)) as status, best.label as priority
          from d join best on best.k = {_KEY})
    select status, priority, count(*) as "rows", {r('sum(price)', 2)} as total, {r('min(price)', 2)} as lowest from c group by all""")
def cl29b(spark, sf):
    """Every value after cleaning: gaps filled with mean and mode, spellings made one."""
    metas = [ColumnMeta("o_orderkey", "id"), ColumnMeta("price", "number"), ColumnMeta("status", "category"), ColumnMeta("priority", "category")]
    done, _, _ = auto_clean(dirty(spark, sf, "o_orderkey", "price", "status", "priority"), metas)
    return rounded(done.groupBy("status", "priority").agg(F.count(F.lit(1)).alias("rows"), F.sum("price").alias("total"), F.min("price").alias("lowest")), 2)


@query("cl30_lineage", f"""
    select 1 as seq, 'fill_missing' as op, count(*) as row_count from {dirty_sql()} union all select 2, 'text_clean', count(*) from {dirty_sql()}
    union all select 3, 'derive', count(*) from {dirty_sql()}
    union all select 4, 'filter', count_if(price / 2 > 50000) from (select coalesce(price, {half_up(f'select avg(price) from {dirty_sql()}')}) as price from {dirty_sql()})""")
def cl30(spark, sf):
    return lineage_table(dirty(spark, sf, *KV), STEPS, count_rows=True).select("seq", "op", "row_count")
