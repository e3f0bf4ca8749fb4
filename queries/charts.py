"""Frames behind charts (AG12-AG19, SL4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import load, query, r, rounded
from tablewise.operators import pivots
from tablewise.operators.aggregate import AggSpec, aggregate


@query("ag12_crosstab_cells", """
    with ta as (select p_brand from part group by 1 order by count(*) desc, 1 limit 12), tb as (select p_type from part group by 1 order by count(*) desc, 1 limit 12)
    select p_brand, p_type, count(*) as n from part where p_brand in (from ta) and p_type in (from tb) group by 1, 2""")
def ag12(spark, sf):
    return pivots.crosstab_cells(load(spark, sf, "part"), "p_brand", "p_type", 12)


@query("ag12_crosstab_all_levels", "select p_brand, p_type, count(*) as n from part where p_brand is not null and p_type is not null group by 1, 2")
def ag12c(spark, sf):
    return pivots.crosstab_cells(load(spark, sf, "part"), "p_brand", "p_type")


@query("ag12_crosstab", """
    select l_returnflag, count_if(l_linestatus = 'F') as "F", count_if(l_linestatus = 'O') as "O", count(*) as "Total" from lineitem group by 1""")
def ag12b(spark, sf):
    return pivots.crosstab(load(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


SERIES_SQL = """
    with g as (select p_brand, cast(p_size as varchar) as c, sum(p_retailprice) as v from part group by 1, 2),
    tc as (select c, sum(v) as w, row_number() over (order by sum(v) desc, cast(c as integer)) as rk from g group by 1),
    tx as (select p_brand from g group by 1 order by sum(v) desc, 1 limit 15),
    s as (select p_brand, case when (select count(*) from tc) <= 8 or rk <= 7 then g.c else 'Other' end as series, v from g join tc using (c) where p_brand in (from tx)),
    cells as (select p_brand, series, sum(v) as value from s group by 1, 2),
    grid as (select * from (select distinct p_brand from cells), (select distinct series from cells)),
    full_cells as (select p_brand, series, coalesce(value, 0) as value from grid left join cells using (p_brand, series))
"""


@query("ag13_series", SERIES_SQL + f"select p_brand, series, {r('value', 2)} as value from full_cells")
def ag13(spark, sf):
    return rounded(pivots.chart_series(load(spark, sf, "part"), "p_brand", "p_size", "p_retailprice", "sum"), 2)


@query("ag14_share_100", SERIES_SQL + f"select p_brand, series, {r('value / sum(value) over (partition by p_brand)')} as value from full_cells")
def ag14(spark, sf):
    cells = pivots.chart_series(load(spark, sf, "part"), "p_brand", "p_size", "p_retailprice", "sum")
    return rounded(pivots.share_100(cells, "p_brand"))


@query("ag13_pivot_wide", f"""
    select l_returnflag, {r("coalesce(sum(case when l_linestatus = 'F' then l_quantity end), 0)")} as "F", {r("coalesce(sum(case when l_linestatus = 'O' then l_quantity end), 0)")} as "O"
    from lineitem group by 1""")
def ag13b(spark, sf):
    return rounded(pivots.pivot_wide(pivots.chart_series(load(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity", "sum"), "l_returnflag"))


@query("ag15_fold_top", f"""
    with g as (select p_brand, sum(p_retailprice) as v from part group by 1), k as (select *, row_number() over (order by v desc, p_brand) as rk from g)
    select case when rk <= 6 then p_brand else 'Other' end as p_brand, {r('sum(v)', 2)} as sum_p_retailprice from k group by 1""")
def ag15(spark, sf):
    groups = aggregate(load(spark, sf, "part"), AggSpec(by=("p_brand",), metrics=(("p_retailprice", "sum"),)))
    return rounded(pivots.fold_top(groups, "p_brand", "sum_p_retailprice", 7), 2)


@query("ag15_drop_tail", f"""
    select p_brand, {r('avg(p_retailprice)')} as mean_p_retailprice from part group by 1 order by avg(p_retailprice) desc, 1 limit 6""")
def ag15b(spark, sf):
    groups = aggregate(load(spark, sf, "part"), AggSpec(by=("p_brand",), metrics=(("p_retailprice", "mean"),)))
    return rounded(pivots.fold_top(groups, "p_brand", "mean_p_retailprice", 7, additive=False))


TOP_CELLS = """
    with tb as (select p_brand from part group by 1 order by count(*) desc, 1 limit 15), ts as (select p_type from part group by 1 order by count(*) desc, 1 limit 15)
"""


@query("ag16_heatmap", TOP_CELLS + f"""
    select p_brand, p_type, {r('avg(p_retailprice)')} as mean_p_retailprice from part where p_brand in (from tb) and p_type in (from ts) group by 1, 2""")
def ag16(spark, sf):
    return rounded(pivots.heatmap(load(spark, sf, "part"), "p_brand", "p_type", "p_retailprice", "mean"))


@query("ag16_rate_heatmap", f"""
    select l_linestatus, l_linenumber, {r("avg(case when l_returnflag = 'R' then 1.0 else 0.0 end)")} as rate from lineitem group by 1, 2""")
def ag16b(spark, sf):
    df = load(spark, sf, "lineitem").withColumn("returned", F.when(F.col("l_returnflag") == "R", "Yes").otherwise("No"))
    return rounded(pivots.rate_heatmap(df, "l_linestatus", "l_linenumber", "returned", "Yes"))


@query("ag17_histogram", f"""
    with s as (select min(l_extendedprice) as mn, max(l_extendedprice) as mx from lineitem),
    c as (select least(floor((l_extendedprice - mn) / ((mx - mn) / 24)), 23) as bin, count(*) as n from lineitem, s group by 1)
    select cast(b.bin as integer) as bin, {r('mn + b.bin * ((mx - mn) / 24)')} as x0, {r('mn + (b.bin + 1) * ((mx - mn) / 24)')} as x1, coalesce(n, 0) as n
    from (select unnest(range(24)) as bin) b cross join s left join c on c.bin = b.bin""")
def ag17(spark, sf):
    return rounded(pivots.histogram(load(spark, sf, "lineitem"), "l_extendedprice", 24))


@query("ag19_box_summary", f"""
    with t as (select p_brand from part group by 1 order by count(*) desc, 1 limit 12)
    select p_brand, count(*) as n, {r('avg(p_retailprice)')} as mean, {r('stddev_samp(p_retailprice)')} as sd, min(p_retailprice) as min, max(p_retailprice) as max,
           {r('quantile_cont(p_retailprice, 0.25)')} as q1, {r('median(p_retailprice)')} as median, {r('quantile_cont(p_retailprice, 0.75)')} as q3
    from part where p_brand in (from t) group by 1""")
def ag19(spark, sf):
    return rounded(pivots.box_summary(load(spark, sf, "part"), "p_retailprice", "p_brand"))


@query("sl04_scatter_points", """
    with l as (select p_type, count(*) as n, row_number() over (order by count(*) desc, p_type) as rk, count(*) over () as c from part group by 1)
    select p_partkey, p_size, p_retailprice, case when c <= 4 or rk <= 3 then p_type else 'Other' end as p_type from part join l using (p_type)""")
def sl04(spark, sf):
    return pivots.scatter_points(load(spark, sf, "part"), "p_size", "p_retailprice", "p_partkey", "p_type")
