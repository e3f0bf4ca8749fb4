"""Models and segments (ML)."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import dirty, dirty_sql, load, query, r, rounded
from tablewise.operators import models
from tablewise.operators.absorb import fit_absorbed

REGR = "l_extendedprice, l_quantity"


@query("ml01_regression_one", f"""
    with s as (select regr_slope({REGR}) as b, regr_intercept({REGR}) as a, regr_r2({REGR}) as r2, count(*) as n, regr_sxx({REGR}) as sxx, regr_syy({REGR}) as syy, avg(l_quantity) as mx from lineitem)
    select '(Intercept)' as term, {r('a', 3)} as coef, {r('sqrt((1 - r2) * syy / (n - 2) * (1.0 / n + mx * mx / sxx))', 3)} as se from s
    union all select 'l_quantity', {r('b', 3)}, {r('sqrt((1 - r2) * syy / (n - 2) / sxx)', 3)} from s""")
def ml01(spark, sf):
    model = models.fit_linear(load(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"])
    return rounded(models.coefficient_frame(spark, model).select("term", "coef", "se"), 3)


@query("ml01_regression_fit", f"""
    select 'l_extendedprice' as target, count(*) as n, {r(f'regr_r2({REGR})', 6)} as r2, {r(f'1 - (1 - regr_r2({REGR})) * (count(*) - 1) / (count(*) - 2)', 6)} as adj_r2,
           {r(f'sqrt((1 - regr_r2({REGR})) * regr_syy({REGR}) / count(*))', 2)} as rmse from lineitem""")
def ml01b(spark, sf):
    model = models.fit_linear(load(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"])
    return rounded(models.fit_frame(spark, model).drop("f", "p_f"), 6, rmse=2)


@query("ml01_regression_levels", f"""
    with m as (select o_orderpriority as g, avg(o_totalprice) as m from orders group by 1), b as (select m as base from m where g = (select o_orderpriority from orders group by 1 order by count(*) desc, 1 limit 1))
    select case when m = base then '(Intercept)' else 'o_orderpriority = ' || g end as term, {r('case when m = base then m else m - base end', 3)} as coef from m, b""")
def ml01c(spark, sf):
    model = models.fit_linear(load(spark, sf, "orders"), "o_totalprice", ["o_orderpriority"])
    return rounded(models.coefficient_frame(spark, model).select("term", "coef"), 3)


@query("ml01_regression_many_levels", f"""
    with t as (select p_brand, row_number() over (order by count(*) desc, p_brand) as rk from part group by 1),
    g as (select case when rk <= 12 then p_brand else '(other)' end as g, min(rk) as rk, avg(p_retailprice) as m from part join t using (p_brand) group by 1), b as (select m as base from g where rk = 1)
    select case when rk = 1 then '(Intercept)' else 'p_brand = ' || g end as term, {r('case when rk = 1 then m else m - base end', 3)} as coef from g, b""")
def ml01e(spark, sf):
    model = models.fit_linear(load(spark, sf, "part"), "p_retailprice", ["p_brand"])
    return rounded(models.coefficient_frame(spark, model).select("term", "coef"), 3)


@query("ml01_regression_full")
def ml01d(spark, sf):
    model = models.fit_linear(load(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_returnflag"])
    return rounded(models.coefficient_frame(spark, model))


@query("ml02_segments")
def ml02(spark, sf):
    found, _ = models.segment(load(spark, sf, "part"), ["p_size", "p_retailprice"], keep=["p_partkey"])
    return found.select("p_partkey", "segment")


@query("ml02_segment_sizes", "select count(*) as n, 3 as segments from part where p_size is not null and p_retailprice is not null")
def ml02b(spark, sf):
    found, _ = models.segment(load(spark, sf, "part"), ["p_size", "p_retailprice"], 3)
    return found.agg(F.count(F.lit(1)).alias("n"), F.max("segment").alias("segments"))


@query("ml02_winsorize", f"""
    with s as (select list(o_totalprice order by o_totalprice) as l, count(*) as n from orders)
    select o_orderkey, greatest(l[cast(floor(0.01 * (n - 1)) as integer) + 1], least(l[cast(ceil(0.99 * (n - 1)) as integer) + 1], o_totalprice)) as o_totalprice from orders, s""")
def ml02c(spark, sf):
    return models.winsorize(load(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"])


@query("ml02_segment_order", "select count(*) as n, 3 as segments, true as falling from part")
def ml02d(spark, sf):
    """Every row has a segment, and segments are numbered by size."""
    found, _ = models.segment(load(spark, sf, "part"), ["p_size", "p_retailprice"], 3)
    sizes = found.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    falling = F.array_agg(F.struct("segment", F.col("n")))
    ordered = F.transform(F.sort_array(falling), lambda s: -s["n"])
    return sizes.agg(F.sum("n").alias("n"), F.max("segment").cast("int").alias("segments"), (F.sort_array(ordered) == ordered).alias("falling"))


@query("ml03_silhouette")
def ml03(spark, sf):
    _, facts = models.segment(load(spark, sf, "part"), ["p_size", "p_retailprice"], 3)
    return spark.createDataFrame([(facts["k"], facts["silhouette"])], "k int, silhouette double")


@query("ml01_regression_absorbed", f"""
    with w as (select l_extendedprice - avg(l_extendedprice) over g as y, l_quantity - avg(l_quantity) over g as a, l_discount - avg(l_discount) over g as b, l_suppkey from lineitem window g as (partition by l_suppkey)),
    s as (select sum(y * y) as yy, sum(a * a) as aa, sum(b * b) as bb, sum(a * b) as ab, sum(a * y) as ay, sum(b * y) as by_, count(*) as n, count(*) - count(distinct l_suppkey) - 2 as df from w),
    c as (select *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) as ca, (by_ * aa - ay * ab) / (aa * bb - ab * ab) as cb from s),
    e as (select *, yy - ca * ay - cb * by_ as sse from c)
    select 'l_quantity' as term, {r('ca')} as coef, {r('sqrt(bb / (aa * bb - ab * ab) * sse / df)')} as se, n, df, {r('1 - sse / yy', 6)} as r2_within from e
    union all select 'l_discount', {r('cb')}, {r('sqrt(aa / (aa * bb - ab * ab) * sse / df)')}, n, df, {r('1 - sse / yy', 6)} from e""")
def ml01e(spark, sf):
    """Slopes with an indicator for every supplier, as within-group regression gives them."""
    fitted = fit_absorbed(load(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"], ["l_suppkey"])
    return rounded(fitted.select("term", "coef", "se", "n", "df", "r2_within"), 4, r2_within=6)


@query("ml03_silhouette_of_labels", f"""
    with z as (select p_partkey, case when p_size > 25 then 'large' when p_size > 20 then 'middle' else 'small' end as label, p_size / 15.0 as x, p_retailprice / 300.0 as y, greatest(1, count(*) over () // 600) as step, count(*) over () as n from part),
    t as (select * from z where n < 1200 or p_partkey % step = 0),
    d as (select a.p_partkey as k, a.label, b.label as other, sum(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) as d, count(*) as n from t a cross join t b group by all),
    s as (select k, label, coalesce(max(case when label = other and n > 1 then d / (n - 1) end), 0) as a, min(case when label <> other then d / n end) as b from d group by all)
    select label, count(*) as n, {r('avg(a)', 6)} as a, {r('avg(b)', 6)} as b, {r('avg((b - a) / greatest(a, b))', 6)} as silhouette from s group by label""")
def ml03b(spark, sf):
    """Silhouettes of given labels on the systematic sample of parts."""
    label = F.when(F.col("p_size") > 25, "large").when(F.col("p_size") > 20, "middle").otherwise("small")
    df = load(spark, sf, "part").select("p_partkey", label.alias("label"), (F.col("p_size") / 15.0).alias("x"), (F.col("p_retailprice") / 300.0).alias("y"))
    found = models.silhouette_rows(df, ["x", "y"], "label", "p_partkey")
    return rounded(found.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("a"), F.avg("b").alias("b"), F.avg("s").alias("silhouette")), 6)


@query("ml04_pca")
def ml04(spark, sf):
    return rounded(models.pca2(load(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], ["l_orderkey", "l_linenumber"])[0])


@query("ml04_explained_share", f"select {r('(1 + abs(corr(l_quantity, l_extendedprice))) / 2')} as pc1, {r('(1 - abs(corr(l_quantity, l_extendedprice))) / 2')} as pc2 from lineitem")
def ml04b(spark, sf):
    """Two standardised columns with correlation c have the shares (1 + |c|) / 2 and (1 - |c|) / 2."""
    _, shares = models.pca2(load(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"])
    return rounded(spark.createDataFrame([tuple(shares)], "pc1 double, pc2 double"))


@query("ml05_standardize", f"""
    with s as (select avg(price) as mp, stddev_samp(price) as sp, avg(spiked) as ms, stddev_samp(spiked) as ss from {dirty_sql()})
    select o_orderkey, {r('(price - mp) / sp')} as price, {r('(spiked - ms) / ss')} as spiked from {dirty_sql()}, s where price is not null""")
def ml05(spark, sf):
    return rounded(models.standardize(dirty(spark, sf, "o_orderkey", "price", "spiked"), ["price", "spiked"], ["o_orderkey"]))


@query("ml06_linear_trend", f"""
    select count(*) as n, {r('regr_slope(l_extendedprice, l_quantity)')} as slope, {r('regr_intercept(l_extendedprice, l_quantity)')} as intercept, {r('corr(l_extendedprice, l_quantity)', 6)} as r from lineitem""")
def ml06(spark, sf):
    return rounded(models.linear_trend(load(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"), 4, r=6)


CANDIDATES = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_suppkey"]


@query("ml07_top_predictors", "select * from (" + " union all ".join(
    f"select '{c}' as \"column\", {r(f'corr({c}, l_extendedprice)', 6)} as r from lineitem" for c in CANDIDATES) + ") order by abs(r) desc, 1 limit 4")
def ml07(spark, sf):
    return rounded(models.top_predictors(load(spark, sf, "lineitem"), "l_extendedprice", CANDIDATES), 6)


@query("ml08_predict", f"""
    with s as (select regr_slope({REGR}) as b, regr_intercept({REGR}) as a from lineitem)
    select l_orderkey, l_linenumber, {r('a + b * l_quantity', 2)} as fitted, {r('l_extendedprice - (a + b * l_quantity)', 2)} as residual from lineitem, s""")
def ml08(spark, sf):
    lines = load(spark, sf, "lineitem")
    model = models.fit_linear(lines, "l_extendedprice", ["l_quantity"])
    return rounded(models.predict(model, lines).select("l_orderkey", "l_linenumber", "fitted", "residual"), 2)


@query("ml09_segment_profile", f"""
    with o as (select avg(p_size) as os, avg(p_retailprice) as op from part),
    g as (select p_type as segment, count(*) as n, avg(p_size) as s, avg(p_retailprice) as p from part group by 1),
    d as (select *, s / os - 1 as ds, p / op - 1 as dp from g, o)
    select segment, n, {r('s')} as p_size, {r('p')} as p_retailprice, case when abs(dp) > abs(ds) then 'p_retailprice' else 'p_size' end as differs_1,
           {r('case when abs(dp) > abs(ds) then dp else ds end')} as gap_1, case when abs(dp) > abs(ds) then 'p_size' else 'p_retailprice' end as differs_2,
           {r('case when abs(dp) > abs(ds) then ds else dp end')} as gap_2 from d""")
def ml09(spark, sf):
    return rounded(models.segment_profile(load(spark, sf, "part"), "p_type", ["p_size", "p_retailprice"]))
