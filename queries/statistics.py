"""Statistics (ST) and survey scales (SV)."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import LIKERT, dirty, dirty_sql, load, query, r, rounded
from tablewise.functions.tails import add_p_values
from tablewise.operators import hypothesis as h, moments
from tablewise.operators.ordered import quantiles
from tablewise.operators.pivots import likert_shares
from tablewise.operators.survey import cronbach_alpha, survey_summary

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _describe_sql(table, cols):
    parts = []
    for c in cols:
        parts.append(f"""select '{c}' as "column", count({c}) as n, {r(f'avg({c})')} as mean, {r(f'stddev_samp({c})')} as sd, {r(f'min({c})')} as min,
            {r(f'quantile_cont({c}, 0.05)')} as p5, {r(f'quantile_cont({c}, 0.25)')} as q1, {r(f'median({c})')} as median, {r(f'quantile_cont({c}, 0.75)')} as q3,
            {r(f'quantile_cont({c}, 0.95)')} as p95, {r(f'max({c})')} as max, {r(f'quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)')} as iqr,
            {r(f'skewness({c})')} as skew, {r(f'kurtosis({c})')} as kurt, {r(f'stddev_samp({c}) / abs(avg({c}))')} as cv, {r(f'sum({c})', 2)} as sum, count_if({c} = 0) as zeros,
            (select count(*) from {table}, (select quantile_cont({c}, 0.25) as a, quantile_cont({c}, 0.75) as b from {table}) where {c} < a - 1.5 * (b - a) or {c} > b + 1.5 * (b - a)) as outliers,
            {r(f'stddev_samp({c}) / sqrt(count({c}))')} as se from {table}""")
    return " union all ".join(parts)


@query("st01_describe", _describe_sql("lineitem", LINE_NUMBERS))
def st01(spark, sf):
    return rounded(moments.describe(load(spark, sf, "lineitem"), LINE_NUMBERS), 4, sum=2)


@query("st01_describe_ranges", _describe_sql("customer", ["c_acctbal"]))
def st01b(spark, sf):
    """Quantiles by the distributed rank search."""
    return rounded(moments.describe(load(spark, sf, "customer"), ["c_acctbal"]), 4, sum=2)


@query("st02_quantiles", f"""
    select {r('quantile_cont(o_totalprice, 0.01)')} as p1, {r('quantile_cont(o_totalprice, 0.333)')} as third, {r('quantile_cont(o_totalprice, 0.99)')} as p99 from orders""")
def st02(spark, sf):
    return rounded(quantiles(load(spark, sf, "orders"), "o_totalprice", {"p1": 0.01, "third": 0.333, "p99": 0.99}))


JB = "count(*) / 6.0 * (skewness({c}) ** 2 + kurtosis({c}) ** 2 / 4)"


@query("st03_distribution", f"""select 'c_acctbal' as "column", count(*) as n, {r('skewness(c_acctbal)')} as skew, {r('kurtosis(c_acctbal)')} as kurt, {r(JB.format(c='c_acctbal'), 3)} as jb from customer""")
def st03(spark, sf):
    tested = moments.jarque_bera_test(moments.describe(load(spark, sf, "customer"), ["c_acctbal"]))
    return rounded(tested.drop("p"), 4, jb=3)


def _corr_sql(table, cols, method="pearson"):
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            parts.append(f"select '{a}' as column_a, '{b}' as column_b, count(*) as n, corr({a}, {b}) as r from {table} where {a} is not null and {b} is not null")
    return f"""select column_a, column_b, n, {r('r', 6)} as r, {r('r * sqrt((n - 2) / greatest(1e-12, 1 - r * r))')} as t, {r('tanh(atanh(r) - 1.96 / sqrt(n - 3))', 6)} as ci_low,
        {r('tanh(atanh(r) + 1.96 / sqrt(n - 3))', 6)} as ci_high from ({' union all '.join(parts)})"""


@query("st04_pearson", _corr_sql("lineitem", LINE_NUMBERS))
def st04(spark, sf):
    return rounded(moments.pearson(load(spark, sf, "lineitem"), LINE_NUMBERS), 6, t=4)


@query("st04_pearson_with_gaps", _corr_sql(dirty_sql(), ["price", "spiked", "o_custkey"]))
def st04b(spark, sf):
    return rounded(moments.pearson(dirty(spark, sf, "price", "spiked", "o_custkey"), ["price", "spiked", "o_custkey"]), 6, t=4)


def _midrank(c):
    return f"(rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0)"


SPEARMAN = f"(select {_midrank('price')} as price, {_midrank('o_custkey')} as o_custkey from {dirty_sql()} where price is not null)"


@query("st05_spearman", _corr_sql(SPEARMAN, ["price", "o_custkey"]))
def st05(spark, sf):
    return rounded(moments.spearman(dirty(spark, sf, "price", "o_custkey"), ["price", "o_custkey"]), 6, t=4)


TWO = "l_linestatus"
WELCH = """with m as (select count(*) filter (l_linestatus = 'F') as na, count(*) filter (l_linestatus = 'O') as nb, avg(l_extendedprice) filter (l_linestatus = 'F') as ma,
    avg(l_extendedprice) filter (l_linestatus = 'O') as mb, var_samp(l_extendedprice) filter (l_linestatus = 'F') as va, var_samp(l_extendedprice) filter (l_linestatus = 'O') as vb from lineitem)"""


@query("st06_welch", WELCH + f"""
    select na as n_a, nb as n_b, {r('ma', 3)} as mean_a, {r('mb', 3)} as mean_b, {r('ma - mb', 3)} as diff, {r('sqrt(va / na + vb / nb)', 3)} as se, {r('(ma - mb) / sqrt(va / na + vb / nb)')} as t,
           {r('(va / na + vb / nb) ** 2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1))', 2)} as df, {r('(ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2))')} as d from m""")
def st06(spark, sf):
    return rounded(h.welch(load(spark, sf, "lineitem"), "l_extendedprice", TWO, "F", "O"), 4, mean_a=3, mean_b=3, diff=3, se=3, df=2)


@query("st07_paired_t", f"""
    with d as (select l_tax - l_discount as d from lineitem)
    select count(*) as n, {r('avg(d)', 6)} as mean_diff, count(*) - 1 as df, {r('avg(d) / (stddev_samp(d) / sqrt(count(*)))')} as t, {r('avg(d) / stddev_samp(d)', 6)} as d from d""")
def st07(spark, sf):
    return rounded(h.paired_t(load(spark, sf, "lineitem"), "l_tax", "l_discount"), 6, t=4)


@query("st08_anova", f"""
    with g as (select p_brand, count(*) as n, avg(p_retailprice) as m, var_samp(p_retailprice) as v from part group by 1 having count(*) >= 2),
    s as (select sum(n) as total, count(*) as g, sum(n * m) / sum(n) as gm from g),
    b as (select total, g, sum(n * (m - gm) ** 2) as ssb, sum((n - 1) * v) as ssw from g, s group by all)
    select cast(g - 1 as bigint) as df1, cast(total - g as bigint) as df2, {r('(ssb / (g - 1)) / (ssw / (total - g))')} as f, {r('ssb / (ssb + ssw)', 6)} as eta2 from b""")
def st08(spark, sf):
    return rounded(h.anova(load(spark, sf, "part"), "p_retailprice", "p_brand"), 4, eta2=6)


@query("st08_group_table", f"""
    select p_brand, count(*) as n, {r('avg(p_retailprice)')} as mean, {r('median(p_retailprice)')} as median, {r('stddev_samp(p_retailprice)')} as sd from part group by 1 having count(*) >= 2""")
def st08b(spark, sf):
    return rounded(h.group_table(load(spark, sf, "part"), "p_retailprice", "p_brand"))


NORMAL = ("0.3989423 * exp(-z * z / 2) * t * (0.3193815 + t * (-0.3565638 + t * (1.781478 + t * (-1.821256 + t * 1.330274))))")


@query("st09_mann_whitney", f"""
    with k as (select l_linestatus as g, {_midrank('l_extendedprice')} as rk from lineitem),
    s as (select count(*) filter (g = 'F') as n1, count(*) filter (g = 'O') as n2, sum(rk) filter (g = 'F') as r1 from k),
    u as (select n1, n2, least(r1 - n1 * (n1 + 1) / 2, n1 * n2 - (r1 - n1 * (n1 + 1) / 2)) as u from s),
    z as (select *, (u - n1 * n2 / 2) / sqrt(n1::double * n2 * (n1 + n2 + 1) / 12) as z, 1 / (1 + 0.2316419 * abs((u - n1 * n2 / 2) / sqrt(n1::double * n2 * (n1 + n2 + 1) / 12))) as t from u)
    select n1 as n_a, n2 as n_b, cast(u as double) as u, {r('z', 6)} as z, {r('2 * ' + NORMAL, 6)} as p, {r('abs(z) / sqrt(n1 + n2)', 6)} as r_effect from z""")
def st09(spark, sf):
    return rounded(h.mann_whitney(load(spark, sf, "lineitem"), "l_extendedprice", TWO, "F", "O"), 6)


@query("st10_kruskal", f"""
    with k as (select p_brand as g, {_midrank('p_retailprice')} as rk from part), s as (select g, count(*) as n, sum(rk) as rs from k group by 1)
    select {r('12.0 / (sum(n) * (sum(n) + 1)) * sum(rs * rs / n) - 3 * (sum(n) + 1)')} as h, count(*) - 1 as df from s""")
def st10(spark, sf):
    return rounded(h.kruskal(load(spark, sf, "part"), "p_retailprice", "p_brand"))


def _jb_row(c):
    return f"""select '{c}' as "column", count(*) as n, {r(f'skewness({c})')} as skew, {r(f'kurtosis({c})')} as kurt, {r(JB.format(c=c), 2)} as jb from lineitem"""


@query("st11_jarque_bera", " union all ".join(_jb_row(c) for c in LINE_NUMBERS))
def st11(spark, sf):
    return rounded(moments.jarque_bera(moments.describe(load(spark, sf, "lineitem"), LINE_NUMBERS)), 4, jb=2)


CHI = """with la as (select p_brand from part group by 1 order by count(*) desc, 1 limit 12), lb as (select p_type from part group by 1 order by count(*) desc, 1 limit 12),
    o as (select p_brand as a, p_type as b, count(*) as n from part where p_brand in (from la) and p_type in (from lb) group by 1, 2),
    ra as (select a, sum(n) as ra from o group by 1), rb as (select b, sum(n) as rb from o group by 1),
    e as (select a, b, coalesce(n, 0) as n, ra * rb * 1.0 / (select sum(n) from o) as expected from ra cross join rb left join o using (a, b))"""


CHI_ALL = """with o as (select p_brand as a, cast(p_size as varchar) as b, count(*) as n from part where p_brand is not null and p_size is not null group by 1, 2),
    ra as (select a, sum(n) as ra from o group by 1), rb as (select b, sum(n) as rb from o group by 1),
    e as (select a, b, coalesce(n, 0) as n, ra * rb * 1.0 / (select sum(n) from o) as expected from ra cross join rb left join o using (a, b))"""
CHI_ROW = f"""
    select cast(sum(n) as bigint) as n, {r('sum((n - expected) ** 2 / expected)')} as chi2, (count(distinct a) - 1) * (count(distinct b) - 1) as df,
           {r('sqrt(sum((n - expected) ** 2 / expected) / (sum(n) * greatest(1, least(count(distinct a) - 1, count(distinct b) - 1))))', 6)} as cramers_v,
           {r('avg(case when expected < 5 then 1.0 else 0.0 end)')} as low_expected from e"""


@query("st12_chi_square", CHI + CHI_ROW)
def st12(spark, sf):
    return rounded(h.chi_square(load(spark, sf, "part"), "p_brand", "p_type", 12), 4, cramers_v=6)


@query("st12_chi_square_all_levels", CHI_ALL + CHI_ROW)
def st12c(spark, sf):
    return rounded(h.chi_square(load(spark, sf, "part"), "p_brand", "p_size"), 4, cramers_v=6)


@query("st12_residuals", CHI + f" select a, b, n, {r('expected')} as expected, {r('(n - expected) / sqrt(expected)')} as residual from e")
def st12b(spark, sf):
    return rounded(h.chi_square_cells(load(spark, sf, "part"), "p_brand", "p_type"))


@query("st13_compare_groups")
def st13(spark, sf):
    return rounded(h.compare_groups(load(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag"), 6)


@query("st13_compare_two_groups")
def st13b(spark, sf):
    return rounded(h.compare_groups(load(spark, sf, "lineitem"), "l_extendedprice", "l_linestatus"), 6)


GROUP_TESTS = f"""
    with g as (select l_returnflag, count(*) as n, avg(l_extendedprice) as m, var_samp(l_extendedprice) as v from lineitem group by 1),
    s as (select sum(n) as total, count(*) as g, sum(n * m) / sum(n) as gm from g),
    b as (select total, g, sum(n * (m - gm) ** 2) as ssb, sum((n - 1) * v) as ssw from g, s group by all),
    k as (select l_returnflag as g, {_midrank('l_extendedprice')} as rk from lineitem), ks as (select g, count(*) as n, sum(rk) as rs from k group by 1)
    select 'ANOVA' as test, {r('(ssb / (g - 1)) / (ssw / (total - g))')} as statistic, cast(g - 1 as double) as df1, cast(total - g as double) as df2, 'eta2' as effect, {r('ssb / (ssb + ssw)')} as effect_size from b
    union all select 'Kruskal-Wallis', {r('12.0 / (sum(n) * (sum(n) + 1)) * sum(rs * rs / n) - 3 * (sum(n) + 1)')}, cast(count(*) - 1 as double), null, '', null from ks"""


@query("st13_group_statistics", GROUP_TESTS)
def st13c(spark, sf):
    return rounded(h.compare_groups(load(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag").drop("p"))


@query("st13_two_group_statistics", WELCH + f"""
    , k as (select l_linestatus as g, {_midrank('l_extendedprice')} as rk from lineitem),
    s as (select count(*) filter (g = 'F') as n1, count(*) filter (g = 'O') as n2, sum(rk) filter (g = 'F') as r1 from k),
    u as (select n1, n2, least(r1 - n1 * (n1 + 1) / 2, n1 * n2 - (r1 - n1 * (n1 + 1) / 2)) as u from s)
    select 'Welch t' as test, {r('(ma - mb) / sqrt(va / na + vb / nb)', 2)} as statistic,
           {r('(va / na + vb / nb) ** 2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1))', 2)} as df1, 'd' as effect, {r('(ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2))', 2)} as effect_size from m
    union all select 'Mann-Whitney U', {r('cast(u as double)', 2)}, null, 'r', {r('abs((u - n1 * n2 / 2) / sqrt(n1::double * n2 * (n1 + n2 + 1) / 12)) / sqrt(n1 + n2)', 2)} from u""")
def st13d(spark, sf):
    return rounded(h.compare_groups(load(spark, sf, "lineitem"), "l_extendedprice", "l_linestatus").drop("p", "df2"), 2)


@query("st14_outlier_report", f"""
    with s as (select avg(spiked) as m, stddev_samp(spiked) as sd, quantile_cont(spiked, 0.25) as q1, quantile_cont(spiked, 0.75) as q3 from {dirty_sql('o_orderkey', 'spiked')})
    select o_orderkey, {r('spiked', 2)} as spiked, {r('(spiked - m) / sd')} as z from {dirty_sql('o_orderkey', 'spiked')}, s where spiked < q1 - 1.5 * (q3 - q1) or spiked > q3 + 1.5 * (q3 - q1)
    order by abs((spiked - m) / sd) desc, o_orderkey limit 25""")
def st14(spark, sf):
    return rounded(h.outlier_report(dirty(spark, sf, "o_orderkey", "spiked"), "spiked", "o_orderkey"), 4, spiked=2)


@query("st14_outlier_counts", f"""
    with s as (select avg(spiked) as m, stddev_samp(spiked) as sd, quantile_cont(spiked, 0.25) as q1, quantile_cont(spiked, 0.75) as q3 from {dirty_sql('o_orderkey', 'spiked')})
    select count(*) as n, count_if(spiked < q1 - 1.5 * (q3 - q1) or spiked > q3 + 1.5 * (q3 - q1)) as outside, count_if(abs((spiked - m) / sd) > 3) as far,
           {r('min(q1 - 1.5 * (q3 - q1))', 2)} as low, {r('min(q3 + 1.5 * (q3 - q1))', 2)} as high from {dirty_sql('o_orderkey', 'spiked')}, s""")
def st14b(spark, sf):
    return rounded(h.outlier_counts(dirty(spark, sf, "spiked"), "spiked"), 2)


@query("st15_effect_label", """
    select l_linenumber, l_orderkey, case when l_discount >= 0.14 then 'large' when l_discount >= 0.06 then 'medium' when l_discount >= 0.01 then 'small' else 'negligible' end as word from lineitem""")
def st15(spark, sf):
    return load(spark, sf, "lineitem").select("l_linenumber", "l_orderkey", h.effect_label("eta2", F.col("l_discount")).alias("word"))


@query("st16_p_values")
def st16(spark, sf):
    """One paired test per supplier, p-values appended to the table of statistics."""
    d = F.col("l_tax") - F.col("l_discount")
    tests = load(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(d).alias("n"), (F.avg(d) / (F.stddev_samp(d) / F.sqrt(F.count(d)))).alias("t"))
    return rounded(add_p_values(tests.withColumn("df", F.col("n") - 1), "t", "t", "df"), 6)


# --- SV: ordered scales ---
ORDERS = {c: list(LIKERT) for c in ("q1", "q2", "q3")}


def _score(c):
    return f"case {c} " + " ".join(f"when '{v}' then {i}" for i, v in enumerate(LIKERT, 1)) + " end"


def _item(c):
    s = _score(c)
    return f"""select '{c}' as item, count({c}) as n, {r(f'avg({s})')} as mean_score, {r(f'avg(case when {s} >= 4 then 1.0 when {c} is not null then 0.0 end)')} as top_two,
        {r(f'avg(case when {s} = 3 then 1.0 when {c} is not null then 0.0 end)')} as middle, {r(f'avg(case when {s} <= 2 then 1.0 when {c} is not null then 0.0 end)')} as bottom_two from {dirty_sql()}"""


@query("sv01_survey_summary", " union all ".join(_item(c) for c in ORDERS))
def sv01(spark, sf):
    return rounded(survey_summary(dirty(spark, sf, *ORDERS), ORDERS))


@query("sv02_cronbach_alpha", f"""
    with s as (select {_score('q1')} as a, {_score('q2')} as b, {_score('q3')} as c from {dirty_sql()} where q2 is not null),
    x as (select count(*) as n, 1.5 * (1 - (var_samp(a) + var_samp(b) + var_samp(c)) / var_samp(a + b + c)) as alpha from s)
    select n, cast(3 as integer) as k, {r('alpha', 6)} as alpha, case when alpha >= 0.9 then 'Excellent' when alpha >= 0.8 then 'Good' when alpha >= 0.7 then 'Acceptable'
        when alpha >= 0.6 then 'Questionable' else 'Poor' end as label from x""")
def sv02(spark, sf):
    return rounded(cronbach_alpha(dirty(spark, sf, *ORDERS), ORDERS), 6)


def _level(c, i, v):
    return f"""select '{c}' as item, count({c}) as n, {i} as position, '{v}' as level, {r(f"count_if({c} = '{v}') * 1.0 / count({c})")} as share from {dirty_sql()}"""


@query("sv03_likert_shares", " union all ".join(_level(c, i, v) for c in ORDERS for i, v in enumerate(LIKERT, 1)))
def sv03(spark, sf):
    return rounded(likert_shares(dirty(spark, sf, *ORDERS), list(ORDERS), list(LIKERT)))
