"""Profiles, quality, findings (PR, DS) and named analyses (PK)."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import LIKERT, dirty, dirty_sql, load, query, r, rounded
from tablewise.functions.tails import p_t
from tablewise.meta import ColumnMeta
from tablewise.operators import findings, series as ts
from tablewise.operators.cube import evidence_cube
from tablewise.operators.hypothesis import anova, chi_square
from tablewise.operators.moments import describe, pearson
from tablewise.operators.pivots import top_values
from tablewise.operators.profile import (
    build_profile, column_counts, health_frame, health_score, inconsistent_labels, issues_frame, profile_frame, quality_audit, schema_summary, top_per_column)
from tablewise.operators.survey import cronbach_alpha, survey_summary
from tablewise.plans.analyses import run, run_package

WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"
METAS = [ColumnMeta("o_orderkey", "id"), ColumnMeta("price", "number"), ColumnMeta("status", "category"), ColumnMeta("priority", "category"), ColumnMeta("o_orderdate", "date")]
COLS = [m.name for m in METAS]


def _facts(c, shown=None):
    return f"""select '{c}' as "column", count(*) as "rows", count(*) - count({c}) as missing, count(distinct {c}) as "unique" from {dirty_sql()}"""


@query("pr01_profile_counts", " union all ".join(_facts(c) for c in COLS))
def pr01(spark, sf):
    return profile_frame(dirty(spark, sf, *COLS), METAS, exact_unique=True).select("column", "rows", "missing", "unique")


@query("pr01_profile_numbers", f"""
    select 'price' as "column", count(price) as n, {r('avg(price)', 2)} as mean, {r('median(price)', 2)} as median, {r('skewness(price)')} as skew, count_if(price < 0) as negatives,
           {r('(count(*) - count(price)) * 1.0 / count(*)')} as missing_share from {dirty_sql()}""")
def pr01b(spark, sf):
    frame = profile_frame(dirty(spark, sf, *COLS), METAS).where("column = 'price'")
    return rounded(frame.select("column", "n", "mean", "median", "skew", "negatives", "missing_share"), 4, mean=2, median=2)


def _top(c):
    return f"(select '{c}' as \"column\", {c} as value, count(*) as n from {dirty_sql()} where {c} is not null group by 2 order by 3 desc, 2 limit 12)"


@query("pr01_top_values", f"select * from {_top('status')} union all select * from {_top('priority')}")
def pr01c(spark, sf):
    return top_per_column(column_counts(dirty(spark, sf, "status", "priority"), ["status", "priority"])).select("column", "value", "n")


@query("pr01_histogram", f"""
    with v as (select price as v, (select min(price) from {dirty_sql()}) as lo, (select max(price) from {dirty_sql()}) as hi from {dirty_sql()} where price is not null),
    b as (select cast(least(floor((v - lo) / ((hi - lo) / 24)), 23) as integer) as bin from v)
    select 'price' as "column", cast(g.i as integer) as bin, count(b.bin) as n from range(24) g(i) left join b on b.bin = g.i group by g.i""")
def pr01d(spark, sf):
    frame = profile_frame(dirty(spark, sf, *COLS), METAS).where("column = 'price'")
    return frame.select("column", F.posexplode("histogram").alias("bin", "n"))


@query("pr01_top_in_frame", f"select * from {_top('status')} union all select * from {_top('priority')}")
def pr01e(spark, sf):
    frame = profile_frame(dirty(spark, sf, *COLS), METAS)
    return frame.where("type = 'category'").select("column", F.explode("top").alias("t")).select("column", "t.value", "t.n")


@query("pr01_dates_in_frame", f"""
    select 'o_orderdate' as "column", min(o_orderdate) as first, max(o_orderdate) as last, case when date_diff('day', min(o_orderdate), max(o_orderdate)) > 2190 then 'year' else 'shorter' end as grain,
           count_if(o_orderdate > now() + interval 2 days) as future from {dirty_sql()}""")
def pr01f(spark, sf):
    frame = profile_frame(dirty(spark, sf, *COLS), METAS).where("column = 'o_orderdate'")
    kind = load(spark, sf, "orders").schema["o_orderdate"].dataType
    return frame.select("column", F.col("first").cast(kind).alias("first"), F.col("last").cast(kind).alias("last"), "grain", "future")


@query("pr01_text_length", f"""
    select 'text' as "column", {r('avg(length(text))')} as avg_length, cast(0 as bigint) as inconsistent, count_if(text <> trim(text, {WHITE})) as whitespace from documents
    union all select 'source', {r('avg(length(source))')}, 0, count_if(source <> trim(source, {WHITE})) from documents""")
def pr01g(spark, sf):
    metas = [ColumnMeta("text", "text"), ColumnMeta("source", "category")]
    frame = profile_frame(load(spark, sf, "documents").select("text", "source"), metas)
    return rounded(frame.select("column", "avg_length", "inconsistent", "whitespace"))


@query("pr02_inconsistent_labels", f"""
    with c as (select priority, regexp_replace(lower(priority), '[^\\p{{L}}\\p{{N}}]+', '', 'g') as key, count(*) as n from {dirty_sql()} group by 1)
    select 'priority' as "column", key, count(*) as spellings, cast(sum(n) as bigint) as "rows", first(priority order by n desc, priority) as best from c group by key having count(*) > 1""")
def pr02(spark, sf):
    return inconsistent_labels(dirty(spark, sf, "status", "priority"), ["status", "priority"])


KEY = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


def _label_sql(table, c):
    """Is a label column spelled in several ways, or with spaces around?"""
    return f"""((select count(*) from (select 1 from {table} where {c} is not null group by {KEY.format(c)} having count(distinct {c}) > 1)) > 0
                or (select count(*) from {table} where {c} <> trim({c}, {WHITE})) > 0)"""


def _weak_sql(table, c):
    return f"(select (count(distinct {c}) = 1 and count(*) > 1) or (count(*) - count({c})) > 0.95 * count(*) from {table})"


def _health_sql(table, cols, labels, numbers=()):
    """The five scores from the values; numbers are columns that cannot be negative by name."""
    miss = " + ".join(f"(select count(*) - count({c}) from {table})" for c in cols)
    bad = " + ".join([f"(select case when count_if({c} < 0) <= 0.05 * count(*) then count_if({c} < 0) else 0 end from {table})" for c in numbers] or ["0"])
    unclean = " + ".join(f"cast({_label_sql(table, c)} as integer)" for c in labels)
    weak = " + ".join(f"cast({_weak_sql(table, c)} as integer)" for c in cols)
    return f"""(select *, floor(0.3 * completeness + 0.2 * uniqueness + 0.2 * validity + 0.15 * consistency + 0.15 * structure + 0.5) as score from (
        select 100 * (1 - miss / (n * {len(cols)}.0)) as completeness, 100 * (1 - least(1, (n - u) * 8.0 / n)) as uniqueness, 100 * (1 - bad / (n * {len(cols)}.0 - miss)) as validity,
               greatest(0, 100 - 25.0 * unclean) as consistency, 100 * (1 - 0.8 * least(1, weak / {len(cols)}.0)) as structure
        from (select (select count(*) from {table}) as n, (select count(*) from (select distinct * from {table})) as u, {miss} as miss, {bad} as bad, {unclean} as unclean, {weak} as weak)))"""


HEALTH_COLS = ["o_orderkey", "price", "status", "priority", "fixed", "spaced"]
HEALTH_ROWS = """(select o_orderkey, price, status, priority, 'same' as fixed, case when o_orderkey % 4 = 0 then status || ' ' else status end as spaced from {0}
                  union all select o_orderkey, price, status, priority, 'same', case when o_orderkey % 4 = 0 then status || ' ' else status end from {0} where status = 'P')""".format(dirty_sql())


@query("pr03_health_score", f"""
    select {r('completeness')} as completeness, {r('uniqueness')} as uniqueness, {r('consistency')} as consistency, {r('structure')} as structure
    from {_health_sql(HEALTH_ROWS, HEALTH_COLS, ['status', 'priority', 'fixed', 'spaced'])}""")
def pr03(spark, sf):
    df = dirty(spark, sf, "o_orderkey", "price", "status", "priority").withColumn("fixed", F.lit("same")).withColumn(
        "spaced", F.when(F.col("o_orderkey") % 4 == 0, F.concat("status", F.lit(" "))).otherwise(F.col("status")))
    return rounded(health_score(df.unionByName(df.where("status = 'P'"))))


SIGNED = ["o_orderkey", "signed_price", "status", "priority", "o_orderdate"]
SIGNED_METAS = [ColumnMeta("o_orderkey", "id"), ColumnMeta("signed_price", "number"), ColumnMeta("status", "category"), ColumnMeta("priority", "category"), ColumnMeta("o_orderdate", "date")]
SIGNED_ROWS = f"(select o_orderkey, signed as signed_price, status, priority, o_orderdate from {dirty_sql()})"


def signed_rows(spark, sf):
    return dirty(spark, sf, "o_orderkey", "signed", "status", "priority", "o_orderdate").withColumnRenamed("signed", "signed_price")


@query("pr03_health_of_profile", " union all ".join(f"select '{k}' as part, {r(k)} as score from {_health_sql(SIGNED_ROWS, SIGNED, ['status', 'priority'], ['signed_price'])}"
                                                    for k in ("completeness", "uniqueness", "validity", "consistency", "structure", "score")))
def pr03b(spark, sf):
    return rounded(health_frame(spark, build_profile(signed_rows(spark, sf), SIGNED_METAS)))


@query("pr04_quality_issues", f"""
    select 'miss' as issue, 'price' as "column", count_if(price is null) as count from {dirty_sql()} having count_if(price is null) > 0
    union all select 'miss', 'status', count_if(status is null) from {dirty_sql()} having count_if(status is null) > 0
    union all select 'inc', 'priority', count(*) from (select regexp_replace(lower(priority), '[^\\p{{L}}\\p{{N}}]+', '', 'g') as k from {dirty_sql()} group by 1 having count(distinct priority) > 1) having count(*) > 0""")
def pr04(spark, sf):
    return issues_frame(spark, build_profile(dirty(spark, sf, *COLS), METAS)).select("issue", "column", "count")


def _dim_sql(table, c):
    return f"select 'dim' as role, '{c}' as \"column\" from {table} having count(distinct {c}) between 2 and 30 and count(*) - count({c}) < 0.3 * count(*)"


SPREADS = "(select l_orderkey % 1000 as alpha, l_discount as beta, l_tax as gamma, l_shipdate, l_returnflag, l_linestatus, cast(l_orderkey as varchar) as code from lineitem)"


@query("pr05_roles", f"""
    select 'measure' as role, name as "column" from (select unnest(['alpha', 'beta', 'gamma']) as name, unnest([stddev(alpha) / abs(avg(alpha)), stddev(beta) / abs(avg(beta)), stddev(gamma) / abs(avg(gamma))]) as cv from {SPREADS})
    qualify row_number() over (order by cv desc) = 1
    union all select 'date', 'l_shipdate' from {SPREADS} having count(distinct l_shipdate) > 3
    union all {_dim_sql(SPREADS, 'l_returnflag')} union all {_dim_sql(SPREADS, 'l_linestatus')} union all {_dim_sql(SPREADS, 'code')}""")
def pr05(spark, sf):
    """No column is named like a measure, so the one that varies most is it; a column of many levels is no dimension."""
    df = load(spark, sf, "lineitem").select((F.col("l_orderkey") % 1000).alias("alpha"), F.col("l_discount").alias("beta"), F.col("l_tax").alias("gamma"), "l_shipdate", "l_returnflag", "l_linestatus",
                                            F.col("l_orderkey").cast("string").alias("code"))
    roles = build_profile(df).roles
    return spark.createDataFrame([("measure", roles["measure"]), ("date", roles["date"]), *[("dim", d) for d in roles["dims"]]], "role string, column string")


_ISSUES = f"""
    select 'miss' as item, 'status' as "column", count_if(status is null) as n from {SIGNED_ROWS} having count_if(status is null) > 0
    union all select 'inc', 'priority', count(*) from (select {KEY.format('priority')} as k from {SIGNED_ROWS} group by 1 having count(distinct priority) > 1) having count(*) > 0
    union all select 'neg', 'signed_price', count_if(signed_price < 0) from {SIGNED_ROWS} having count_if(signed_price < 0) between 1 and 0.05 * count(*)
    union all select 'out', 'signed_price', count_if(signed_price < q1 - 3 * (q3 - q1) or signed_price > q3 + 3 * (q3 - q1))
              from {SIGNED_ROWS}, (select quantile_cont(signed_price, 0.25) as q1, quantile_cont(signed_price, 0.75) as q3 from {SIGNED_ROWS})
              having count_if(signed_price < q1 - 3 * (q3 - q1) or signed_price > q3 + 3 * (q3 - q1)) between 1 and 0.01 * count(*) - 1"""


@query("pr06_quality_audit", " union all ".join(f"select 'health' as section, '{k}' as item, null as \"column\", {r(k)} as score from {_health_sql(SIGNED_ROWS, SIGNED, ['status', 'priority'], ['signed_price'])}"
                                                for k in ("completeness", "uniqueness", "validity", "consistency", "structure", "score"))
       + f" union all select 'issue', item, \"column\", cast(n as double) from ({_ISSUES})")
def pr06(spark, sf):
    return rounded(quality_audit(spark, build_profile(signed_rows(spark, sf), SIGNED_METAS)))


def _levels(c):
    return f"""(select string_agg({c} || ' (' || n || ')', ', ' order by n desc, {c}) from (select {c}, count(*) as n from {dirty_sql()} where {c} is not null group by 1 order by 2 desc, 1 limit 5))"""


@query("pr07_schema_summary", f"""
    select 'o_orderkey' as "column", 'id' as type, count(*) - count(o_orderkey) as missing, '' as role, count(distinct o_orderkey) || ' distinct' as detail from {dirty_sql()}
    union all select 'price', 'number', count(*) - count(price), 'measure', format('min {{:g}}, median {{:g}}, max {{:g}}', min(price), median(price), max(price)) from {dirty_sql()}
    union all select 'status', 'category', count(*) - count(status), 'dimension', count(distinct status) || ' distinct: ' || {_levels('status')} from {dirty_sql()}
    union all select 'priority', 'category', count(*) - count(priority), 'dimension', count(distinct priority) || ' distinct: ' || {_levels('priority')} from {dirty_sql()}
    union all select 'o_orderdate', 'date', count(*) - count(o_orderdate), 'date', strftime(min(o_orderdate), '%Y-%m-%d') || ' to ' || strftime(max(o_orderdate), '%Y-%m-%d') from {dirty_sql()}""")
def pr07(spark, sf):
    return schema_summary(spark, build_profile(dirty(spark, sf, *COLS), METAS, exact_unique=True)).drop("unit")


# --- DS: findings ---
def returned_lines(spark, sf):
    return load(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice", "l_quantity", "l_discount", "l_shipdate", "l_linestatus", F.col("l_linenumber").cast("string").alias("line"),
                                              F.when(F.col("l_returnflag") == "R", "Yes").otherwise("No").alias("returned"))


@query("ds01_discover")
def ds01(spark, sf):
    return findings.discover(dirty(spark, sf, "price", "spiked", "status", "priority", "o_orderdate"))


@query("ds01_evidence_cube", f"""
    select case when grouping(l_returnflag) = 0 then 'l_returnflag' when grouping(l_linestatus) = 0 then 'l_linestatus' when grouping(line) = 0 then 'line' end as dim_a,
           case when grouping(l_returnflag) = 0 and grouping(l_linestatus) = 0 then 'l_linestatus' when (grouping(l_returnflag) = 0 or grouping(l_linestatus) = 0) and grouping(line) = 0 then 'line' end as dim_b,
           case when grouping(l_returnflag) = 0 then l_returnflag when grouping(l_linestatus) = 0 then l_linestatus else line end as a,
           case when grouping(l_returnflag) = 0 and grouping(l_linestatus) = 0 then l_linestatus when (grouping(l_returnflag) = 0 or grouping(l_linestatus) = 0) and grouping(line) = 0 then line end as b,
           count(*) as "rows", count(v) as n, {r('avg(v)', 2)} as mean, {r('sqrt(var_pop(v))', 2)} as sd, {r('sum(v)', 2)} as total, count_if(l_discount is not null) as known, count_if(l_discount > 0.05) as hits
    from (select l_returnflag, l_linestatus, cast(l_linenumber as varchar) as line, l_discount, case when l_orderkey % 7 = 0 then null else l_extendedprice end as v from lineitem)
    group by grouping sets ((), (l_returnflag), (l_linestatus), (line), (l_returnflag, l_linestatus), (l_returnflag, line), (l_linestatus, line))""")
def ds01b(spark, sf):
    """Every number that the finders of shares, group tests, associations and unusual cells read."""
    df = load(spark, sf, "lineitem").withColumn("line", F.col("l_linenumber").cast("string")).withColumn("v", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_extendedprice")))
    cube = evidence_cube(df, ["l_returnflag", "l_linestatus", "line"], "v", F.col("l_discount") > 0.05)
    return rounded(cube.withColumn("sd", F.sqrt(F.col("m2") / F.col("n"))).drop("m2"), 2)


BOOSTED = "(select date_trunc('month', o_orderdate) as p, sum(o_totalprice * case when o_orderdate >= timestamp '1996-03-01' and o_orderdate < timestamp '1996-04-01' then 4 else 1 end) as v from orders group by 1)"
WHOLE_MONTHS = "(select p, v from (select p, v, lead(p) over w is null as tail, avg(v) over (order by p rows between 3 preceding and 1 preceding) as before, count(*) over () as n from {0} window w as (order by p)) where not (tail and n > 4 and v < before / 2))"


@query("ds02_spike_finding", f"""
    with c as (select p, v / lag(v) over (order by p) - 1 as ch from {WHOLE_MONTHS.format(BOOSTED)}), s as (select stddev_samp(ch) as sd from c)
    select 'spike' as id, strftime(p, '%Y-%m') as period, {r('ch')} as change, {r('80 + least(10, abs(ch) * 10)')} as score from c, s where abs(ch) > 0.15 and abs(ch) > 1.8 * sd order by abs(ch) desc, p limit 1""")
def ds02b(spark, sf):
    boost = F.when((F.col("o_orderdate") >= F.lit("1996-03-01").cast("timestamp")) & (F.col("o_orderdate") < F.lit("1996-04-01").cast("timestamp")), 4).otherwise(1)
    df = load(spark, sf, "orders").select("o_orderdate", (F.col("o_totalprice") * boost).alias("v"))
    found = findings.findings_frame(spark, findings.time_findings(df, "o_orderdate", "v", "sum", "month")).where("id = 'spike'")
    return rounded(found.select("id", F.substring(F.col("evidence")["period"], 1, 7).alias("period"), F.col("evidence")["change"].cast("double").alias("change"), "score"))


RISING = "(select date_trunc('month', o_orderdate) as p, sum(o_totalprice * pow(2, date_diff('month', date_trunc('month', timestamp '1992-01-01'), date_trunc('month', o_orderdate)) / 2.0)) as v from orders group by 1)"


@query("ds02_streak_finding", f"""
    with i as (select row_number() over (order by p) as i, v, lag(v) over (order by p) as before from {WHOLE_MONTHS.format(RISING)}), s as (select max(i) - max(case when before is null or v <= before then i end) as streak from i)
    select 'streak' as id, cast(streak as bigint) as periods, 70.0 + streak as score from s where streak >= 3""")
def ds02c(spark, sf):
    months = (F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate") - 1
    df = load(spark, sf, "orders").select("o_orderdate", (F.col("o_totalprice") * F.pow(F.lit(2.0), months / 2)).alias("v"))
    found = findings.findings_frame(spark, findings.time_findings(df, "o_orderdate", "v", "sum", "month")).where("id = 'streak'")
    return rounded(found.select("id", F.col("evidence")["periods"].cast("long").alias("periods"), "score"))


@query("ds02_trend_evidence", f"""
    with m as (select date_trunc('week', ts) as p, sum(value) as v from events group by 1), i as (select p, v, row_number() over (order by p) - 1 as i, count(*) over () as n from m)
    select count(*) as n, {r('corr(i, v)', 6)} as r, {r('avg(case when i >= n - n // 2 then v end) / avg(case when i < n // 2 then v end) - 1')} as change from i""")
def ds02(spark, sf):
    frame = ts.period_values(load(spark, sf, "events"), "ts", "value", "sum", "week")
    change = ts.half_split_change(frame).select("change").scalar()
    return rounded(ts.trend_fit(frame).select("n", "r", change.alias("change")), 4, r=6)


@query("ds03_leading_share", f"""
    with g as (select status as level, sum(price) as v from {dirty_sql()} where status is not null group by 1)
    select 'status' as dim, first(level order by v desc, level) as level, {r('max(v)', 2)} as value, {r('max(v) / sum(v)', 6)} as share, count(*) as groups, {r('max(v) / sum(v) * count(*)')} as times_even from g""")
def ds03(spark, sf):
    return rounded(findings.leading_share(dirty(spark, sf, "status", "price"), "status", "price"), 4, value=2, share=6)


@query("ds04_anova_evidence", f"""
    with g as (select status, count(price) as n, avg(price) as m, var_samp(price) as v from {dirty_sql()} where status is not null and price is not null group by 1 having count(price) >= 2),
    s as (select sum(n) as total, count(*) as g, sum(n * m) / sum(n) as gm from g), b as (select total, g, sum(n * (m - gm) ** 2) as ssb, sum((n - 1) * v) as ssw from g, s group by all)
    select {r('(ssb / (g - 1)) / (ssw / (total - g))')} as f, {r('ssb / (ssb + ssw)', 6)} as eta2 from b""")
def ds04(spark, sf):
    return rounded(anova(dirty(spark, sf, "status", "price"), "price", "status").select("f", "eta2"), 4, eta2=6)


@query("ds05_unusual_cells", f"""
    with o as (select l_linestatus, cast(l_linenumber as varchar) as line, case when l_returnflag = 'R' then 1.0 else 0.0 end as hit, cast(l_tax as varchar) as tax from lineitem),
    c as (select 'l_linestatus' as dim_a, 'line' as dim_b, l_linestatus as a, line as b, count(*) as n, sum(hit) as k from o group by all)
    select dim_a, dim_b, a, b, n, cast(k as bigint) as k, {r('k / n')} as rate, {r('(k / n - (select avg(hit) from o)) / sqrt((select avg(hit) from o) * (1 - (select avg(hit) from o)) / n)')} as z from c where n >= 20""")
def ds05(spark, sf):
    return rounded(findings.unusual_cells(returned_lines(spark, sf), "returned", "Yes", ["l_linestatus", "line"]))


@query("ds06_correlation_evidence", f"""
    select 'l_quantity' as column_a, 'l_extendedprice' as column_b, {r('corr(l_quantity, l_extendedprice)', 6)} as r from lineitem where 1 = 1 having abs(corr(l_quantity, l_extendedprice)) between 0.2 and 0.985
    union all select 'l_quantity', 'l_discount', {r('corr(l_quantity, l_discount)', 6)} from lineitem where 1 = 1 having abs(corr(l_quantity, l_discount)) between 0.2 and 0.985
    union all select 'l_extendedprice', 'l_discount', {r('corr(l_extendedprice, l_discount)', 6)} from lineitem where 1 = 1 having abs(corr(l_extendedprice, l_discount)) between 0.2 and 0.985""")
def ds06(spark, sf):
    pairs = pearson(load(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return rounded(pairs.where(F.abs("r").between(0.2, 0.985) & (F.col("n") >= 10)).select("column_a", "column_b", "r"), 6)


@query("ds07_association_evidence", f"""
    with o as (select l_returnflag as a, l_linestatus as b, count(*) as n from lineitem group by all), ra as (select a, sum(n) as ra from o group by 1), rb as (select b, sum(n) as rb from o group by 1),
    e as (select coalesce(n, 0) as n, ra * rb * 1.0 / (select sum(n) from o) as e from ra cross join rb left join o using (a, b))
    select {r('sum((n - e) ** 2 / e)')} as chi2, {r('sqrt(sum((n - e) ** 2 / e) / sum(n) / least((select count(*) from ra) - 1, (select count(*) from rb) - 1))', 6)} as cramers_v from e""")
def ds07(spark, sf):
    return rounded(chi_square(load(spark, sf, "lineitem"), "l_returnflag", "l_linestatus").select("chi2", "cramers_v"), 4, cramers_v=6)


@query("ds08_skew_evidence", f"""
    select 'spiked' as "column", {r('skewness(spiked)')} as skew, abs(skewness(spiked)) > 1.5 as flagged from {dirty_sql()}
    union all select 'price', {r('skewness(price)')}, abs(skewness(price)) > 1.5 from {dirty_sql()}""")
def ds08(spark, sf):
    d = describe(dirty(spark, sf, "spiked", "price"), ["spiked", "price"])
    return rounded(d.select("column", "skew", (F.abs("skew") > 1.5).alias("flagged")))


@query("ds09_survey_evidence", f"""
    with i as (select 'q1' as item, count_if(q1 in ('{LIKERT[3]}', '{LIKERT[4]}')) * 1.0 / count(q1) as t from {dirty_sql()} union all select 'q2', count_if(q2 in ('{LIKERT[3]}', '{LIKERT[4]}')) * 1.0 / count(q2) from {dirty_sql()}
               union all select 'q3', count_if(q3 in ('{LIKERT[3]}', '{LIKERT[4]}')) * 1.0 / count(q3) from {dirty_sql()})
    select item, {r('t')} as top_two from i order by t desc, item limit 1""")
def ds09(spark, sf):
    orders = {c: list(LIKERT) for c in ("q1", "q2", "q3")}
    top = survey_summary(dirty(spark, sf, *orders), orders).orderBy(F.col("top_two").desc(), "item").limit(1)
    return rounded(top.select("item", "top_two"))


_SCORED = " , ".join(f"list_position([{', '.join(repr(x) for x in LIKERT)}], {q}) as {q}" for q in ("q1", "q2", "q3"))


@query("ds09_alpha_finding", f"""
    with s as (select {_SCORED} from {dirty_sql()}), c as (select * from s where q1 is not null and q2 is not null and q3 is not null)
    select 'alpha' as id, {r('1.5 * (1 - (var_samp(q1) + var_samp(q2) + var_samp(q3)) / var_samp(q1 + q2 + q3))')} as alpha, cast(3 as bigint) as items, count(*) as n, 60.0 as score from c having count(*) >= 3""")
def ds09b(spark, sf):
    orders = {c: list(LIKERT) for c in ("q1", "q2", "q3")}
    found = findings.findings_frame(spark, [findings.alpha_finding(cronbach_alpha(dirty(spark, sf, *orders), orders).first())])
    e = lambda k, kind: F.col("evidence")[k].cast(kind).alias(k)
    return rounded(found.select("id", e("alpha", "double"), e("items", "long"), e("n", "long"), "score"))


@query("ds10_quality_finding", f"""
    with i as (select count(*) as issues from ({_ISSUES})), h as (select score as health from {_health_sql(SIGNED_ROWS, SIGNED, ['status', 'priority'], ['signed_price'])})
    select 'quality' as id, issues, health, case when health < 85 then 75.0 else 40.0 end as score from i, h""")
def ds10(spark, sf):
    found = findings.findings_frame(spark, [findings.quality_finding(build_profile(signed_rows(spark, sf), SIGNED_METAS))])
    return found.select("id", F.col("evidence")["issues"].cast("long").alias("issues"), F.col("evidence")["score"].cast("double").alias("health"), "score")


@query("ds11_dominant_value", f"""
    select count(*) as "rows", {r('max(spiked)', 2)} as largest, {r('sum(spiked)', 2)} as total, {r('max(spiked) / sum(spiked)', 6)} as share from {dirty_sql()} where spiked > 0""")
def ds11(spark, sf):
    return rounded(findings.dominant_value(dirty(spark, sf, "spiked"), "spiked"), 2, share=6)


# --- PK: analyses by name ---
@query("pk01_run_group", f"""
    select status, {r('avg(price)', 2)} as mean_price, count(price) as n from {dirty_sql()} where status is not null group by 1""")
def pk01(spark, sf):
    return rounded(run(dirty(spark, sf, *COLS), "group", {"by": "status"}, METAS), 2)


@query("pk01_run_describe", f"""select 'price' as "column", count(price) as n, {r('avg(price)', 2)} as mean from {dirty_sql()}""")
def pk01b(spark, sf):
    return rounded(run(dirty(spark, sf, *COLS), "describe", None, METAS).select("column", "n", "mean"), 2)


@query("pk01_run_distribution", f"""
    with j as (select count(price) as n, skewness(price) as s, kurtosis(price) as k from {dirty_sql()}), t as (select *, n / 6.0 * (s * s + k * k / 4) as jb from j)
    select 'price' as "column", n, {r('s')} as skew, {r('k')} as kurt, {r('jb', 2)} as jb, {r('exp(-jb / 2)')} as p from t""")
def pk01c(spark, sf):
    """The tail of a chi-square with two degrees of freedom is exp(-x / 2)."""
    return rounded(run(dirty(spark, sf, *COLS), "distribution", {"col": "price"}, METAS), 4, jb=2)


@query("pk01_run_outliers", f"""
    with s as (select avg(price) as m, stddev_samp(price) as sd, quantile_cont(price, 0.25) as q1, quantile_cont(price, 0.75) as q3 from {dirty_sql('price')})
    select count(price) as n, count_if(price < q1 - 1.5 * (q3 - q1) or price > q3 + 1.5 * (q3 - q1)) as outside, count_if(abs((price - m) / sd) > 3) as far,
           {r('min(q1 - 1.5 * (q3 - q1))', 2)} as low, {r('min(q3 + 1.5 * (q3 - q1))', 2)} as high from {dirty_sql('price')}, s""")
def pk01d(spark, sf):
    return rounded(run(dirty(spark, sf, *COLS), "outliers", None, METAS), 2)


@query("pk01_run_crosstab", f"""
    with o as (select status as a, priority as b, count(*) as n from {dirty_sql()} where status is not null and priority is not null group by 1, 2), ra as (select a, sum(n) as ra from o group by 1), rb as (select b, sum(n) as rb from o group by 1),
    e as (select coalesce(n, 0) as n, ra * rb * 1.0 / (select sum(n) from o) as e from ra cross join rb left join o using (a, b))
    select cast(sum(n) as bigint) as n, {r('sum((n - e) ** 2 / e)')} as chi2, ((select count(*) from ra) - 1) * ((select count(*) from rb) - 1) as df, {r('avg(case when e < 5 then 1.0 else 0.0 end)')} as low_expected from e""")
def pk01e(spark, sf):
    return rounded(run(dirty(spark, sf, *COLS), "crosstab", {"a": "status", "b": "priority"}, METAS).select("n", "chi2", "df", "low_expected"))


@query("pk01_run_correlation", f"""
    select 'o_custkey' as column_a, 'price' as column_b, count(*) as n, {r('corr(o_custkey, price)', 6)} as r from {dirty_sql()} where price is not null
    union all select 'o_custkey', 'spiked', count(*), {r('corr(o_custkey, spiked)', 6)} from {dirty_sql()} union all select 'price', 'spiked', count(*), {r('corr(price, spiked)', 6)} from {dirty_sql()} where price is not null""")
def pk01f(spark, sf):
    cols = ["o_custkey", "price", "spiked"]
    return rounded(run(dirty(spark, sf, *cols), "correlation", {"cols": cols}).select("column_a", "column_b", "n", "r"), 6)


@query("pk01_run_regression", f"""
    select '(Intercept)' as term, {r('regr_intercept(spiked, price)', 2)} as coef from {dirty_sql()} union all select 'price', {r('regr_slope(spiked, price)', 2)} from {dirty_sql()}""")
def pk01g(spark, sf):
    return rounded(run(dirty(spark, sf, "price", "spiked"), "regression", {"target": "spiked", "predictors": ["price"]}).select("term", "coef"), 2)


@query("pk01_run_paired", f"""
    with d as (select spiked - price as d from {dirty_sql()} where price is not null)
    select count(*) as n, {r('avg(d)', 2)} as mean_diff, count(*) - 1 as df, {r('avg(d) / (stddev_samp(d) / sqrt(count(*)))')} as t from d""")
def pk01h(spark, sf):
    return rounded(run(dirty(spark, sf, "price", "spiked"), "paired", {"a": "spiked", "b": "price"}).select("n", "mean_diff", "df", "t"), 4, mean_diff=2)


@query("pk01_run_timeseries", f"""
    with y as (select date_trunc('year', o_orderdate) as p, avg(price) as v from {dirty_sql()} group by 1)
    select cast(p as date) as period, {r('v', 2)} as value, {r('v / nullif(lag(v) over (order by p), 0) - 1')} as change from y""")
def pk01i(spark, sf):
    made = run(dirty(spark, sf, *COLS), "timeseries", {"grain": "year"}, METAS)
    return rounded(made.select(F.col("period").cast("date").alias("period"), "value", "change"), 4, value=2)


@query("pk01_run_survey", " union all ".join(f"""select '{q}' as item, count({q}) as n, {r(f"avg(list_position([{', '.join(repr(x) for x in LIKERT)}], {q}))")} as mean_score from {dirty_sql()}""" for q in ("q1", "q2", "q3")))
def pk01j(spark, sf):
    metas = [ColumnMeta(q, "category", order=LIKERT, likert=True) for q in ("q1", "q2", "q3")]
    return rounded(run(dirty(spark, sf, "q1", "q2", "q3"), "survey", None, metas).select("item", "n", "mean_score"))


@query("pk01_run_quality", f"select item, \"column\", n as score from ({_ISSUES})")
def pk01k(spark, sf):
    found = run(signed_rows(spark, sf), "quality", None, SIGNED_METAS).where("section = 'issue'")
    return found.select("item", "column", F.col("score").cast("long").alias("score"))


@query("pk01_run_clusters", "select cast(3 as bigint) as segments, count(*) as \"rows\" from part")
def pk01l(spark, sf):
    made = run(load(spark, sf, "part").select("p_size", "p_retailprice"), "clusters", {"cols": ["p_size", "p_retailprice"], "k": 3})
    return made.agg(F.count(F.lit(1)).alias("segments"), F.sum("n").alias("rows"))


@query("pk02_package_stats")
def pk02(spark, sf):
    """Rows that each analysis of the package gives."""
    done = run_package(dirty(spark, sf, *COLS), "stats", METAS)
    counted = [frame.agg(F.lit(name).alias("analysis"), F.count(F.lit(1)).alias("n"), F.lit(None).cast("string").alias("problem")) if not isinstance(frame, str)
               else spark.range(1).select(F.lit(name).alias("analysis"), F.lit(0).cast("long").alias("n"), F.lit(frame).alias("problem")) for name, frame in done.items()]
    out = counted[0]
    for frame in counted[1:]:
        out = out.unionByName(frame)
    return out
