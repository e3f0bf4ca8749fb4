"""Filters (FP), aggregation (AG), sorting and sampling (SL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import dirty, dirty_sql, load, query, r, rounded
from tablewise.operators import filters
from tablewise.operators.aggregate import AggSpec, aggregate, auto_grain, bucket, group_summary, total_groups
from tablewise.operators.ordered import nth_row_sample, quantiles
from tablewise.operators.pivots import duplicate_count, top_values
from tablewise.operators.series import kpis


def _cast_day(df, col):
    return df.withColumn(col, F.col(col).cast("date"))


# --- FP: predicates, projections, derived columns ---
ORDER_COLS = "o_orderkey, status, price"
FILTERS = {
    "fp01_equals": (("status", "=", "f"), "lower(status) = 'f'"),
    "fp01_not_equals": (("status", "!=", "F"), "lower(status) <> 'f'"),
    "fp01_greater": (("price", ">", "$150,000"), "price > 150000"),
    "fp01_less": (("price", "<", 100000), "price < 100000"),
    "fp01_at_least": (("price", ">=", "200000"), "price >= 200000"),
    "fp01_at_most": (("o_orderdate", "<=", "31/12/1997"), "o_orderdate <= timestamp '1997-12-31'"),
    "fp01_contains": (("status", "contains", "o"), "lower(status) like '%o%'"),
    "fp01_in": (("status", "in", ["F", "P"]), "status in ('F', 'P')"),
}


def _filter_query(name, condition, test):
    @query(name, f"select {ORDER_COLS} from {dirty_sql()} where {test}")
    def run(spark, sf):
        return filters.filter_rows(dirty(spark, sf), *condition).select("o_orderkey", "status", "price")


for _name, (_condition, _test) in FILTERS.items():
    _filter_query(_name, _condition, _test)


@query("fp02_filtered_view", f"select {ORDER_COLS} from {dirty_sql()} where lower(status) <> 'f' and price >= 50000 and o_orderdate >= timestamp '1998-06-01'")
def fp02(spark, sf):
    view = filters.filtered_view(dirty(spark, sf), [("status", "!=", "F"), ("price", ">=", 50000), ("o_orderdate", ">=", "1998-06-01")])
    return view.select("o_orderkey", "status", "price")


@query("fp03_rename", "select r_regionkey as region_id, r_name from region")
def fp03(spark, sf):
    return filters.rename(load(spark, sf, "region"), "r_regionkey", "region_id")


@query("fp04_drop_column", "select n_nationkey, n_name from nation")
def fp04(spark, sf):
    return filters.drop_column(load(spark, sf, "nation"), "n_regionkey")


DERIVED = {
    "fp05_add": ("l_extendedprice", "+", "l_quantity", False, "l_extendedprice + l_quantity"),
    "fp05_subtract": ("l_extendedprice", "-", "l_quantity", False, "l_extendedprice - l_quantity"),
    "fp05_multiply": ("l_extendedprice", "*", 2, True, "l_extendedprice * 2"),
    "fp05_divide": ("l_extendedprice", "/", "l_tax", False, "l_extendedprice / nullif(l_tax, 0)"),
}


def _derive_query(name, a, op, b, constant, text):
    @query(name, f"select l_orderkey, l_linenumber, {r(text)} as made from lineitem")
    def run(spark, sf):
        return rounded(filters.derive(load(spark, sf, "lineitem"), "made", a, op, b, constant).select("l_orderkey", "l_linenumber", "made"))


for _name, _spec in DERIVED.items():
    _derive_query(_name, *_spec)


@query("fp06_preview", "select * from customer order by c_custkey limit 50")
def fp06(spark, sf):
    return filters.preview(load(spark, sf, "customer"), 50, ["c_custkey"])


# --- AG: grouped metrics ---
@query("ag01_group_by", f"""
    select status, {r('sum(price)', 2)} as sum_price, {r('avg(price)', 2)} as mean_price, count(*) as count from {dirty_sql()} where status is not null group by status""")
def ag01(spark, sf):
    spec = AggSpec(by=("status",), metrics=(("price", "sum"), ("price", "mean"), (None, "count")))
    return rounded(aggregate(dirty(spark, sf), spec), 2)


@query("ag01_missing_group", f"select coalesce(status, '(missing)') as status, count(*) as count from {dirty_sql()} group by 1")
def ag01b(spark, sf):
    return aggregate(dirty(spark, sf), AggSpec(by=("status",), drop_null=False))


@query("ag01_global_row", f"select {r('sum(price)', 2)} as sum_price from {dirty_sql()} where lower(status) = 'f' having count(*) > 0")
def ag01c(spark, sf):
    return rounded(aggregate(dirty(spark, sf), AggSpec(metrics=(("price", "sum"),), filters=(("status", "=", "F"),))), 2)


@query("ag01_nothing_passes", f"select {r('sum(price)', 2)} as sum_price from {dirty_sql()} where status = 'nowhere' having count(*) > 0")
def ag01d(spark, sf):
    return rounded(aggregate(dirty(spark, sf), AggSpec(metrics=(("price", "sum"),), filters=(("status", "=", "nowhere"),))), 2)


@query("ag02_sum_of_nothing", f"""
    select status, {r("coalesce(sum(case when status = 'F' then null else price end), 0)", 2)} as sum_v from {dirty_sql()} where status is not null group by status""")
def ag02(spark, sf):
    df = dirty(spark, sf).withColumn("v", F.when(F.col("status") != "F", F.col("price")))
    return rounded(aggregate(df, AggSpec(by=("status",), metrics=(("v", "sum"),))), 2)


@query("ag03_mean_min_max", f"""
    select l_returnflag, {r('avg(l_extendedprice)')} as mean_l_extendedprice, min(l_extendedprice) as min_l_extendedprice, max(l_extendedprice) as max_l_extendedprice
    from lineitem group by l_returnflag""")
def ag03(spark, sf):
    spec = AggSpec(by=("l_returnflag",), metrics=tuple(("l_extendedprice", a) for a in ("mean", "min", "max")))
    return rounded(aggregate(load(spark, sf, "lineitem"), spec))


@query("ag04_median", f"select l_returnflag, l_linestatus, {r('median(l_extendedprice)')} as median_l_extendedprice from lineitem group by all")
def ag04(spark, sf):
    return rounded(aggregate(load(spark, sf, "lineitem"), AggSpec(by=("l_returnflag", "l_linestatus"), metrics=(("l_extendedprice", "median"),))))


@query("ag04_median_by_ranges", f"select l_returnflag, {r('median(l_extendedprice)')} as med, {r('quantile_cont(l_extendedprice, 0.9)')} as p90 from lineitem group by all")
def ag04b(spark, sf):
    """Two quantiles of each group from the same histograms."""
    return rounded(quantiles(load(spark, sf, "lineitem"), "l_extendedprice", {"med": 0.5, "p90": 0.9}, ["l_returnflag"]))


@query("ag05_std", f"select c_mktsegment, {r('stddev_samp(c_acctbal)')} as std_c_acctbal from customer group by all")
def ag05(spark, sf):
    return rounded(aggregate(load(spark, sf, "customer"), AggSpec(by=("c_mktsegment",), metrics=(("c_acctbal", "std"),))))


@query("ag06_count", f"select status, count(price) as count from {dirty_sql()} where status is not null group by status")
def ag06(spark, sf):
    return aggregate(dirty(spark, sf), AggSpec(by=("status",), metrics=(("price", "count"),)))


@query("ag07_count_distinct", "select o_orderpriority, count(distinct o_custkey) as count_distinct_o_custkey from orders group by all")
def ag07(spark, sf):
    return aggregate(load(spark, sf, "orders"), AggSpec(by=("o_orderpriority",), metrics=(("o_custkey", "count_distinct"),)))


@query("ag08_sorted_limited", f"""
    select o_custkey, {r('sum(o_totalprice)', 2)} as sum_o_totalprice from orders group by o_custkey order by 2 desc, 1 limit 10""")
def ag08(spark, sf):
    spec = AggSpec(by=("o_custkey",), metrics=(("o_totalprice", "sum"),), sort=("sum_o_totalprice", "desc"), limit=10)
    return rounded(aggregate(load(spark, sf, "orders"), spec), 2)


@query("ag08_total_groups", "select count(distinct o_custkey) as total_groups from orders")
def ag08b(spark, sf):
    return total_groups(load(spark, sf, "orders"), AggSpec(by=("o_custkey",), metrics=(("o_totalprice", "sum"),)))


def _bucket_query(grain):
    @query(f"ag09_bucket_{grain}", f"""
        select cast(date_trunc('{grain}', o_orderdate) as date) as o_orderdate, {r('sum(o_totalprice)', 2)} as sum_o_totalprice from orders group by 1""")
    def run(spark, sf):
        spec = AggSpec(by=("o_orderdate",), metrics=(("o_totalprice", "sum"),), time_grain=grain)
        return rounded(_cast_day(aggregate(load(spark, sf, "orders"), spec), "o_orderdate"), 2)


for _grain in ("day", "week", "month", "quarter", "year"):
    _bucket_query(_grain)


@query("ag10_auto_grain", """
    with d as (select (epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) / 86400e6 as a from orders), e as (select (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400e6 as a from events)
    select 'orders' as source, case when a > 2190 then 'year' when a > 912.5 then 'quarter' when a > 75 then 'month' when a > 20 then 'week' else 'day' end as grain from d
    union all select 'events', case when a > 2190 then 'year' when a > 912.5 then 'quarter' when a > 75 then 'month' when a > 20 then 'week' else 'day' end from e""")
def ag10(spark, sf):
    orders, events = load(spark, sf, "orders"), load(spark, sf, "events")
    grains = [("orders", auto_grain(orders, "o_orderdate")), ("events", auto_grain(events, "ts"))]
    return spark.createDataFrame(grains, "source string, grain string")


@query("ag11_group_summary", f"""
    select l_returnflag, {r('sum(l_quantity)')} as sum_l_quantity, count(l_quantity) as n, {r('sum(l_quantity) / sum(sum(l_quantity)) over ()')} as share
    from lineitem where l_returnflag is not null group by 1""")
def ag11(spark, sf):
    return rounded(group_summary(load(spark, sf, "lineitem"), "l_returnflag", "l_quantity", "sum"))


@query("ag11_group_mean", f"select l_returnflag, {r('avg(l_discount)', 6)} as mean_l_discount, count(*) as n from lineitem group by 1")
def ag11b(spark, sf):
    return rounded(group_summary(load(spark, sf, "lineitem"), "l_returnflag", "l_discount", "mean"), 6)


@query("ag11_group_rows", f"select p_type, count(*) as count, {r('count(*) / sum(count(*)) over ()')} as share from part group by 1")
def ag11c(spark, sf):
    return rounded(group_summary(load(spark, sf, "part"), "p_type"))


@query("ag18_top_values", "select o_custkey, count(*) as n from orders group by 1 order by 2 desc, 1 limit 12")
def ag18(spark, sf):
    return top_values(load(spark, sf, "orders"), "o_custkey", 12)


@query("ag20_kpis", f"""
    with m as (select date_trunc('month', o_orderdate) as p, sum(o_totalprice) as v from orders group by 1),
    i as (select *, row_number() over (order by p) - 1 as i, count(*) over () as n from m),
    h as (select sum(case when i < n // 2 then v end) as a, sum(case when i >= n - n // 2 then v end) as b from i)
    select {r('sum(o_totalprice)', 2)} as value, count(*) as "rows", 6 as "columns", (select {r('b / a - 1')} from h) as delta from orders""")
def ag20(spark, sf):
    return rounded(kpis(load(spark, sf, "orders"), "o_totalprice", "sum", "o_orderdate", "month"), 4, value=2)


DUPLICATED = "(select o_orderkey, o_orderstatus, o_totalprice from orders union all select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderpriority = '1-URGENT')"


@query("ag21_duplicate_count", f"""
    select count(*) as "rows", (select count(*) from (select distinct * from {DUPLICATED})) as distinct_rows,
           count(*) - (select count(*) from (select distinct * from {DUPLICATED})) as duplicates from {DUPLICATED}""")
def ag21(spark, sf):
    orders = load(spark, sf, "orders")
    cols = ["o_orderkey", "o_orderstatus", "o_totalprice"]
    return duplicate_count(orders.select(*cols).unionByName(orders.where(F.col("o_orderpriority") == "1-URGENT").select(*cols)))


# --- SL: order, limits, samples ---
@query("sl01_sort_missing_first", f"select o_orderkey, price from {dirty_sql()}")
def sl01(spark, sf):
    return filters.sort_rows(dirty(spark, sf, "o_orderkey", "price"), "price")


@query("sl02_top_k", "select p_partkey, p_retailprice from part order by p_retailprice desc, p_partkey limit 20")
def sl02(spark, sf):
    return filters.top_k(load(spark, sf, "part"), "p_retailprice", 20, ["p_partkey"]).select("p_partkey", "p_retailprice")


@query("sl02_bottom_k", "select p_partkey, p_retailprice from part order by p_retailprice, p_partkey limit 20")
def sl02b(spark, sf):
    return filters.top_k(load(spark, sf, "part"), "p_retailprice", 20, ["p_partkey"], bottom=True).select("p_partkey", "p_retailprice")


@query("sl03_systematic_sample", "select event_id, value from events where event_id % 7 = 0")
def sl03(spark, sf):
    return filters.systematic_sample(load(spark, sf, "events"), "event_id", 7).select("event_id", "value")


@query("sl03_every_nth_row", """
    select event_id, value from (select *, row_number() over (order by ts, event_id) - 1 as i from events) where i % 9 = 0""")
def sl03b(spark, sf):
    return nth_row_sample(load(spark, sf, "events"), 9, ["ts", "event_id"]).select("event_id", "value")


@query("sl05_distinct_values", "select distinct p_brand from part order by 1 limit 200")
def sl05(spark, sf):
    return filters.distinct_values(load(spark, sf, "part"), "p_brand")
