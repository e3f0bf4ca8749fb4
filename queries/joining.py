"""Joins and relationship discovery (JN), key intersection (SO)."""

from __future__ import annotations

import re
from itertools import combinations

from pyspark.sql import functions as F

from queries.base import load, query, r, rounded
from tablewise.operators.joins import find_relationships, join_tables, normalise_name, relationship_kind


@query("jn01_inner_join", "select o_orderkey, o_totalprice, c_name, c_mktsegment from orders join customer on o_custkey = c_custkey")
def jn01(spark, sf):
    out = join_tables(load(spark, sf, "orders"), load(spark, sf, "customer"), "o_custkey", "c_custkey", "inner", "customer")
    return out.select("o_orderkey", "o_totalprice", "c_name", "c_mktsegment")


@query("jn01_text_key", """
    select o_orderkey, c_name from (select o_orderkey, case when o_orderkey % 19 = 0 then null else cast(o_custkey as varchar) end as k from orders) o
    join customer c on o.k = cast(c.c_custkey as varchar)""")
def jn01b(spark, sf):
    orders = load(spark, sf, "orders").selectExpr("o_orderkey", "case when o_orderkey % 19 = 0 then null else cast(o_custkey as string) end as k")
    return join_tables(orders, load(spark, sf, "customer"), "k", "c_custkey", "inner").select("o_orderkey", "c_name")


@query("jn02_left_join", """
    select c_custkey, c_name, s_name, s.c_acctbal as c_acctbal_supplier from customer c left join
    (select s_suppkey, s_name, s_acctbal as c_acctbal from supplier) s on c_custkey = s_suppkey""")
def jn02(spark, sf):
    supplier = load(spark, sf, "supplier").select("s_suppkey", "s_name", F.col("s_acctbal").alias("c_acctbal"))
    return join_tables(load(spark, sf, "customer"), supplier, "c_custkey", "s_suppkey", "left", "supplier").select(
        "c_custkey", "c_name", "s_name", "c_acctbal_supplier")


@query("jn02_left_join_salted", """
    select l_orderkey, l_linenumber, l_quantity, r_name from lineitem left join (select case r_regionkey when 0 then 'N' when 1 then 'R' else concat('x', r_regionkey) end as flag, r_name from region) on l_returnflag = flag""")
def jn02b(spark, sf):
    """Three flags hold all rows: every key is hot and gets salted."""
    region = load(spark, sf, "region").selectExpr("case r_regionkey when 0 then 'N' when 1 then 'R' else concat('x', r_regionkey) end as flag", "r_name")
    out = join_tables(load(spark, sf, "lineitem"), region, "l_returnflag", "flag", "left", salt_share=0.2, salts=8)
    return out.select("l_orderkey", "l_linenumber", "l_quantity", "r_name")


def plain_name(name: str) -> str:
    """Names without their table prefix."""
    return normalise_name(re.sub(r"^[a-z]{1,2}_", "", name))


def _pair(ta, ca, tb, cb):
    u = lambda t, c: f"(select count(distinct {c}) * 1.0 / count(*) from {t})"
    ua, ub = u(ta, ca), u(tb, cb)
    return f"""select '{ta}' as table_a, '{ca}' as column_a, '{tb}' as table_b, '{cb}' as column_b,
        (round((select count(*) from (select distinct {ca} from {ta} intersect select distinct {cb} from {tb})) * 1.0
            / least((select count(distinct {ca}) from {ta}), (select count(distinct {cb}) from {tb})), 4) + 0.0) as overlap,
        case when {ua} > 0.95 and {ub} < 0.95 then 'one-to-many' when {ub} > 0.95 and {ua} < 0.95 then 'many-to-one'
             when {ua} > 0.95 and {ub} > 0.95 then 'one-to-one' else 'many-to-many' end as kind"""


PAIRS = [("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey")]


@query("jn03_find_relationships", "select * from (" + " union all ".join(_pair(*p) for p in PAIRS) + ") where overlap >= 0.3")
def jn03(spark, sf):
    return rounded(find_relationships({t: load(spark, sf, t) for t in ("orders", "customer", "nation", "region")}, normalise=plain_name))


ALL_PAIRS = [*PAIRS, ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
             ("customer", "c_nationkey", "supplier", "s_nationkey"), ("customer", "c_acctbal", "supplier", "s_acctbal"), ("supplier", "s_nationkey", "nation", "n_nationkey"),
             *[(a, f"{a[0]}_name", b, f"{b[0]}_name") for a, b in combinations(("customer", "supplier", "part", "nation", "region"), 2)]]


@query("jn03_all_tables", "select * from (" + " union all ".join(_pair(*p) for p in ALL_PAIRS) + ") where overlap >= 0.3")
def jn03b(spark, sf):
    """Every column of every table; order keys are too many for a sketch and are counted."""
    names = ("lineitem", "orders", "customer", "supplier", "part", "nation", "region", "events")
    return rounded(find_relationships({t: load(spark, sf, t) for t in names}, normalise=plain_name))


@query("jn04_relationship_kind", """
    with a as (select count(distinct l_partkey) * 1.0 / count(*) as u from lineitem), b as (select count(distinct p_partkey) * 1.0 / count(*) as u from part)
    select case when a.u > 0.95 and b.u < 0.95 then 'one-to-many' when b.u > 0.95 and a.u < 0.95 then 'many-to-one'
                when a.u > 0.95 and b.u > 0.95 then 'one-to-one' else 'many-to-many' end as kind from a, b""")
def jn04(spark, sf):
    share = lambda df, c: df.agg((F.count_distinct(c) / F.count(F.lit(1))).alias("u")).scalar()
    lines, parts = load(spark, sf, "lineitem"), load(spark, sf, "part")
    return lines.agg((F.count_distinct("l_partkey") / F.count(F.lit(1))).alias("ua")).select(relationship_kind(F.col("ua"), share(parts, "p_partkey")).alias("kind"))


@query("so01_key_intersection", "select l_suppkey as k from lineitem intersect select s_suppkey from supplier")
def so01(spark, sf):
    return load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k")).intersect(load(spark, sf, "supplier").select("s_suppkey"))
