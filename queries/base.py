"""Registry, table loading and the dirt recipes both engines share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is what DuckDB should find on the same tables."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"Query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def load(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf}/{table}.parquet")


def rounded(df: DataFrame, digits: int = 4, /, **special: int) -> DataFrame:
    """Doubles rounded for comparison: sums depend on the order of addition in the last bits."""
    made = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        made.append(F.round(c, special.get(f.name, digits)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c)
    return df.select(*made)


def r(expr: str, digits: int = 4) -> str:
    """The same rounding in SQL; adding zero turns a negative zero into zero."""
    return f"(round({expr}, {digits}) + 0.0)"


# Orders with gaps, label variants, spikes, negatives and survey answers, derived from the keys.
LIKERT = ("Strongly disagree", "Disagree", "Neutral", "Agree", "Strongly agree")


def likert_case(key: str) -> str:
    return f"case {key} when 0 then '{LIKERT[0]}' when 1 then '{LIKERT[1]}' when 2 then '{LIKERT[2]}' when 3 then '{LIKERT[3]}' else '{LIKERT[4]}' end"


DIRTY_ORDERS = {
    "o_orderkey": "o_orderkey",
    "o_custkey": "o_custkey",
    "o_orderdate": "o_orderdate",
    "price": "case when o_orderkey % 17 = 0 then null else o_totalprice end",
    "status": "case when o_orderkey % 23 = 0 then null else o_orderstatus end",
    "priority": "case when o_orderkey % 31 = 0 then lower(o_orderpriority) when o_orderkey % 37 = 0 then concat(o_orderpriority, ' ') else o_orderpriority end",
    "spiked": "case when o_orderkey % 101 = 0 then o_totalprice * 50 else o_totalprice end",
    "signed": "case when o_orderkey % 97 = 0 then -o_totalprice else o_totalprice end",
    "q1": likert_case("o_orderkey % 5"),
    "q2": f"case when o_orderkey % 50 = 7 then null else {likert_case('(o_orderkey + o_custkey) % 5')} end",
    "q3": likert_case("(o_custkey * 3) % 5"),
}


def dirty_sql(*cols: str) -> str:
    """The dirty orders as a parenthesised SELECT."""
    return "(select " + ", ".join(f"{DIRTY_ORDERS[c]} as {c}" for c in cols or DIRTY_ORDERS) + " from orders)"


def dirty(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    return load(spark, sf, "orders").selectExpr(*[f"{DIRTY_ORDERS[c]} as {c}" for c in cols or DIRTY_ORDERS])


GAPPY_EVENTS = {
    "event_id": "event_id",
    "ts": "ts",
    "event_type": "event_type",
    "value": "case when event_id % 7 in (1, 2, 5) then null else value end",
}


def gappy_sql() -> str:
    return "(select " + ", ".join(f"{e} as {c}" for c, e in GAPPY_EVENTS.items()) + " from events)"


def gappy(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").selectExpr(*[f"{e} as {c}" for c, e in GAPPY_EVENTS.items()])
