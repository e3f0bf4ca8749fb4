"""Registered queries against DuckDB on the smallest tables: one query per inventory entry; all with TABLEWISE_ALL=1."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.check_oracles import TABLES, compare

SF_DIR = "/root/testdata/sf0.001"
SLOW = {"cl29", "ml02", "ml03", "cl26", "ds01", "pk02"}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


def chosen():
    if os.environ.get("TABLEWISE_ALL"):
        return list(entry.queries())
    seen = {}
    for name in entry.queries():
        seen.setdefault(name.split("_")[0], name)
    return [name for key, name in seen.items() if key not in SLOW]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", chosen())
def test_query(spark, con, name):
    text, _, fine = compare(spark, con, SF_DIR, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert fine, text


def test_entry(spark):
    assert entry.entry(spark).columns == ["l_returnflag", "sum_l_quantity", "n", "share"] and entry.entry(spark).count() == 3
