"""Compare registered queries with their DuckDB SQL: python tests/check_oracles.py <sf> [name part ...]"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    import decimal

    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def same(a, b, loose=False):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool) and not isinstance(b, bool):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) if loose else a == b
    return a == b


def kind(v):
    return "num" if isinstance(v, (int, float)) and not isinstance(v, bool) else type(v).__name__


def compare(spark, con, sf_dir, name, query, sql):
    start = time.time()
    df = query(spark, sf_dir)
    got_rows = [tuple(r) for r in df.collect()]
    spent = time.time() - start
    if sql is None:
        return f"rows {len(got_rows)}", spent, True
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want_rows = cur.fetchall()
    if sorted(df.columns) != sorted(cols):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(cols)}", spent, False
    got, want = rows_of(df.columns, got_rows), rows_of(cols, want_rows)
    if len(got) != len(want):
        return f"ROWS {len(got)} vs {len(want)}", spent, False
    bad = [(g, w) for g, w in zip(got, want) if not all(same(x, y) for x, y in zip(g, w))]
    if bad:
        near = all(len(g) == len(w) and all(same(x, y, True) for x, y in zip(g, w)) for g, w in bad)
        return f"VALUES {len(bad)} of {len(got)} differ{' (only in the last bits)' if near else ''}: {bad[0][0]} vs {bad[0][1]}", spent, False
    for i, c in enumerate(sorted(df.columns)):
        kinds = {(kind(g[i]), kind(w[i])) for g, w in zip(got, want) if g[i] is not None}
        mixed = {(type(g[i]).__name__, type(w[i]).__name__) for g, w in zip(got, want) if g[i] is not None and type(g[i]) is not type(w[i])}
        if any(a != b for a, b in kinds) or mixed:
            return f"TYPES {c}: {kinds} {mixed}", spent, False
    return f"ok {len(got)}", spent, True


def main(argv):
    import duckdb

    import __spark_entry__ as entry
    from tablewise.session import build_session

    sf_dir = f"/root/testdata/sf{argv[0]}"
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    oracles = entry.oracle_sql()
    failed = []
    for name, query in entry.queries().items():
        if argv[1:] and not any(part in name for part in argv[1:]):
            continue
        try:
            text, spent, fine = compare(spark, con, sf_dir, name, query, oracles.get(name))
        except Exception as error:  # report every query, whatever stops it
            text, spent, fine = f"ERROR {type(error).__name__}: {str(error)[:600]}", 0.0, False
        if not fine:
            failed.append(name)
        print(f"{'' if fine else '!! '}{name}: {text} [{spent:.2f}s]", flush=True)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
