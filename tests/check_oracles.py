"""Compares registered queries with their SQL in DuckDB.

Usage: python tests/check_oracles.py SF [name-substring ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads=8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(float(v))
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=lambda t: tuple((x is None, x or "") for x in t))


def compare(spark, con, plan, sql, sf_dir):
    df = plan(spark, sf_dir)
    t0 = time.time()
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - t0
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    theirs = rows_of(cols, res.fetchall())
    problems = []
    if sorted(cols) != sorted(df.columns):
        problems.append(f"columns {sorted(df.columns)} vs {sorted(cols)}")
    if len(mine) != len(theirs):
        problems.append(f"rows {len(mine)} vs {len(theirs)}")
    if not problems and mine != theirs:
        bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
        problems.append(f"{len(bad)} rows differ, columns {sorted(cols)}: {bad[0]}")
    return problems, len(mine), spent


def main(argv):
    from vistagrid.session import local_session

    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/sf{argv[0]}"
    spark, con = local_session("checks"), duck(sf_dir)
    plans, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in plans:
        if len(argv) > 1 and not any(a in name for a in argv[1:]):
            continue
        try:
            if name in sqls:
                problems, n, spent = compare(spark, con, plans[name], sqls[name], sf_dir)
            else:
                t0 = time.time()
                n, problems = len(plans[name](spark, sf_dir).collect()), []
                spent = time.time() - t0
        except Exception as exc:  # report and go on with the next query
            problems, n, spent = [f"{type(exc).__name__}: {str(exc)[:1500]}"], 0, 0.0
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} rows={n} {spent:.2f}s{'' if name in sqls else ' (no sql)'} {'; '.join(problems)[:1800]}", flush=True)
    print(f"failed: {failed}")
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
