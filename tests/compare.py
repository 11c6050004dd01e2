"""Run registered queries against their SQL twins and report differences."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

import __spark_entry__ as registry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    return x


def _rows(names: list[str], rows: list) -> list:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def kinds(spark_type: str) -> str:
    return {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE",
            "boolean": "BOOLEAN", "timestamp": "TIMESTAMP WITH TIME ZONE"}.get(spark_type, spark_type)


def compare(spark, con, name: str, sf_dir: str) -> str | None:
    """None when both sides agree, else what differs."""
    df = registry.queries()[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return None
    cur = con.execute(sql)
    columns = [(d[0], str(d[1])) for d in cur.description]
    want = cur.fetchall()
    mine = sorted((f.name, kinds(f.dataType.simpleString())) for f in df.schema)
    if mine != sorted(columns):
        return f"schema {[x for x in mine if x not in columns]} vs {[x for x in columns if x not in mine]}"
    a, b = _rows(df.columns, got), _rows([c for c, _ in columns], want)
    if len(a) != len(b):
        return f"{len(a)} rows, expected {len(b)}"
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(bad)} rows differ, first: {bad[0]}"
    return None


if __name__ == "__main__":
    from jobfacts.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(registry.queries())
    spark, con = local_session(), duck(sf_dir)
    failed = 0
    for query in wanted:
        began = time.time()
        try:
            problem = compare(spark, con, query, sf_dir)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {query} {time.time() - began:.2f}s {problem or ''}", flush=True)
    print("failed:", failed, "missing SQL:", [q for q in registry.queries() if q not in registry.oracle_sql()])
