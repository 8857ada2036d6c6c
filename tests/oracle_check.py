"""Compare registered queries with their SQL: `python tests/oracle_check.py [sf_dir] [name ...]`."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, db, sf_dir: str, query, sql: str) -> str | None:
    """None when both give the same rows, else what differs."""
    df = query(spark, sf_dir)
    mine = _rows(df.columns, [tuple(r) for r in df.collect()])
    result = db.execute(sql)
    theirs = _rows([d[0] for d in result.description], result.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} != {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"rows {len(mine[1])} != {len(theirs[1])}"
    for a, b in zip(mine[1], theirs[1]):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{str(a)[:700]}\n  != {str(b)[:700]}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from reviewloom.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, db = local_session("8"), connect(sf)
    queries, sqls = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            if name in sqls:
                verdict = compare(spark, db, sf, queries[name], sqls[name]) or "equal"
            else:
                verdict = f"{len(queries[name](spark, sf).collect())} rows, no SQL"
        except Exception as error:  # report and go on with the next query
            verdict = f"FAILED {type(error).__name__}: {str(error)[:1500]}"
        print(f"{name}: {verdict} ({time.time() - start:.1f}s)", flush=True)
