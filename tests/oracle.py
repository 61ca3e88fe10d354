"""Compare registered queries with their DuckDB SQL: `python -m tests.oracle <folder> [query ...]`."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

from catalog.inputs import TABLES


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def duckdb_rows(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    found = con.execute(sql)
    return [d[0] for d in found.description], found.fetchall()


def difference(spark, sf_dir: str, query, sql: str) -> str | None:
    """What differs between a query and its SQL, or None."""
    df = query(spark, sf_dir)
    ours = df.collect()
    columns, theirs = duckdb_rows(sf_dir, sql)
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}"
    a, b = bag(df.columns, ours), bag(columns, theirs)
    if a != b:
        return f"rows {len(ours)} / {len(theirs)}; only ours {list((a - b).items())[:2]}; only sql {list((b - a).items())[:2]}"
    return None


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from tests.conftest import make_session

    session = make_session()
    folder, wanted = sys.argv[1], sys.argv[2:]
    sql = oracle_sql()
    for name, query in queries().items():
        if wanted and name not in wanted:
            continue
        started = time.time()
        try:
            problem = difference(session, folder, query, sql[name]) if name in sql else "no sql"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok  ' if problem is None else 'DIFF'} {name} {time.time() - started:.1f}s {problem or ''}", flush=True)
