"""Run queries against their SQL in DuckDB and compare all rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value: object) -> object:
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


def normalised(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """None if both give the same rows, else a short description of the difference."""
    df = query(spark, sf_dir)
    ours = normalised(df.columns, df.collect())
    relation = con.sql(sql)
    theirs = normalised(relation.columns, relation.fetchall())
    if sorted(df.columns) != sorted(relation.columns):
        return f"columns {sorted(df.columns)} != {sorted(relation.columns)}"
    if ours == theirs:
        return None
    mine, other = set(map(repr, ours)), set(map(repr, theirs))
    return (
        f"{len(ours)} rows vs {len(theirs)}; only here {sorted(mine - other)[:3]}; only SQL {sorted(other - mine)[:3]}"
    )


if __name__ == "__main__":
    import __spark_entry__ as entry
    from funnelwright.session import local_session

    directory, *names = sys.argv[1:]
    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    connection, statements = duck(directory), entry.oracle_sql()
    for name in names or statements:
        started = time.time()
        try:
            result = compare(session, connection, entry.queries()[name], statements[name], directory)
        except Exception as error:
            result = f"FAILED {str(error)[:700]}"
        print(f"{name:26s} {time.time() - started:6.2f}s {'ok' if result is None else result}", flush=True)
