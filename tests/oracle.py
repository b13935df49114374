"""Compare the result of a registered query with that of its SQL on the same tables."""

import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def compare(con, mine, sql: str) -> int:
    """Number of rows; raises if columns, types or values differ."""
    theirs = con.sql(sql)
    assert sorted(mine.columns) == sorted(theirs.columns), (mine.columns, theirs.columns)
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE"}
    got = {c: kinds[t] for c, t in mine.dtypes}
    want = {c: str(t) for c, t in zip(theirs.columns, theirs.types)}
    assert got == want, (got, want)
    a = rows_of(mine.columns, mine.collect())
    b = rows_of(theirs.columns, theirs.fetchall())
    assert len(a) == len(b), (len(a), len(b), a[:3], b[:3])
    different = [(x, y) for x, y in zip(a, b) if x != y]
    assert not different, different[:5]
    return len(a)
