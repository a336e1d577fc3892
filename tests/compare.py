"""Run a registered query and its SQL equivalent and compare the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else v + 0.0
        return v

    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE"}


def differences(spark, con, query, sql: str, sf_dir: str) -> list[str]:
    """Messages about schema and row differences; empty if the results agree."""
    df = query(spark, sf_dir)
    found = con.execute(sql)
    sql_columns = [d[0] for d in found.description]
    sql_types = {d[0]: str(d[1]) for d in found.description}
    sql_rows = found.fetchall()
    out = []
    if sorted(df.columns) != sorted(sql_columns):
        return [f"columns {sorted(df.columns)} / {sorted(sql_columns)}"]
    for name, kind in df.dtypes:
        if KINDS.get(kind) != sql_types[name]:
            out.append(f"type of {name}: {kind} / {sql_types[name]}")
    a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    b = rows_of(sql_columns, sql_rows)
    if len(a) != len(b):
        out.append(f"{len(a)} / {len(b)} rows")
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        out.append(f"{len(bad)} different rows, first {bad[0]}")
    return out
