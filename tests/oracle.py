"""Runs a query in Spark and its SQL in DuckDB over the same tables and compares all rows."""

from __future__ import annotations

import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "FLOAT": "float", "SMALLINT": "smallint", "TINYINT": "tinyint"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.isdir(path):
            path += "/*.parquet"
        con.execute(f"create view {t} as select * from '{path}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 10) + 0.0)
    if isinstance(x, decimal.Decimal):
        return repr(float(x))
    return repr(x)


def compare(df, con, sql: str) -> None:
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = con.execute(f"select * from ({sql}) x limit 0").description
    assert sorted(d[0] for d in found) == columns, (sorted(d[0] for d in found), columns)
    kinds = {d[0]: KINDS.get(str(d[1]), str(d[1])) for d in found}
    differ = {c: (t, kinds[c]) for c, t in df.dtypes if t != kinds[c]}
    want = sorted(tuple(map(plain, r)) for r in con.execute(f"select {', '.join(columns)} from ({sql}) x").fetchall())
    odd = [(a, b) for a, b in zip(got, want, strict=False) if a != b][:3]
    assert len(got) == len(want) and not odd, (len(got), len(want), columns, odd)
    assert not differ, differ
