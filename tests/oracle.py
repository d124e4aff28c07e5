"""Runs a query in Spark and its SQL in DuckDB over the same tables and compares the rows."""

from __future__ import annotations

import math
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(config={"threads": 2})
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, query, sql: str, sf_dir: str = SF) -> int:
    df = query(spark, sf_dir)
    got = df.collect()
    want = connect(sf_dir).execute(sql)
    names, kinds = [d[0] for d in want.description], {d[0]: str(d[1]) for d in want.description}
    want = want.fetchall()
    assert sorted(df.columns) == sorted(names)
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for c, kind in df.dtypes:
        assert same.get(kind, kind) == kinds[c] or kinds[c] in ('"NULL"', "NULL"), (c, kind, kinds[c])
    a, b = rows_of(df.columns, got), rows_of(names, want)
    assert len(a) == len(b), (len(a), len(b))
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    assert not wrong, (sorted(df.columns), len(wrong), wrong[:3])
    return len(a)
