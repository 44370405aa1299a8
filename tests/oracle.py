"""Compares a query with its SQL in DuckDB."""

import datetime
import math
from pathlib import Path

import duckdb


def _cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return x


def compare(spark, query, sql, sf_dir):
    """Fails unless the columns and the rows, in any order, are the same."""
    got = query(spark, sf_dir)
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    key = lambda r: [(x is None, str(x)) for x in r]
    a = sorted(([_cell(r[c]) for c in order] for r in got.collect()), key=key)
    b = sorted(([_cell(r[names.index(c)]) for c in order] for r in cur.fetchall()), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == y
