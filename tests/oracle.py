"""Compares a query with its DuckDB twin, row by row, order aside."""

import math
import os

import duckdb


def plain(v):
    if v is None:
        return None
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return "nan" if math.isnan(v) else float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.isoformat() if hasattr(v, "isoformat") else v


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def twin(sql, sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    r = c.execute(sql)
    names = [d[0] for d in r.description]
    cols = sorted(names)
    at = [names.index(x) for x in cols]
    return cols, sorted((tuple(plain(row[i]) for i in at) for row in r.fetchall()), key=repr)


def same(spark, query, sql, sf_dir):
    got, want = rows_of(query(spark, sf_dir)), twin(sql, sf_dir)
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1], strict=True):
        assert a == b
