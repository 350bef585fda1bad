"""Rows of a query against rows of its SQL on DuckDB."""

import datetime
import decimal
import math
import os


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


def same(a, b):
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, float) or isinstance(b, float):
        return type(a) is type(b) and abs(a - b) <= 1e-6 * max(1.0, abs(a))
    return type(a) is type(b) and a == b


def rows_match(spark, query, sql, folder):
    import duckdb

    df = query(spark, folder)
    cols = sorted(df.columns)
    got = [tuple(map(norm, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    r = c.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = [tuple(norm(x[names.index(k)]) for k in cols) for x in r.fetchall()]
    order = lambda row: [(x is None, isinstance(x, float), str(x)) for x in row]
    got, want = sorted(got, key=order), sorted(want, key=order)
    assert len(got) == len(want)
    bad = [(a, b) for a, b in zip(got, want) if not same(a, b)]
    assert not bad, (cols, bad[:2])
