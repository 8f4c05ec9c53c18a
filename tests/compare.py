"""Rows of a query and of its SQL twin, in comparable form."""

import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return float(v) if type(v).__name__ == "Decimal" else v


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))


def connect(sf_dir):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(sf_dir):
        p = f"{sf_dir}/{f}"
        c.execute(f"CREATE VIEW {f[:-8]} AS FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def sql_rows(c, sql):
    r = c.execute(sql)
    names = [x[0] for x in r.description]
    cols = sorted(names)
    ix = [names.index(x) for x in cols]
    return cols, sorted((tuple(plain(x[i]) for i in ix) for x in r.fetchall()), key=lambda r: tuple((v is None, str(v)) for v in r))
