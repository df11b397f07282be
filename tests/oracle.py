"""Run a query's SQL in DuckDB over the same files, and compare rows."""

import math

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, float)) or hasattr(v, "__float__"):
        x = float(v)
        return None if math.isnan(x) else round(x, 5) + 0.0
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def of_sql(con, sql):
    cur = con.execute(sql)
    return table([c[0] for c in cur.description], cur.fetchall())


def of_frame(df):
    return table(df.columns, [tuple(r) for r in df.collect()])


def close(a, b):
    """Equal, or numbers that differ in the last rounded place."""
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-5)
    return a == b
