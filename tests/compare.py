"""Runs a query and its SQL over the same tables and compares the rows, order aside."""

import duckdb

SF = "/root/testdata/sf0.001"


def norm(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.6g}" if abs(v) > 1e-12 else "0"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(str(norm(x)) for x in v) + "]"
    if isinstance(v, int):
        return f"{v:.6g}" if abs(v) < 1e5 else str(v)
    return str(v)


def connect(sf=SF):
    from pathlib import Path

    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted(str([norm(r[c]) for c in cols]) for r in df.collect())


def rows_of_sql(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted(str([norm(r[i]) for i in order]) for r in cur.fetchall())
