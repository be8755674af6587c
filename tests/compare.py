"""Runs a query's SQL in DuckDB and compares rows, regardless of order."""

from __future__ import annotations

import datetime as dt
import math
import os
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads TO 4")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if v is None or isinstance(v, (bool, str, int)):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (dt.date, dt.datetime)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(v)


def bag(rows) -> Counter:
    return Counter(tuple(map(plain, r)) for r in rows)


def differences(df, sql: str, con) -> list[str]:
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    want = got.fetchall()
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    order = [names.index(c) for c in sorted(names)]
    have = bag(tuple(r) for r in df.select(*sorted(df.columns)).collect())
    need = bag(tuple(r[i] for i in order) for r in want)
    if have == need:
        return []
    return [f"{sum(have.values())} and {sum(need.values())} rows; only here {list((have - need).items())[:3]}; only there {list((need - have).items())[:3]}"]
