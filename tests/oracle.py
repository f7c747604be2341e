"""Runs a query and its SQL side by side."""

from __future__ import annotations

import math
import os

import duckdb


def value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5)
    return x


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted((tuple(value(r[c]) for c in names) for r in df.collect()), key=str)


def oracle_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted((tuple(value(r[k]) for k in order) for r in cursor.fetchall()), key=str)
