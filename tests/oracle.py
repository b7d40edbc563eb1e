"""Run a query and its SQL twin and compare rows."""

from __future__ import annotations

import datetime
import decimal

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return int(value) if value == int(value) else value
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql):
    """(ok, message)"""
    spark_names = df.columns
    mine = _rows(spark_names, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = _rows(names, cur.fetchall())
    if sorted(names) != sorted(spark_names):
        return False, f"columns {sorted(spark_names)} / {sorted(names)}"
    if mine == theirs:
        return True, f"{len(mine)} rows"
    a, b = set(mine), set(theirs)
    return False, (f"rows {len(mine)} / {len(theirs)}; only spark {sorted(a - b, key=repr)[:3]}; "
                   f"only sql {sorted(b - a, key=repr)[:3]}")
