"""Compares a query with the SQL that says the same."""

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "bigint", "int": "integer", "string": "varchar", "timestamp_ntz": "timestamp"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return c


def plain(x):
    if isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def check(df, connection, sql: str) -> None:
    r = connection.execute(sql)
    names = [d[0] for d in r.description]
    types = {d[0]: str(d[1]).lower() for d in r.description}
    assert sorted(names) == sorted(df.columns)
    ours = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    assert ours == types
    order = sorted(names)
    theirs = sorted((tuple(plain(row[names.index(c)]) for c in order) for row in r.fetchall()), key=repr)
    mine = sorted((tuple(plain(row[c]) for c in order) for row in df.collect()), key=repr)
    assert mine == theirs
