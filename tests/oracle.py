"""Compare a registered query with its SQL on DuckDB."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf_dir, name, fn, sql):
    got = fn(spark, sf_dir)
    rel = connect(sf_dir).sql(sql)
    names = rel.columns
    assert sorted(got.columns) == sorted(names), (name, got.columns, names)
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    want_types = dict(zip(names, map(str, rel.types)))
    for column, dtype in got.dtypes:
        assert kinds[dtype] == want_types[column], (name, column, dtype, want_types[column])
    mine = rows_of(got.columns, [tuple(r) for r in got.collect()])
    theirs = rows_of(names, rel.fetchall())
    assert len(mine) == len(theirs), (name, len(mine), len(theirs))
    for a, b in zip(mine, theirs):
        assert a == b, (name, a, b)
    return len(mine)
