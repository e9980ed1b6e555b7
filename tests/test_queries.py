"""Each registered query against its DuckDB SQL."""

import math
import os

import duckdb
import pytest

from siltstone.plans import registry


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return v


def _rows(rows, order):
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf, query, sql):
    got = query(spark, sf)
    db = duckdb.connect()
    for f in os.listdir(sf):
        if f.endswith(".parquet"):
            db.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    cur = db.execute(sql)
    names = [d[0] for d in cur.description]
    expected = cur.fetchall()
    assert sorted(got.columns) == sorted(names)
    order = sorted(range(len(names)), key=lambda i: names[i])
    mine = sorted(range(len(got.columns)), key=lambda i: got.columns[i])
    assert _rows(got.collect(), mine) == _rows(expected, order)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, sf, name):
    compare(spark, sf, registry.QUERIES[name], registry.ORACLES[name])


def test_all_have_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)
