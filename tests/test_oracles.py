"""Every query of the library against its SQL on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from verdance.plans import files, joins, layout, models, mosaics, overlay, pixels, relief, series, statistics, validation

PARTS = (pixels, joins, series, statistics, models, validation, layout, overlay, relief, mosaics, files)
QUERIES = {n: q for p in PARTS for n, q in p.R.queries.items()}
ORACLES = {n: s for p in PARTS for n, s in p.R.oracles.items()}


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 5) if isinstance(v, float) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def close(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-4))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    got = df.collect()
    if name not in ORACLES:
        assert df.columns
        return
    want = db.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    a, b = rows(df.columns, got), rows(names, want.fetchall())
    assert len(a) == len(b)
    assert all(close(x, y) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))
