"""Textbook values and properties of the column functions."""

from __future__ import annotations

import math
import sqlite3
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from verdance.functions import special
from verdance.operators import layout, regress
from verdance.plans import pixels
from verdance.sources import readers


@pytest.mark.parametrize(("f", "d1", "d2"), [(4.17, 1, 30), (3.32, 2, 30), (2.53, 5, 30), (2.70, 3, 100)])
def test_f_critical_values(f, d1, d2):
    assert abs(special.f_p(f, d1, d2) - 0.05) < 6e-4


@pytest.mark.parametrize(("x", "df"), [(3.841, 1), (5.991, 2), (11.07, 5), (18.31, 10)])
def test_chi2_critical_values(x, df):
    assert abs(special.chi2_p(x, df) - 0.05) < 1e-4


@given(st.floats(0.2, 80), st.floats(0.2, 80), st.floats(0.001, 0.999))
@settings(max_examples=200, deadline=None)
def test_beta_is_symmetric_and_monotone(a, b, x):
    v = special.beta_inc(a, b, x)
    assert 0 <= v <= 1 + 1e-12
    assert abs(v + special.beta_inc(b, a, 1 - x) - 1) < 1e-9
    assert special.beta_inc(a, b, min(0.9999, x + 1e-3)) >= v - 1e-9


def test_extreme_correlations():
    assert special.r_p(1.0, 10) == 0.0
    assert special.r_p(0.5, 2) is None
    assert special.f_p(float("nan"), 1, 2) is None


def _polygon(order: str, ring, multi: bool) -> bytes:
    body = struct.pack(order + "I", 1) + struct.pack(order + "I", len(ring)) + b"".join(struct.pack(order + "dd", *p) for p in ring)
    one = (b"\x01" if order == "<" else b"\x00") + struct.pack(order + "I", 3) + body
    return (b"\x01" if order == "<" else b"\x00") + struct.pack(order + "II", 6, 1) + one if multi else one


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("multi", [False, True])
def test_vertex_mean_counts_the_closing_vertex_twice(order, multi):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 0.0)]
    blob = b"GP\x00" + bytes([0b0011]) + struct.pack("<i", 32636) + struct.pack("<4d", 0, 4, 0, 2) + _polygon(order, ring, multi)
    assert readers.blob_centre(blob) == (2.0, 0.5)
    assert readers.blob_centre(b"") == (None, None)
    assert readers.blob_centre(None) == (None, None)


def test_hull_of_a_square_with_inner_points():
    pts = np.array([(0, 0), (2, 0), (2, 2), (0, 2), (1, 1), (1, 0)], float)
    assert layout.hull(pts) == [(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]


def _gram(x, y):
    a = np.column_stack([np.ones(len(x)), x, y])
    return regress.Gram(("a", "b", "c", "y"), a.T @ a)


def test_linear_families_against_plain_solutions():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    y = 1 + x @ [2.0, -1.0, 0.5] + 0.1 * rng.normal(size=200)
    g, xs = _gram(x, y), ["a", "b", "c"]
    plain = np.linalg.lstsq(np.column_stack([np.ones(200), x]), y, rcond=None)[0]
    assert np.allclose(regress.ols(g, xs, "y"), plain)
    assert np.allclose(regress.pls1(g, xs, "y", 3), plain)
    assert np.allclose(regress.elastic_net(g, xs, "y", 0.0), plain, atol=1e-6)
    assert np.allclose(regress.matching_pursuit(g, xs, "y", 3)[0], plain)
    assert np.allclose(regress.ridge(g, xs, "y", np.array([1e-9]))[0], plain, atol=1e-6)
    share, load = regress.pca(g, xs)
    assert math.isclose(share.sum(), 1.0) and np.allclose(load.T @ load, np.eye(3))
    r2 = regress.scores(g, plain, xs, "y")["r2"]
    resid = y - np.column_stack([np.ones(200), x]) @ plain
    assert math.isclose(r2, 1 - resid @ resid / ((y - y.mean()) @ (y - y.mean())))
    assert regress.nested_test(g, ["a"], ["b", "c"], "y")["p"] < 1e-9
    assert regress.rank(g, xs) == 4


def test_geopackage_and_tiff(spark, tmp_path):
    path = str(tmp_path / "a.gpkg")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('crowns', 'geom')")
    db.execute("CREATE TABLE crowns (fid INTEGER PRIMARY KEY, geom BLOB, plot TEXT)")
    blob = b"GP\x00" + bytes([0b0011]) + struct.pack("<i", 32636) + struct.pack("<4d", 0, 4, 0, 2) + _polygon("<", [(0, 0), (4, 0), (4, 2), (0, 0)], False)
    db.executemany("INSERT INTO crowns VALUES (?, ?, ?)", [(1, blob, "A"), (2, None, "B")])
    db.commit()
    db.close()
    rows = readers.geopackage(spark, path, {"plot": "string", "absent": "double"}).orderBy("fid")
    got = rows.select("fid", "plot", "absent", readers.vertex_mean("geom").alias("m"), readers.envelope_centre("geom").alias("e")).collect()
    assert [(r["fid"], r["plot"], r["absent"]) for r in got] == [(1, "A", None), (2, "B", None)]
    assert (got[0]["m"]["x"], got[0]["m"]["y"], got[0]["e"]["x"]) == (2.0, 0.5, 2.0)
    assert readers.geopackage(spark, path, {"plot": "string"}, where="plot = 'B'").count() == 1
    tiff = str(tmp_path / "a.tif")
    with open(tiff, "wb") as f:
        f.write(b"II*\x00" + struct.pack("<I", 8) + struct.pack("<H", 2) + struct.pack("<HHIHH", 256, 3, 1, 640, 0) + struct.pack("<HHII", 257, 4, 1, 480))
    assert readers.tiff_sizes(spark, tiff).select("width", "height").first() == (640, 480)


def test_imputation_by_year_sorts_no_year_in_one_task(spark, sf, capsys):
    pixels.R.queries["prj_terms"](spark, sf).explain()
    assert "Window" not in capsys.readouterr().out
