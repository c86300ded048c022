"""Distances, peaks and floods against plain loops over small images of all kinds."""

from __future__ import annotations

import random

import numpy as np
import pytest

from verdance.operators import relief


def distances(mask):
    out = np.argwhere(~mask)
    return {(r, c): int(((out - (r, c)) ** 2).sum(1).min()) if len(out) else None for r, c in np.argwhere(mask).tolist()}


def peaks(d2, apart):
    near = lambda p: [q for q in d2 if abs(p[0] - q[0]) <= apart and abs(p[1] - q[1]) <= apart]
    taken = []
    for p in sorted((p for p in d2 if d2[p] == max(d2[q] for q in near(p))), key=lambda p: (-d2[p], p)):
        if all(abs(p[0] - q[0]) > apart or abs(p[1] - q[1]) > apart for q in taken):
            taken.append(p)
    return set(taken)


def flooded(d2, marks):
    """Links between neighbours from the highest down, each taken unless both its sides have a mark."""
    key = {p: (d2[p], -(p[0] * 2**32 + p[1])) for p in d2}
    links = sorted(((min(key[p], key[q]), max(key[p], key[q]), p, q) for p in d2 for q in ((p[0] + i, p[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1)) if q in d2 and p < q), reverse=True)
    group, mark = {p: {p} for p in d2}, {p: p if p in marks else None for p in d2}
    for _, _, p, q in links:
        a, b = group[p], group[q]
        if a is not b and not (mark[p] and mark[q]):
            found = mark[p] or mark[q]
            a |= b
            for x in a:
                group[x], mark[x] = a, found
    return {p: mark[p] for p in d2 if mark[p]}


def image(spark, mask, at=(0, 0)):
    return spark.createDataFrame([(r + at[0], c + at[1], bool(mask[r, c])) for r in range(mask.shape[0]) for c in range(mask.shape[1])], "row bigint, col bigint, inside boolean")


def blobs(rng, h, w, n):
    y, x = np.mgrid[:h, :w]
    mask = np.zeros((h, w), bool)
    for _ in range(n):
        mask |= (y - rng.integers(h)) ** 2 + (x - rng.integers(w)) ** 2 < rng.integers(9, 60)
    return mask


def test_envelope_against_all_pairs():
    rng = np.random.default_rng(1)
    for _ in range(50):
        at = np.sort(rng.choice(200, rng.integers(1, 40), replace=False))
        height, wanted = rng.integers(0, 900, len(at)), np.arange(-10, 210)
        assert (relief.envelope(at, height, wanted) == ((wanted[:, None] - at) ** 2 + height).min(1)).all()


@pytest.mark.parametrize("kind", ["blobs", "noise", "full"])
def test_relief_of_images(spark, kind):
    rng = np.random.default_rng(7)
    mask = {"blobs": blobs(rng, 40, 55, 14), "noise": rng.random((17, 19)) < 0.9, "full": np.ones((5, 6), bool)}[kind]
    got = relief.distances(image(spark, mask))
    own = {(r["row"], r["col"]): r["d2"] for r in got.collect()}
    assert own == distances(mask)
    if kind == "full":
        assert relief.peaks(got, 2).isEmpty() and relief.watershed(got, relief.peaks(got, 2)).isEmpty() and relief.crests(got, 2, 0.0).isEmpty()
        return
    for apart in (2, 5):
        found = relief.peaks(got, apart)
        marks = {(r["row"], r["col"]) for r in found.collect()}
        assert marks == peaks(own, apart)
        labels = {(r["row"], r["col"]): divmod(r["label"], 2**32) for r in relief.watershed(got, found).collect()}
        assert labels == flooded(own, marks)


def test_flood_from_any_marks(spark):
    rng = np.random.default_rng(3)
    mask = blobs(rng, 25, 25, 8)
    own = distances(mask)
    marks = set(list(own)[::37])
    got = relief.watershed(relief.distances(image(spark, mask)), spark.createDataFrame(list(marks), "row bigint, col bigint"))
    assert {(r["row"], r["col"]): divmod(r["label"], 2**32) for r in got.collect()} == flooded(own, marks)
    assert relief.watershed(relief.distances(image(spark, mask)), spark.createDataFrame([], "row bigint, col bigint")).isEmpty()
    assert relief.distances(image(spark, mask).limit(0)).isEmpty()


def test_tiles_have_no_seams(spark, monkeypatch):
    monkeypatch.setattr(relief, "TILE", 8)
    rng = np.random.default_rng(5)
    values = {(int(r), int(c)): float(rng.integers(100)) for r in range(-13, 20) for c in range(-5, 22) if rng.random() < 0.8}
    df = spark.createDataFrame([(r, c, v) for (r, c), v in values.items()], "row bigint, col bigint, v double")
    for radius, square in ((0, False), (3, False), (11, False), (4, True)):
        inside = (lambda i, j: True) if square else (lambda i, j: i * i + j * j <= radius * radius)  # noqa: B023
        want = {(r, c): max(values[r + i, c + j] for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if (r + i, c + j) in values and inside(i, j)) for r, c in values}
        assert {(r["row"], r["col"]): r["highest"] for r in relief.focal_maximum(df, "v", radius, square).collect()} == want
    small = df.selectExpr("row", "col", "v % 3 as z")
    want = {(r, c): len({values[r + i, c + j] % 3 for i in (-1, 0, 1) for j in (-1, 0, 1) if (r + i, c + j) in values}) for r, c in values}
    assert {(r["row"], r["col"]): r["kinds"] for r in relief.variety(small, "z").collect()} == want


def test_solid_objects(spark):
    square, ell = [(r, c, 1) for r in range(10) for c in range(10)], [(r, c + 100, 2) for r in range(10) for c in range(10) if r == 9 or c == 0]
    speck = [(0, 500, 3)]
    got = {r["label"]: (r["area"], round(r["solidity"], 6)) for r in relief.solid(spark.createDataFrame(square + ell + speck, "row bigint, col bigint, label bigint"), 5, 0.2, 0.0).collect()}
    # The hull of the L: its bounding square less the triangle between its ends.
    assert got == {1: (100, 1.0), 2: (19, round(19 / (100 - 81 / 2), 6))}
    assert {r["label"] for r in relief.solid(spark.createDataFrame(square + ell, "row bigint, col bigint, label bigint"), 5, 0.2, 0.7).collect()} == {1}


def test_distances_pass_through_places_without_a_row(spark):
    rnd = random.Random(11)
    for wide, n in ((9, 60), (400, 60)):  # few and most places without a row
        px = {(rnd.randrange(wide), rnd.randrange(wide)): rnd.random() < 0.7 for _ in range(n)}
        out = [at for at, inside in px.items() if not inside]
        got = relief.distances(spark.createDataFrame([(*at, inside) for at, inside in px.items()], "row int, col int, inside boolean"))
        got = {(r["row"], r["col"]): r["d2"] for r in got.collect()}
        assert got == {(r, c): min((r - a) ** 2 + (c - b) ** 2 for a, b in out) for (r, c), inside in px.items() if inside}


def test_floods_and_peaks_cross_tiles(spark, monkeypatch):
    """Marks and plateaus that reach over small tiles, and floods over tiles of both sizes, are those of a plain loop."""
    monkeypatch.setattr(relief, "TILE", 6)
    monkeypatch.setattr(relief, "COARSE", 3)
    rng = np.random.default_rng(11)
    own = {(r, c): int(rng.integers(1, 4)) for r in range(40) for c in range(31) if rng.random() < 0.9}
    df = spark.createDataFrame([(r, c, v) for (r, c), v in own.items()], "row bigint, col bigint, d2 bigint").coalesce(2)
    found = relief.peaks(df, 2)
    marks = {(r["row"], r["col"]) for r in found.collect()}
    assert marks == peaks(own, 2)
    some = sorted(marks)[::9]
    got = relief.watershed(df, spark.createDataFrame(some, "row bigint, col bigint"))
    assert {(r["row"], r["col"]): divmod(r["label"], 2**32) for r in got.collect()} == flooded(own, set(some))
