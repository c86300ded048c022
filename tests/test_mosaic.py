"""Mosaics against plain loops."""

from __future__ import annotations

import numpy as np
import pytest

from verdance.operators import mosaic

SCHEMA = "image string, row bigint, col bigint, value double"


def by_hand(pixels, width):
    cover, boxes = {}, {}
    for image, r, c, v in pixels:
        if v is not None:
            cover.setdefault((r, c), {})[image] = v
            boxes.setdefault(image, []).append((r, c))
    centre = {i: ((min(r for r, _ in p) + max(r for r, _ in p)) / 2, (min(c for _, c in p) + max(c for _, c in p)) / 2) for i, p in boxes.items()}
    zone = {(r, c): min(own, key=lambda i: ((r - centre[i][0]) ** 2 + (c - centre[i][1]) ** 2, i)) for (r, c), own in cover.items()}  # noqa: B023
    out = {}
    for (r, c), image in zone.items():
        near = [((r - y) ** 2 + (c - x) ** 2, o) for (y, x), o in zone.items() if o != image and (r - y) ** 2 + (c - x) ** 2 <= (width // 2) ** 2]
        w, other = 1.0, None
        if near and min(near)[1] in cover[r, c]:
            d2, other = min(near)
            w = min(1.0, 0.5 + (d2**0.5 - 0.5) / width)
        out[r, c] = (image, other, pytest.approx(w), pytest.approx(w * cover[r, c][image] + (1 - w) * (cover[r, c][other] if other else 0)))
    return zone, out


def test_mosaic_by_hand(spark, monkeypatch):
    monkeypatch.setattr(mosaic, "TILE", 8)
    rng = np.random.default_rng(6)
    pixels = []
    for k in range(7):
        top, left, h, w = rng.integers(-10, 15), rng.integers(-10, 15), rng.integers(1, 14), rng.integers(1, 14)
        pixels += [(f"i{k}", int(r), int(c), float(rng.integers(100)) if rng.random() < 0.9 else None) for r in range(top, top + h) for c in range(left, left + w)]
    df = spark.createDataFrame(pixels, SCHEMA)
    zone, want = by_hand(pixels, 10)
    assert {(r["row"], r["col"]): r["image"] for r in mosaic.seamlines(df).collect()} == zone
    assert {(r["row"], r["col"]): (r["image"], r["other"], r["weight"], r["value"]) for r in mosaic.blended(df).collect()} == want
    rim = {(r, c) for r, c in zone if any((r + i, c + j) not in zone for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0)))}
    assert {(r["row"], r["col"]) for r in mosaic.boundary(mosaic.seamlines(df)).collect()} == rim


def test_one_image_ties_and_none(spark):
    one = [("a", r, c, 1.0 * r) for r in range(30) for c in range(30)]
    assert {(r["weight"], r["other"]) for r in mosaic.blended(spark.createDataFrame(one, SCHEMA)).collect()} == {(1.0, None)}
    # Two images of one place: the smaller name has all of it.
    assert {r["image"] for r in mosaic.seamlines(spark.createDataFrame([*one, *(("b", *p[1:]) for p in one)], SCHEMA)).collect()} == {"a"}
    assert mosaic.blended(spark.createDataFrame([("a", 1, 1, None)], SCHEMA)).isEmpty() and mosaic.footprints(spark.createDataFrame([], SCHEMA)).isEmpty()
