"""Clips against exact fractions, cell by cell."""

from __future__ import annotations

import random
from fractions import Fraction
from math import floor

from verdance.operators import clip

SIZE = range(-3, 26)


def by_hand(ring):
    inside, touched = set(), set()
    sides = [tuple(Fraction(v) for v in (*a, *b)) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
    for r in SIZE:
        for c in SIZE:
            x, y = c + Fraction(1, 2), r + Fraction(1, 2)
            if sum(min(y1, y2) <= y < max(y1, y2) and x1 + (y - y1) * (x2 - x1) / (y2 - y1) <= x for x1, y1, x2, y2 in sides if y1 != y2) % 2:
                inside.add((r, c))
            for x1, y1, x2, y2 in sides:
                if floor(min(y1, y2)) <= r <= floor(max(y1, y2)):
                    ends = [x1, x2] if y1 == y2 else [x1 + (v - y1) * (x2 - x1) / (y2 - y1) for v in (max(min(y1, y2), r), min(max(y1, y2), r + 1))]
                    if floor(min(ends)) <= c <= floor(max(ends)):
                        touched.add((r, c))
    return inside, inside | touched


def test_clip_by_hand(spark, monkeypatch):
    monkeypatch.setattr(clip, "BLOCK", 4)
    rng = random.Random(8)
    point = lambda: (rng.randrange(0, 22 * 16) / 16, rng.randrange(0, 22 * 16) / 16)
    rings = {k: [point() for _ in range(n)] for k, n in enumerate((3, 4, 7, 12, 40, 5))}
    rings |= {90: [(2.0, 3.0), (9.0, 3.0), (9.0, 8.0), (2.0, 8.0)], 91: [(5.5, 5.5)], 92: [(1.0, 1.0), (6.0, 1.0)]}
    corners = spark.createDataFrame([(k, i, x, y) for k, ring in rings.items() for i, (x, y) in enumerate(ring)], "id int, i int, x double, y double")
    pixels = spark.createDataFrame([(r, c, r * 100 + c) for r in SIZE for c in SIZE], "row bigint, col bigint, low int").withColumnRenamed("low", "v")
    for touched in (False, True):
        got = {}
        for r in clip.clipped(pixels, corners, touched).collect():
            assert (r["row"], r["col"]) not in got.setdefault(r["id"], set()) and r["v"] == r["row"] * 100 + r["col"]
            got[r["id"]].add((r["row"], r["col"]))
        assert got == {k: own for k, ring in rings.items() if (own := by_hand(ring)[touched])}
    assert clip.clipped(pixels, corners.limit(0)).isEmpty() and clip.clipped(pixels.limit(0), corners).isEmpty()


def test_one_large_ring(spark):
    """A ring of 20,000 corners around a box is that box."""
    n = 5000
    side = lambda a, b: [(a[0] + (b[0] - a[0]) * i / n, a[1] + (b[1] - a[1]) * i / n) for i in range(n)]
    box = [(0.5, 0.5), (900.5, 0.5), (900.5, 40.5), (0.5, 40.5)]
    ring = [p for a, b in zip(box, box[1:] + box[:1], strict=True) for p in side(a, b)]
    corners = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate(ring)], "id int, i int, x double, y double")
    assert sum(r["high"] - r["low"] + 1 for r in clip.spans(corners).collect()) == 901 * 41
