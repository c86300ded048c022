"""Grid detection and strips on images whose answers are known."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from verdance.operators import layout

PIXELS = "x double, y double"


def turned_grid(angle: float, du: float, dv: float, size: int) -> list[tuple[float, float]]:
    """Pixels of patches that repeat every du and dv, turned by ``angle``."""
    a = math.radians(angle)
    y, x = np.mgrid[0:size, 0:size]
    u, v = x * math.cos(a) + y * math.sin(a), y * math.cos(a) - x * math.sin(a)
    on = (np.mod(u, du) < du / 2) & (np.mod(v, dv) < dv / 2)
    return [(float(c), float(r)) for r, c in zip(*np.where(on), strict=True)]


def test_scan_finds_angle_and_periods(spark):
    """The same as histograms of NumPy give, and near the truth: the score has its maximum within a few degrees."""
    image = turned_grid(17, 25, 40, 320)
    rows = {r["angle"]: r for r in layout.grid_scan(spark.createDataFrame(image, PIXELS), 15, 60).collect()}
    assert len(rows) == 90 and sum(r["best"] for r in rows.values()) == 1
    x, y = np.array(image).T
    want = {}
    for angle in range(90):
        c, s = math.cos(angle * math.pi / 180), math.sin(angle * math.pi / 180)
        found = []
        for at in (np.round(x * c + y * s, 6), np.round(y * c - x * s, 6)):
            span = at.max() - at.min()
            size = np.abs(np.fft.rfft(np.histogram(at, max(int(span), 32))[0]))
            k = np.arange(1, len(size))
            k = k[(span / k >= 15) & (span / k <= 60)]
            found.append((span / k[np.argmax(size[k])], size[k].max() / size[k].mean()))
        want[angle] = (found[0][0], found[1][0], found[0][1] + found[1][1])
    assert all(np.allclose([rows[a]["period_u"], rows[a]["period_v"], rows[a]["score"]], w, rtol=5e-3) for a, w in want.items())
    best = next(r for r in rows.values() if r["best"])
    assert best["angle"] == max(want, key=lambda a: want[a][2])
    assert abs(best["angle"] - 17) <= 3 and abs(best["period_u"] - 25) < 2 and abs(best["period_v"] - 40) < 2


def test_scan_without_points_or_with_few(spark):
    assert layout.grid_scan(spark.createDataFrame([], PIXELS), 15, 60).count() == 0
    few = layout.grid_scan(spark.createDataFrame([(1.0, 2.0), (None, 3.0), (50.0, 9.0)], PIXELS), 15, 60, (0, 45)).collect()
    assert [(r["period_u"], r["score"], r["best"]) for r in few] == [(None, 0.0, False)] * 2


def test_scan_takes_the_strongest_frequency_of_a_plain_transform():
    counts = np.array([(3.0 if i % 20 < 4 else 1.0) for i in range(400)])
    period, phase, score = layout.spectrum(counts, 400.0, 12, 60)
    assert (period, phase) == (20.0, 0.5) and score > 5
    assert layout.spectrum(np.ones(400), 400.0, 12, 60) == (None, None, 0.0)


def test_strips_split_wide_stretches(spark):
    # One strip with gaps at u = 20, 60 and 180: the second stretch is three places wide.
    rows = [(float(g + d), float(y)) for g in (20, 60, 180) for d in (-1, 0, 1) for y in range(12, 30)]
    got = layout.strip_centres(spark.createDataFrame(rows, PIXELS), 0.0, 40.0, 0.0, 8.0, (0.0, 0.0, 200.0, 39.0)).orderBy("i").collect()
    assert len({r["strip"] for r in got}) == 1 and all(r["y"] == 20.0 for r in got)
    assert np.allclose([r["x"] for r in got], [40, 80, 120, 160], atol=2.0)
    few = layout.strip_centres(spark.createDataFrame(rows, PIXELS), 0.0, 40.0, 0.0, 8.0, (0.0, 0.0, 200.0, 39.0), support=len(rows) + 1)
    assert few.count() == 0


def test_seed_pixels_stay_in_the_image(spark):
    seeds = spark.createDataFrame([(0.0, 0.0), (5.0, 5.0), (5.0, 5.0)], PIXELS)
    got = {(r["row"], r["col"]) for r in layout.seed_pixels(seeds, 0.0, 3.0, (0, 0, 9, 9)).collect()}
    assert got == {(r, c) for r in (0, 1) for c in (0, 1)} | {(r, c) for r in (4, 5, 6) for c in (4, 5, 6)}


@pytest.mark.parametrize("diagonal", [False, True])
def test_labels_spread_by_tiles_and_not_by_pixels(spark, monkeypatch, diagonal):
    rnd = random.Random(9)
    images = [{(r, c) for r in range(-9, 25) for c in range(-7, 30) if rnd.random() < 0.55}, {(r, c) for r in range(40) for c in range(40) if r % 2 == 0 or c == (39 if r % 4 == 1 else 0)}]
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if abs(a) + abs(b) == 1 or diagonal and a and b]
    for side, px in ((8, images[0]), (16, images[1]), (256, images[1])):
        monkeypatch.setattr(layout, "SIDE", side)
        want, seen = {}, set()
        for p in sorted(px):
            stack = [p] if p not in seen else []
            while stack:
                q = stack.pop()
                if q in seen:
                    continue
                seen.add(q)
                want[q] = p[0] * 2**32 + p[1]
                stack += [(q[0] + a, q[1] + b) for a, b in steps if (q[0] + a, q[1] + b) in px]
        tables = []
        own = layout.written
        monkeypatch.setattr(layout, "written", lambda df, own=own: tables.append(1) or own(df))
        got = layout.labelled(spark.createDataFrame(sorted(px), "row int, col int"), diagonal)
        assert {(r["row"], r["col"]): r["label"] for r in got.collect()} == want
        monkeypatch.setattr(layout, "written", own)
        if side == 256:
            assert len(tables) <= 3 + 1  # nothing crosses a tile


def test_hulls_of_many_groups_share_tasks(spark, monkeypatch):
    monkeypatch.setattr(layout, "CORNERS", 500)
    rnd = random.Random(1)
    rows = [(None if g == 0 else 2**60 + g, float(rnd.randrange(20)), float(rnd.randrange(20))) for g in range(150) for _ in range(1 + g % 9)]
    made = layout.hulls(spark.createDataFrame(rows, "id long, x double, y double"), "id")
    got = {r["id"]: [(p["x"], p["y"]) for p in r["ring"]] for r in made.collect()}
    assert got == {k: layout.hull(np.array([(x, y) for i, x, y in rows if i == k])) for k in {r[0] for r in rows}}
