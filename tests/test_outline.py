"""Outlines and polygons against walks along each object."""

from __future__ import annotations

import numpy as np
import pytest

from verdance.operators import outline


def walked(labels):
    """Rings as lists of corners where the walk turns, by label; right turns where a corner is shared."""
    rings, seen = [], set()
    for (r, c), label in sorted(labels.items()):
        for side in range(4):
            if (r, c, side) in seen or labels.get((r + outline.BEYOND[side][0], c + outline.BEYOND[side][1])) == label:
                continue
            at, path = (r, c, side), []
            while at not in seen:
                seen.add(at)
                path.append(at)
                y, x, s = at
                (br, bc), (ar, ac) = outline.BEYOND[s], outline.AHEAD[s]
                if labels.get((y + ar, x + ac)) != label:
                    at = (y, x, (s + 1) % 4)
                elif labels.get((y + ar + br, x + ac + bc)) != label:
                    at = (y + ar, x + ac, s)
                else:
                    at = (y + ar + br, x + ac + bc, (s + 3) % 4)
            corners = [(x + outline.START[s][1], y + outline.START[s][0]) for i, (y, x, s) in enumerate(path) if path[i - 1][2] != s]
            rings.append((label, len(path), corners))
    return rings


def normal(corners):
    i = corners.index(min(corners))
    return tuple(corners[i:] + corners[:i])


def area(p):
    return sum(x * w - z * y for (x, y), (z, w) in zip(p, p[1:] + p[:1], strict=True)) / 2


def peucker(p, limit):
    """Corners kept of the stretch from p[0] to p[-1], without the last."""
    (ax, ay), (bx, by) = p[0], p[-1]
    span = np.hypot(bx - ax, by - ay)
    off = [round(abs((bx - ax) * (y - ay) - (by - ay) * (x - ax)) / span if span else np.hypot(x - ax, y - ay), 9) for x, y in p[1:-1]]
    if not off or max(off) <= limit:
        return [p[0]]
    i = off.index(max(off)) + 1
    return peucker(p[: i + 1], limit) + peucker(p[i:], limit)


def read(rows):
    rings = {}
    for r in sorted(rows, key=lambda r: (r["ring"], r["k"])):
        rings.setdefault(r["ring"], (r["label"], r["length"], []))[2].append((r["x"], r["y"]))
    return rings


@pytest.mark.parametrize("kind", ["noise", "blocks"])
def test_rings_and_polygons(spark, kind):
    rng = np.random.default_rng(9)
    grid = rng.integers(0, 3, (14, 16)) if kind == "noise" else np.kron(rng.integers(0, 3, (4, 4)), np.ones((6, 7), int))
    grid[2:5, 2:5] = 7
    grid[3, 3] = 0  # a hole
    labels = {(int(r) - 4, int(c)): int(v) for (r, c), v in np.ndenumerate(grid) if v}
    df = spark.createDataFrame([(r, c, v) for (r, c), v in labels.items()], "row bigint, col bigint, label int")
    rings = outline.outlines(df)
    got = read(rings.collect())
    want = walked(labels)
    assert sorted((label, n, normal(p)) for label, n, p in got.values()) == sorted((label, n, normal(p)) for label, n, p in want)
    areas = {r["ring"]: (r["area"], r["corners"]) for r in outline.ring_areas(rings).collect()}
    assert areas == {k: (area(p), len(p)) for k, (_, _, p) in got.items()}
    for v in set(labels.values()):
        assert sum(areas[k][0] for k, (label, _, _) in got.items() if label == v) == sum(x == v for x in labels.values())
    for share in (0.01, 0.05):
        kept = {}
        for r in sorted(outline.simplified(rings, share).collect(), key=lambda r: (r["ring"], r["k"])):
            kept.setdefault(r["ring"], []).append((r["x"], r["y"]))
        for k, (_, n, p) in got.items():
            far = max(range(len(p)), key=lambda i: (round((p[i][0] - p[0][0]) ** 2 + (p[i][1] - p[0][1]) ** 2, 9), -i))
            assert kept[k] == peucker(p[: far + 1], n * share) + peucker([*p[far:], p[0]], n * share)


def test_one_large_object_and_none(spark):
    df = spark.range(300 * 200).selectExpr("id div 200 as row", "id % 200 as col", "1 as label")
    got = outline.outlines(df).collect()
    assert {(r["x"], r["y"]) for r in got} == {(0, 0), (200, 0), (200, 300), (0, 300)} and {r["length"] for r in got} == {1000}
    assert outline.outlines(df.limit(0)).isEmpty() and outline.simplified(outline.outlines(df.limit(0))).isEmpty()


def test_outlines_send_no_side_to_the_driver(spark):
    """Each join by merging: sides that are small enough to be broadcast would add up over the rounds."""
    df = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (3, 3, 2)], "row bigint, col bigint, label bigint")
    for made in (outline.outline_edges(df), outline.outlines(df)):
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()


def test_rings_over_many_tiles(spark, monkeypatch):
    """Rings that cross tiles, also some that come back to a tile, and rings inside of one; with few corners a task."""
    monkeypatch.setattr(outline, "SIDE", 5, raising=False)
    monkeypatch.setattr(outline, "CORNERS", 20, raising=False)
    rng = np.random.default_rng(3)
    labels = {(int(r) - 9, int(c) - 7): 1 for r, c in np.argwhere(rng.random((24, 30)) < 0.62)}
    df = spark.createDataFrame([(r, c, v) for (r, c), v in labels.items()], "row bigint, col bigint, label int")
    rings = outline.outlines(df)
    rows = rings.collect()
    got = read(rows)
    assert sorted((label, n, normal(p)) for label, n, p in got.values()) == sorted((label, n, normal(p)) for label, n, p in walked(labels))
    kept = {}
    for r in sorted(outline.simplified(rings, 0.02).collect(), key=lambda r: (r["ring"], r["k"])):
        kept.setdefault(r["ring"], []).append((r["x"], r["y"]))
    for k, (_, n, p) in got.items():
        far = max(range(len(p)), key=lambda i: (round((p[i][0] - p[0][0]) ** 2 + (p[i][1] - p[0][1]) ** 2, 9), -i))
        assert kept[k] == peucker(p[: far + 1], n * 0.02) + peucker([*p[far:], p[0]], n * 0.02)
    # The first corner comes at or after the ring's smallest edge.
    edges = {r["id"]: r["next"] for r in outline.outline_edges(df).collect()}
    for r in outline.ring_places(outline.outline_edges(df)).collect():
        at, n = r["id"], 0
        while edges[at] != r["ring"]:
            at, n = edges[at], n + 1
        assert r["left"] == n and r["ring"] <= r["id"]


def test_rounds_do_not_grow_with_rings_inside_of_tiles(spark, monkeypatch):
    """A comb of 120 rows has a ring of thousands of edges and corners; it takes no more writes than a square."""
    seen = []
    real = outline.written
    monkeypatch.setattr(outline, "written", lambda df: seen.append(1) or real(df))
    counts = []
    for cells in ([(0, 0)], [(r, c) for r in range(120) for c in range(40) if r % 2 == 0 or c == 0]):
        seen.clear()
        outline.simplified(outline.outlines(spark.createDataFrame([(r, c, 1) for r, c in cells], "row bigint, col bigint, label int")), 1e-4).count()
        counts.append(len(seen))
    assert counts[0] == counts[1]
