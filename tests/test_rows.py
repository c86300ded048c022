"""The row-aware splitter against marches and counts by loops."""

import math

import pytest

from verdance.operators import layout, rows

PIXELS = "row long, col long"


def disc(y, x, r):
    return {(i, j) for i in range(y - r, y + r + 1) for j in range(x - r, x + r + 1) if (i - y) ** 2 + (j - x) ** 2 <= r * r}


def march(own, deg):
    """Steps from the centroid until the nearest pixel is outside."""
    y, x = (sum(p[i] for p in own) / len(own) for i in (0, 1))
    n, c, s = 0, math.cos(math.radians(deg)), math.sin(math.radians(deg))
    while (round(y + n * s), round(x + n * c)) in own:
        n += 1
    return n


def test_radii_equal_marches(spark):
    ring = disc(60, 60, 9) - disc(60, 60, 4)  # its centroid is outside of it
    made = {1: disc(20, 20, 7) | disc(20, 31, 7), 2: ring, 3: {(5, 100)}, 4: disc(100, 40, 8) - {(100, 45), (97, 40)}, 5: {(200, c) for c in range(300)}}
    got = {(r.label, r.deg): r.radius for r in rows.radii(spark.createDataFrame([(*p, k) for k, v in made.items() for p in v], PIXELS + ", label long")).collect()}
    assert got == {(k, d): march(v, d) for k, v in made.items() for d in range(0, 180, 15)}


def test_opening_takes_thin_parts_away(spark):
    thick, thin = disc(10, 10, 4), {(10, c) for c in range(15, 25)}
    got = {tuple(r) for r in rows.opened(spark.createDataFrame(sorted(thick | thin), PIXELS)).select("row", "col").collect()}
    cross = [(0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)]
    kept = {p for p in thick | thin if all((p[0] + a, p[1] + b) in thick | thin for a, b in cross)}
    assert got == {(p[0] + a, p[1] + b) for p in kept for a, b in cross} and not got & {(10, c) for c in range(18, 25)}


def profile_cuts(own, radius, angle, ends):
    """Bounds and half width of an object's cuts by loops; None where it is too short."""
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    t, across = [x * c + y * s for y, x in own], [y * c - x * s for y, x in own]
    t0, long, wide = min(t), max(t) - min(t), max(across) - min(across) + 1e-6
    fit, bins = round(long / max(2 * radius * 0.98, 1)), min(max(round(long), 48), 256)
    if fit < 2 or long / wide < 1.2:
        return None
    n = [0] * bins
    for v in t:
        n[min(int((v - t0) / (long + 1e-6) * bins), bins - 1)] += 1
    sigma = max(1.0, 0.02 * bins)
    reach = int(4 * sigma + 0.5)
    w = {d: math.exp(-0.5 * d * d / sigma**2) for d in range(-reach, reach + 1)}
    p = [round(sum(w[d] * n[min(max(i + d, 0), bins - 1)] for d in w) / sum(w.values()), 9) for i in range(bins)]
    less = lambda i, j: p[i] < p[j] if 0 <= j < bins else ends
    deep = sorted((p[i], i) for i in range(bins) if less(i, i - 1) and less(i, i + 1))[: fit - 1]
    return [t0 + (i + 0.5) * long / bins for _, i in deep], max(1.0, 0.1 * wide)


@pytest.mark.parametrize("ends", [True, False])
def test_cuts_equal_loops(spark, ends):
    made = {1: disc(20, 20, 7) | disc(20, 33, 7) | disc(20, 46, 7), 2: disc(60, 20, 7), 3: {(y, x) for y in range(90, 96) for x in range(400)}, 4: disc(120, 20, 8) | disc(124, 34, 8)}
    got = {r.label: (list(r.bounds), r.half) for r in rows.cuts(spark.createDataFrame([(*p, k) for k, v in made.items() for p in v], PIXELS + ", label long"), 7.5, 2.5, ends).collect()}
    want = {k: cut for k, v in made.items() if (cut := profile_cuts(v, 7.5, 2.5, ends)) is not None}
    assert set(got) == set(want) == {1, 3, 4}
    assert all(got[k][0] == pytest.approx(want[k][0], abs=1e-6) and got[k][1] == pytest.approx(want[k][1]) for k in want)


@pytest.mark.parametrize("turned", [False, True])
def test_discs_in_a_row_come_apart(spark, turned):
    # Three rows of three discs that run together, single discs, and a speck; once along columns.
    discs = [(y, x) for y in (15, 45, 75) for x in (15, 28, 41)] + [(15, 90), (45, 90), (75, 90), (100, 90)]
    pixels = {p for y, x in discs for p in disc(y, x, 7)} | {(110, 10), (110, 11)}
    flip = lambda p: p[::-1] if turned else p
    given = [flip(p) for p in pixels] * 2 + [(None, 1)]
    out = [tuple(r) for r in rows.split(spark.createDataFrame(given, PIXELS), 60, ends=False).collect()]
    assert len(out) == len({r[:2] for r in out}) and {r[:2] for r in out} <= set(map(flip, pixels))
    centres = {flip(d): {r[2] for r in out if math.dist(r[:2], flip(d)) <= 3} for d in discs}
    assert all(len(v) == 1 for v in centres.values())
    assert len({next(iter(v)) for v in centres.values()}) == len(discs) == len({r[2] for r in out})


def test_no_pixels(spark):
    assert rows.split(spark.createDataFrame([], PIXELS)).count() == 0
    assert rows.split(spark.createDataFrame([(1, 1)], PIXELS), 5).count() == 0


def test_longer_objects_take_no_more_rounds(spark, monkeypatch):
    """Labels are found in tiles: a split of a long winding object writes as often as that of a disc."""
    winding = {(y, x) for y in range(60) for x in range(40) if y % 2 == 0 or x == (39 if y % 4 == 1 else 0)}
    seen, counts = [], []
    real = layout.written
    monkeypatch.setattr(layout, "written", lambda df: seen.append(1) or real(df))
    for own in (disc(20, 20, 7), winding):
        seen.clear()
        rows.split(spark.createDataFrame(sorted(own), PIXELS), 5, opening=False).count()
        counts.append(len(seen))
    assert counts[0] == counts[1]
