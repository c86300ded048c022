"""Rounds of mutual best pairs give what taking pairs one by one gives."""

from __future__ import annotations

import random

import numpy as np

from verdance.operators import layout, match, stats
from verdance.plans import joins, statistics
from verdance.plans import layout as layout_plans
from verdance.plans.registry import pixels, spots


def by_hand(pairs):
    left, right, out = set(), set(), set()
    for d, a, b in sorted((d, a, b) for a, b, d in pairs):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            out.add((a, b))
    return out


def test_greedy_equals_one_by_one(spark):
    rnd = random.Random(5)
    for _ in range(3):
        pairs = list({(rnd.randrange(12), rnd.randrange(12)): None for _ in range(50)})
        rows = [(a, b, float(rnd.randrange(6))) for a, b in pairs]
        got = match.greedy(spark.createDataFrame(rows, "left_id int, right_id int, d double"))
        assert {(r["left_id"], r["right_id"]) for r in got.collect()} == by_hand(rows)


def test_greedy_of_nothing(spark):
    assert match.greedy(spark.createDataFrame([], "left_id int, right_id int, d double")).count() == 0


def test_fdr_is_monotone_and_passes_nulls(spark):
    rows = [(1, 0.01), (2, 0.04), (3, 0.03), (4, None), (5, 0.9)]
    got = {r["k"]: r["q"] for r in stats.fdr(spark.createDataFrame(rows, "k int, p double"), "p", "k").collect()}
    assert got[4] is None
    assert got[1] <= got[3] <= got[2] <= got[5] <= 1
    assert abs(got[1] - 0.04) < 1e-12


def test_labels_of_two_blobs(spark):
    px = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (5, 5)], "row int, col int")
    got = {(r["row"], r["col"]): r["label"] for r in layout.labelled(px).collect()}
    assert got == {(0, 0): 0, (0, 1): 0, (1, 1): 0, (5, 5): 5 * 2**32 + 5}


def test_constants_without_spread_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0)] * 5, "x double, y double")
    assert stats.pearson(df, "x", "y").first()["r"] is None


def brute_closest(left, right):
    return {i: min((round(((x - u) ** 2 + (y - v) ** 2) ** 0.5, 6), j) for j, u, v in right)[::-1] for i, x, y in left}


def test_closest_has_no_cap(spark):
    rnd = random.Random(3)
    make = lambda n, w: [(i, rnd.uniform(0, w), rnd.uniform(0, w)) for i in range(n)]
    left = [*make(60, 50.0), (100, 9e5, -4e5), (101, -7e6, 3.0)]
    for right in (make(20, 50.0), [(4, 7.0, 7.0), (2, 7.0, 7.0)], [(1, 0.0, 5e6), (2, 10.0, 5e6)]):
        got = match.closest(*(spark.createDataFrame(rows, "id int, x double, y double") for rows in (left, right)))
        got = {r["left_id"]: (r["right_id"], r["d"]) for r in got.collect()}
        want = brute_closest(left, right)
        assert got.keys() == want.keys()
        assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 2e-6 for i in want)
    none = spark.createDataFrame([], "id int, x double, y double")
    assert match.closest(spark.createDataFrame(left, "id int, x double, y double"), none).count() == 0


def test_allocation_of_all_points(spark, sf):
    cu, su = ([tuple(r) for r in side.select("id", "x", "y").collect()] for side in spots(spark, sf))
    got = {r["id"]: r["zone"] for r in layout_plans.R.queries["up_allocation"](spark, sf).collect()}
    assert got == {i: m[0] for i, m in brute_closest(cu, su).items()}


def test_nearest_attribute_of_every_row(spark, sf):
    cu, su = ([tuple(r) for r in side.select("id", "x", "y").collect()] for side in spots(spark, sf))
    got = {r["left_id"]: r["right_id"] for r in joins.R.queries["joi_nearest_any"](spark, sf).collect()}
    assert got == {i: m[0] for i, m in brute_closest(cu, su).items()}


def test_regression_over_all_rows(spark, sf):
    px = pixels(spark, sf).select("flag", "r", "v").toPandas()
    got = {r["flag"]: r for r in statistics.R.queries["st_simple_regression"](spark, sf).collect()}
    assert sum(r["n"] for r in got.values()) == len(px)
    for flag, rows in px.groupby("flag"):
        x, y = rows["r"].to_numpy(float), rows["v"].to_numpy(float)
        slope, intercept = np.polyfit(x, y, 1)
        rest = ((y - slope * x - intercept) ** 2).sum()
        se = (rest / (len(x) - 2) / ((x - x.mean()) ** 2).sum()) ** 0.5
        want = {"slope": slope, "intercept": intercept, "r2": 1 - rest / ((y - y.mean()) ** 2).sum(), "se": se, "t": slope / se}
        assert all(np.isclose(got[flag][k], w, rtol=1e-4, atol=1e-3) for k, w in want.items())


def test_labels_of_an_image_of_all_rows(spark, sf):
    on = {(r["row"], r["col"]) for r in layout_plans.foreground(spark, sf).collect()}
    want = {}
    for start in sorted(on):
        todo = [] if start in want else [start]
        while todo:
            r, c = todo.pop()
            if (r, c) in on and (r, c) not in want:
                want[r, c] = start[0] * 2**32 + start[1]
                todo += [(r, c + 1), (r + 1, c), (r, c - 1), (r - 1, c)]
    got = {(r["row"], r["col"]): r["label"] for r in layout_plans.R.queries["up_labels"](spark, sf).collect()}
    assert got == want
    assert len(set(want.values())) < len(want)


def test_greedy_in_tiles_equals_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(match, "TILE_PAIRS", 40)
    rnd = random.Random(8)
    for at in (None, ("x", "y")):
        pairs = list({(rnd.randrange(40), rnd.randrange(30)): None for _ in range(150)})
        rows = [(a, b, float(rnd.randrange(6)), float(a % 7), float(a // 7)) for a, b in pairs]
        got = match.greedy(spark.createDataFrame(rows, "left_id int, right_id int, d double, x double, y double"), at=at)
        assert {(r["left_id"], r["right_id"]) for r in got.collect()} == by_hand([r[:3] for r in rows])


def test_greedy_rounds_do_not_grow_with_chains(spark, monkeypatch):
    """A chain of pairs of one length along a line, in the order of ids, took a round a pair."""
    rounds = []
    add = match.Appended.add
    monkeypatch.setattr(match.Appended, "add", lambda self, df: rounds.append(1) or add(self, df))
    left = spark.createDataFrame([(i, 2.0 * i, 0.0) for i in range(60)], "id long, x double, y double")
    right = spark.createDataFrame([(i, 2.0 * i + 1, 0.0) for i in range(60)], "id long, x double, y double")
    got = {(r["left_id"], r["right_id"]) for r in match.greedy_within(left, right, 1.5).collect()}
    assert got == {(i, i) for i in range(60)}
    assert len(rounds) < 10


def test_greedy_of_places_with_copies(spark):
    rnd = random.Random(4)
    side = lambda n: [(i, float(rnd.randrange(5)), float(rnd.randrange(4))) for i in range(n)]
    for n, m in ((70, 25), (20, 60)):
        a, b = side(n), side(m)
        every = [(i, j, round(((x - u) ** 2 + (y - v) ** 2) ** 0.5, 6)) for i, x, y in a for j, u, v in b]
        left, right = (spark.createDataFrame(s, "id long, x double, y double") for s in (a, b))
        near = [p for p in every if p[2] <= 2.5]
        assert {(r["left_id"], r["right_id"]) for r in match.greedy_within(left, right, 2.5).collect()} == by_hand(near)
        ranked = {i: sorted((d, j) for k, j, d in near if k == i)[:3] for i, *_ in a}
        closest = [(i, j, d) for i, found in ranked.items() for d, j in found]
        assert {(r["left_id"], r["right_id"]) for r in match.greedy_nearest(left, right, 3, 2.5).collect()} == by_hand(closest)


def test_thinning_makes_no_pairs_and_equals_one_by_one(spark, monkeypatch):
    rnd = random.Random(6)
    rows = [(i, float(rnd.randrange(30)), float(rnd.randrange(30))) for i in range(300)] + [(900, None, 1.0)]
    kept = []
    for i, x, y in rows[:-1]:
        if all((x - u) ** 2 + (y - v) ** 2 >= 49 for _, u, v in kept):
            kept.append((i, x, y))
    met = []
    own = layout.within
    monkeypatch.setattr(layout, "within", lambda a, b, *r: met.append(b.count()) or own(a, b, *r))
    got = {r["id"] for r in layout.thinned(spark.createDataFrame(rows, "id long, x double, y double"), 7.0).collect()}
    assert got == {i for i, *_ in kept} | {900}
    assert sum(met) <= len(kept)
