"""Row numbers and order statistics against plain sorting."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdance.operators import deals, layout, ordering, regress, stats
from verdance.plans import validation


def test_numbered(spark):
    df = spark.range(1000).select(((F.col("id") * 377) % 1009).alias("a"), "id").repartition(7)
    got = {r["id"]: r["i"] for r in ordering.numbered(df, ["a", "id"]).collect()}
    want = sorted(range(1000), key=lambda i: ((i * 377) % 1009, i))
    assert got == {v: n for n, v in enumerate(want, 1)}
    assert ordering.numbered(df.limit(0), ["a", "id"]).count() == 0


@pytest.mark.parametrize("fetched", [20, 50_000])
def test_quantiles(spark, monkeypatch, fetched):
    monkeypatch.setattr(ordering, "FETCHED", fetched)
    rnd = np.random.default_rng(3)
    at = (0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0)
    for values in (rnd.normal(size=2000), rnd.integers(0, 5, 1500).astype(float), np.zeros(300), np.array([4.0])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        assert ordering.quantiles(df, "v", at) == pytest.approx(list(np.quantile(values, at)))
    assert ordering.quantiles(spark.createDataFrame([], "v double"), "v", (0.5,)) == [None]


def test_fdr_and_rolling_over_many_ranges(spark, monkeypatch):
    rnd = np.random.default_rng(4)
    p = rnd.random(400) ** 3
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)] + [(900, None)], "k long, p double").repartition(6)
    got = {r["k"]: r["q"] for r in stats.fdr(df, "p", "k").collect()}
    order = np.argsort(p, kind="stable")
    q = np.minimum(1, np.minimum.accumulate((p[order] * 400 / np.arange(1, 401))[::-1])[::-1])
    assert got.pop(900) is None and got == pytest.approx({int(k): float(v) for k, v in zip(order, q, strict=True)})
    monkeypatch.setattr(layout, "ROWS", 32)
    v = [None if i % 5 == 0 else float(i * i % 37) for i in range(300)]
    rows = spark.createDataFrame([(i, x, x) for i, x in enumerate(v)], "k long, dx double, dy double")
    out = {r["k"]: r["roll_x"] for r in layout.rolling_offsets(rows, "k", "dx", "dy").collect()}
    for i in range(300):
        own = [x for x in v[max(0, i - 10) : i] if x is not None]
        assert out[i] == (pytest.approx(np.mean(own)) if len(own) >= 3 else None)


def test_places_are_permutations(spark):
    for n in (1, 2, 3, 7, 60, 997):
        got = spark.range(n).select(*(deals.place(F.col("id"), n, F.lit(k)).alias(f"p{k}") for k in (1, 2, 977))).collect()
        for j in range(3):
            assert sorted(r[j] for r in got) == list(range(n))


def test_permuted_gradients_look_like_chance(spark):
    """On a row-ordered grid with a gradient, places keep no neighbourhoods: the null's deviation is that of random permutations."""
    side, rounds = 24, 40
    n = side * side
    df = spark.range(n).withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    at = np.zeros((rounds, n), int)
    for r in df.select("id", "j", deals.place(F.col("id"), n, F.col("j") + 42 * 100_003).alias("p")).collect():
        at[r["j"] - 1, r["p"]] = r["id"]
    rnd = np.random.default_rng(0)

    def deviation(perms):
        out = []
        for p in perms:
            z = (p // side - (side - 1) / 2).reshape(side, side)
            num = (z[1:] * z[:-1]).sum() + (z[:, 1:] * z[:, :-1]).sum()
            out.append(num / (2 * side * (side - 1)) / z.var())
        return np.std(out), np.max(np.abs(out))

    got, want = deviation(at), deviation([rnd.permutation(n) for _ in range(rounds)])
    assert got[0] < 1.5 * want[0] and got[1] < 0.2


def test_seeded_folds_are_independent(spark):
    rows = validation.seeded(spark.range(4000).withColumnRenamed("id", "k")).select("k", "s.at", "fold").collect()
    fold = np.zeros((len(validation.SEEDS), 4000), int)
    for r in rows:
        fold[r["at"], r["k"]] = r["fold"]
    pairs = np.random.default_rng(1).integers(0, 4000, (40_000, 2))
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    same = fold[:, pairs[:, 0]] == fold[:, pairs[:, 1]]
    for a in range(len(fold)):
        assert 0.18 < same[a].mean() < 0.22
        for b in range(a):
            assert 0.17 < same[a][same[b]].mean() < 0.23


def test_poisson_counts(spark):
    w = np.array([r[0] for r in spark.range(20_000).select(deals.poisson(deals.mixed(F.col("id"), F.lit(7)) / float(deals.MODULUS))).collect()])
    assert abs(w.mean() - 1) < 0.03 and abs(w.var() - 1) < 0.05


def test_neighbours_in_blocks(spark):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(150, 2))
    df = spark.createDataFrame([(i, float(a), float(b), float(i % 11), i % 3) for i, (a, b) in enumerate(x)], "k long, a double, b double, y double, g int")
    z = (x - x.mean(0)) / x.std(0)
    for apart in (None, "g"):
        got = {r["k"]: r["predicted"] for r in regress.knn_regression(df, df, ["a", "b"], "y", 4, "k", block=40, apart=apart).collect()}
        for i in range(150):
            order = sorted((float(((z[i] - z[j]) ** 2).sum()), j) for j in range(150) if j != i and (apart is None or j % 3 != i % 3))
            assert got[i] == pytest.approx(np.mean([j % 11 for _, j in order[:4]]))


@pytest.mark.parametrize("least", [0, 10**9])
def test_kendall_with_ties_in_groups_of_any_size(spark, least):
    rnd = np.random.default_rng(2)
    rows = [(g, float(x), float(y)) for g, n in ((0, 1), (1, 2), (2, 300), (3, 60)) for x, y in zip(rnd.integers(0, 40, n) // (1 + 39 * (rnd.random(n) < 0.4)), rnd.integers(0, 25, n), strict=True)]
    df = spark.createDataFrame([*rows, (2, None, 1.0), (4, 1.0, None)], "g int, x double, y double")
    want = {}
    for g in (1, 2, 3):
        own = [(x, y) for h, x, y in rows if h == g]
        pairs = [(np.sign(a[0] - b[0]) * np.sign(a[1] - b[1])) for i, a in enumerate(own) for b in own[:i]]
        want[g] = (len(pairs), pytest.approx(float(np.mean(pairs))))
    got = {r["g"]: (r["pairs"], r["tau"]) for r in stats.kendall(df, "x", "y", "x", ("g",), ranges=9, least=least).collect()}
    assert got == want
    one = stats.kendall(df.filter("g = 2"), "x", "y", "x", ranges=9, least=least).collect()
    assert [(r["pairs"], r["tau"]) for r in one] == [want[2]]


def test_quantiles_of_many_ranks_at_once(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    values = np.concatenate([rnd.normal(size=3000), np.zeros(2000), [5.0] * 700])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(5)
    at = (0.0, 0.01, 0.3, 0.5, 0.5001, 0.9, 0.99, 1.0)
    for fetched in (50_000, 40):
        monkeypatch.setattr(ordering, "FETCHED", fetched)
        assert ordering.quantiles(df, "v", at) == pytest.approx([float(np.quantile(values, p)) for p in at])
    assert ordering.quantiles(df.limit(0), "v", (0.5,)) == [None]


@pytest.mark.parametrize("fetched", [1, 50_000])
def test_middle_equals_the_median(spark, monkeypatch, fetched):
    monkeypatch.setattr(ordering, "FETCHED", fetched)
    rnd = random.Random(3)
    for values in ([], [2.5], [1.0, 4.0], [0.0, 5e-324, 5e-324], [-1.7e308, 0.5, 1.7e308, 3.0], [7.0] * 9 + [1.0], [rnd.choice([rnd.gauss(0, 1), 3.0, 1e9]) for _ in range(501)], [float(i // 7) for i in range(200)]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        assert ordering.middle(df, F.col("v"), 16) == (np.median(values) if values else None)


def test_huber_takes_no_median_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(F, "median", lambda *_: pytest.fail("an exact median holds all values in one task"))
    rows = [(float(i % 10), 3.0 * (i % 10) + i % 7 / 10 + (500.0 if i % 50 == 0 else 0.0)) for i in range(1000)]
    slope = regress.huber(spark.createDataFrame(rows, "x double, y double"), ["x"], "y")[1]
    assert abs(slope - 3.0) < 0.05


def test_spearman_deals_groups_over_more_tasks_with_more_rows(spark, monkeypatch):
    monkeypatch.setattr(stats, "RANKED", 20)
    rnd = random.Random(2)
    rows = [(g, float(rnd.randrange(6)), float(rnd.randrange(9))) for g in range(12) for _ in range(30)]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    seen = []
    own = stats.pearson
    monkeypatch.setattr(stats, "pearson", lambda d, *a: seen.append(d.rdd.getNumPartitions()) or own(d, *a))
    got = {r["g"]: r["rho"] for r in stats.spearman(df, "x", "y", ("g",)).collect()}
    assert seen == [18]
    mean = lambda v: [sum((a < b) + (a == b) / 2 for a in v) for b in v]
    for g in range(12):
        x, y = zip(*((a, b) for k, a, b in rows if k == g), strict=True)
        assert abs(got[g] - np.corrcoef(mean(x), mean(y))[0, 1]) < 1e-9


def test_neighbours_of_copies_and_clusters(spark):
    """Rows at a few places in many copies, and clusters far apart: as a plain loop says, with leaves much smaller than the table."""
    from verdance.operators import regress

    rng = np.random.default_rng(5)
    rows = [(i, float(a), float(b), float(i % 17), i % 3) for i, (a, b) in enumerate(np.concatenate([np.repeat(rng.normal(size=(6, 2)), 40, axis=0), rng.normal(size=(200, 2)) + 50]).tolist())]
    df = spark.createDataFrame(rows, "k long, a double, b double, y double, part long")
    v = np.array([[r[1], r[2]] for r in rows])
    z = (v - v.mean(0)) / v.std(0)
    for apart in (None, "part"):
        got = {}
        for r in regress.neighbours(df, df, ["a", "b"], "y", 7, "k", block=16, apart=apart).collect():
            got.setdefault(r["_k"], {})[r["rank"]] = r["_i"]
        for i, row in enumerate(rows):
            d = ((z - z[i]) ** 2).sum(1).round(12)
            others = [j for j in range(len(rows)) if j != i and not (apart and rows[j][4] == row[4])]
            assert [d[j] for j in (got[i][n] for n in range(1, 8))] == sorted(d[j] for j in others)[:7]
            if i < 240:  # copies at a place: the smallest keys
                assert list(got[i][n] for n in range(1, 8)) == sorted(others, key=lambda j: (d[j], j))[:7]


def test_dealt_in_arrays(spark):
    """The column that arrays deal is that of the column function, and a permutation."""
    df = spark.range(1000).select("id", deals.placed(F.col("id"), 1000, 77).alias("a"), deals.place(F.col("id"), 1000, F.lit(77)).alias("b"))
    got = df.collect()
    assert all(r["a"] == r["b"] for r in got) and {r["a"] for r in got} == set(range(1000))
