"""Seed-robust validation, searches, ensembles and inference, each beside its SQL.

Folds are a function of a row's order and a seed, so that both sides deal alike and
an order's rows stay together. A search reads the data once: Gram rows by seed and fold.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from verdance.operators import regress, stats
from verdance.operators.deals import mixed, mixed_sql, place_sql
from verdance.plans.models import _px, irls_sql, tidy
from verdance.plans.registry import PX, Registry, pixels, read, rounded
from verdance.plans.statistics import f_sql, t_sql

R = Registry()
C = F.col
#: The seeds of the robustness check.
SEEDS = [42, 1, 7, 13, 99, 2024]
FOLDS = 5
SEEDED = f"""s(seed) AS (VALUES {", ".join(f"({s})" for s in SEEDS)}),
p AS (SELECT seed, {mixed_sql("k", "seed")} % {FOLDS} AS fold, k, n, r, g, b, v FROM px, s)"""


def seeded(df):
    """``df`` once a seed, with its fold and a group number seed * FOLDS + fold."""
    own = df.withColumn("s", F.explode(F.array(*(F.struct(F.lit(i).alias("at"), F.lit(s).cast("long").alias("seed")) for i, s in enumerate(SEEDS)))))
    fold = mixed(C("k"), C("s.seed")) % FOLDS
    return own.withColumn("fold", fold.cast("int")).withColumn("group", (C("s.at") * FOLDS + C("fold")).cast("int"))


@R.add(
    "cv_seeds",
    f"""WITH {PX}, {SEEDED}, m AS (SELECT avg(v) AS mu FROM px),
    f AS (SELECT a.seed, a.fold, regr_slope(c.v, c.r) AS cb, regr_intercept(c.v, c.r) AS ca
      FROM (SELECT DISTINCT seed, fold FROM p) a JOIN p c ON a.seed = c.seed AND a.fold <> c.fold GROUP BY ALL),
    e AS (SELECT seed, 1 - sum(pow(v - ca - cb * r, 2)) / sum(pow(v - mu, 2)) AS r2, avg(pow(v - ca - cb * r, 2)) / 1e6 AS mse,
      avg(abs(v - ca - cb * r)) AS mae FROM p JOIN f USING (seed, fold), m GROUP BY seed),
    l AS (UNPIVOT e ON r2, mse, mae INTO NAME metric VALUE x)
    SELECT metric, round(min(x), 5) AS low, round(max(x), 5) AS high, round(avg(x), 5) AS mean FROM l GROUP BY metric""",
)
def cv_seeds(spark, sf):
    """Held-out r2, MSE and MAE over six seeds' folds: smallest, largest, mean (CV-1, CV-2)."""
    px = seeded(pixels(spark, sf))
    gs = regress.grams(px, ["r", "v"], C("group"))
    coef, scores = [], {}
    for i, s in enumerate(SEEDS):
        own = {k: g for k, g in gs.items() if k // FOLDS == i}
        every = regress.total(own)
        coef += [(k, *map(float, regress.ols(every - g, ["r"], "v"))) for k, g in own.items()]
        scores[s] = regress.cross_validated(own, ["r"], "v")
    table = spark.createDataFrame(coef, "group int, ca double, cb double")  # one row a seed and fold
    mae = px.join(F.broadcast(table), "group").groupBy("s.seed").agg(F.avg(F.abs(C("v") - C("ca") - C("cb") * C("r"))).alias("mae")).collect()
    values = {"r2": [s["r2"] for s in scores.values()], "mse": [s["mse"] / 1e6 for s in scores.values()], "mae": [r["mae"] for r in mae]}
    rows = [(m, round(float(min(v)), 5), round(float(max(v)), 5), round(float(np.mean(v)), 5)) for m, v in values.items()]
    return spark.createDataFrame(rows, "metric string, low double, high double, mean double")


def shrunk(lam: float):
    """Least squares with one predictor, its slope divided by 1 + lam."""

    def fit(g, xs, y):
        a, b = regress.ols(g, xs, y)
        j = g.at(xs)[0]
        slope = b / (1 + lam)
        return np.array([a + (b - slope) * g.m[0, j] / g.n, slope])

    return fit


PENALTIES = (0.0, 0.05, 0.5)


@R.add(
    "cv_grid",
    f"""WITH {PX}, {SEEDED}, q AS (SELECT seed, fold, 'r' AS x, r AS u, v FROM p UNION ALL SELECT seed, fold, 'g', g, v FROM p UNION ALL SELECT seed, fold, 'b', b, v FROM p),
    lam(penalty) AS (VALUES {", ".join(f"({p}::DOUBLE)" for p in PENALTIES)}),
    f AS (SELECT a.seed, a.fold, a.x, regr_slope(c.v, c.u) AS cb, avg(c.v) AS my, avg(c.u) AS mx
      FROM (SELECT DISTINCT seed, fold, x FROM q) a JOIN q c ON a.seed = c.seed AND a.x = c.x AND a.fold <> c.fold GROUP BY ALL),
    e AS (SELECT seed, x, penalty, 1 - sum(pow(v - my - cb / (1 + penalty) * (u - mx), 2)) / sum(pow(v - (SELECT avg(v) FROM px), 2)) AS r2
      FROM q JOIN f USING (seed, fold, x), lam GROUP BY ALL),
    t AS (SELECT x, penalty, r2 AS screened FROM e WHERE seed = 42 ORDER BY round(r2, 9) DESC, x || ' ' || penalty LIMIT 3)
    SELECT x || ' ' || penalty AS name, round(min(screened), 6) AS screened, round(min(r2), 6) AS low, round(max(r2), 6) AS high, round(avg(r2), 6) AS mean
    FROM t JOIN e USING (x, penalty) GROUP BY x, penalty""",
)
def cv_grid(spark, sf):
    """Grid of predictors and penalties: screened on one seed, the best three finalised on six (CV-6)."""
    gs = regress.grams(seeded(pixels(spark, sf)), ["r", "g", "b", "v"], C("group"))
    grid = {f"{x} {p}": ([x], shrunk(p)) for x in ("r", "g", "b") for p in PENALTIES}
    found = regress.grid_search(gs, grid, "v", SEEDS, FOLDS, 42, 3)
    rows = [(r["name"], *(round(float(r[c]), 6) for c in ("screened", "low", "high", "mean"))) for r in found]
    return spark.createDataFrame(rows, "name string, screened double, low double, high double, mean double")


ONE_FOLD = "p AS (SELECT *, CAST(k % 5 AS INTEGER) AS fold FROM px)"
LEFT_OUT = "FROM (SELECT DISTINCT fold FROM p) a JOIN p c ON a.fold <> c.fold GROUP BY ALL"


@R.add(
    "cv_swap",
    f"""WITH {PX}, {ONE_FOLD}, q AS (SELECT fold, v, r AS u, 'r' AS field FROM p UNION ALL SELECT fold, v, 2 * r + 3, 'r_moved' FROM p UNION ALL SELECT fold, v, -r / 7, 'r_turned' FROM p),
    f AS (SELECT a.fold, a.field, regr_slope(c.v, c.u) AS cb, regr_intercept(c.v, c.u) AS ca
      FROM (SELECT DISTINCT fold, field FROM q) a JOIN q c ON a.field = c.field AND a.fold <> c.fold GROUP BY ALL),
    e AS (SELECT field, 1 - sum(pow(v - ca - cb * u, 2)) / sum(pow(v - (SELECT avg(v) FROM px), 2)) AS r2 FROM q JOIN f USING (fold, field) GROUP BY field)
    SELECT field, round(r2, 6) AS r2, (SELECT max(r2) - min(r2) < 1e-6 FROM e) AS same FROM e""",
)
def cv_swap(spark, sf):
    """A term swapped for fields that say the same: every one gives the same held-out r2 (CV-11)."""
    px = _px(spark, sf).withColumns({"r_moved": 2 * C("r") + 3, "r_turned": -C("r") / 7})
    gs = regress.grams(px, ["r", "r_moved", "r_turned", "v"], C("fold"))
    got = {x: float(regress.cross_validated(gs, [x], "v")["r2"]) for x in ("r", "r_moved", "r_turned")}
    same = max(got.values()) - min(got.values()) < 1e-6
    return spark.createDataFrame([(x, round(v, 6), same) for x, v in got.items()], "field string, r2 double, same boolean")


@R.add(
    "ml_survivors",
    f"""WITH {PX}, {SEEDED}, q AS (SELECT seed, fold, 'r' AS x, r AS u, v FROM p UNION ALL SELECT seed, fold, 'g', g, v FROM p UNION ALL SELECT seed, fold, 'b', b, v FROM p
      UNION ALL SELECT seed, fold, 'r2', r * r, v FROM p),
    f AS (SELECT a.seed, a.fold, a.x, regr_slope(c.v, c.u) AS cb, regr_intercept(c.v, c.u) AS ca
      FROM (SELECT DISTINCT seed, fold, x FROM q) a JOIN q c ON a.seed = c.seed AND a.x = c.x AND a.fold <> c.fold GROUP BY ALL),
    e AS (SELECT seed, x, 1 - sum(pow(v - ca - cb * u, 2)) / sum(pow(v - (SELECT avg(v) FROM px), 2)) AS r2 FROM q JOIN f USING (seed, fold, x) GROUP BY ALL),
    t AS (SELECT seed, x, row_number() OVER (PARTITION BY seed ORDER BY round(r2, 9) DESC, x) AS i FROM e),
    o AS (SELECT x, count(*) AS seeds FROM t WHERE i <= 2 GROUP BY x),
    w AS (SELECT a.x AS term, a.seeds, z.x AS other, CASE a.x WHEN 'r' THEN r WHEN 'g' THEN g WHEN 'b' THEN b ELSE r * r END AS ua,
      CASE z.x WHEN 'r' THEN r WHEN 'g' THEN g WHEN 'b' THEN b ELSE r * r END AS uz FROM o a JOIN o z ON a.x < z.x, px)
    SELECT term, seeds, other, round(corr(ua, uz), 6) + 0.0 AS r FROM w GROUP BY ALL""",
)
def ml_survivors(spark, sf):
    """How often a term is among a seed's best two, and the correlations of those that ever are (AGG-26, CV-12)."""
    px = seeded(pixels(spark, sf).withColumn("r2", C("r") * C("r")))
    gs = regress.grams(px, ["r", "g", "b", "r2", "v"], C("group"))
    picked: dict[str, int] = {}
    for i in range(len(SEEDS)):
        own = {k: g for k, g in gs.items() if k // FOLDS == i}
        ranked = sorted(("r", "g", "b", "r2"), key=lambda x: (-round(float(regress.cross_validated(own, [x], "v")["r2"]), 9), x))
        for x in ranked[:2]:
            picked[x] = picked.get(x, 0) + 1
    g = regress.total(gs)
    rows = [(a, picked[a], z, round(regress.correlation(g, a, z), 6) + 0.0) for a in sorted(picked) for z in sorted(picked) if a < z]
    return spark.createDataFrame(rows, "term string, seeds long, other string, r double")


@R.add(
    "ml_ensemble",
    f"""WITH {PX}, {ONE_FOLD}, f AS (SELECT a.fold, regr_slope(c.v, c.r) AS rb, regr_intercept(c.v, c.r) AS ra, regr_slope(c.v, c.r * c.r) AS qb,
      regr_intercept(c.v, c.r * c.r) AS qa, avg(c.v) AS mu {LEFT_OUT}),
    e AS (SELECT v, ra + rb * r AS a, qa + qb * r * r AS q, (ra + rb * r + qa + qb * r * r) / 2 AS m FROM p JOIN f USING (fold)),
    t AS (SELECT sum(pow(v - (SELECT avg(v) FROM px), 2)) AS sst FROM px)
    SELECT 'line' AS model, round(1 - sum(pow(v - a, 2)) / min(sst), 6) AS r2 FROM e, t UNION ALL SELECT 'square', round(1 - sum(pow(v - q, 2)) / min(sst), 6) FROM e, t
    UNION ALL SELECT 'mean', round(1 - sum(pow(v - m, 2)) / min(sst), 6) FROM e, t""",
)
def ml_ensemble(spark, sf):
    """Held-out predictions of two models and of their mean (ML-18, PRJ-38)."""
    gs = regress.grams(_px(spark, sf), ["r", "r2", "v"], C("fold"))

    def mean(g, xs, y):
        a, b = regress.ols(g, ["r"], y), regress.ols(g, ["r2"], y)
        return np.array([(a[0] + b[0]) / 2, a[1] / 2, b[1] / 2])

    both = ["r", "r2"]
    line = regress.cross_validated(gs, ["r"], "v")["r2"]
    rows = [("line", line), ("square", regress.cross_validated(gs, ["r2"], "v")["r2"]), ("mean", regress.cross_validated(gs, both, "v", mean)["r2"])]
    return spark.createDataFrame([(m, round(float(v), 6)) for m, v in rows], "model string, r2 double")


def _glm_sql(family: str, steps: int = 8) -> str:
    cubic = family == "inverse_gaussian"
    part = "pow(v - mu, 2) / (mu * mu * v)" if cubic else "2 * (-ln(v / mu) + (v - mu) / mu)"
    return f"""WITH {PX}, {irls_sql(family, "g", steps)}, u AS (SELECT g, v, exp(ca + cb * g) AS mu FROM px, b{steps}),
    d AS (SELECT sum(pow(v - mu, 2) / pow(mu, {3 if cubic else 2})) / (count(*) - 2) AS phi, sum({part}) AS dev, count(*) AS n FROM u),
    i AS (SELECT sum(w) AS sw, sum(w * g) AS swx, sum(w * g * g) AS swxx FROM (SELECT g, {"1 / mu" if cubic else "1.0"} AS w FROM u)),
    t AS (SELECT cb / sqrt(phi * sw / (sw * swxx - swx * swx)) AS t, sqrt(phi * sw / (sw * swxx - swx * swx)) AS se, phi, dev, n, cb FROM d, i, b{steps})
    SELECT '{family}' AS family, round(cb, 7) AS slope, round(se, 7) AS se, round(t, 4) AS t, round({t_sql("t", "(n - 2)")}, 5) AS p,
    round(phi, 5) AS dispersion, round(dev, 4) AS deviance FROM t"""


@R.add("st_glm", _glm_sql("gamma") + " UNION ALL (" + _glm_sql("inverse_gaussian") + ")")
def st_glm(spark, sf):
    """Log-link gamma and inverse Gaussian fits: Wald t and p of the slope, dispersion, deviance (ST-33, ML-4, ML-5)."""
    px, rows = pixels(spark, sf), []
    for family in ("gamma", "inverse_gaussian"):
        beta = regress.irls(px, ["g"], "v", family)
        w = regress.glm_inference(px, ["g"], "v", family, beta)
        rows.append((family, round(float(beta[1]), 7), round(w["se"][1], 7), round(w["t"][1], 4), round(w["p"][1], 5), round(w["dispersion"], 5), round(w["deviance"], 4)))
    return spark.createDataFrame(rows, "family string, slope double, se double, t double, p double, dispersion double, deviance double")


SLOPE_ROUNDS = 5000


@R.add(
    "st_slope_permuted",
    f"""WITH RECURSIVE c AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS i, CAST((c_custkey * 37) % 1000 AS DOUBLE) AS x_, c_acctbal AS y_, c_mktsegment = 'BUILDING' AS g FROM customer),
    s AS (SELECT count(*) AS n, count(*) FILTER (WHERE g) AS m FROM c), f AS (SELECT i, x_, y_, n, m, j, j + {42 * 100_003} AS key FROM c, s, range(1, {SLOPE_ROUNDS + 1}) t(j)), {place_sql("f")},
    l AS (SELECT j, x_, y_, x < m AS g FROM placed UNION ALL SELECT 0, x_, y_, g FROM c),
    d AS (SELECT j, regr_slope(y_, x_) FILTER (WHERE g) - regr_slope(y_, x_) FILTER (WHERE NOT g) AS d FROM l GROUP BY j)
    SELECT round((SELECT d FROM d WHERE j = 0), 6) AS difference,
    (1 + count(*) FILTER (WHERE abs(d) >= abs((SELECT d FROM d WHERE j = 0)) - 1e-12)) / {SLOPE_ROUNDS + 1}.0::DOUBLE AS p FROM d WHERE j > 0""",
)
def st_slope_permuted(spark, sf):
    """Difference of two groups' slopes with a permutation p of 5,000 rounds: membership is dealt anew by a keyed permutation (ST-32)."""
    k = C("c_custkey")
    c = read(spark, sf, "customer").select(k.alias("k"), ((k * 37) % 1000).cast("double").alias("x"), C("c_acctbal").alias("y"), (C("c_mktsegment") == "BUILDING").alias("a"))
    out = stats.slope_permuted(c, "x", "y", "a", "k", SLOPE_ROUNDS)
    return out.select(F.round("difference", 6).alias("difference"), "p")


KS = (3, 5, 7, 9, 11, 15, 20, 25)
NEAR = """s AS (SELECT avg(s_acctbal) AS m, stddev_pop(s_acctbal) AS d, avg(s_nationkey) AS mn, stddev_pop(s_nationkey) AS dn FROM supplier),
z AS (SELECT s_suppkey AS k, (s_acctbal - m) / d AS a, (s_nationkey - mn) / dn AS b, s_nationkey * 10 + s_acctbal / 500 AS y, s_suppkey % 3 AS part FROM supplier, s)"""


@R.add(
    "ml_knn_tuned",
    f"""WITH {NEAR}, i AS (SELECT p.k, p.y AS own, q.y, row_number() OVER (PARTITION BY p.k ORDER BY pow(p.a - q.a, 2) + pow(p.b - q.b, 2), q.k) AS i FROM z p JOIN z q ON p.part <> q.part),
    t(kk) AS (VALUES {", ".join(f"({k})" for k in KS)}), g AS (SELECT kk, k, min(own) AS own, avg(y) AS f FROM t JOIN i ON i.i <= kk GROUP BY ALL),
    e AS (SELECT kk, avg(pow(own - f, 2)) AS mse FROM g GROUP BY kk), best AS (SELECT kk FROM e ORDER BY round(mse, 9), kk LIMIT 1),
    o AS (SELECT p.k, q.y, row_number() OVER (PARTITION BY p.k ORDER BY pow(p.a - q.a, 2) + pow(p.b - q.b, 2), q.k) AS i FROM z p JOIN z q ON p.k <> q.k)
    SELECT k, min(kk) AS neighbours, round(avg(y), 6) AS predicted FROM o, best WHERE i <= kk GROUP BY k""",
)
def ml_knn_tuned(spark, sf):
    """Nearest-neighbour regression whose k is chosen by inner cross-validation (ML-10)."""
    s = read(spark, sf, "supplier").select(
        C("s_suppkey").alias("k"), "s_acctbal", C("s_nationkey").cast("double").alias("nk"),
        (C("s_nationkey") * 10 + C("s_acctbal") / 500).alias("y"), (C("s_suppkey") % 3).alias("part"),
    )
    xs = ["s_acctbal", "nk"]
    inner = regress.neighbours(s, s, xs, "y", max(KS), "k", apart="part")
    tried = F.explode(F.array(*(F.lit(k) for k in KS))).alias("kk")
    means = inner.select("*", tried).filter("rank <= kk").groupBy("kk", "_k").agg(F.avg("_y").alias("f"))
    errors = means.join(s.select(C("k").alias("_k"), "y"), "_k").groupBy("kk").agg(F.avg(F.pow(C("y") - C("f"), 2)).alias("mse")).collect()
    best = min(errors, key=lambda r: (round(r["mse"], 9), r["kk"]))["kk"]
    return rounded(regress.knn_regression(s, s, xs, "y", best, "k").select("k", F.lit(best).alias("neighbours"), "predicted"))


@R.add(
    "st_adds_within",
    f"""WITH {PX}, a AS (SELECT flag, count(*) AS n, regr_syy(v, r) AS sy, regr_sxx(v, r) AS sr, regr_sxy(v, r) AS syr, regr_sxx(v, g) AS sg, regr_sxy(v, g) AS syg, regr_sxy(r, g) AS srg FROM px GROUP BY flag
      UNION ALL SELECT 'all', count(*), regr_syy(v, r), regr_sxx(v, r), regr_sxy(v, r), regr_sxx(v, g), regr_sxy(v, g), regr_sxy(r, g) FROM px),
    e AS (SELECT flag, n, sy - syr * syr / sr AS small, sy - (syr * syr * sg - 2 * syr * syg * srg + syg * syg * sr) / (sr * sg - srg * srg) AS big FROM a),
    f AS (SELECT flag, n, (small - big) / (big / (n - 3)) AS f FROM e) SELECT flag AS scope, round(f, 4) AS f, round({f_sql("f", "1", "(n - 3)")}, 5) AS p FROM f""",
)
def st_adds_within(spark, sf):
    """Whether a term adds to the base model, over all rows and within each group (ST-24, ST-26)."""
    gs = regress.grams(pixels(spark, sf), ["r", "g", "v"], C("flag"))
    rows = [(k, regress.nested_test(g, ["r"], ["g"], "v")) for k, g in {**gs, "all": regress.total(gs)}.items()]
    return spark.createDataFrame([(k, round(float(t["f"]), 4), round(float(t["p"]), 5)) for k, t in rows], "scope string, f double, p double")


@R.add("ml_permutation_drop")
def ml_permutation_drop(spark, sf):
    """Fall of held-out r2 a fold when a column is dealt anew (ML-20)."""
    px = _px(spark, sf).withColumn("key", C("k") * 8 + C("n"))
    return rounded(tidy(spark, [("drop", x, v) for x, v in regress.permutation_drop(px, ["r", "g"], "v", "key", "fold")]))
