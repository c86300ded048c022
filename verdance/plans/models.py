"""Regression, validation and detection queries.

Most results are small tables that are worked out from one Gram pass; they are
returned as DataFrames of (model, metric, value) rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from verdance.operators import detect, regress
from verdance.plans.registry import PX, Registry, pixels, read, rounded
from verdance.plans.statistics import f_sql
from verdance.session import written

R = Registry()
C = F.col
XS = ["r", "g", "b"]


def tidy(spark, rows: list[tuple[str, str, float]]):
    return spark.createDataFrame([(a, b, None if v is None else float(v)) for a, b, v in rows], "model string, metric string, value double")


def _px(spark, sf):
    return pixels(spark, sf).withColumns({"r2": C("r") * C("r"), "r_g": C("r") * C("g"), "r_b": C("r") * C("b"), "g_b": C("g") * C("b"), "fold": (C("k") % 5).cast("int")})


FIT = "f AS (SELECT regr_slope(v, r) AS cb, regr_intercept(v, r) AS ca, count(*) AS cn FROM px)"


@R.add("ml_ols_scores", f"WITH {PX}, {FIT}, e AS (SELECT sum(pow(v - ca - cb * r, 2)) AS rss, sum(pow(v - (SELECT avg(v) FROM px), 2)) AS sst, min(cn) AS n, min(ca) AS a, min(cb) AS b FROM px, f) SELECT round(a, 3) AS intercept, round(b, 4) AS slope, round(1 - rss / sst, 6) AS r2, round(1 - rss / sst * (n - 1) / (n - 2), 6) AS adj_r2, round(rss / n / 1e6, 4) AS mse, round(n * ln(rss / n) + n * (ln(2 * pi()) + 1) + 6, 2) AS aic, round(n * ln(rss / n) + n * (ln(2 * pi()) + 1) + 3 * ln(n), 2) AS bic FROM e")
def ml_ols_scores(spark, sf):
    """Least squares with fit scores, one predictor (ML-1, ML-2)."""
    g = regress.total(regress.grams(pixels(spark, sf), ["r", "v"]))
    b = regress.ols(g, ["r"], "v")
    s = regress.scores(g, b, ["r"], "v")
    row = (float(b[0]), float(b[1]), float(s["r2"]), float(s["adj_r2"]), float(s["mse"] / 1e6), float(s["aic"]), float(s["bic"]))
    return spark.createDataFrame([tuple(round(v, d) for v, d in zip(row, (3, 4, 6, 6, 4, 2, 2), strict=True))], "intercept double, slope double, r2 double, adj_r2 double, mse double, aic double, bic double")


def _cv_sql(fold):
    return f"WITH {PX}, p AS (SELECT *, {fold} AS fold FROM px), k AS (SELECT DISTINCT fold FROM p), f AS (SELECT k.fold, regr_slope(v, r) AS cb, regr_intercept(v, r) AS ca FROM k JOIN p ON p.fold <> k.fold GROUP BY k.fold)"


@R.add("cv_folds", _cv_sql("CAST(k % 5 AS INTEGER)") + " SELECT round(1 - sum(pow(v - ca - cb * r, 2)) / sum(pow(v - (SELECT avg(v) FROM px), 2)), 6) AS r2, round(avg(pow(v - ca - cb * r, 2)) / 1e6, 4) AS mse FROM p JOIN f USING (fold)")
def cv_folds(spark, sf):
    """Pooled held-out scores over folds that keep an order's rows together (CV-1, CV-3); over seeds: cv_seeds."""
    s = regress.cross_validated(regress.grams(_px(spark, sf), ["r", "v"], C("fold")), ["r"], "v")
    return spark.createDataFrame([(round(float(s["r2"]), 6), round(float(s["mse"] / 1e6), 4))], "r2 double, mse double")


@R.add("cv_seasons", _cv_sql("year") + ", m AS (SELECT fold, avg(v) AS mu FROM p GROUP BY fold) SELECT fold AS year, round(1 - sum(pow(v - ca - cb * r, 2)) / sum(pow(v - mu, 2)), 6) AS r2 FROM p JOIN f USING (fold) JOIN m USING (fold) GROUP BY fold")
def cv_seasons(spark, sf):
    """Each season left out (CV-4)."""
    got = regress.each_left_out(regress.grams(pixels(spark, sf), ["r", "v"], C("year")), ["r"], "v")
    return spark.createDataFrame([(int(k), round(float(v), 6)) for k, v in got.items()], "year int, r2 double")


@R.add("ml_fold_rows", _cv_sql("CAST(k % 5 AS INTEGER)") + " SELECT k, n, round(v - ca - cb * r, 3) AS residual FROM p JOIN f USING (fold)")
def ml_fold_rows(spark, sf):
    """Held-out residuals of every row; coefficients are one row a fold (CV-1)."""
    px = _px(spark, sf)
    gs = regress.grams(px, ["r", "v"], C("fold"))
    every = regress.total(gs)
    rows = [(int(f), *map(float, regress.ols(every - g, ["r"], "v"))) for f, g in gs.items()]
    coef = spark.createDataFrame(rows, "fold int, ca double, cb double")
    return px.join(F.broadcast(coef), "fold").select("k", "n", F.round(C("v") - C("ca") - C("cb") * C("r"), 3).alias("residual"))


@R.add("ml_linear_families")
def ml_linear_families(spark, sf):
    """Ridge, lasso, elastic net, partial least squares, matching pursuit, polynomials (ML-7, 8, 15, 16, 17), from one Gram pass."""
    gs = regress.grams(_px(spark, sf), [*XS, "r2", "r_g", "r_b", "g_b", "v"], C("fold"))
    g, wide, rows = regress.total(gs), [*XS, "r2", "r_g"], []
    b, lam = regress.ridge(g, wide, "v")
    rows += [("ridge", "lambda", lam), ("ridge", "r2", regress.scores(g, b, wide, "v")["r2"])]
    for name, mix in (("lasso", 1.0), ("net", 0.5)):
        rows.append((name, "r2", regress.scores(g, regress.elastic_net(g, wide, "v", 0.1, mix), wide, "v")["r2"]))
    rows.append(("pls_2", "cv_r2", regress.cross_validated(gs, wide, "v", lambda a, x, y: regress.pls1(a, x, y, 2))["r2"]))
    b, chosen = regress.matching_pursuit(g, wide, "v", 2)
    rows += [("pursuit_" + "+".join(chosen), "r2", regress.scores(g, b, wide, "v")["r2"])]
    rows += [(f"poly_{n}", "cv_r2", regress.cross_validated(gs, xs, "v")["r2"]) for n, xs in (("1", ["r"]), ("2", ["r", "r2"]), ("surface", [*XS, "r2", "r_g", "r_b", "g_b"]))]
    return rounded(tidy(spark, rows))


@R.add("ml_search")
def ml_search(spark, sf):
    """Forward selection, add and remove scans, screening with false-discovery control, ladders (CV-7..10, ST-24)."""
    terms = ["r2", "r_g", "r_b", "g_b"]
    gs = regress.grams(_px(spark, sf), [*XS, *terms, "v"], C("fold"))
    g = regress.total(gs)
    chosen, best = regress.forward(gs, [*XS, *terms], "v")
    rows = [("forward:" + "+".join(chosen), "cv_r2", best)]
    rows += [(f"{r['move']}:{r['term']}", "aic", r["aic"]) for r in regress.one_changed(g, XS, [*XS, *terms], "v")]
    rows += [(f"screen:{r['term']}", m, r[m]) for r in regress.screened(g, XS, terms, "v") for m in ("f", "p", "q")]
    rows += [("ladder", "p", regress.nested_test(g, XS, terms, "v")["p"])]
    return rounded(tidy(spark, rows))


def _test_sql(name: str, small: str, big: str, d1: str, d2: str) -> str:
    f = f"(({small} - {big}) / ({d1}) / ({big} / ({d2})))"
    row = lambda m, x: f"SELECT '{name}' AS model, '{m}' AS metric, CAST({x} AS DOUBLE) AS value FROM t"
    return " UNION ALL ".join((row("f", f), row("df1", d1), row("df2", d2), row("p", f_sql(f, d1, f"({d2})"))))


@R.add(
    "ml_ancova",
    f"""WITH {PX}, a AS (SELECT flag, regr_syy(v, r) AS yy, regr_sxx(v, r) AS xx, regr_sxy(v, r) AS xy FROM px GROUP BY flag),
    t AS (SELECT (SELECT sum(yy) FROM a) AS means, (SELECT sum(yy) - pow(sum(xy), 2) / sum(xx) FROM a) AS lines, (SELECT sum(yy - xy * xy / xx) FROM a) AS whole,
      regr_syy(v, r) - pow(regr_sxy(v, r), 2) / regr_sxx(v, r) AS one, regr_syy(v, r) AS sst, count(*) AS n FROM px),
    o AS ({_test_sql("covariate", "means", "lines", "1", "n - 4")} UNION ALL {_test_sql("factor", "one", "lines", "2", "n - 4")} UNION ALL {_test_sql("interaction", "lines", "whole", "2", "n - 6")}
    UNION ALL SELECT 'fit', 'n', n FROM t UNION ALL SELECT 'fit', 'r2', 1 - whole / sst FROM t UNION ALL SELECT 'fit', 'adj_r2', 1 - whole / sst * (n - 1) / (n - 6) FROM t
    UNION ALL SELECT 'fit', 'mse', whole / n FROM t UNION ALL SELECT 'fit', 'rss', whole FROM t
    UNION ALL SELECT 'fit', 'aic', n * ln(whole / n) + n * (ln(2 * pi()) + 1) + 14 FROM t UNION ALL SELECT 'fit', 'bic', n * ln(whole / n) + n * (ln(2 * pi()) + 1) + 7 * ln(n) FROM t)
    SELECT model, metric, CASE WHEN abs(value) >= 1e5 THEN round(value, -2) ELSE round(value, 3) END + 0.0 AS value FROM o""",
)
def ml_ancova(spark, sf):
    """Covariate, factor and interaction tests (ST-25)."""
    px = pixels(spark, sf).withColumns({"is_a": (C("flag") == "A").cast("double"), "is_r": (C("flag") == "R").cast("double")}).withColumns({"r_a": C("r") * C("is_a"), "r_r": C("r") * C("is_r")})
    a = regress.ancova(regress.total(regress.grams(px, ["r", "is_a", "is_r", "r_a", "r_r", "v"])), "r", ["is_a", "is_r"], ["r_a", "r_r"], "v")
    shown = lambda v: round(v, -2 if abs(v) >= 1e5 else 3) + 0.0
    return tidy(spark, [(k, m, shown(float(v))) for k, d in a.items() for m, v in d.items()])


@R.add("ml_matrix_diagnostics")
def ml_matrix_diagnostics(spark, sf):
    """Principal components, inflation factors and rank (ST-27, 28, 29)."""
    g = regress.total(regress.grams(_px(spark, sf), [*XS, "r2", "v"]))
    share, load = regress.pca(g, [*XS, "v"])
    rows = [(f"pc{i + 1}", "share", s) for i, s in enumerate(share)] + [(f"pc1:{x}", "loading", load[j, 0]) for j, x in enumerate([*XS, "v"])]
    rows += [(x, "vif", v) for x, v in regress.vif(g, [*XS, "r2"]).items()] + [("matrix", "rank", regress.rank(g, [*XS, "r2"]))]
    return rounded(tidy(spark, rows))


def irls_sql(family: str, x: str, steps: int, tag: str = "") -> str:
    """CTEs b0..b{steps} (ca, cb) of a log-link fit of v on x, each a weighted regression."""
    out = [f"{tag}b0 AS (SELECT regr_intercept(ln(v), {x}) AS ca, regr_slope(ln(v), {x}) AS cb FROM px)"]
    w = "exp(-e)" if family == "inverse_gaussian" else "1.0"
    for i in range(steps):
        e = f"SELECT {x}, v, ca + cb * {x} AS e FROM px, {tag}b{i}"
        out += _weighted_sql(tag, i + 1, f"SELECT {x} AS x, (v - exp(e)) / exp(e) + e AS z, {w} AS w FROM ({e})")
    return ", ".join(out)


def _weighted_sql(tag: str, i: int, rows: str) -> list[str]:
    """CTEs of a weighted regression of z on x over ``rows`` (x, z, w): {tag}b{i} (ca, cb)."""
    return [
        f"{tag}w{i} AS ({rows})",
        f"{tag}m{i} AS (SELECT sum(w * x) / sum(w) AS mx, sum(w * z) / sum(w) AS mz FROM {tag}w{i})",
        f"{tag}c{i} AS (SELECT sum(w * (x - mx) * (z - mz)) / sum(w * (x - mx) * (x - mx)) AS cb, min(mx) AS mx, min(mz) AS mz FROM {tag}w{i}, {tag}m{i})",
        f"{tag}b{i} AS (SELECT mz - cb * mx AS ca, cb FROM {tag}c{i})",
    ]


def huber_sql(steps: int) -> str:
    out = ["hb0 AS (SELECT regr_intercept(v, r) AS ca, regr_slope(v, r) AS cb FROM px)"]
    for i in range(steps):
        out.append(f"hr{i} AS (SELECT r, v, v - ca - cb * r AS e FROM px, hb{i})")
        out.append(f"hs{i} AS (SELECT greatest(1.4826 * median(abs(e - (SELECT median(e) FROM hr{i}))), 1e-12) AS s FROM hr{i})")
        out += _weighted_sql("h", i + 1, f"SELECT r AS x, v AS z, least(1.0, 1.345 * s / greatest(abs(e), 1e-12)) AS w FROM hr{i}, hs{i}")
    return ", ".join(out)


@R.add(
    "ml_log_families",
    f"""WITH {PX}, l AS (SELECT regr_slope(ln(v), r) AS cb, regr_intercept(ln(v), r) AS ca FROM px), {irls_sql("gamma", "r", 12, "g")}, {irls_sql("inverse_gaussian", "r", 12, "i")}, {huber_sql(20)}
    SELECT 'lognormal' AS model, 'slope' AS metric, round(cb, 4) AS value FROM l UNION ALL SELECT 'lognormal', 'smearing', round(avg(exp(ln(v) - ca - cb * r)), 4) FROM px, l
    UNION ALL SELECT 'gamma', 'slope', round(cb, 4) FROM gb12 UNION ALL SELECT 'inverse_gaussian', 'slope', round(cb, 4) FROM ib12 UNION ALL SELECT 'huber', 'slope', round(cb, 2) FROM hb20""",
)
def ml_log_families(spark, sf):
    """Log-normal with smearing, gamma and inverse Gaussian with log link, Huber (ML-3..6)."""
    px = written(pixels(spark, sf).select("r", "v"))  # each step of a fit reads it again
    beta, smear = regress.lognormal(px, ["r"], "v")
    rows = [("lognormal", "slope", beta[1]), ("lognormal", "smearing", smear)]
    rows += [(f, "slope", regress.irls(px, ["r"], "v", f)[1]) for f in ("gamma", "inverse_gaussian")]
    rows.append(("huber", "slope", round(float(regress.huber(px, ["r"], "v")[1]), 2)))
    return rounded(tidy(spark, rows), 4)


@R.add(
    "ml_random_intercept",
    f"""WITH {PX}, l AS (SELECT regr_slope(v, r) AS cb, regr_intercept(v, r) AS ca FROM px), e AS (SELECT zone, v - ca - cb * r AS e FROM px, l),
    g AS (SELECT zone, count(*) AS n, avg(e) AS m, var_pop(e) AS s FROM e GROUP BY zone),
    a AS (SELECT count(*) AS k, sum(n) AS nn, sum(n * n) AS n2, sum(n * s) AS w, sum(n * m) AS t, sum(n * m * m) AS q FROM g),
    c AS (SELECT w / (nn - k) AS msw, greatest(0.0, ((q - t * t / nn) / (k - 1) - w / (nn - k)) / ((nn - n2 / nn) / (k - 1))) AS sb FROM a)
    SELECT zone, round(m * sb / (sb + msw / n), 4) + 0.0 AS blup FROM g, c""",
)
def ml_random_intercept(spark, sf):
    """Shrunken group intercepts (ML-9)."""
    return rounded(regress.random_intercept(pixels(spark, sf), ["r"], "v", "zone")[1], 4)


@R.add(
    "ml_knn",
    "WITH s AS (SELECT avg(s_acctbal) AS m, stddev_pop(s_acctbal) AS d, avg(s_nationkey) AS mn, stddev_pop(s_nationkey) AS dn FROM supplier), z AS (SELECT s_suppkey AS k, (s_acctbal - m) / d AS a, (s_nationkey - mn) / dn AS b, CAST((s_suppkey * 37) % 101 AS DOUBLE) AS y FROM supplier, s), o AS (SELECT p.k, q.y, row_number() OVER (PARTITION BY p.k ORDER BY pow(p.a - q.a, 2) + pow(p.b - q.b, 2), q.k) AS i FROM z p JOIN z q ON p.k <> q.k) SELECT k, round(avg(y), 6) AS predicted FROM o WHERE i <= 5 GROUP BY k",
)
def ml_knn(spark, sf):
    """k-nearest-neighbour regression with a given k; chosen by inner validation: ml_knn_tuned (ML-10)."""
    s = read(spark, sf, "supplier").select(C("s_suppkey").alias("k"), "s_acctbal", C("s_nationkey").cast("double").alias("nk"), ((C("s_suppkey") * 37) % 101).cast("double").alias("y"))
    return rounded(regress.knn_regression(s, s, ["s_acctbal", "nk"], "y", 5, "k"))


@R.add("ml_trees")
def ml_trees(spark, sf):
    """Tree, forest and boosting with importances (ML-11..14, ML-19, ML-20)."""
    px = written(pixels(spark, sf).select((C("k") * 8 + C("n")).alias("key"), *XS, "v"))
    rows, made = [], {}
    least = {"minInstancesPerNode": 10}
    models = (
        ("tree", "tree", {"maxDepth": 3}),
        ("forest", "forest", {"numTrees": 80, "maxDepth": 3, "featureSubsetStrategy": "onethird", **least}),
        ("boost", "boost", {"maxIter": 80, "maxDepth": 2, "stepSize": 0.1, **least}),
    )
    for name, kind, params in models:
        m = made[name] = regress.trees(px, XS, "v", kind, **params)
        rows += [(name, f"importance_{x}", m.featureImportances[i]) for i, x in enumerate(XS)]
    rows += [("tree", f"permuted_{x}", v / 1e6) for x, v in regress.permutation_importance(made["tree"], px, XS, "v", "key")]
    return rounded(tidy(spark, rows), 3)


def _tree_sql(depth: int) -> str:
    """CTEs of the nodes of each level, exact splits at midpoints."""
    out = ["t0 AS (SELECT 1::BIGINT AS node, r, g, b, v FROM px)"]
    for i in range(depth + 1):
        long = " UNION ALL ".join(f"SELECT node, {f} AS f, {x} AS x, v FROM t{i}" for f, x in enumerate("rgb"))
        out += [
            f"""v{i} AS (SELECT node, f, x, count(*) AS n, sum(v) AS s FROM ({long}) GROUP BY ALL),
    c{i} AS (SELECT node, f, x, sum(n) OVER w AS nl, sum(s) OVER w AS sl, lead(x) OVER w AS nx, sum(n) OVER (PARTITION BY node, f) AS n, sum(s) OVER (PARTITION BY node, f) AS s
      FROM v{i} WINDOW w AS (PARTITION BY node, f ORDER BY x)),
    b{i} AS (SELECT node, max(struct_pack(fall := sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n, f := -f, t := -(x + nx) / 2)) AS b FROM c{i}
      WHERE nx IS NOT NULL AND nl >= 5 AND n - nl >= 5 AND {i} < {depth} GROUP BY node),
    n{i} AS (SELECT a.node, a.n, a.s / a.n AS mean, b.b AS b FROM (SELECT node, sum(n) AS n, sum(s) AS s FROM v{i} WHERE f = 0 GROUP BY node) a LEFT JOIN b{i} b USING (node)),
    t{i + 1} AS (SELECT node * 2 + CASE WHEN CASE -b.f WHEN 0 THEN r WHEN 1 THEN g ELSE t{i}.b END > -b.t THEN 1 ELSE 0 END AS node, r, g, t{i}.b AS b, v
      FROM t{i} JOIN (SELECT node AS k, b FROM b{i}) z ON z.k = node)""".replace("-b.f", "-z.b.f").replace("> -b.t", "> -z.b.t")
        ]
    return ", ".join(out)


DEPTH = 3


@R.add(
    "ml_cart",
    f"WITH {PX}, {_tree_sql(DEPTH)}, o AS ("
    + " UNION ALL ".join(f"SELECT * FROM n{i}" for i in range(DEPTH + 1))
    + """) SELECT CAST(node AS BIGINT) AS node, CASE -b.f WHEN 0 THEN 'r' WHEN 1 THEN 'g' WHEN 2 THEN 'b' END AS feature, round(-b.t, 6) AS threshold, CAST(n AS BIGINT) AS n,
    round(mean, 3) AS mean, round(b.fall / (SELECT var_pop(v) * count(*) FROM px), 6) AS share FROM o""",
)
def ml_cart(spark, sf):
    """Regression tree with exact midpoints, and the share of the squared error that each split takes (ML-11, ML-19)."""
    px = pixels(spark, sf).select("r", "g", "b", "v")
    nodes = regress.exact_tree(px, ["r", "g", "b"], "v", DEPTH)
    whole = px.agg(F.var_pop("v") * F.count("v")).first()[0]
    rows = [(n["node"], n["feature"], n["threshold"], n["n"], round(n["mean"], 3), None if n["fall"] is None else n["fall"] / whole) for n in nodes]
    out = spark.createDataFrame(rows, "node long, feature string, threshold double, n long, mean double, share double")
    return rounded(out, 6, but=("mean",))


@R.add("cv_nested")
def cv_nested(spark, sf):
    """Nested cross-validation of the lasso (CV-5)."""
    got = regress.nested_cv(_px(spark, sf), [*XS, "r2"], "v", "k", [float(x) for x in np.logspace(-3, 1, 6)])
    return rounded(tidy(spark, [("lasso", k, v) for k, v in got.items()]), 4)


BOXES = "bx AS (SELECT l_suppkey % 10 AS image, l_suppkey % 13 AS pred, (l_suppkey + CASE WHEN l_linenumber > 5 THEN 1 ELSE 0 END) % 13 AS gt, count(*) AS px FROM lineitem GROUP BY ALL)"


def boxes(spark, sf):
    s = C("l_suppkey")
    return read(spark, sf, "lineitem").groupBy((s % 10).alias("image"), (s % 13).alias("pred"), ((s + F.when(C("l_linenumber") > 5, 1).otherwise(0)) % 13).alias("gt")).agg(F.count(F.lit(1)).alias("px"))


@R.add("dt_pooled", f"WITH {BOXES}, a AS (SELECT image, CAST(sum(CASE WHEN pred > 0 AND gt > 0 THEN px ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN pred > 0 AND gt = 0 THEN px ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN pred = 0 AND gt > 0 THEN px ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN pred = 0 AND gt = 0 THEN px ELSE 0 END) AS BIGINT) AS tn FROM bx GROUP BY image) SELECT *, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS dice, round(coalesce(tp / nullif(tp + fp + fn, 0), 0), 6) AS iou, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM a")
def dt_pooled(spark, sf):
    """Pixel scores by image (DT-1, DT-2, DT-8)."""
    return rounded(detect.pooled(boxes(spark, sf), ("image",)))


IOU = f"{BOXES}, pa AS (SELECT image, pred, sum(px) AS pa FROM bx WHERE pred > 0 GROUP BY ALL), ga AS (SELECT image, gt, sum(px) AS ga FROM bx WHERE gt > 0 GROUP BY ALL), io AS (SELECT image, pred, gt, px / (pa + ga - px) AS iou, px / ga AS of_gt, px / pa AS of_pred FROM bx JOIN pa USING (image, pred) JOIN ga USING (image, gt))"


@R.add("dt_overlaps", f"WITH {IOU} SELECT image, pred, gt, round(iou, 6) AS iou, round(of_gt, 6) AS of_gt, round(of_pred, 6) AS of_pred FROM io")
def dt_overlaps(spark, sf):
    """Object overlaps (JOI-25, JOI-26)."""
    return rounded(detect.overlaps(boxes(spark, sf)))


@R.add("dt_splits_merges", f"WITH {IOU} SELECT (SELECT count(*) FROM (SELECT image, gt FROM io WHERE of_pred > 0.25 GROUP BY ALL HAVING count(*) >= 2)) AS splits, (SELECT count(*) FROM (SELECT image, pred FROM io WHERE of_gt > 0.25 GROUP BY ALL HAVING count(*) >= 2)) AS merges")
def dt_splits_merges(spark, sf):
    """Splits and merges (JOI-26)."""
    return detect.splits_and_merges(boxes(spark, sf))


@R.add("dt_sweep", f"""WITH RECURSIVE {IOU}, o AS (SELECT *, row_number() OVER (ORDER BY -iou, image, pred, gt) AS i FROM io), g AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS ls, []::BIGINT[] AS rs, []::DOUBLE[] AS vs UNION ALL
    SELECT g.i + 1, CASE WHEN used THEN ls ELSE list_append(ls, l) END, CASE WHEN used THEN rs ELSE list_append(rs, r) END, CASE WHEN used THEN vs ELSE list_append(vs, iou) END FROM (SELECT g.*, o.iou, o.image * 100 + o.pred AS l, o.image * 100 + o.gt AS r, list_contains(ls, o.image * 100 + o.pred) OR list_contains(rs, o.image * 100 + o.gt) AS used FROM g JOIN o ON o.i = g.i + 1) g),
    m AS (SELECT unnest(vs) AS iou FROM (SELECT vs FROM g ORDER BY i DESC LIMIT 1)), n AS (SELECT (SELECT count(*) FROM pa) AS np, (SELECT count(*) FROM ga) AS ng), t(threshold) AS (VALUES (0.3::DOUBLE), (0.5::DOUBLE), (0.7::DOUBLE)), h AS (SELECT threshold, (SELECT count(*) FROM m WHERE iou >= threshold) AS tp FROM t)
    SELECT threshold, tp, np - tp AS fp, ng - tp AS fn, round(tp / np, 6) AS precision, round(tp / ng, 6) AS recall, round(coalesce(2 * (tp / np) * (tp / ng) / nullif(tp / np + tp / ng, 0), 0), 6) AS f1 FROM h, n""")
def dt_sweep(spark, sf):
    """Greedy object match swept over thresholds (JOI-26)."""
    return rounded(detect.sweep(boxes(spark, sf), [0.3, 0.5, 0.7]))


@R.add("dt_soft", f"WITH {PX}, s AS (SELECT flag, r / 50 AS p, CASE WHEN status = 'O' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS t FROM px), a AS (SELECT flag, sum(p * t) AS tp, sum(p * (1 - t)) AS fp, sum((1 - p) * t) AS fn FROM s GROUP BY flag) SELECT flag, round((2 * tp + 1e-6) / (2 * tp + fp + fn + 1e-6), 6) AS dice, round((tp + 1e-6) / (tp + fp + fn + 1e-6), 6) AS iou, round(pow(1 - (tp + 1e-6) / (tp + 0.3 * fp + 0.7 * fn + 1e-6), 0.75), 6) AS focal_tversky FROM a")
def dt_soft(spark, sf):
    """Batch scores of probabilities (DT-6)."""
    px = pixels(spark, sf).select("flag", (C("r") / 50).alias("p"), (C("status") == "O").cast("double").alias("t"))
    return rounded(detect.soft_scores(px, "p", "t", ("flag",)))


@R.add("dt_losses", f"WITH {PX}, g AS (SELECT r / 50 AS p, count(*) AS n FROM px GROUP BY 1) SELECT p, n, round(-ln(greatest(1e-7, least(1 - 1e-7, p))), 6) AS bce, round(1 - 2 * p / (p + 1 + 1e-7), 6) AS dice, round(1 - p / (p + 0.7 * (1 - p) + 1e-7), 6) AS tversky, round(pow(1 - p / (p + 0.7 * (1 - p) + 1e-7), 0.75), 6) AS focal_tversky FROM g")
def dt_losses(spark, sf):
    """Loss curves over the pixels' probabilities, with the pixels at each (DT-7)."""
    p = pixels(spark, sf).groupBy((C("r") / 50).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return p.select("p", "n", *(F.round(c, 6).alias(n) for n, c in detect.loss_curves(C("p")).items()))
