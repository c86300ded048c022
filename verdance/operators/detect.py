"""Scoring of detections from contingency rows (image, pred, gt, px); 0 is background."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdance.operators.match import greedy

C = F.col


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall and F1, 0 where they have no denominator."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    p, r = zero(F.try_divide(tp, tp + fp)), zero(F.try_divide(tp, tp + fn))
    return {"precision": p, "recall": r, "f1": zero(F.try_divide(2 * p * r, p + r))}


def pooled(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Dice, IoU, precision, recall and F1 of pixels over all images."""
    s = lambda c: F.sum(F.when(c, C("px")).otherwise(0))
    on, gt = C("pred") > 0, C("gt") > 0
    a = df.groupBy(*by).agg(s(on & gt).alias("tp"), s(on & ~gt).alias("fp"), s(~on & gt).alias("fn"), s(~on & ~gt).alias("tn"))
    tp, fp, fn = C("tp"), C("fp"), C("fn")
    return a.select(*by, "tp", "fp", "fn", "tn", F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("dice"), F.coalesce(F.try_divide(tp, tp + fp + fn), F.lit(0.0)).alias("iou"), ((tp + C("tn")) / (tp + fp + fn + C("tn"))).alias("accuracy"), *(c.alias(n) for n, c in prf(tp, fp, fn).items()))


def overlaps(df: DataFrame) -> DataFrame:
    """(image, pred, gt, iou, cover of gt, cover of pred) of object pairs that touch."""
    px = df.groupBy("image", "pred", "gt").agg(F.sum("px").alias("px"))
    a = px.filter("pred > 0").groupBy("image", "pred").agg(F.sum("px").alias("pa"))
    g = px.filter("gt > 0").groupBy("image", "gt").agg(F.sum("px").alias("ga"))
    both = px.filter("pred > 0 and gt > 0").join(a, ["image", "pred"]).join(g, ["image", "gt"])
    return both.select("image", "pred", "gt", (C("px") / (C("pa") + C("ga") - C("px"))).alias("iou"), (C("px") / C("ga")).alias("of_gt"), (C("px") / C("pa")).alias("of_pred"))


def matched(df: DataFrame) -> DataFrame:
    """Greedy one-to-one match of objects, highest IoU first: (image, pred, gt, iou)."""
    o = overlaps(df)
    pairs = o.select(F.struct("image", "pred").alias("left_id"), F.struct("image", "gt").alias("right_id"), (-C("iou")).alias("d"))
    return greedy(pairs).select(C("left_id.image").alias("image"), C("left_id.pred").alias("pred"), C("right_id.gt").alias("gt"), (-C("d")).alias("iou"))


def splits_and_merges(df: DataFrame, cover: float = 0.25) -> DataFrame:
    """Objects that are covered by, or cover, two or more of the other side by more than ``cover``."""
    o = overlaps(df)
    s = o.filter(C("of_pred") > cover).groupBy("image", "gt").count().filter("count >= 2").agg(F.count(F.lit(1)).alias("splits"))
    m = o.filter(C("of_gt") > cover).groupBy("image", "pred").count().filter("count >= 2").agg(F.count(F.lit(1)).alias("merges"))
    return s.crossJoin(m)


def sweep(df: DataFrame, thresholds: list[float]) -> DataFrame:
    """Object precision, recall and F1 at each IoU threshold; one match serves all."""
    m = matched(df)
    n = df.agg(F.count_distinct(F.when(C("pred") > 0, F.struct("image", "pred"))).alias("np"), F.count_distinct(F.when(C("gt") > 0, F.struct("image", "gt"))).alias("ng"))
    hits = m.agg(*(F.count_if(C("iou") >= t).alias(f"h{i}") for i, t in enumerate(thresholds)))
    rows = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), C(f"h{i}").alias("tp")) for i, t in enumerate(thresholds)))
    x = hits.crossJoin(n).select("np", "ng", F.explode(rows).alias("r")).select("r.threshold", "r.tp", (C("np") - C("r.tp")).alias("fp"), (C("ng") - C("r.tp")).alias("fn"))
    return x.select("threshold", "tp", "fp", "fn", *(c.alias(n) for n, c in prf(C("tp"), C("fp"), C("fn")).items()))


def loss_curves(p: Column, alpha: float = 0.3, beta: float = 0.7, gamma: float = 0.75, eps: float = 1e-7) -> dict[str, Column]:
    """Losses of one positive pixel predicted with probability p."""
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    tversky = p / (p + beta * (1 - p) + eps)
    return {"bce": -F.log(q), "dice": 1 - 2 * p / (p + 1 + eps), "tversky": 1 - tversky, "focal_tversky": F.pow(1 - tversky, gamma)}


def soft_scores(df: DataFrame, p: str, t: str, by: tuple[str, ...] = (), alpha: float = 0.3, beta: float = 0.7, gamma: float = 0.75, eps: float = 1e-6) -> DataFrame:
    """Batch Dice, IoU and focal Tversky loss of probabilities against 0/1."""
    tp, fp, fn = F.sum(C(p) * C(t)), F.sum(C(p) * (1 - C(t))), F.sum((1 - C(p)) * C(t))
    return df.groupBy(*by).agg(((2 * tp + eps) / (2 * tp + fp + fn + eps)).alias("dice"), ((tp + eps) / (tp + fp + fn + eps)).alias("iou"), F.pow(1 - (tp + eps) / (tp + alpha * fp + beta * fn + eps), gamma).alias("focal_tversky"))


def probability_sweep(df: DataFrame, p: str, truth: str, cuts: list[float]) -> DataFrame:
    """Pixel counts and scores at each probability threshold: rows are counted once, by the number of thresholds they reach."""
    reached = F.size(F.filter(F.array(*(F.lit(float(c)) for c in cuts)), lambda c: C(p) >= c))
    counts = df.groupBy(reached.alias("_n")).agg(F.count_if(C(truth)).alias("_y"), F.count_if(~C(truth)).alias("_x"))  # one row a threshold
    at = F.explode(F.array(*(F.struct(F.lit(float(c)).alias("cut"), F.lit(i).alias("i")) for i, c in enumerate(sorted(cuts))))).alias("c")
    rows = counts.select("*", at).groupBy("c.cut").agg(
        F.sum(F.when(C("_n") > C("c.i"), C("_y")).otherwise(0)).alias("tp"),
        F.sum(F.when(C("_n") > C("c.i"), C("_x")).otherwise(0)).alias("fp"),
        F.sum(F.when(C("_n") > C("c.i"), 0).otherwise(C("_y"))).alias("fn"),
    )
    made = prf(C("tp"), C("fp"), C("fn"))
    dice = F.coalesce(F.try_divide(2 * C("tp"), 2 * C("tp") + C("fp") + C("fn")), F.lit(0.0))
    return rows.select("cut", "tp", "fp", "fn", dice.alias("dice"), made["precision"].alias("precision"), made["recall"].alias("recall"))
