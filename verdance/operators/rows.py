"""Objects that run together along rows, cut where their width has valleys."""

from __future__ import annotations

from math import cos, radians, sin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdance.operators.layout import labelled
from verdance.operators.ordering import quantiles
from verdance.session import checkpointed

C = F.col

#: How much longer than its base radius a ray is a jump, the share of a radius that objects are apart,
#: the half width of a cut as a share of an object's width, the smoothing as a share of the bins, the bins, and the least elongation.
JUMP, SPACING, BAND, SMOOTH, BINS, LONG = 1.45, 0.98, 0.10, 0.02, (48, 256), 1.2


def opened(pixels: DataFrame) -> DataFrame:
    """Pixels (row, col) after an opening by a pixel and its four neighbours; what is outside of the table is background."""
    cross = F.explode(F.array(*(F.struct((C("row") + r).alias("row"), (C("col") + c).alias("col")) for r, c in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)))))
    around = lambda df: df.select(cross.alias("p")).groupBy(C("p.row").alias("row"), C("p.col").alias("col")).agg(F.count(F.lit(1)).alias("n"))
    return around(around(pixels.select("row", "col").distinct()).filter("n = 5")).select("row", "col")


def large(labels: DataFrame, least: int) -> DataFrame:
    """Pixels of labels that have at least ``least``."""
    kept = labels.groupBy("label").agg(F.count(F.lit(1)).alias("_n")).filter(C("_n") >= least).select("label")
    return labels.join(kept, "label", "left_semi").select("row", "col", "label")


def radii(labels: DataFrame, step: int = 15) -> DataFrame:
    """(label, deg, radius): steps of length 1 from a label's centroid until the first whose nearest pixel is outside of it.

    Each pixel tells which steps of each ray fall on it, so no object is walked in one place; the radius is the first
    step that falls on none. A centroid outside of its label gives 0.
    """
    centre = labels.groupBy("label").agg(F.avg("row").alias("y"), F.avg("col").alias("x"))
    rays = F.array(*(F.struct(F.lit(d).alias("deg"), F.lit(cos(radians(d))).alias("c"), F.lit(sin(radians(d))).alias("s")) for d in range(0, 180, step)))
    own = labels.join(centre, "label").withColumn("_a", F.explode(rays))
    near = F.floor((C("col") - C("x")) * C("_a.c") + (C("row") - C("y")) * C("_a.s"))
    own = own.withColumn("n", F.explode(F.sequence(near - 1, near + 2))).filter("n >= 0")
    hit = (F.rint(C("x") + C("n") * C("_a.c")) == C("col")) & (F.rint(C("y") + C("n") * C("_a.s")) == C("row"))
    # A step falls on one pixel, so steps are distinct; the sorted steps of a ray are as many as an object is wide.
    steps = own.filter(hit).groupBy("label", C("_a.deg").alias("deg")).agg(F.sort_array(F.collect_list("n")).alias("n"))
    run = F.size(F.filter("n", lambda x, i: x == i))
    every = centre.select("label", F.explode(F.array(*map(F.lit, range(0, 180, step)))).alias("deg"))
    return every.join(steps.select("label", "deg", run.alias("radius")), ["label", "deg"], "left").na.fill(0, ["radius"])


def frame(rays: DataFrame, angle: float) -> tuple[float, float]:
    """(radius, angle in degrees) of the objects of an image: the median of base radii, and the middle of the most frequent range of jumps.

    A base radius lies between an object's two middle quantiles. With fewer than three jumps the given ``angle`` holds.
    """
    base = rays.groupBy("label").agg(F.percentile("radius", F.array(F.lit(0.35), F.lit(0.65))).alias("q")).select("label", ((C("q")[0] + C("q")[1]) / 2).alias("base"))
    base = checkpointed(base)
    middle = quantiles(base, "base", (0.5,))[0]
    jumps = rays.join(base, "label").filter(C("radius") > JUMP * C("base")).groupBy((F.floor(C("deg") / 5) * 5).alias("deg")).agg(F.count(F.lit(1)).alias("n"))
    found = jumps.orderBy(F.desc("n"), "deg").collect()  # at most 36 rows
    return max(1.0, middle if middle is not None else 3.0), found[0]["deg"] + 2.5 if sum(r["n"] for r in found) >= 3 else angle


def _smoothed(profile: Column, bins: Column) -> Column:
    """A profile smoothed by a Gaussian that is cut at four deviations; its ends go on with their own values."""
    sigma = F.greatest(F.lit(1.0), SMOOTH * bins)
    reach = F.floor(4 * sigma + 0.5).cast("int")
    steps = F.sequence(-reach, reach)
    weight = lambda d: F.exp(-0.5 * d * d / (sigma * sigma))
    total = F.aggregate(steps, F.lit(0.0), lambda a, d: a + weight(d))
    at = lambda i: F.element_at(profile, (F.least(F.greatest(i, F.lit(0)), bins - 1) + 1).cast("int")).cast("double")
    return F.transform(F.sequence(F.lit(0), bins - 1), lambda i: F.round(F.aggregate(steps, F.lit(0.0), lambda a, d: a + weight(d) * at(i + d)) / total, 9))


def cuts(labels: DataFrame, radius: float, angle: float, ends: bool = True) -> DataFrame:
    """(label, bounds, half) of objects long enough for two of ``radius`` along ``angle`` degrees: places of the cuts and half their width.

    An object's profile counts its pixels in 48 to 256 bins along the angle; the deepest valleys of the smoothed profile,
    one fewer than objects fit, are cut. With ``ends`` the outermost bins count as valleys where they are lower than the next.
    """
    a = radians(angle)
    t, s = C("col") * cos(a) + C("row") * sin(a), C("row") * cos(a) - C("col") * sin(a)
    spans = labels.groupBy("label").agg(F.min(t).alias("t0"), (F.max(t) - F.min(t)).alias("long"), (F.max(s) - F.min(s) + 1e-6).alias("wide"))
    spans = spans.withColumn("fit", F.rint(C("long") / max(2 * radius * SPACING, 1.0)).cast("int")).filter((C("fit") >= 2) & (C("long") / C("wide") >= LONG))
    spans = checkpointed(spans.withColumn("bins", F.least(F.greatest(F.rint("long"), F.lit(BINS[0])), F.lit(BINS[1])).cast("int")))
    place = F.least(F.floor((t - C("t0")) / (C("long") + 1e-6) * C("bins")), C("bins") - 1)
    counts = labels.join(spans, "label").groupBy("label", place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    held = counts.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))  # at most 256 bins
    # Written between the steps, since Spark would work an array out again wherever it is read.
    own = checkpointed(spans.join(held, "label").withColumn("own", F.transform(F.sequence(F.lit(0), C("bins") - 1), lambda i: F.coalesce(F.element_at("m", i), F.lit(0)))).drop("m"))
    own = checkpointed(own.withColumn("p", _smoothed(C("own"), C("bins"))).drop("own"))
    low = lambda i, to: F.coalesce(F.get("p", i) < F.get("p", i + to), F.lit(ends))
    valleys = F.filter(F.sequence(F.lit(0), C("bins") - 1), lambda i: low(i, -1) & low(i, 1))
    deepest = F.slice(F.sort_array(F.transform(valleys, lambda i: F.struct(F.get("p", i).alias("p"), i.alias("i")))), 1, C("fit") - 1)
    bounds = F.transform(deepest, lambda v: C("t0") + (v["i"] + 0.5) * (C("long") / C("bins")))
    return checkpointed(own.select("label", bounds.alias("bounds"), F.greatest(F.lit(1.0), BAND * C("wide")).alias("half")))


def split(pixels: DataFrame, least: int = 220, opening: bool = True, angle: float = 0.0, step: int = 15, ends: bool = True) -> DataFrame:
    """(row, col, label): objects of a mask's pixels, cut across and along the rows that they form.

    Objects are joined by sides; those of fewer than ``least`` pixels are left out, before and after the cuts. Rays from
    all centroids give the size of one object and the angle of the rows (``frame``), each long object is cut at the
    valleys of its width, and what is left is labelled again. ``angle`` holds where rays show no rows.
    ``ends`` lets the ends of an object count as valleys: they are mostly the deepest, so an object of two or three parts is then
    trimmed rather than cut; False cuts only inside. Profiles have at
    most 256 bins and rays as many steps as an object is wide; all else is sums by label.
    """
    own = pixels.select("row", "col").dropna().distinct()
    first = checkpointed(large(labelled(opened(own) if opening else own), least))
    size, along = frame(checkpointed(radii(first, step)), angle)
    rest = first
    for turn in (along, (along + 90) % 180):
        a = radians(turn)
        t = C("col") * cos(a) + C("row") * sin(a)
        rest = rest.join(cuts(first, size, turn, ends), "label", "left").filter(~F.coalesce(F.exists("bounds", lambda b: F.abs(t - b) <= C("half")), F.lit(False))).select("row", "col", "label")
    return large(labelled(checkpointed(rest.select("row", "col"))), least)
