"""Adaptive gamma and contrast-limited equalisation of pixel tables."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col
#: Grey levels.
LEVELS = 256


def gamma_exponent(mean: Column, target: float = 0.5, low: float = 0.8, high: float = 1.3) -> Column:
    """Exponent that brings a mean brightness (0..1, taken as 0.05 to 0.95) towards ``target``; the gamma stays within low and high."""
    vm = F.least(F.greatest(mean, F.lit(0.05)), F.lit(0.95))
    return 1 / F.least(F.greatest(F.log(vm) / log(target), F.lit(low)), F.lit(high))


def clip_limit(sd: Column, base: float = 2.0) -> Column:
    """Flat images get a higher limit, from 1.5 to 3; ``sd`` is the population spread of levels 0..255."""
    return F.least(F.greatest(F.lit(base) + (F.lit(0.8) - sd / 255), F.lit(1.5)), F.lit(3.0))


def equalised(pixels: DataFrame, width: int, height: int, tiles: int = 8, base: float = 2.0) -> DataFrame:
    """(image, row, col, v, out): levels ``v`` (0..255) equalised within tiles, with clipped histograms, and blended between tiles.

    Sides that the tiles do not divide are mirrored at the right and lower edge. A tile's histogram is cut at the image's
    limit, what was cut is spread evenly (the rest from level 0 on at equal steps), and its running sum gives the tile's new levels.
    A pixel's result blends those of the four nearest tile centres. Rows without a place, level or image take no part.

    Histograms and tables have 256 rows a tile, whatever the image's size; the pixels are shuffled once, to their blend.
    """
    even = width % tiles == 0 and height % tiles == 0
    w, h = (width, height) if even else (width + tiles - width % tiles, height + tiles - height % tiles)
    tw, th = w // tiles, h // tiles
    own = pixels.select("image", "row", "col", C("v").cast("int").alias("v")).dropna()
    limit = own.groupBy("image").agg(F.greatest(F.floor(clip_limit(F.stddev_pop("v"), base) * (tw * th) / LEVELS), F.lit(1)).alias("limit"))

    # The pixel itself, and its images beyond the edges.
    def mirrored(at: str, size: int, full: int) -> Column:
        return F.explode(F.filter(F.array(C(at), 2 * (size - 1) - C(at)), lambda p: (p == C(at)) | ((p >= size) & (p < full))))

    seen = own.select("image", "v", "row", mirrored("col", width, w).alias("_x")).select("image", "v", "_x", mirrored("row", height, h).alias("_y"))
    seen = seen.groupBy("image", F.floor(C("_y") / th).cast("int").alias("ty"), F.floor(C("_x") / tw).cast("int").alias("tx"), "v").agg(F.count(F.lit(1)).alias("c"))
    span = lambda a, b: F.explode(F.sequence(F.lit(a), F.lit(b - 1)))
    dense = limit.select("image", "limit", span(0, tiles).alias("ty")).select("*", span(0, tiles).alias("tx")).select("*", span(0, LEVELS).alias("v"))
    tile = Window.partitionBy("image", "ty", "tx")
    hist = dense.join(seen, ["image", "ty", "tx", "v"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    hist = hist.withColumn("cut", F.sum(F.greatest(C("c") - C("limit"), F.lit(0))).over(tile))
    rest = C("cut") % LEVELS
    step = F.greatest(F.floor(F.lit(LEVELS) / F.greatest(rest, F.lit(1))), F.lit(1))
    more = F.when((C("v") % step == 0) & (F.floor(C("v") / step) < rest), 1).otherwise(0)
    hist = hist.select("image", "ty", "tx", "v", (F.least("c", "limit") + F.floor(C("cut") / LEVELS) + more).alias("c"))
    sums = F.sum("c").over(tile.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    table = hist.select("image", "ty", "tx", "v", F.least(F.rint(sums * ((LEVELS - 1) / (tw * th))), F.lit(255.0)).alias("l"))

    # A cell between four tile centres takes the tables of its corners; cells at the border take the border's twice.
    def sides(t: str) -> Column:
        first = F.array(F.struct(C(t).alias("cell"), F.lit(1).alias("side")), F.struct(F.lit(-1).alias("cell"), F.lit(1).alias("side")))
        second = F.array(F.struct((C(t) - 1).alias("cell"), F.lit(2).alias("side")), F.struct(F.lit(tiles - 1).alias("cell"), F.lit(2).alias("side")))
        edge = F.array(F.lit(True), C(t) == 0, F.lit(True), C(t) == tiles - 1)
        return F.explode(F.filter(F.concat(first, second), lambda s, i: F.get(edge, i)))

    parts = table.select("*", sides("ty").alias("a")).select("*", sides("tx").alias("b"))
    corner = lambda a, b: F.max(F.when((C("a.side") == a) & (C("b.side") == b), C("l"))).alias(f"l{a}{b}")
    cells = parts.groupBy("image", C("a.cell").alias("cy"), C("b.cell").alias("cx"), "v").agg(*(corner(a, b) for a in (1, 2) for b in (1, 2)))
    fy, fx = C("row") / F.lit(float(th)) - 0.5, C("col") / F.lit(float(tw)) - 0.5
    placed = own.select("image", "row", "col", "v", F.floor(fy).cast("int").alias("cy"), F.floor(fx).cast("int").alias("cx"), (fy - F.floor(fy)).alias("ya"), (fx - F.floor(fx)).alias("xa"))
    top = C("l11") * (1 - C("xa")) + C("l12") * C("xa")
    low = C("l21") * (1 - C("xa")) + C("l22") * C("xa")
    out = F.rint(top * (1 - C("ya")) + low * C("ya")).cast("int")
    return placed.join(cells, ["image", "cy", "cx", "v"]).select("image", "row", "col", "v", out.alias("out"))


def flattened(pixels: DataFrame) -> DataFrame:
    """Pixels (image, row, col, r, g, b) with gamma by the mean of the brightest channel of their image: r, g, b of 0..255."""
    top = F.greatest("r", "g", "b")
    e = pixels.groupBy("image").agg(gamma_exponent(F.avg(top / 255)).alias("_e"))
    bent = lambda c: F.floor(F.least(F.greatest(F.pow(C(c) / 255, C("_e")) * 255, F.lit(0.0)), F.lit(255.0))).cast("int").alias(c)
    return pixels.join(e, "image").select("image", "row", "col", bent("r"), bent("g"), bent("b"))
