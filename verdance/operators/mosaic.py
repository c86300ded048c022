"""Mosaics of overlapping images: footprints, boundary, seamlines by the closest centre, and a blend across the seams.

Images are (image, row, col, value) pixels on one map grid; a footprint is the box of an image's pixels. Nothing
compares all images with all pixels: a pixel meets the images that have it, and seams are looked for
in tiles with a rim as wide as the blend.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdance.operators.relief import TILE
from verdance.session import checkpointed

C = F.col


def footprints(pixels: DataFrame) -> DataFrame:
    """(image, top, left, bottom, right, centre_row, centre_col, pixels) of each image; null values are no pixels."""
    own = pixels.filter("value is not null").groupBy("image").agg(F.min("row").alias("top"), F.min("col").alias("left"), F.max("row").alias("bottom"), F.max("col").alias("right"), F.count(F.lit(1)).alias("pixels"))
    return own.select("image", "top", "left", "bottom", "right", ((C("top") + C("bottom")) / 2).alias("centre_row"), ((C("left") + C("right")) / 2).alias("centre_col"), "pixels")


def seamlines(pixels: DataFrame) -> DataFrame:
    """(row, col, image): of the images that have a pixel, the one whose centre is the closest; the smaller image on ties."""
    centres = footprints(pixels).select("image", "centre_row", "centre_col")
    d2 = F.pow(C("row") - C("centre_row"), 2) + F.pow(C("col") - C("centre_col"), 2)
    near = pixels.filter("value is not null").join(centres, "image").select("row", "col", "image", d2.alias("d2"))
    return near.groupBy("row", "col").agg(F.min(F.struct("d2", "image")).alias("m")).select("row", "col", C("m.image").alias("image"))


def boundary(zones: DataFrame) -> DataFrame:
    """(row, col) of the mosaic's pixels that have one of the four around them outside of it."""
    around = F.array(*(F.struct((C("row") + i).alias("row"), (C("col") + j).alias("col")) for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0))))
    met = zones.select(C("row").alias("_r"), C("col").alias("_c"), F.inline(around)).join(zones.select("row", "col"), ["row", "col"])
    inner = met.groupBy(C("_r").alias("row"), C("_c").alias("col")).agg(F.count(F.lit(1)).alias("n")).filter("n = 4")
    return zones.select("row", "col").join(inner, ["row", "col"], "left_anti")


def _beyond(label: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each pixel the squared distance to the closest pixel of another label within ``width``, and that label; of equally close ones the smallest. -1: none."""
    best, other = np.full(label.shape, np.iinfo(np.int64).max), np.full(label.shape, -1, np.int64)
    steps = sorted((i * i + j * j, i, j) for i in range(-width, width + 1) for j in range(-width, width + 1) if 0 < i * i + j * j <= width * width)
    wide = np.pad(label, width, constant_values=-1)
    h, w = label.shape
    for d2, i, j in steps:
        there = wide[width + i : width + i + h, width + j : width + j + w]
        new = (label >= 0) & (there >= 0) & (there != label) & ((d2 < best) | ((d2 == best) & (there < other)))
        best[new], other[new] = d2, there[new]
    return best, other


def seams(zones: DataFrame, width: int) -> DataFrame:
    """(row, col, image, d2, other) of each pixel of (row, col, image): squared distance to the closest pixel of another image's zone, up to ``width``, and that image; nulls beyond."""
    side = max(TILE, width)
    tile = lambda c: F.array_distinct(F.array(*(F.floor((C(c) + d) / side) for d in (-width, 0, width))))
    copied = zones.select("row", "col", "image").withColumn("_tr", F.explode(tile("row"))).withColumn("_tc", F.explode(tile("col")))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        top, left = int(pdf["_tr"].iloc[0]) * side - width, int(pdf["_tc"].iloc[0]) * side - width
        r, c = pdf["row"].to_numpy(np.int64) - top, pdf["col"].to_numpy(np.int64) - left
        names, code = np.unique(pdf["image"].to_numpy(), return_inverse=True)
        label = np.full((side + 2 * width, side + 2 * width), -1, np.int64)
        label[r, c] = code
        d2, other = (x[r, c] for x in _beyond(label, width))
        keep = (r >= width) & (r < width + side) & (c >= width) & (c < width + side)
        out = pdf.loc[keep, ["row", "col", "image"]].copy()
        met = other[keep] >= 0
        out["d2"] = pd.array(np.where(met, d2[keep], 0), dtype="Int64")
        out["other"] = pd.array(names[np.where(met, other[keep], 0)])
        out.loc[~met, ["d2", "other"]] = None
        return out

    kinds = dict(zones.dtypes)
    return copied.groupBy("_tr", "_tc").applyInPandas(one, f"row {kinds['row']}, col {kinds['col']}, image {kinds['image']}, d2 bigint, other {kinds['image']}")


def blended(pixels: DataFrame, width: int = 10) -> DataFrame:
    """(row, col, image, other, weight, value): the mosaic of images, blended over ``width`` pixels across its seams.

    A pixel's own image counts a half on the seam and all of it from half of ``width`` away; the rest is that of the image beyond the
    seam, where that image has the pixel. Pixels that repeat in an image count by their mean.
    """
    own = checkpointed(pixels.filter("value is not null").groupBy("image", "row", "col").agg(F.avg("value").alias("value")))
    reach = width // 2
    zones = checkpointed(seams(checkpointed(seamlines(own)), reach))
    # Pixels lie half a pixel off the line between them.
    weight = F.when(C("d2").isNull(), 1.0).otherwise(F.least(F.lit(1.0), 0.5 + (F.sqrt("d2") - 0.5) / width))
    first = zones.join(own, ["image", "row", "col"]).select("row", "col", "image", "other", weight.alias("_w"), C("value").alias("_a"))
    second = own.select("row", "col", C("image").alias("other"), C("value").alias("_b"))
    both = first.join(second, ["row", "col", "other"], "left")
    w = F.when(C("_b").isNull(), 1.0).otherwise(C("_w"))
    return both.select("row", "col", "image", F.when(w < 1, C("other")).alias("other"), w.alias("weight"), (w * C("_a") + (1 - w) * F.coalesce("_b", F.lit(0.0))).alias("value"))
