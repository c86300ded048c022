"""Pixels inside of polygons, by scan lines; polygons of any number and of any number of corners.

A pixel (row, col) is the square from (col, row) to (col + 1, row + 1) of the plane. Corners are rows (id, i, x, y), with i from 0 up
to their number; a polygon's ring closes by itself and may be concave or cross itself (even-odd rule).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col
#: Columns in a block: the join of spans and pixels is by row and block.
BLOCK = 256
#: Digits of places along a row.
DIGITS = 9


def edges(corners: DataFrame) -> DataFrame:
    """(id, x1, y1, x2, y2) from each corner to the next; an equi-join, so a ring of many corners is spread out. Corners without a place are left out with their edges."""
    own = corners.select("id", "i", C("x").cast("double").alias("x"), C("y").cast("double").alias("y"))
    n = own.groupBy("id").agg((F.max("i") + 1).alias("n"))
    first = own.join(n, "id").select("id", ((C("i") + 1) % C("n")).alias("i"), C("x").alias("x1"), C("y").alias("y1"))
    return first.join(own.select("id", "i", C("x").alias("x2"), C("y").alias("y2")), ["id", "i"]).drop("i").filter("x1 + y1 + x2 + y2 is not null")


def _whole(c: Column) -> Column:
    return F.floor(c).cast("bigint")


def _x_at(y: Column) -> Column:
    return F.round(C("x1") + (y - C("y1")) * (C("x2") - C("x1")) / (C("y2") - C("y1")), DIGITS)


def inner_spans(ring: DataFrame) -> DataFrame:
    """(id, row, low, high): columns whose centres are inside, from crossings of the line through the centres of each row."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    # Rows whose centre is from the lower end on and under the upper end.
    first, last = F.ceil(low - 0.5).cast("bigint"), F.ceil(high - 0.5).cast("bigint") - 1
    cross = ring.filter(C("y1") != C("y2")).filter(first <= last).select("id", "x1", "y1", "x2", "y2", F.explode(F.sequence(first, last)).alias("row"))
    cross = cross.select("id", "row", _x_at(C("row") + 0.5).alias("x"))
    line = Window.partitionBy("id", "row").orderBy("x")
    paired = cross.select("id", "row", "x", F.lead("x").over(line).alias("to"), F.row_number().over(line).alias("k")).filter("k % 2 = 1")
    spans = paired.select("id", "row", F.ceil(C("x") - 0.5).cast("bigint").alias("low"), (F.ceil(C("to") - 0.5).cast("bigint") - 1).alias("high"))
    return spans.filter("low <= high")


def touched_spans(ring: DataFrame) -> DataFrame:
    """(id, row, low, high): columns that an edge passes, in each of its rows."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    own = ring.select("*", F.explode(F.sequence(_whole(low), _whole(high))).alias("row"))
    flat = C("y1") == C("y2")
    a = F.when(flat, C("x1")).otherwise(_x_at(F.greatest(low, C("row").cast("double"))))
    b = F.when(flat, C("x2")).otherwise(_x_at(F.least(high, C("row") + 1.0)))
    return own.select("id", "row", _whole(F.least(a, b)).alias("low"), _whole(F.greatest(a, b)).alias("high"))


def merged(spans: DataFrame) -> DataFrame:
    """(id, row, low, high): the same columns in spans that do not meet."""
    line = Window.partitionBy("id", "row").orderBy("low", "high")
    so_far = F.max("high").over(line.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.select("*", (so_far.isNull() | (C("low") > so_far + 1)).cast("int").alias("_new"))
    return new.select("*", F.sum("_new").over(line).alias("_k")).groupBy("id", "row", "_k").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("_k")


def spans(corners: DataFrame, all_touched: bool = True) -> DataFrame:
    """(id, row, low, high) of each polygon: pixels whose centre is inside and, with ``all_touched``, those that an edge passes."""
    ring = edges(corners)
    found = inner_spans(ring)
    return merged(found.unionByName(touched_spans(ring)) if all_touched else found)


def clipped(pixels: DataFrame, corners: DataFrame, all_touched: bool = True) -> DataFrame:
    """``pixels`` (row, col, ...) with the id of each polygon they are in; one row for each of them.

    Spans are copied to the blocks of columns they reach; pixels meet the spans of their row and block only.
    """
    held = spans(corners, all_touched)
    block = lambda c: F.floor(C(c) / BLOCK).cast("bigint")
    held = held.select("id", C("row").alias("_row"), "low", "high", F.explode(F.sequence(block("low"), block("high"))).alias("_block"))
    own = pixels.withColumn("_b", block("col"))
    return own.join(held, (C("row") == C("_row")) & (C("_b") == C("_block")) & C("col").between(C("low"), C("high"))).select("id", *pixels.columns)
