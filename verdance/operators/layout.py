"""Plane geometry over points: hulls, thinning, connected pixels, grids and calibration."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, cos, floor, pi, sin
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdance.operators.match import within
from verdance.operators.ordering import numbered, quantiles
from verdance.operators.timeseries import gaussian_kernel
from verdance.session import Appended, checkpointed, written

C = F.col
#: Rows of an ordered table that share a block.
ROWS = 1 << 16
#: Rows and columns of a tile in which components are found.
SIDE = 256
#: Corners of hulls that meet in a task, on average.
CORNERS = 50_000


def hull(points: np.ndarray) -> list[tuple[float, float]]:
    """Convex hull as a closed ring, counter-clockwise from the smallest point."""
    pts = sorted(set(map(tuple, points.tolist())))
    if len(pts) < 3:
        return [*pts, *pts[:1]]

    def half(seq):
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    ring = half(pts) + half(reversed(pts))
    return [*ring, ring[0]]


def _rings(t: pa.Table, by: str) -> tuple[pa.Array, list[tuple[int, list[tuple[float, float]]]]]:
    """The values of ``by``, and (index into them, closed hull) of each group of a table (by, x, y)."""
    own = t.column(by).combine_chunks().dictionary_encode(null_encoding="encode")
    own = pa.concat_arrays(own.chunks) if isinstance(own, pa.ChunkedArray) else own
    code, points = own.indices.to_numpy(zero_copy_only=False), np.column_stack([t.column("x").to_numpy(), t.column("y").to_numpy()])
    order = np.argsort(code, kind="stable")
    starts = np.flatnonzero(np.diff(code[order], prepend=-1)) if len(order) else []
    return own.dictionary, [(int(code[at[0]]), hull(points[at])) for at in np.split(order, starts[1:]) if len(at)]


def hulls(df: DataFrame, by: str) -> DataFrame:
    """(by, ring) from points (by, x, y).

    Hulls of the groups of each batch of rows first, without a shuffle, then the hull of their corners: a large group is spread over
    tasks, what meets in the end are corners only, and many small groups share a task.
    """
    kind = df.schema[by].dataType.simpleString()
    own = df.select(by, C("x").cast("double").alias("x"), C("y").cast("double").alias("y")).filter("x is not null and y is not null")

    def corners(batches):
        for batch in batches:
            values, rings = _rings(pa.Table.from_batches([batch]), by)
            n = [max(len(ring) - 1, 1) for _, ring in rings]
            flat = np.array([p for (_, ring), k in zip(rings, n, strict=True) for p in ring[:k]], float).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([values.take(pa.array(np.repeat([c for c, _ in rings], n).astype(np.int64))), pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=[by, "x", "y"])

    def ring(t: pa.Table) -> pa.Table:
        values, rings = _rings(t.select([by, "x", "y"]), by)
        flat = np.array([p for _, r in rings for p in r], float).reshape(-1, 2)
        ends = pa.array(np.cumsum([0, *(len(r) for _, r in rings)]), pa.int32())
        held = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["x", "y"]))
        return pa.table({by: values.take(pa.array([c for c, _ in rings], pa.int64())), "ring": held})

    first = written(own.mapInArrow(corners, f"{by} {kind}, x double, y double"))
    parts = max(1, -(-first.count() // CORNERS))
    return first.withColumn("_c", F.pmod(F.xxhash64(by), F.lit(parts))).groupBy("_c").applyInArrow(ring, f"{by} {kind}, ring array<struct<x:double,y:double>>")


def thinned(points: DataFrame, least: float) -> DataFrame:
    """Points kept by taking them in id order, each if no kept one is closer than ``least``.

    At one place only the smallest id can be kept. Rounds over what is left: a point whose id is the smallest of its
    cell (as wide as ``least``) and of the eight around it has no smaller neighbour, so it is kept, and drops those closer than ``least``. That is the same
    set, without pairs of points: a point meets the few kept ones that are next to it. Points without a place are kept.
    """
    if not least > 0:
        return points.select("id")
    placed = (F.abs(C("x").cast("double")) < float("inf")) & (F.abs(C("y").cast("double")) < float("inf"))
    kept = Appended(points.sparkSession, points.select("id").schema)
    kept.add(points.filter(~F.coalesce(placed, F.lit(False))).select("id"))
    left = points.filter(placed).groupBy(C("x").cast("double").alias("x"), C("y").cast("double").alias("y")).agg(F.min("id").alias("id"))
    cell = lambda c: F.floor(C(c) / F.lit(least)).cast("bigint")
    left = written(left.select("id", "x", "y", cell("x").alias("_cx"), cell("y").alias("_cy")))
    near = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    while not left.isEmpty():
        lowest = left.groupBy("_cx", "_cy").agg(F.min("id").alias("id"))
        around = lowest.withColumn("_ox", F.explode(near)).withColumn("_oy", F.explode(near)).groupBy((C("_cx") + C("_ox")).alias("_cx"), (C("_cy") + C("_oy")).alias("_cy")).agg(F.min("id").alias("id"))
        now = written(left.join(around, ["_cx", "_cy", "id"], "left_semi").select("id", "x", "y"))
        kept.add(now)
        # Kept ones are the right side, which is copied to the cells around.
        drop = within(left, now, least).filter(C("d") < least).select(C("left_id").alias("id"))
        left = written(left.join(drop.distinct(), "id", "left_anti"))
    return kept.read()


def joined_runs(row: np.ndarray, col: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """For pixels in the order (row, col), without repeats, the position of the first pixel of each one's connected component.

    Pixels side by side are runs; a run meets those of the next row that it overlaps. The larger root of a meeting hangs on the smaller, all at once, until none does.
    """
    if not len(row):
        return np.zeros(0, np.int64)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (col[1:] != col[:-1] + 1)
    first = np.flatnonzero(new)
    r, low, high = row[first], col[first], col[np.append(first[1:], len(row)) - 1]
    reach, width = int(diagonal), int(col.max() - col.min()) + 4
    at = lambda y, x: (y - row.min()) * width + (x - col.min() + 2)
    start = np.searchsorted(at(r, high), at(r + 1, low - reach), "left")
    count = np.maximum(np.searchsorted(at(r, low), at(r + 1, high + reach), "right") - start, 0)
    a = np.repeat(np.arange(len(r)), count)
    b = np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())
    root = np.arange(len(r))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return first[root][np.cumsum(new) - 1]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def labelled(pixels: DataFrame, diagonal: bool = False) -> DataFrame:
    """Connected components of (row, col) pixels: label is the smallest row * 2^32 + col of each.

    Components are found in tiles first, each named by its smallest pixel. Only those that touch across the borders of tiles are then a graph, in
    which smallest names spread over neighbours, with names of names followed, until nothing changes.
    """
    key = lambda r, c: r.cast("bigint") * F.lit(2**32) + c.cast("bigint")
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])

    def parts(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["row"].to_numpy(np.int64), pdf["col"].to_numpy(np.int64)
        order = np.lexsort((c, r))
        r, c = r[order], c[order]
        root = joined_runs(r, c, diagonal)
        return pd.DataFrame({"row": r, "col": c, "part": r[root] * 2**32 + c[root]})

    tile = lambda c: F.floor(C(c) / SIDE).cast("bigint")
    own = pixels.select(C("row").cast("bigint").alias("row"), C("col").cast("bigint").alias("col")).dropna().distinct()
    placed = written(own.withColumns({"_tr": tile("row"), "_tc": tile("col")}).groupBy("_tr", "_tc").applyInPandas(parts, "row bigint, col bigint, part bigint"))
    rim = lambda c: F.pmod(C(c), F.lit(SIDE)).isin(0, SIDE - 1)
    edge = placed.filter(rim("row") | rim("col")).select("row", "col", "part")
    around = edge.select("part", F.explode(F.array(*(key(C("row") + a, C("col") + b) for a, b in steps))).alias("id"))
    edges = around.join(edge.select(key(C("row"), C("col")).alias("id"), C("part").alias("to")).hint("merge"), "id").filter("part != to").select(C("part").alias("id"), "to").distinct()
    edges = written(edges)
    labels = edges.select("id").distinct().withColumn("label", C("id"))
    while True:
        met = edges.join(labels.select(C("id").alias("to"), "label").hint("merge"), "to").groupBy("id").agg(F.min("label").alias("m"))
        step = labels.join(met.hint("merge"), "id", "left").select("id", C("label").alias("was"), F.least("label", "m").alias("label"))
        jump = step.select(C("id").alias("_l"), C("label").alias("_n"))
        step = written(step.join(jump.hint("merge"), C("label") == C("_l"), "left").select("id", "was", F.least("label", F.coalesce("_n", "label")).alias("label")))
        labels = step.select("id", "label")
        if step.filter("label != was").isEmpty():
            return placed.join(labels.select(C("id").alias("part"), "label"), "part", "left").select("row", "col", F.coalesce("label", "part").alias("label"))


def rotated(df: DataFrame, angle: float) -> DataFrame:
    """Points with u, v: coordinates turned by ``angle`` degrees."""
    a = angle * pi / 180
    return df.withColumns({"u": C("x") * cos(a) + C("y") * sin(a), "v": C("y") * cos(a) - C("x") * sin(a)})


def grid_angles(points: DataFrame, period: float, angles: list[float]) -> DataFrame:
    """(angle, strength_u, strength_v, phase_u, phase_v): how well points fall on lines of a period, for each angle.

    The strength is the length of the mean unit vector of the phases, one aggregate for all angles.
    """
    turns = F.array(*(F.struct(F.lit(float(a)).alias("angle"), F.lit(cos(a * pi / 180)).alias("c"), F.lit(sin(a * pi / 180)).alias("s")) for a in angles))
    own = points.select("x", "y", F.explode(turns).alias("t"))
    u, v = C("x") * C("t.c") + C("y") * C("t.s"), C("y") * C("t.c") - C("x") * C("t.s")
    w = 2 * pi / period
    out = own.groupBy(C("t.angle").alias("angle")).agg(*(f(e * w).alias(n) for n, f, e in (("cu", lambda z: F.avg(F.cos(z)), u), ("su", lambda z: F.avg(F.sin(z)), u), ("cv", lambda z: F.avg(F.cos(z)), v), ("sv", lambda z: F.avg(F.sin(z)), v))))
    return out.select("angle", F.hypot("cu", "su").alias("strength_u"), F.hypot("cv", "sv").alias("strength_v"), (F.atan2("su", "cu") / w).alias("phase_u"), (F.atan2("sv", "cv") / w).alias("phase_v"))


def spectrum(counts: np.ndarray, span: float, low: float, high: float) -> tuple[float | None, float | None, float]:
    """(period, place of the fullest bin, score) of a histogram over ``span``.

    The period is that of the strongest frequency with a period from ``low`` to ``high``; the score is its
    amplitude over the mean amplitude there. No period: fewer than 200 values, less than two periods, or no amplitude.
    """
    if counts.sum() < 200 or span < 2 * low:
        return None, None, 0.0
    size = np.round(np.abs(np.fft.rfft(counts)), 6)
    periods = span / np.maximum(np.arange(len(size)), 1e-12)
    size[(periods < low) | (periods > high)] = -1.0
    at = int(np.argmax(size))
    if size[at] <= 0:
        return None, None, 0.0
    return float(periods[at]), (int(np.argmax(counts)) + 0.5) * span / len(counts), float(size[at] / (size[size >= 0].mean() + 1e-9))


def grid_scan(points: DataFrame, low: float, high: float, angles: Sequence[float] = tuple(range(90))) -> DataFrame:
    """(angle, period_u, phase_u, period_v, phase_v, score, best): period and phase of the rows of points on both axes, by angle.

    Points at one place are turned once, by every angle, and counted in bins about one unit wide inside
    the scan (partial counts; as many groups as the image is wide, an axis and
    angle). Only a histogram of one axis meets in a task, for its Fourier
    transform. ``best`` marks the first angle with the highest sum of both
    scores; an angle without a period on an axis has nulls and score 0.
    """
    turns = F.array(*(F.struct(F.lit(float(a)).alias("angle"), F.lit(cos(a * pi / 180)).alias("c"), F.lit(sin(a * pi / 180)).alias("s")) for a in angles))
    u, v = C("x") * C("t.c") + C("y") * C("t.s"), C("y") * C("t.c") - C("x") * C("t.s")
    places = written(points.filter("x is not null and y is not null").groupBy("x", "y").agg(F.count(F.lit(1)).alias("m")))
    own = places.select("x", "y", "m", F.explode(turns).alias("t"))
    own = own.select(C("t.angle").alias("angle"), F.round(u, 6).alias("u"), F.round(v, 6).alias("v"), "m")
    ends = own.groupBy("angle").agg(*(f(c).alias(f"{n}_{c}") for n, f in (("low", F.min), ("high", F.max)) for c in "uv"))
    both = own.join(F.broadcast(ends), "angle")  # one row an angle
    axes = F.array(*(F.struct(F.lit(c).alias("axis"), C(c).alias("at"), C(f"low_{c}").alias("low"), (C(f"high_{c}") - C(f"low_{c}")).alias("span")) for c in "uv"))
    flat = both.select("angle", "m", F.explode(axes).alias("a")).select("angle", "m", "a.*").withColumn("n", F.greatest(F.floor("span"), F.lit(32)).cast("int"))
    place = F.when(C("span") > 0, F.least(F.floor((C("at") - C("low")) / (C("span") / C("n"))).cast("int"), C("n") - 1)).otherwise(0)
    bins = flat.groupBy("angle", "axis", "low", "span", "n", place.alias("bin")).agg(F.sum("m").alias("count"))

    def found(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        counts = np.zeros(int(first["n"]))
        counts[pdf["bin"].to_numpy()] = pdf["count"].to_numpy()
        period, phase, score = spectrum(counts, float(first["span"]), low, high)
        return pd.DataFrame([(first["angle"], first["axis"], period, None if phase is None else first["low"] + phase, score)], columns=["angle", "axis", "period", "phase", "score"])

    each = bins.groupBy("angle", "axis").applyInPandas(found, "angle double, axis string, period double, phase double, score double")
    side = lambda c, n: F.max(F.when(C("axis") == n, C(c))).alias(f"{c}_{n}")
    out = each.groupBy("angle").agg(side("period", "u"), side("phase", "u"), side("period", "v"), side("phase", "v"), F.round(F.sum("score"), 6).alias("score"))
    whole = C("period_u").isNotNull() & C("period_v").isNotNull()
    top = checkpointed(out).withColumn("score", F.when(whole, C("score")).otherwise(0.0))
    first = top.filter(whole).agg(F.min_by("angle", F.struct(-C("score"), C("angle"))).alias("_best"))
    return top.join(F.broadcast(first)).withColumn("best", F.coalesce(C("angle") == C("_best"), F.lit(False))).drop("_best")


#: Bins on either side that smoothing of strip histograms reaches, for its spread of 2 bins.
REACH = 6


class StripFrame(NamedTuple):
    """Turned axes of an extent: cosine, sine, u from low to high in ``n`` bins, and where the first strip starts."""

    c: float
    s: float
    low: float
    high: float
    n: int
    step: float
    start: float


def strip_frame(angle: float, period: float, phase: float, least_gap: float, extent: tuple[float, float, float, float]) -> StripFrame:
    a = angle * pi / 180
    c, s = cos(a), sin(a)
    x0, y0, x1, y1 = extent
    corners = [(x * c + y * s, y * c - x * s) for x in (x0, x1) for y in (y0, y1)]
    low, high = round(min(u for u, _ in corners), 6), round(max(u for u, _ in corners), 6)
    step, bottom = max(least_gap / 4, 1.0), phase - period
    start = bottom + floor((min(v for _, v in corners) - bottom) / period) * period
    return StripFrame(c, s, low, high, max(int((high - low) / step), 8), step, start)


def strip_centres(points: DataFrame, angle: float, period: float, phase: float, least_gap: float, extent: tuple[float, float, float, float], support: int = 20, ratio: float = 0.8, width: float = 1.0) -> DataFrame:
    """(strip, i, centre, x, y): places along each strip, halfway between its gaps, and where they lie in the image.

    ``points`` are background pixels. Strips are bands of ``period`` across v from ``phase`` on. Along u a strip's
    background is counted in bins of about a quarter of ``least_gap`` over the whole ``extent`` (x0, y0, x1, y1) and
    smoothed; its maxima, at least max(``least_gap``, ``ratio`` * ``period``) apart (of closer ones the higher, of
    equal ones the first stays), are the gaps. A stretch between two gaps holds one place a ``width`` * ``period``, rounded,
    at least one. Strips with fewer than ``support`` pixels or two gaps have none.

    One shuffle counts (strip, bin); the rest works on these counts, of which a strip has as many as the extent has bins.
    """
    c, s, low, high, n, step, start = strip_frame(angle, period, phase, least_gap, extent)
    apart = max(round(max(least_gap, ratio * period) / step), 1)
    u, v = F.round(C("x") * c + C("y") * s, 6), F.round(C("y") * c - C("x") * s, 6)
    place = F.least(F.floor((u - low) / ((high - low) / n)), F.lit(n - 1)).cast("int")
    counts = points.select(F.floor((v - start) / period).cast("int").alias("strip"), place.alias("bin")).filter(f"bin between 0 and {n - 1}")
    counts = counts.groupBy("strip", "bin").agg(F.count(F.lit(1)).alias("c"))
    # Every count is added to the bins it reaches, so that empty bins need no rows of their own unless something is near.
    kernel = gaussian_kernel(2.0, REACH)
    spread = F.array(*(F.struct(F.lit(i).alias("d"), F.lit(k).alias("k")) for i, k in zip(range(-REACH, REACH + 1), kernel, strict=True)))
    reached = counts.select("strip", "c", "bin", F.explode(spread).alias("e")).select("strip", (C("bin") + C("e.d")).alias("bin"), (C("c") * C("e.k")).alias("h"), F.when(C("e.d") == 0, C("c")).otherwise(0).alias("c"))
    smooth = reached.filter(f"bin between 0 and {n - 1}").groupBy("strip", "bin").agg(F.round(F.sum("h"), 9).alias("h"), F.sum("c").alias("c"))
    order = Window.partitionBy("strip").orderBy("bin")
    beside = lambda f, d: F.coalesce(F.when(f("bin").over(order) == C("bin") + d, f("h").over(order)), F.lit(0.0))
    tops = smooth.select("strip", "bin", "h", beside(F.lag, -1).alias("_a"), beside(F.lead, 1).alias("_b"), F.sum("c").over(Window.partitionBy("strip")).alias("_n"))
    tops = tops.filter((C("_n") >= support) & (C("h") >= C("_a")) & (C("h") >= C("_b")) & (C("h") > 0) & C("bin").between(1, n - 2))
    seen = tops.groupBy("strip").agg(F.array_sort(F.collect_list(F.struct("bin", "h"))).alias("p"))

    def take(kept, p):
        last = F.try_element_at(kept, F.lit(-1))
        near = (F.size(kept) > 0) & (p["bin"] - last["bin"] < apart)
        swapped = F.when(p["h"] > last["h"], F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(p))).otherwise(kept)
        return F.when(near, swapped).otherwise(F.concat(kept, F.array(p)))

    gaps = F.aggregate("p", F.lit([]).cast("array<struct<bin:int,h:double>>"), take)
    edge = lambda p: low + p["bin"] * ((high - low) / n) + step / 2
    stretch = lambda i: F.struct(F.element_at("g", i).alias("a"), (F.element_at("g", i + 1) - F.element_at("g", i)).alias("w"))
    own = seen.select("strip", F.transform(gaps, edge).alias("g")).filter("size(g) > 1")
    own = own.select("strip", F.explode(F.transform(F.sequence(F.lit(1), F.size("g") - 1), stretch)).alias("s"))
    own = own.select("strip", "s.a", "s.w")
    own = own.withColumn("n", F.greatest(F.lit(1), F.floor(C("w") / (period * width) + 0.5).cast("int")))
    own = own.select("strip", "a", "w", "n", F.explode(F.sequence(F.lit(0), C("n") - 1)).alias("j")).withColumn("centre", C("a") + C("w") * (C("j") + 0.5) / C("n"))
    across = start + (C("strip") + 0.5) * period
    i = F.row_number().over(Window.partitionBy("strip").orderBy("centre"))
    return own.select("strip", i.alias("i"), "centre", (C("centre") * c - across * s).alias("x"), (C("centre") * s + across * c).alias("y"))


def seed_pixels(seeds: DataFrame, angle: float, size: float, extent: tuple[int, int, int, int]) -> DataFrame:
    """(row, col) of pixels inside turned squares of side ``size`` around seeds (x, y), within ``extent`` (x0, y0, x1, y1)."""
    a = angle * pi / 180
    c, s = cos(a), sin(a)
    r = ceil(size / 2 * (abs(c) + abs(s))) + 1
    x0, y0, x1, y1 = extent
    span = lambda at: F.explode(F.sequence((F.floor(at) - r).cast("bigint"), (F.ceil(at) + r).cast("bigint")))
    box = seeds.select("x", "y", span(C("x")).alias("col")).select("x", "y", "col", span(C("y")).alias("row"))
    dx, dy = C("col") - C("x"), C("row") - C("y")
    inside = (F.abs(dx * c + dy * s) < size / 2) & (F.abs(dy * c - dx * s) < size / 2) & C("col").between(x0, x1) & C("row").between(y0, y1)
    return box.filter(inside).select("row", "col").distinct()


def strips(df: DataFrame, centres: list[float], v: str) -> DataFrame:
    """Rows with the strip their ``v`` falls in; borders lie halfway between neighbouring centres."""
    at = F.lit(0)
    for i, (a, b) in enumerate(zip(sorted(centres), sorted(centres)[1:], strict=False), 1):
        at = F.when(C(v) >= (a + b) / 2, i).otherwise(at)
    return df.withColumn("strip", at)


def rolling_offsets(df: DataFrame, order: str, dx: str, dy: str, last: int = 10, least: int = 3) -> DataFrame:
    """Mean of the last successful offsets in front of each row; null until there are ``least``."""
    own = numbered(df, [order], "_i").withColumn("_block", F.floor(C("_i") / ROWS))
    # The last rows in front of a block are copied into it.
    edge = own.filter(C("_i") % ROWS >= ROWS - last).withColumn("_block", C("_block") + 1)
    w = Window.partitionBy("_block").orderBy("_i").rowsBetween(-last, -1)
    mean = lambda c: F.when(F.count(c).over(w) >= least, F.avg(c).over(w))
    both = own.withColumn("_own", F.lit(True)).unionByName(edge.withColumn("_own", F.lit(False)))
    return both.withColumns({"roll_x": mean(dx), "roll_y": mean(dy)}).filter("_own").select(*df.columns, "roll_x", "roll_y")


def clock_offset(photos: DataFrame, triggers: DataFrame, ts: str, span: float = 15.0, coarse: float = 0.5, fine_span: float = 2.0, fine: float = 0.05, limit: float = 8.0) -> tuple[float | None, float | None]:
    """(offset, score): the shift of photo times with the smallest mean distance to the nearest trigger.

    A coarse grid, then a fine one around its best; offsets beyond ``limit`` are
    rejected. Each grid is one job: photos are copied to every offset, and the
    nearest triggers come from neighbouring one-second cells.
    """
    sec = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    t = triggers.select(sec(C(ts)).alias("_b")).distinct()
    t = t.select("_b", F.explode(F.array(*(F.floor("_b") + i for i in (-1, 0, 1)))).alias("_c"))

    def best(offsets: list[float]) -> tuple[float | None, float | None]:
        p = photos.select(sec(C(ts)).alias("_a"), F.monotonically_increasing_id().alias("_i")).withColumn("_o", F.explode(F.array(*(F.lit(float(o)) for o in offsets))))
        p = p.withColumn("_c", F.floor(C("_a") + C("_o")))
        d = p.join(t, "_c", "left").groupBy("_o", "_i").agg(F.least(F.lit(1.0), F.coalesce(F.min(F.abs(C("_a") + C("_o") - C("_b"))), F.lit(1.0))).alias("d"))
        row = d.groupBy("_o").agg(F.round(F.avg("d"), 9).alias("s")).orderBy("s", F.abs("_o"), "_o").first()
        return (float(row["_o"]), float(row["s"])) if row else (None, None)

    o, s = best([i * coarse for i in range(-round(span / coarse), round(span / coarse) + 1)])
    if o is None:
        return None, None
    o, s = best([o + i * fine for i in range(-round(fine_span / fine), round(fine_span / fine) + 1)])
    return (o, s) if abs(o) <= limit else (None, s)


def linted(lines: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(file, rule, hits) for patterns found in text lines (file, value)."""
    found = F.array_compact(F.array(*(F.when(C("value").rlike(p), F.lit(n)) for n, p in rules.items())))
    return lines.select("file", F.explode(found).alias("rule")).groupBy("file", "rule").agg(F.count(F.lit(1)).alias("hits"))


def guarded(df: DataFrame, residual: str, limit: float = 1.0) -> DataFrame:
    """(median, maximum) of residuals; the row raises an error if the median is over ``limit``."""
    df = checkpointed(df.select(residual))
    (mid,) = quantiles(df, residual, (0.5,))
    a = df.agg(F.lit(mid).cast("double").alias("median"), F.max(residual).alias("maximum"))
    return a.select(F.when(C("median") > limit, F.raise_error(F.concat(F.lit("coordinates are off: median residual "), C("median").cast("string"))).cast("double")).otherwise(C("median")).alias("median"), "maximum")
