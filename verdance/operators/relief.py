"""Relief of a mask: distances to the background, peaks, borders, and floods from the peaks.

Pixels are rows (row, col, ...), at most one a place, of an image of any size and shape; a place without a row is no
part of the image. Lines of the image are worked on by window functions and by line; neighbourhoods in
square tiles with a rim copied from the tiles beside them, so that a task holds one tile. Floods are
graphs of pixels: pointers that double, and a forest that grows by its best edges, over written tables.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdance.operators.match import closest
from verdance.session import Appended, checkpointed, written

C = F.col
#: Rows and columns of a tile, at least; a tile is no smaller than its rim.
TILE = 256
#: Places of an image a pixel, up to which those without a row are filled up.
FILLED = 4
#: Tiles beside each other that a second flood takes as one.
COARSE = 16


def pixel_id(row: Column, col: Column) -> Column:
    """One number a place; rows and columns are from -2^31 up to 2^31."""
    return row.cast("bigint") * F.lit(2**32) + col.cast("bigint")


def envelope(at: np.ndarray, height: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """min over i of (wanted - at[i])^2 + height[i], for rising ``at`` and rising ``wanted``: the lower envelope of parabolas."""
    top = np.empty(len(at), np.int64)
    start = np.empty(len(at))
    last = -1
    for i in range(len(at)):
        left = -np.inf
        while last >= 0:
            j = top[last]
            # Where parabola i comes under parabola j.
            left = ((height[i] + at[i] * at[i]) - (height[j] + at[j] * at[j])) / (2.0 * (at[i] - at[j]))
            if left > start[last]:
                break
            last -= 1
            left = -np.inf
        last += 1
        top[last], start[last] = i, left
    own = top[np.searchsorted(start[: last + 1], wanted, side="right") - 1]
    return (wanted - at[own]) ** 2 + height[own]


def distances(pixels: DataFrame, inside: str = "inside") -> DataFrame:
    """(row, col, d2) of each pixel that is ``inside``: the exact squared distance to the closest pixel that is not.

    Columns first: the nearest pixel outside above and below, carried along by window functions. Rows
    then: the lower envelope of the parabolas that the columns' distances are. A row of the image is what a task
    holds. d2 is null where the image has no pixel outside; null marks count as outside. Places without a row are filled up, as a
    column's distance passes through them; where they are most of the image, the closest pixel outside is searched for instead.
    """
    own = pixels.select("row", "col", F.coalesce(C(inside), F.lit(False)).alias("_in"))
    kinds = {n: t for n, t in pixels.dtypes if n in ("row", "col")}
    box = own.agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("top"), F.max("row").alias("foot"), F.min("col").alias("left"), F.max("col").alias("right")).first()
    if box["n"]:
        width = box["right"] - box["left"] + 1
        area = width * (box["foot"] - box["top"] + 1)
        if area > FILLED * box["n"]:
            return _searched(own, kinds)
        if area > box["n"]:
            grid = own.sparkSession.range(area).select((F.floor(C("id") / width) + box["top"]).cast(kinds["row"]).alias("row"), (C("id") % width + box["left"]).cast(kinds["col"]).alias("col"))
            own = grid.join(own, ["row", "col"], "left")
    out = F.when(~C("_in"), C("row"))
    line = Window.partitionBy("col").orderBy("row")
    above = F.last(out, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    below = F.first(out, ignorenulls=True).over(line.rowsBetween(0, Window.unboundedFollowing))
    gap = F.least(C("row") - above, below - C("row")).cast("bigint")
    lines = own.select("row", "col", F.coalesce("_in", F.lit(False)).alias("_in"), gap.alias("_g"))

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("col")
        known, wanted = pdf[pdf["_g"].notna()], pdf[pdf["_in"]]
        made = wanted[["row", "col"]].copy()
        if len(known):
            # Of a stretch of the background only its ends can be the closest.
            at, g = known["col"].to_numpy(np.int64), known["_g"].to_numpy(np.int64)
            ends = np.ones(len(at), bool)
            ends[1:-1] = (g[1:-1] > 0) | (g[:-2] > 0) | (g[2:] > 0) | (at[1:-1] - at[:-2] > 1) | (at[2:] - at[1:-1] > 1)
            made["d2"] = pd.array(envelope(at[ends], (g * g)[ends], wanted["col"].to_numpy(np.int64)), dtype="Int64")
        else:
            made["d2"] = pd.array([None] * len(made), dtype="Int64")
        return made

    return lines.groupBy("row").applyInPandas(across, f"row {kinds['row']}, col {kinds['col']}, d2 bigint")


def _searched(own: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """``distances`` of an image with few pixels in its extent."""
    spots = own.select("row", "col", "_in", pixel_id(C("row"), C("col")).alias("id"), C("col").alias("x"), C("row").alias("y"))
    found = closest(spots.filter("_in"), spots.filter("not _in"), None).withColumn("_r", F.expr("shiftright(right_id + 2147483648, 32)"))
    found = found.select(C("left_id").alias("id"), "_r", (C("right_id") - C("_r") * F.lit(2**32)).alias("_c"))
    gap = lambda a, b: (C(a).cast("bigint") - C(b)) * (C(a).cast("bigint") - C(b))
    return spots.filter("_in").join(found, "id", "left").select(*(C(c).cast(t) for c, t in kinds.items()), (gap("row", "_r") + gap("col", "_c")).alias("d2"))


def tiled(pixels: DataFrame, v: str, rim: int, work: Callable[[np.ndarray], np.ndarray], name: str, kind: str = "double") -> DataFrame:
    """(row, col, v, name): ``work`` of each tile with its rim, as a dense array with NaN where there is no pixel.

    A pixel is copied to the tiles whose rim it is in (at most four); what ``work`` gives for the rim is dropped.
    """
    side = max(TILE, rim)
    own = pixels.select("row", "col", v).withColumns({"_r": F.floor(C("row") / side), "_c": F.floor(C("col") / side)})
    reach = lambda at, tile: F.array_distinct(F.array(*(F.floor((C(at) + d) / side) for d in (-rim, 0, rim)))) if rim else F.array(C(tile))
    copied = own.withColumn("_tr", F.explode(reach("row", "_r"))).withColumn("_tc", F.explode(reach("col", "_c"))).drop("_r", "_c")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        top, left = int(pdf["_tr"].iloc[0]) * side - rim, int(pdf["_tc"].iloc[0]) * side - rim
        r, c = pdf["row"].to_numpy(np.int64) - top, pdf["col"].to_numpy(np.int64) - left
        dense = np.full((side + 2 * rim, side + 2 * rim), np.nan)
        dense[r, c] = pdf[v].to_numpy(float)
        got = work(dense)[r, c]
        keep = (r >= rim) & (r < rim + side) & (c >= rim) & (c < rim + side)
        return pdf.loc[keep, ["row", "col", v]].assign(**{name: got[keep]})

    kinds = dict(pixels.dtypes)
    return copied.groupBy("_tr", "_tc").applyInPandas(one, f"row {kinds['row']}, col {kinds['col']}, {v} {kinds[v]}, {name} {kind}")


def _slid(x: np.ndarray, half: int) -> np.ndarray:
    """Maximum over 2 * half + 1 columns, by doubling; ``x`` has no NaN."""
    width, done, out = 2 * half + 1, 1, x
    padded = lambda a, n: np.concatenate([a[:, n:], np.full((len(a), min(n, a.shape[1])), -np.inf)], 1)[:, : a.shape[1]]
    while done < width:
        step = min(done, width - done)
        out = np.maximum(out, padded(out, step))
        done += step
    shifted = np.full_like(out, -np.inf)
    if half < out.shape[1]:
        shifted[:, half:] = out[:, : out.shape[1] - half]
        for k in range(half):  # windows that begin in front of the array
            shifted[:, k] = x[:, : k + half + 1].max(1)
    return shifted


def maximum_around(dense: np.ndarray, radius: int, square: bool = False) -> np.ndarray:
    """Maximum over the circle (or the square) of ``radius`` pixels around each; NaN counts as nothing."""
    x = np.where(np.isnan(dense), -np.inf, dense)
    out = np.full_like(x, -np.inf)
    slid: dict[int, np.ndarray] = {}
    for dy in range(min(radius, len(x) - 1) + 1):
        half = radius if square else int((radius * radius - dy * dy) ** 0.5 + 1e-9)
        m = slid[half] if half in slid else slid.setdefault(half, _slid(x, half))
        out[: len(x) - dy] = np.maximum(out[: len(x) - dy], m[dy:])
        out[dy:] = np.maximum(out[dy:], m[: len(x) - dy])
    return out


def focal_maximum(pixels: DataFrame, v: str, radius: int, square: bool = False) -> DataFrame:
    """(row, col, v, highest) of each pixel: the largest ``v`` within ``radius`` pixels."""
    return tiled(pixels, v, radius, lambda x: maximum_around(x, radius, square), "highest")


def variety(pixels: DataFrame, v: str) -> DataFrame:
    """(row, col, v, kinds): how many different values the 3 x 3 pixels around hold; pixels without a value count as none."""

    def counted(x: np.ndarray) -> np.ndarray:
        wide = np.pad(x, 1, constant_values=np.nan)
        around = np.sort(np.stack([wide[i : i + len(x), j : j + x.shape[1]] for i in range(3) for j in range(3)]), axis=0)  # NaN last
        new = np.concatenate([~np.isnan(around[:1]), (around[1:] != around[:-1]) & ~np.isnan(around[1:])])
        return new.sum(0).astype(float)

    return tiled(pixels, v, 1, counted, "kinds").withColumn("kinds", C("kinds").cast("int"))


def crests(relief: DataFrame, radius: int, depth: float) -> DataFrame:
    """(row, col) of pixels whose distance is the largest within a circle of ``radius`` and more than ``depth``; plateaus are kept whole."""
    return focal_maximum(relief.filter("d2 is not null"), "d2", radius).filter((C("d2") >= C("highest")) & (F.sqrt("d2") > depth)).select("row", "col")


def peaks(relief: DataFrame, apart: int) -> DataFrame:
    """(row, col, d2) of peaks more than ``apart`` pixels apart in rows or columns.

    Candidates are the largest of their square. Of candidates too close to each other (equally high, as in a
    plateau) those are taken that come first in the order (height, row, col). Tiles settle their own in that order, as far as
    none waits for one of a tile beside; rounds are as many as chains of conflicts cross tiles.
    """
    found = focal_maximum(relief.filter("d2 is not null"), "d2", apart, square=True).filter("d2 >= highest").select("row", "col", "d2")
    side = max(TILE, apart)
    left = written(found.select(C("row").cast("bigint").alias("row"), C("col").cast("bigint").alias("col"), "d2", F.lit(0).alias("state")))
    reach = lambda c: F.array_distinct(F.array(*(F.floor((C(c) + d) / side) for d in (-apart, 0, apart))))

    def settled(pdf: pd.DataFrame) -> pd.DataFrame:
        top, first = int(pdf["_tr"].iloc[0]) * side, int(pdf["_tc"].iloc[0]) * side
        pdf = pdf.iloc[np.lexsort((pdf["col"], pdf["row"], -pdf["d2"].to_numpy()))]
        r, c, was = pdf["row"].to_numpy() - top + 2 * apart, pdf["col"].to_numpy() - first + 2 * apart, pdf["state"].to_numpy()
        own = (r >= 2 * apart) & (r < 2 * apart + side) & (c >= 2 * apart) & (c < 2 * apart + side)
        taken, open_ = (np.zeros((side + 4 * apart,) * 2, bool) for _ in range(2))
        now = was.copy()
        taken[r[was == 1], c[was == 1]] = True
        for i, (y, x) in enumerate(zip(r.tolist(), c.tolist(), strict=True)):
            if was[i] == 0:
                around = slice(y - apart, y + apart + 1), slice(x - apart, x + apart + 1)
                if own[i] and taken[around].any():
                    now[i] = 2
                elif not own[i] or open_[around].any():
                    open_[y, x] = True
                else:
                    now[i], taken[y, x] = 1, True
        return pdf.assign(state=now)[own & (was == 0)][["row", "col", "d2", "state"]]

    taken = Appended(relief.sparkSession, left.select("row", "col", "d2").schema)
    while not left.isEmpty():
        copied = left.withColumn("_tr", F.explode(reach("row"))).withColumn("_tc", F.explode(reach("col")))
        step = written(copied.groupBy("_tr", "_tc").applyInPandas(settled, left.schema))
        taken.add(step.filter("state = 1"))
        waiting = step.filter("state = 0")
        if waiting.isEmpty():
            break
        # What is taken is there once more, for what waits in the tiles beside.
        left = written(waiting.unionByName(taken.read().withColumn("state", F.lit(1))))
    return taken.read()


def followed(moves: DataFrame) -> DataFrame:
    """(id, to) with ``to`` at the end of the chain that starts at ``id``; ends point at themselves. Pointers double."""
    now = written(moves.select("id", "to"))
    while True:
        ahead = now.select(C("id").alias("to"), C("to").alias("_next"))
        step = written(now.join(ahead, "to").select("id", C("_next").alias("to"), (C("_next") != C("to")).alias("_moved")))
        now = step.select("id", "to")
        if step.filter("_moved").isEmpty():
            return now


def _beside(own: DataFrame, keep: list[Column]) -> DataFrame:
    """Each pixel of ``own`` (id, row, col, key) with those of the eight around it: ``keep`` beside (to, to_key)."""
    around = F.array(*(pixel_id(C("row") + i, C("col") + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j))
    near = own.select(*keep, F.explode(around).alias("to"))
    return near.join(own.select(C("id").alias("to"), C("key").alias("to_key")), "to")


def _forest(a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root of each node, links that stay open) of a flood over links a - b ranked by low, then high: the highest first.

    A link that closes a cycle is in no flood. One with an end (``ends``) on one side at most joins both sides; one between two ends stays open, whatever
    lies outside. A root is the end of its tree where there is one.
    """
    n = len(ends)
    whole, tree, full, open_ = list(range(n)), list(range(n)), ends.tolist(), []

    def root(of: list[int], i: int) -> int:
        while of[i] != i:
            of[i] = of[of[i]]
            i = of[i]
        return i

    order = np.lexsort((-high, -low))
    for k, x, y in zip(order.tolist(), a[order].tolist(), b[order].tolist(), strict=True):
        p, q = root(whole, x), root(whole, y)
        if p == q:
            continue
        whole[p] = q
        p, q = root(tree, x), root(tree, y)
        if full[p] and full[q]:
            open_.append(k)
        elif full[p]:
            tree[q] = p
        else:
            tree[p] = q
    return np.array([root(tree, i) for i in range(n)], np.int64), np.array(open_, np.int64)


#: Columns of a link: its basins, whether they have a mark, and its rank: the keys of its lower and of its higher end.
LINK = ("a", "b", "a_full", "b_full", "low_d2", "low_at", "high_d2", "high_at")


def _ranked(pdf: pd.DataFrame, end: str) -> np.ndarray:
    """The rank of each link's lower or higher end among all ends of both kinds."""
    keys = pd.concat([pdf[[f"{e}_d2", f"{e}_at"]].set_axis(["d2", "at"], axis=1) for e in ("low", "high")])
    codes = pd.MultiIndex.from_frame(keys.drop_duplicates().sort_values(["d2", "at"]))
    return codes.get_indexer(pd.MultiIndex.from_frame(pdf[[f"{end}_d2", f"{end}_at"]]))


def watershed(relief: DataFrame, marks: DataFrame) -> DataFrame:
    """(row, col, label) of each pixel of ``relief`` (row, col, d2) that the flood from ``marks`` (row, col) reaches; label is the mark's pixel_id.

    The flood goes down from the marks, by the eight neighbours. Pixels are ordered by height and then by
    place, links between neighbours by their lower end and then by their higher end; the highest link
    is taken first, unless both its sides have a mark. That is a spanning forest. Tiles grow it first, with marks and rims as ends that stay apart;
    what stays open between them, and the links across tiles, are grown again in tiles COARSE times as wide. Of what is then
    left, basins without a mark, all at once, hang on the best they have, until none is left that has one.
    """
    d2 = dict(relief.dtypes)["d2"]
    marked = written(marks.select(pixel_id(C("row"), C("col")).alias("id")).distinct().withColumn("mark", F.lit(True)))
    own = relief.filter("d2 is not null").select("row", "col", "d2", pixel_id(C("row"), C("col")).alias("id")).join(marked, "id", "left").withColumn("mark", F.coalesce("mark", F.lit(False)))
    tile = lambda c, side: F.floor(C(c) / side).cast("bigint")
    kinds = dict(relief.dtypes)
    link = f"a bigint, b bigint, a_full boolean, b_full boolean, low_d2 {d2}, low_at bigint, high_d2 {d2}, high_at bigint"

    def rim(r, c, side):
        return (r % side == 0) | (r % side == side - 1) | (c % side == 0) | (c % side == side - 1)

    def flooded(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["d2", "id"], ascending=[True, False]).reset_index(drop=True)
        r, c, ids, mark, h = (pdf[n].to_numpy() for n in ("row", "col", "id", "mark", "d2"))
        at = np.full((TILE + 2, TILE + 2), -1, np.int64)
        y, x = r.astype(np.int64) % TILE + 1, c.astype(np.int64) % TILE + 1
        at[y, x] = np.arange(len(pdf))
        sides = [(np.arange(len(pdf)), at[y + i, x + j]) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1))]
        p, q = (np.concatenate([s[k] for s in sides]) for k in (0, 1))
        p, q = p[q >= 0], q[q >= 0]
        low, high = np.minimum(p, q), np.maximum(p, q)
        root, left = _forest(p, q, low, high, mark.astype(bool) | rim(r, c, TILE))
        of = ids[root]
        left = left[~(mark[root[p[left]]] & mark[root[q[left]]]).astype(bool)]
        m, n, lo, hi = root[p[left]], root[q[left]], low[left], high[left]
        made = pd.DataFrame({"a": ids[m], "b": ids[n], "a_full": mark[m], "b_full": mark[n], "low_d2": h[lo], "low_at": -ids[lo], "high_d2": h[hi], "high_at": -ids[hi]})
        return pd.concat([pdf.assign(basin=of, full=mark[root])[["row", "col", "id", "d2", "basin", "full"]].astype(object), made.astype(object)], ignore_index=True)

    both = written(own.withColumns({"_tr": tile("row", TILE), "_tc": tile("col", TILE)}).groupBy("_tr", "_tc").applyInPandas(flooded, f"row {kinds['row']}, col {kinds['col']}, id bigint, d2 {d2}, basin bigint, full boolean, {link}"))
    placed = both.filter("id is not null").select("row", "col", "id", "d2", "basin", "full")
    edge = placed.filter(rim(F.pmod(C("row"), F.lit(TILE)), F.pmod(C("col"), F.lit(TILE)), TILE))
    edge = edge.select("row", "col", "id", F.struct("d2", (-C("id")).alias("at"), "basin", "full").alias("key"))
    across = _beside(edge, [C("id"), C("key"), C("row"), C("col")]).withColumns({"_r": F.shiftright(C("to") + F.lit(2**31), 32), "_tr": tile("row", TILE), "_tc": tile("col", TILE)})
    across = across.withColumn("_c", C("to") - C("_r") * F.lit(2**32)).filter((F.struct("key.d2", "key.at") > F.struct("to_key.d2", "to_key.at")) & ((tile("_r", TILE) != C("_tr")) | (tile("_c", TILE) != C("_tc"))))
    across = across.filter("not (key.full and to_key.full)").select(C("key.basin").alias("a"), C("to_key.basin").alias("b"), C("key.full").alias("a_full"), C("to_key.full").alias("b_full"), C("to_key.d2").alias("low_d2"), C("to_key.at").alias("low_at"), C("key.d2").alias("high_d2"), C("key.at").alias("high_at"))
    every = both.filter("id is null").select(*LINK).unionByName(across)
    wide = TILE * COARSE

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(np.concatenate([pdf["a"].to_numpy(), pdf["b"].to_numpy()]), return_inverse=True)
        a, b = at[: len(pdf)], at[len(pdf) :]
        mark = np.zeros(len(ids), bool)
        mark[a], mark[b] = pdf["a_full"].to_numpy(bool), pdf["b_full"].to_numpy(bool)
        r = (ids + 2**31) // 2**32
        root, left = _forest(a, b, _ranked(pdf, "low"), _ranked(pdf, "high"), mark | rim(r, ids - r * 2**32, wide))
        m, n = root[a[left]], root[b[left]]
        stays = pdf.iloc[left].assign(a=ids[m], b=ids[n], a_full=mark[m], b_full=mark[n])[~(mark[m] & mark[n])]
        return pd.concat([pd.DataFrame({"id": ids, "to": ids[root]}).astype(object), stays[list(LINK)].astype(object)], ignore_index=True)

    line = lambda c: F.shiftright(C(c) + F.lit(2**31), 32)
    spot = lambda c: F.struct(F.floor(line(c) / wide).alias("r"), F.floor((C(c) - line(c) * F.lit(2**32)) / wide).alias("c"))
    every = written(every.withColumn("_t", F.when(spot("a") == spot("b"), spot("a"))))
    again = written(every.filter("_t is not null").groupBy("_t").applyInPandas(lambda pdf: joined(pdf), f"id bigint, `to` bigint, {link}"))
    moved = again.filter("id is not null").select(C("id").alias("basin"), "to")
    open_ = again.filter("id is null").select(*LINK).unionByName(every.filter("_t is null").select(*LINK))
    rank = F.struct(F.struct("low_d2", "low_at").alias("low"), F.struct("high_d2", "high_at").alias("high"))
    links = written(open_.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max(rank).alias("rank")))
    nodes = links.select(C("a").alias("id")).unionByName(links.select(C("b").alias("id"))).unionByName(marked.select("id")).distinct()
    group = written(nodes.join(marked, "id", "left").select("id", C("id").alias("of"), C("mark").isNotNull().alias("full")))
    while True:
        ends = group.select("of", "full").distinct()
        out = links.select(C("a").alias("of"), C("b").alias("to"), "rank").unionByName(links.select(C("b").alias("of"), C("a").alias("to"), "rank"))
        pick = out.join(ends.filter("not full").select("of"), "of").groupBy("of").agg(F.max(F.struct("rank", "to")).alias("m")).select("of", C("m.to").alias("to"))
        pick = written(pick)
        if pick.isEmpty():
            break
        # Two groups that pick each other share a link; the smaller stays.
        back = pick.select(C("of").alias("to"), C("to").alias("of")).withColumn("_mutual", F.lit(True))
        moves = pick.join(back, ["of", "to"], "left").select(C("of").alias("id"), F.when(C("_mutual") & (C("of") < C("to")), C("of")).otherwise(C("to")).alias("to"))
        every = ends.select(C("of").alias("id")).join(moves, "id", "left").select("id", F.coalesce("to", "id").alias("to"))
        merged = followed(every).select(C("id").alias("of"), C("to").alias("_root"))
        full = ends.filter("full").select(C("of").alias("_root"), F.lit(True).alias("_full"))
        group = written(group.join(merged, "of").join(full, "_root", "left").select("id", C("_root").alias("of"), F.coalesce("_full", F.lit(False)).alias("full")))
        renamed = links.join(merged.select(C("of").alias("a"), C("_root").alias("_a")), "a").join(merged.select(C("of").alias("b"), C("_root").alias("_b")), "b").filter("_a != _b")
        links = written(renamed.groupBy(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).agg(F.max("rank").alias("rank")))
    reached = group.filter("full").select(C("id").alias("_at"), C("of").alias("label"))
    last = placed.join(moved, "basin", "left").withColumn("_at", F.coalesce("to", "basin"))
    return last.join(reached, "_at").select("row", "col", "label")


def allocated(pixels: DataFrame, seeds: DataFrame) -> DataFrame:
    """(row, col, zone) of each pixel: the label of the closest seed pixel (row, col, label), of equally close ones the first by row and column."""
    from verdance.operators.match import closest

    spots = lambda df: df.select(pixel_id(C("row"), C("col")).alias("id"), C("col").cast("double").alias("x"), C("row").cast("double").alias("y"))
    pair = closest(spots(pixels), spots(seeds))
    own = seeds.select(pixel_id(C("row"), C("col")).alias("right_id"), C("label").alias("zone"))
    return pair.join(own, "right_id").join(pixels.select("row", "col", pixel_id(C("row"), C("col")).alias("left_id")), "left_id").select("row", "col", "zone")


def solid(labels: DataFrame, least: float = 200.0, share: float = 0.2, solidity: float = 0.7) -> DataFrame:
    """(label, area, solidity) of objects (row, col, label) that are large enough and fill enough of their convex hull.

    Large enough is ``least`` pixels, and ``share`` of the median object. The hull is that of the corners of an
    object's first and last pixels in each row: what meets in a task is a few corners, not the object.
    """
    from verdance.operators.layout import hulls
    from verdance.operators.ordering import quantiles

    rows = labels.groupBy("label", "row").agg(F.count(F.lit(1)).alias("n"), F.min("col").alias("low"), F.max("col").alias("high"))
    rows = checkpointed(rows)
    areas = checkpointed(rows.groupBy("label").agg(F.sum("n").alias("area")))
    (middle,) = quantiles(areas, "area", (0.5,))
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    corners = F.array(*(point(x, y) for x in (C("low"), C("high") + 1) for y in (C("row"), C("row") + 1)))
    rings = hulls(rows.select("label", F.explode(corners).alias("p")).select("label", "p.x", "p.y").distinct(), "label")
    # Twice the area of a ring, from its first corner, so that far objects lose no digits.
    cross = F.transform(F.sequence(F.lit(1), F.size("ring") - 1), lambda i: (F.get("ring", i - 1).x - F.get("ring", F.lit(0)).x) * (F.get("ring", i).y - F.get("ring", F.lit(0)).y) - (F.get("ring", i).x - F.get("ring", F.lit(0)).x) * (F.get("ring", i - 1).y - F.get("ring", F.lit(0)).y))
    hull = rings.select("label", (F.aggregate(cross, F.lit(0.0), lambda a, x: a + x) / 2).alias("hull"))
    own = areas.join(hull, "label").withColumn("solidity", C("area") / C("hull"))
    return own.filter((C("area") >= max(least, share * (middle or 0.0))) & (C("solidity") >= solidity)).select("label", "area", "solidity")


def instances(mask: DataFrame, apart: int, least: float = 200.0, share: float = 0.2, solidity: float = 0.7, gap: bool = True) -> DataFrame:
    """(row, col, label) of objects of a mask (row, col, inside): distances, peaks, the flood from them, objects that are solid, and lines left free between them."""
    relief = checkpointed(distances(mask))
    labels = checkpointed(watershed(relief, peaks(relief, apart)))
    own = labels.join(solid(labels, least, share, solidity).select("label"), "label").select("row", "col", "label")
    if not gap:
        return own
    # Labels are numbers beyond what a double holds; tiles get their rank among the few that are left.
    from verdance.operators.ordering import numbered

    ranks = checkpointed(numbered(own.select("label").distinct(), ["label"], "rank").select("label", "rank"))
    ranked = own.join(ranks, "label").select("row", "col", C("rank").cast("double").alias("rank"))
    return variety(ranked, "rank").filter("kinds = 1").join(ranks.select(C("rank").cast("double").alias("rank"), "label"), "rank").select("row", "col", "label")
