"""Outlines of labelled pixels as rings of corners, and rings simplified to polygons.

Pixels are (row, col, label), one label a place; a pixel is the square from (col, row) to (col + 1, row + 1). Each
side of a pixel that borders another label, or nothing, is an edge that runs with its pixel on the right (rows go down). What
follows an edge is known from the pixels around it, so edges are linked by one join. Edges of a tile form chains there; rings that cross tiles
are named and numbered by doubling pointers from chain to chain, in as many rounds as the logarithm of the most chains of a ring. Outer rings run clockwise and
have a positive area, rings of holes a negative one; objects that meet at a corner only are apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdance.operators.relief import pixel_id
from verdance.session import checkpointed, written

C = F.col
#: Sides in the order of the ring: top (to the east), right (south), bottom (west), left (north). Of each: the pixel beyond it, the
#: pixel ahead, and where its edge starts, as steps in rows and columns.
BEYOND = ((-1, 0), (0, 1), (1, 0), (0, -1))
AHEAD = ((0, 1), (1, 0), (0, -1), (-1, 0))
START = ((0, 0), (0, 1), (1, 1), (1, 0))
#: Doublings between two checkpoints. Joins are by merging: a broadcast of one side a round, each small enough, adds up in the driver.
STRIDE = 2
#: Rows and columns of a tile in which edges are chained; corners of the rings that share a task, on average.
SIDE, CORNERS = 256, 100_000


def edge_id(row: Column, col: Column, side: int) -> Column:
    """One number an edge; rows are from -2^29 up to 2^29."""
    return pixel_id(row, col) * 4 + side


def outline_edges(pixels: DataFrame) -> DataFrame:
    """(label, id, next, row, col, side): the edges of all outlines; row and col are where the edge starts."""
    own = pixels.select("row", "col", "label")
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    around = F.array(*(F.struct((C("row") + i).alias("_r"), (C("col") + j).alias("_c"), F.lit(1 << k).alias("_bit")) for k, (i, j) in enumerate(steps)))
    there = own.select(C("row").alias("_r"), C("col").alias("_c"), C("label").alias("_l"))
    met = own.select("*", F.inline(around)).join(there.hint("merge"), ["_r", "_c"]).filter(C("label") == C("_l")).groupBy("row", "col").agg(F.sum("_bit").alias("_bits"))
    bits = own.join(met.hint("merge"), ["row", "col"], "left").withColumn("_bits", F.coalesce("_bits", F.lit(0)))
    has = lambda step: C("_bits").bitwiseAND(1 << steps.index(step)) != 0
    made = []
    for side in range(4):
        (br, bc), (ar, ac), (sr, sc) = BEYOND[side], AHEAD[side], START[side]
        turn = edge_id(C("row"), C("col"), (side + 1) % 4)
        straight = edge_id(C("row") + ar, C("col") + ac, side)
        # The pixel ahead and the one beyond it: the outline turns left, along the latter's side behind.
        left = edge_id(C("row") + ar + br, C("col") + ac + bc, (side + 3) % 4)
        following = F.when(~has((ar, ac)), turn).when(~has((ar + br, ac + bc)), straight).otherwise(left)
        edge = F.struct(edge_id(C("row"), C("col"), side).alias("id"), following.alias("next"), (C("row") + sr).alias("_sr"), (C("col") + sc).alias("_sc"), F.lit(side).alias("side"))
        made.append(F.when(~has((br, bc)), edge))
    return bits.select("label", F.explode(F.array_compact(F.array(*made))).alias("e")).select("label", "e.id", "e.next", C("e._sr").alias("row"), C("e._sc").alias("col"), "e.side")


def _chained(t: pa.Table) -> pa.Table:
    """Edges of a tile by chains that run inside of it: of each edge its chain's first edge and how many come behind it in the chain.

    A ring inside of the tile is a chain from its smallest id on. The first edge of a chain that leaves the tile also tells the edge that follows (``to``), the
    chain's smallest id, how many come behind that one, and how long the chain is.
    """
    t = t.sort_by("id")
    ids, following = t.column("id").to_numpy(), t.column("next").to_numpy()
    n = len(ids)
    every = np.arange(n)
    at = np.minimum(np.searchsorted(ids, following), n - 1)
    step = np.where(ids[at] == following, at, every)
    # Longer and longer stretches ahead; after these rounds one holds its whole ring or ends at its chain's last edge.
    jump, low = step, np.minimum(every, step)
    for _ in range(n.bit_length()):
        low, jump = np.minimum(low, low[jump]), jump[jump]
    closed = step[jump] != jump
    step = np.where(closed & (step == low), every, step)
    jump, left = step, (step != every).astype(np.int64)
    for _ in range(n.bit_length()):
        left, jump = left + left[jump], jump[jump]
    # The chain's first edge is the one with the most behind it.
    order = np.lexsort((-left, jump))
    first = order[np.append(True, jump[order][1:] != jump[order][:-1])]
    head = np.zeros(n, np.int64)
    head[jump[first]] = first
    head = head[jump]
    inner = ~((head == every) & ~closed)
    only = lambda v: pa.array(v, pa.int64(), mask=inner)
    return pa.table({"id": ids, "head": ids[head], "left": left, "closed": closed, "to": only(following[jump]), "low": only(ids[low]), "behind": only(left[low]), "size": only(left + 1)})


def chains(edges: DataFrame) -> DataFrame:
    """(id, head, left, closed, to, low, behind, size): ``edges`` by the chains that they form inside of tiles."""
    pixel = F.shiftright("id", 2)  # row * 2^32 + col, the column being below 2^31 on either side of 0
    row = F.shiftright(pixel + F.lit(2**31), 32)
    tile = lambda c: F.floor(c / SIDE).cast("bigint")
    own = edges.select("id", "next", tile(row).alias("_tr"), tile(pixel - row * F.lit(2**32)).alias("_tc"))
    return own.groupBy("_tr", "_tc").applyInArrow(_chained, "id bigint, head bigint, left bigint, closed boolean, to bigint, low bigint, behind bigint, size bigint")


def ring_names(parts: DataFrame) -> DataFrame:
    """(id, ring): the smallest ``low`` of the ring of each part (id, to, low). Windows along the ring double until all of them hold it."""
    now = parts.select("id", "to", C("low").alias("ring"))
    while True:
        step = now
        for _ in range(STRIDE):
            ahead = step.select(C("id").alias("to"), C("to").alias("_to"), C("ring").alias("_ring"))
            step = step.join(ahead.hint("merge"), "to").select("id", C("_to").alias("to"), F.least("ring", "_ring").alias("ring"), (C("ring") != C("_ring")).alias("_new"))
        step = written(step)
        now = step.select("id", "to", "ring")
        if step.filter("_new").isEmpty():
            return now.select("id", "ring")


def ring_places(edges: DataFrame) -> DataFrame:
    """(id, ring, left): how many edges of its ring come behind each edge, the ring's first being its smallest id.

    Rings inside of a tile are done there. Of others only one row a chain takes part in rounds, in which steps to the ring's last chain double; that is the one in front of
    the chain that holds the smallest id.
    """
    held = written(chains(edges))
    parts = written(held.filter("to is not null").select("id", "to", "low", "behind", "size"))
    named = parts.join(ring_names(parts).hint("merge"), "id")
    named = written(named.join(named.filter("low = ring").select("ring", C("id").alias("first")).hint("merge"), "ring").withColumn("last", C("to") == C("first")))
    now = named.select("id", F.when(C("last"), C("id")).otherwise(C("to")).alias("to"), F.when(C("last"), 0).otherwise(C("size")).cast("bigint").alias("ahead"))
    while True:
        step = now
        for _ in range(STRIDE):
            ahead = step.select(C("id").alias("to"), C("to").alias("_to"), C("ahead").alias("_ahead"))
            step = step.join(ahead.hint("merge"), "to").select("id", C("_to").alias("to"), (C("ahead") + C("_ahead")).alias("ahead"), (C("to") != C("_to")).alias("_moved"))
        step = written(step)
        now = step.select("id", "to", "ahead")
        if step.filter("_moved").isEmpty():
            break
    # ``ahead`` counts from a chain's first edge up to the last chain.
    own = named.join(now.select("id", "ahead").hint("merge"), "id")
    whole = own.groupBy("ring").agg(F.sum("size").alias("total"), F.max(F.when(C("last"), C("size"))).alias("end"), F.max(F.when(C("low") == C("ring"), C("behind") - C("size"))).alias("start"))
    own = own.join(whole.hint("merge"), "ring").select(C("id").alias("head"), "ring", "total", "start", (C("ahead") - C("size") + C("end")).alias("after"))
    placed = held.filter("not closed").select("id", "head", "left").join(own.hint("merge"), "head")
    # Edges behind one before the first chain comes again; those of the smallest id are ``total + start``.
    placed = placed.select("id", "ring", (C("total") - 1 - F.pmod(C("start") - C("after") - C("left"), C("total"))).alias("left"))
    return held.filter("closed").select("id", C("head").alias("ring"), "left").unionByName(placed)


def outlines(pixels: DataFrame) -> DataFrame:
    """(label, ring, k, x, y, length): the corners of each ring in order, k from 0, where edges turn; ``length`` is the ring's."""
    edges = checkpointed(outline_edges(pixels))
    placed = checkpointed(edges.join(ring_places(edges).hint("merge"), "id"))
    sizes = placed.groupBy("ring").agg(F.count(F.lit(1)).alias("length"))
    before = placed.select(C("next").alias("id"), C("side").alias("_side"))
    turns = placed.join(before.hint("merge"), "id").filter(C("side") != C("_side")).join(sizes.hint("merge"), "ring")
    return turns.select("label", "ring", (C("length") - 1 - C("left")).alias("k"), C("col").alias("x"), C("row").alias("y"), "length")


def ring_areas(corners: DataFrame) -> DataFrame:
    """(ring, area, corners) of rings (ring, k, x, y): positive for outer rings."""
    line = Window.partitionBy("ring").orderBy("k")
    first = lambda c: F.first(c).over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    x, y = F.coalesce(F.lead("x").over(line), first("x")), F.coalesce(F.lead("y").over(line), first("y"))
    sides = corners.select("ring", ((C("x") * y - x * C("y")) / 2).alias("_a"))
    return sides.groupBy("ring").agg(F.sum("_a").alias("area"), F.count(F.lit(1)).alias("corners"))


def _peucker(t: pa.Table) -> pa.Table:
    """The corners that ``simplified`` keeps of whole rings: all stretches of all rings at once, a level of them after another."""
    t = t.sort_by([("ring", "ascending"), ("k", "ascending")])
    ring, x, y, limit = (t.column(c).to_numpy() for c in ("ring", "x", "y", "limit"))
    n = len(ring)
    every = np.arange(n)
    new = np.append(True, ring[1:] != ring[:-1])
    start = np.flatnonzero(new)
    of = np.cumsum(new) - 1
    highest = lambda value, heads, group: np.flatnonzero(value == np.maximum.reduceat(value, heads)[group])
    one = lambda top, group: top[np.append(True, group[top][1:] != group[top][:-1])]  # the first of a group
    kept = new.copy()
    kept[one(highest(np.round((x - x[start][of]) ** 2 + (y - y[start][of]) ** 2, 9), start, of), of)] = True
    while True:
        heads = np.flatnonzero(kept)
        group = np.cumsum(kept) - 1
        # A stretch ends at the next kept corner of its ring, or where the ring began.
        ends = np.append(heads[1:], 0)
        ends = np.where(np.append(new[heads[1:]], True), start[of[heads]], ends)
        a, b = heads[group], ends[group]
        dx, dy, px, py = x[b] - x[a], y[b] - y[a], x - x[a], y - y[a]
        span = np.hypot(dx, dy)
        off = np.round(np.where(span > 0, np.abs(dx * py - dy * px) / np.where(span > 0, span, 1.0), np.hypot(px, py)), 9)
        off[every == a] = 0.0
        top = one(highest(off, heads, group), group)
        top = top[(off[top] > limit[top]) & ~kept[top]]
        if not len(top):
            return t.take(pa.array(heads)).select(["label", "ring", "k", "x", "y"])
        kept[top] = True


def simplified(corners: DataFrame, share: float = 0.01) -> DataFrame:
    """(label, ring, k, x, y): rings (label, ring, k, x, y, length) with corners left out, none of them farther than ``share`` of its length from what stays.

    From the first corner and the one farthest from it on, each stretch between two kept corners keeps its farthest one (the first of equally far), as long
    as that is too far from the line between them. A task holds whole rings, about ``CORNERS`` corners of them.
    """
    own = written(corners.select("label", "ring", C("k").cast("bigint").alias("k"), C("x").cast("double").alias("x"), C("y").cast("double").alias("y"), (C("length") * share).cast("double").alias("limit")))
    buckets = max(1, -(-own.count() // CORNERS))
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    dealt = own.withColumn("_c", F.pmod(F.xxhash64("ring"), F.lit(buckets)))
    return dealt.groupBy("_c").applyInArrow(_peucker, ", ".join(f"{c} {kinds[c]}" for c in ("label", "ring", "k", "x", "y")))
