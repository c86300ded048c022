"""Clock calibration of a camera against a position log: flights are dealt into cells of time, and a task tries all offsets of its cells in arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdance.operators.ordering import beside
from verdance.session import written

C = F.col
#: Microseconds of a cell, at least; rows, and cells with photos, that share a task on average.
WIDE, ROWS, CELLS = 900_000_000, 100_000, 2_000
#: What a dealt row is.
FIX, PHOTO, TRIGGER = 0, 1, 2


def _more(a: np.ndarray, b: np.ndarray | float) -> np.ndarray:
    """a > b, where NaN is the largest value, as in Spark."""
    return (a > b) | (np.isnan(a) & ~np.isnan(b))


class Cells:
    """How photos, fixes and triggers of a flight meet in cells of ``wide`` microseconds of the photo clock.

    A photo is in one cell. A fix is copied to the cells of all photos that an offset from ``low`` to ``high`` brings within
    ``gap`` of it: farther ones are not placed by it. A trigger is copied to the cells of all photos that can be the closest one for some offset.
    """

    def __init__(self, low: int, high: int, gap: int) -> None:
        self.low, self.high, self.gap, self.wide = low, high, gap, max(WIDE, high - low + 2 * gap)

    def of(self, at: Column) -> Column:
        return F.call_function("div", at - F.pmod(at, F.lit(self.wide)), F.lit(self.wide))

    def fixes(self, fixes: DataFrame) -> DataFrame:
        cells = F.sequence(self.of(C("at") - (self.high + self.gap)), self.of(C("at") - (self.low - self.gap)))
        return fixes.withColumns({"cell": F.explode(cells), "_side": F.lit(FIX)})

    def marked(self, shots: DataFrame, marks: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
        """``shots`` with the instants ``prev`` and ``next`` to them in their flight, and ``marks`` by cell."""
        photos = shots.withColumns({"cell": self.of(C("at")), "_v": C("at"), "_side": F.lit(PHOTO)})
        ends = F.array(F.struct((C("at") - self.high).alias("q"), F.lit(True).alias("early")), F.struct((C("at") - self.low).alias("q"), F.lit(False).alias("early")))
        probes = marks.withColumn("_e", F.explode(ends)).select(by, C("at").alias("t"), "x", "y", "m", C("_e.q").alias("at"), C("_e.early").alias("early"), F.lit(TRIGGER).alias("_side"))
        line = written(beside(photos.unionByName(probes, allowMissingColumns=True), [by], ["at", "_side"], "_v"))
        near = F.sequence(self.of(C("t") - self.high), self.of(C("t") - self.low))
        # The photo in front of the first time asked for and the one behind the last; cells between are the same from both ends.
        front, behind = (F.array_compact(F.array(self.of(C(c)))) for c in ("_p", "_n"))
        cells = F.when(C("early"), F.array_union(near, front)).otherwise(F.array_except(behind, near))
        asked = line.filter(C("_side") == TRIGGER).select(by, C("t").alias("at"), "x", "y", "m", F.explode(cells).alias("cell"), "_side")
        return line.filter(C("_side") == PHOTO).select(*photos.drop("_v").columns, C("_p").alias("prev"), C("_n").alias("next")), asked


#: Sums of a cell and offset: placed photos; triggers with a placed photo and their metres, or flown photos; pairs of flown photos, their mean speed and step,
#: and the sums of squares and products around these; the first and the last flown photo.
SUMS = ("n", "m", "e", "k", "v", "d", "vv", "dd", "vd")
ENDS = ("fx", "fy", "fs", "lx", "ly", "ls")


def _scores(by: str, cells: Cells, steps: list[int], climb: float, moving: float):
    """A function that turns a bucket of dealt rows into a row of sums a cell with photos and offset (centre of its flight + step)."""

    def tried(t: pa.Table) -> pa.Table:
        names = t.column(by).combine_chunks().dictionary_encode()
        names = pa.concat_arrays(names.chunks) if isinstance(names, pa.ChunkedArray) else names
        flight, cell, at, side = (np.asarray(c, np.int64) for c in (names.indices, *(t.column(c).to_numpy() for c in ("cell", "at", "_side"))))
        first, reach = cell.min(), cell.max() - cell.min() + 1
        code = np.unique(flight * reach + cell - first, return_inverse=True)[1].astype(np.int64)
        rel = at - cell * cells.wide
        # Times of all cells on one line, cells apart.
        room = cells.wide + cells.high - cells.low + 2 * cells.gap + 2
        shift = cells.gap - cells.low

        def rows(which: int, columns: tuple[str, ...]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
            own = np.flatnonzero(side == which)
            own = own[np.argsort(code[own] * room + rel[own], kind="stable")]
            took = t.select(columns).take(pa.array(own))
            # Instants stay whole numbers where some are null.
            whole = lambda c: c.fill_null(0) if pa.types.is_integer(c.type) else c
            return own, {c: whole(took.column(c)).to_numpy() for c in columns} | {f"no_{c}": took.column(c).is_null().to_numpy() for c in columns}

        own, fix = rows(FIX, ("x", "y", "alt", "speed"))
        # A last row that stands for no fix.
        fk, fc = np.append(code[own] * room + rel[own] + shift, np.iinfo(np.int64).max), np.append(code[own], -1)
        fix = {c: np.append(v, v.dtype.type(0)) for c, v in fix.items()}
        own, p = rows(PHOTO, ("m", "prev", "next", "anchored", "ground", "o"))
        pc, pat, prel, pm = code[own], at[own], rel[own], p["m"].astype(float)
        pk = pc * room + prel
        new = np.append(True, pc[1:] != pc[:-1])[: len(pc)]
        slot, heads = np.cumsum(new) - 1, np.flatnonzero(new)
        centre, anchored = p["o"][heads].astype(np.int64), p["anchored"][heads].astype(bool)
        high = p["ground"].astype(float) + climb
        free = ~anchored[slot] & ~p["no_ground"]
        count = len(heads)
        slots = np.full(int(code.max()) + 1, -1, np.int64)
        slots[pc[heads]] = np.arange(count)
        asked, g = rows(TRIGGER, ("x", "y", "m"))
        there = slots[code[asked]] >= 0
        asked, gx, gy, gm = asked[there], g["x"][there], g["y"][there], g["m"][there].astype(float)
        gc, gat, gslot = code[asked], at[asked], slots[code[asked]]
        total = lambda at, w: np.bincount(at, w, minlength=count)

        def one(step: int) -> dict[str, np.ndarray]:
            key = pk + shift + centre[slot] + step
            i = np.searchsorted(fk, key, "right") - 1
            front, behind = fc[i] == pc, fc[i + 1 - len(fk)] == pc
            exact = front & (fk[i] == key)
            span = np.where(front & behind, fk[i + 1 - len(fk)] - fk[i], cells.gap + 1)
            between = ~exact & (span <= cells.gap)
            share = np.where(between, (key - fk[i]) / span, 0.0)
            placed = exact | between
            value = lambda c: np.where(exact, fix[c][i], fix[c][i] + share * (fix[c][i + 1 - len(fk)] - fix[c][i]))
            known = lambda c: ~np.where(exact, fix[f"no_{c}"][i], fix[f"no_{c}"][i] | fix[f"no_{c}"][i + 1 - len(fk)])
            x, y, speed = value("x"), value("y"), value("speed")
            out = {"n": total(slot, pm * placed)}
            # The photo in front of a trigger if it is as close as the one behind that one, else the one behind, each told apart by what is next to it in its flight.
            q = gat - centre[gslot] - step
            j = np.searchsorted(pk, gc * room + np.clip(q - cell[asked] * cells.wide, -1, cells.wide), "right") - 1
            a, b = np.maximum(j, 0), np.minimum(j + 1, len(pk) - 1)
            left = (j >= 0) & (pc[a] == gc) & (p["no_next"][a] | (q - pat[a] <= p["next"][a] - q))
            right = (j + 1 < len(pk)) & (pc[b] == gc) & (p["no_prev"][b] | (pat[b] - q < q - p["prev"][b]))
            near = np.where(left, a, b)
            ok = (left | right) & placed[near]
            out["e"] = total(gslot[ok], gm[ok] * np.hypot(x[near] - gx, y[near] - gy)[ok])
            flown = np.flatnonzero(free & placed & known("alt") & known("speed") & _more(value("alt"), high) & _more(speed, moving))
            s, fx, fy, fs, w = slot[flown], x[flown], y[flown], speed[flown], pm[flown]
            out["m"] = total(gslot[ok], gm[ok]) + total(s, w)
            # Photos that follow each other, and those of one instant.
            same, more = s[1:] == s[:-1], w > 1
            of = np.append(s[1:][same], s[more])
            w = np.append(np.ones(int(same.sum())), w[more] - 1)
            v = np.append(((fs[:-1] + fs[1:]) / 2)[same], fs[more])
            d = np.append(np.hypot(fx[1:] - fx[:-1], fy[1:] - fy[:-1])[same], np.zeros(int(more.sum())))
            k = total(of, w)
            out |= {"k": k, "v": total(of, w * v) / np.maximum(k, 1), "d": total(of, w * d) / np.maximum(k, 1)}
            v, d = v - out["v"][of], d - out["d"][of]
            out |= {"vv": total(of, w * v * v), "dd": total(of, w * d * d), "vd": total(of, w * v * d)}
            lead, last = np.append(True, ~same)[: len(s)], np.append(~same, True)[: len(s)]
            for c, z in zip("xys", (fx, fy, fs), strict=True):
                for end, at_ in (("f", lead), ("l", last)):
                    out[end + c] = np.zeros(count)
                    out[end + c][s[at_]] = z[at_]
            return out | {"o": centre + step}

        made = [one(step) for step in steps] if count else []
        flat = lambda c, kind: np.concatenate([np.zeros(0, kind), *(r[c] for r in made)]).astype(kind)
        every = np.tile(own[heads], len(made))
        held = {by: names.dictionary.take(pa.array(flight[every])), "cell": pa.array(cell[every]), "anchored": pa.array(np.tile(anchored, len(made)).astype(bool)), "o": pa.array(flat("o", np.int64))}
        return pa.table(held | {c: pa.array(flat(c, float)) for c in SUMS + ENDS})

    return tried


def _joined(sums: DataFrame, by: str) -> DataFrame:
    """(by, o, s): the score of each flight and offset; a row of ``sums`` is a cell's.

    Flights of triggers: metres from a trigger to the photo closest in time, null below three placed photos. Others: the negative correlation of a photo pair's
    mean speed and distance, 0 where it is not defined; a pair may lie in two cells.
    """
    front = Window.partitionBy(by, "o").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    flown = ~C("anchored") & (C("m") > 0)
    before = F.last(F.when(flown, F.struct("lx", "ly", "ls")), True).over(front)
    zero = F.lit(0.0)
    pair = F.struct(zero.alias("n"), zero.alias("m"), zero.alias("e"), F.lit(1.0).alias("k"), ((C("_b.ls") + C("fs")) / 2).alias("v"), F.hypot(C("fx") - C("_b.lx"), C("fy") - C("_b.ly")).alias("d"), *(zero.alias(c) for c in ("vv", "dd", "vd")))
    parts = sums.withColumn("_b", before).select(by, "o", "anchored", F.inline(F.array_compact(F.array(F.struct(*SUMS), F.when(flown & C("_b").isNotNull(), pair)))))
    every = Window.partitionBy(by, "o")
    mean = lambda c: F.when(F.sum("k").over(every) > 0, F.sum(C("k") * C(c)).over(every) / F.sum("k").over(every)).otherwise(0.0)
    parts = parts.withColumns({"_v": C("v") - mean("v"), "_d": C("d") - mean("d")})
    around = lambda c, a, b: F.sum(C(c) + C("k") * C(a) * C(b)).alias(c)
    own = parts.groupBy(by, "o", "anchored").agg(*(F.sum(c).alias(c) for c in "nmek"), around("vv", "_v", "_v"), around("dd", "_d", "_d"), around("vd", "_v", "_d"))
    sure = (C("n") >= 5) & (C("m") >= 10) & (F.sqrt(C("vv") / C("k")) >= 1e-6) & (F.sqrt(C("dd") / C("k")) >= 1e-6)
    speed = F.when((C("k") > 0) & sure, -F.nanvl(C("vd") / F.sqrt(C("vv") * C("dd")), zero)).otherwise(0.0)
    return own.select(by, "o", F.when(~C("anchored"), speed).when((C("n") >= 3) & (C("m") > 0), C("e") / C("m")).alias("s"))


def calibrated(photos: DataFrame, log: DataFrame, triggers: DataFrame, by: str, manual: float = 0.0, span: float = 15.0, coarse: float = 0.5, fine_span: float = 2.0, fine: float = 0.05, limit: float = 8.0, gap_s: float = 30.0, climb: float = 50.0, moving: float = 1.5) -> DataFrame:
    """One row a flight with photos: ``offset`` seconds to add to the photo clock, ``score``, ``method`` and ``fell_back``.

    ``photos`` have ``by`` and ``at``, ``triggers`` also ``x y`` and the ``log`` also ``x y alt speed``; times are whole
    microseconds, positions and heights metres. A coarse grid around ``manual`` and a fine one around its best are
    searched; of equal scores the smallest offset counts. Flights of two or more triggers are scored by the metres
    between a trigger and the photo closest in time (the earlier of two), all others by the correlation of speed and
    distance: of pairs that follow each other among the photos taken at more than ``climb`` above the first fix and faster than ``moving``. Only
    the latter fall back to ``manual``, where they end more than ``limit`` seconds from it; so does a
    flight of triggers that no offset can score (``score`` null). Rows without a flight, time or position
    are left out; fixes of one instant count by their mean. A photo lies linearly between two fixes, and nowhere outside of the log or within a gap of more than ``gap_s``.

    Photos are not copied to offsets: flights are dealt into cells of time (``Cells``), of which a task holds some, and only sums by cell and offset leave it. A
    cell has as many rows as there are different instants in its quarter of an hour.
    """
    us = lambda s: round(s * 1e6)
    grids = [[i * us(step) for i in range(-round(reach / step), round(reach / step) + 1)] for reach, step in ((span, coarse), (fine_span, fine))]
    far = sum(grid[-1] for grid in grids)
    cells = Cells(us(manual) - far, us(manual) + far, us(gap_s))
    long = lambda c: C(c).cast("long").alias(c)
    double = lambda c: C(c).cast("double").alias(c)
    fixes = written(log.dropna(subset=[by, "at", "x", "y"]).groupBy(by, long("at")).agg(*(F.avg(c).alias(c) for c in ("x", "y", "alt", "speed"))))
    shots = photos.select(by, long("at")).dropna().groupBy(by, "at").agg(F.count(F.lit(1)).alias("m"))
    marks = triggers.select(by, long("at"), double("x"), double("y")).dropna().groupBy(by, "at", "x", "y").agg(F.count(F.lit(1)).alias("m"))
    ground = fixes.groupBy(by).agg(F.min_by("alt", "at").alias("ground"))
    flights = shots.select(by).distinct().join(marks.groupBy(by).agg(F.sum("m").alias("_t")), by, "left").join(ground, by, "left")
    flights = written(flights.select(by, (F.coalesce("_t", F.lit(0)) >= 2).alias("anchored"), "ground", F.lit(us(manual)).cast("long").alias("o")))
    seen = shots.join(flights.drop("o"), by)
    held, asked = cells.marked(seen.filter("anchored"), marks.join(flights.filter("anchored").select(by), by, "left_semi"), by)
    free = seen.filter("not anchored").withColumns({"cell": cells.of(C("at")), "_side": F.lit(PHOTO), "prev": F.lit(None).cast("long"), "next": F.lit(None).cast("long")})
    taken = written(held.unionByName(free))
    rest = written(cells.fixes(fixes).unionByName(asked, allowMissingColumns=True))
    sizes = taken.agg(F.approx_count_distinct(F.xxhash64(by, "cell")).alias("cells"), F.count(F.lit(1)).alias("n")).first()
    buckets = max(1, -(-(sizes["n"] + rest.count()) // ROWS), -(-sizes["cells"] // CELLS))
    kind = photos.select(by).schema[by].dataType.simpleString()
    schema = f"`{by}` {kind}, cell bigint, anchored boolean, o bigint, " + ", ".join(f"{c} double" for c in SUMS + ENDS)

    def best(centres: DataFrame, steps: list[int]) -> DataFrame:
        dealt = taken.join(centres.select(by, "o"), by).unionByName(rest, allowMissingColumns=True).withColumn("_c", F.pmod(F.xxhash64(by, "cell"), F.lit(buckets)))
        scores = _joined(dealt.groupBy("_c").applyInArrow(_scores(by, cells, steps, climb, moving), schema), by)
        # Nulls are left out; a flight without a score keeps its centre.
        top = scores.withColumn("s", F.round("s", 9) + F.lit(0.0)).filter("s is not null").groupBy(by).agg(F.min(F.struct("s", "o")).alias("m"))
        return written(centres.drop("s").join(top, by, "left").select(by, "anchored", F.coalesce("m.o", "o").alias("o"), C("m.s").alias("s")))

    found = best(best(flights, grids[0]), grids[1])
    far = ~C("anchored") & (F.abs(C("o") - us(manual)) > us(limit))
    return found.select(by, (F.when(far, us(manual)).otherwise(C("o")) / 1e6).alias("offset"), C("s").alias("score"), F.when(C("anchored"), "anchors").otherwise("speed").alias("method"), far.alias("fell_back"))
