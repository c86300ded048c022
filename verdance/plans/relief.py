"""Queries over the relief of a mask: distances, peaks, borders, floods, solid objects."""

from __future__ import annotations

from math import cos, radians, sin

from pyspark.sql import functions as F

from verdance.operators import layout, outline, relief, rows
from verdance.plans.registry import Registry, read
from verdance.session import checkpointed

R = Registry()
C = F.col
#: A pixel of the mask has a balance above this.
LEAST = -700


def mask(spark, sf):
    """The image of all customers in key order, and whether a pixel is inside of the mask."""
    cu = read(spark, sf, "customer").select(C("c_custkey").alias("i"), "c_acctbal")
    width = F.broadcast(cu.agg(F.ceil(F.sqrt(F.max("i") + 1)).cast("bigint").alias("w")))
    return cu.join(width).select(F.floor(C("i") / C("w")).cast("bigint").alias("row"), (C("i") % C("w")).alias("col"), (C("c_acctbal") > LEAST).alias("inside"))


MASK = f"""s AS (SELECT CAST(ceil(sqrt(max(c_custkey) + 1)) AS BIGINT) AS w FROM customer),
    m AS (SELECT c_custkey // s.w AS r, c_custkey % s.w AS c, c_acctbal > {LEAST} AS inside FROM customer, s),
    d AS (SELECT a.r, a.c, min((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c)) AS d2 FROM m a LEFT JOIN m b ON NOT b.inside WHERE a.inside GROUP BY ALL)"""
#: Radius of the circle in which a peak is the highest, and its least distance.
RADIUS, DEPTH = 4, 1.5
CRESTS = f"""{MASK}, p AS (SELECT r, c, r * 4294967296 + c AS id FROM d WHERE sqrt(d2) > {DEPTH} AND NOT EXISTS
      (SELECT 1 FROM d o WHERE (o.r - d.r) * (o.r - d.r) + (o.c - d.c) * (o.c - d.c) <= {RADIUS * RADIUS} AND o.d2 > d.d2))"""


@R.add("up_distance", f'WITH {MASK} SELECT r AS "row", c AS col, d2 FROM d')
def up_distance(spark, sf):
    """Squared distance of each pixel of a mask to the background (UP-3, UP-6)."""
    return relief.distances(mask(spark, sf))


@R.add("up_peaks", f'WITH {CRESTS} SELECT r AS "row", c AS col FROM p')
def up_peaks(spark, sf):
    """Pixels with the largest distance in the circle around them (UP-6)."""
    return relief.crests(relief.distances(mask(spark, sf)), RADIUS, DEPTH)


@R.add(
    "up_borders",
    f"""WITH RECURSIVE {CRESTS}, e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND a.id <> b.id),
    w AS (SELECT id, id AS label FROM p UNION SELECT e.b, w.label FROM w JOIN e ON e.a = w.id WHERE w.label < e.b),
    l AS (SELECT id, min(label) AS label FROM w GROUP BY id),
    q AS (SELECT d.r, d.c, min(struct_pack(z := round(sqrt((d.r - p.r) * (d.r - p.r) + (d.c - p.c) * (d.c - p.c)), 6), id := p.id)).id AS id FROM d, p GROUP BY ALL),
    z AS (SELECT r, c, label AS zone FROM q JOIN l USING (id))
    SELECT m.r AS "row", m.c AS col, a.zone, CASE WHEN a.zone IS NULL OR count(DISTINCT b.zone) > 1 THEN 255 ELSE 0 END AS value
    FROM m LEFT JOIN z a ON a.r = m.r AND a.c = m.c LEFT JOIN z b ON abs(b.r - m.r) <= 1 AND abs(b.c - m.c) <= 1 GROUP BY m.r, m.c, a.zone""",
)
def up_borders(spark, sf):
    """Zones grown from the groups of peaks, and an image with background and lines between zones at 255 (UP-6)."""
    image = checkpointed(mask(spark, sf))
    seeds = layout.labelled(relief.crests(relief.distances(image), RADIUS, DEPTH), diagonal=True)
    zones = checkpointed(relief.allocated(image.filter("inside").select("row", "col"), seeds))
    # Tiles hold doubles, which tell rows and columns of 2^26 apart.
    short = F.floor(C("zone") / F.lit(2**32)) * F.lit(2.0**26) + C("zone") % F.lit(2**32)
    kinds = relief.variety(zones.select("row", "col", short.alias("z")), "z").select("row", "col", "kinds")
    out = image.select("row", "col").join(zones, ["row", "col"], "left").join(kinds, ["row", "col"], "left")
    return out.select("row", "col", "zone", F.when(C("zone").isNull() | (C("kinds") > 1), 255).otherwise(0).alias("value"))


@R.add("up_watershed")
def up_watershed(spark, sf):
    """Objects of a mask split by a flood from peaks at a least distance, kept if large and solid enough, with free lines between (UP-3)."""
    return relief.instances(mask(spark, sf), 3, least=4, share=0.2)


@R.add("dt_watershed_sweep")
def dt_watershed_sweep(spark, sf):
    """Peaks, objects, objects kept and their pixels, by the least distance of peaks (DT-4)."""
    own = checkpointed(relief.distances(mask(spark, sf)))
    out = None
    for apart in (1, 2, 3, 5, 8):
        found = checkpointed(relief.peaks(own, apart))
        labels = checkpointed(relief.watershed(own, found))
        kept = relief.solid(labels, 4, 0.2)
        row = kept.agg(F.count(F.lit(1)).alias("kept"), F.coalesce(F.sum("area"), F.lit(0)).alias("pixels"))
        row = row.crossJoin(found.agg(F.count(F.lit(1)).alias("peaks"))).crossJoin(labels.agg(F.count_distinct("label").alias("objects")))
        row = row.select(F.lit(apart).alias("apart"), "peaks", "objects", "kept", "pixels")
        out = row if out is None else out.unionByName(row)
    return out


@R.add(
    "flt_solidity",
    """WITH RECURSIVE s AS (SELECT CAST(ceil(sqrt(max(c_custkey) + 1)) AS BIGINT) AS w FROM customer),
    k AS (SELECT c_custkey // s.w AS r, c_custkey % s.w AS c, (c_custkey // s.w) * 4294967296 + c_custkey % s.w AS id FROM customer, s WHERE c_acctbal > 4500),
    e AS (SELECT a.id AS a, b.id AS b FROM k a JOIN k b ON (b.r = a.r AND abs(a.c - b.c) = 1) OR (b.c = a.c AND abs(a.r - b.r) = 1)),
    w AS (SELECT id, id AS label FROM k UNION SELECT e.b, w.label FROM w JOIN e ON e.a = w.id WHERE w.label < e.b),
    l AS (SELECT k.r, k.c, min(w.label) AS label FROM w JOIN k USING (id) GROUP BY ALL),
    o AS (SELECT label, count(*) AS area FROM l GROUP BY label), g AS (SELECT label, r, min(c) AS lo, max(c) + 1 AS hi FROM l GROUP BY ALL),
    p AS (SELECT DISTINCT label, x, y FROM (SELECT label, unnest([lo, hi, lo, hi]) AS x, unnest([r, r, r + 1, r + 1]) AS y FROM g)),
    v AS (SELECT a.label, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM p a JOIN p b ON a.label = b.label AND (a.x <> b.x OR a.y <> b.y)),
    bad AS (SELECT DISTINCT v.* FROM v JOIN p c ON c.label = v.label WHERE (bx - ax) * (c.y - ay) - (by_ - ay) * (c.x - ax) < 0
      OR ((bx - ax) * (c.y - ay) - (by_ - ay) * (c.x - ax) = 0 AND ((c.x - ax) * (bx - ax) + (c.y - ay) * (by_ - ay) < 0 OR (c.x - bx) * (bx - ax) + (c.y - by_) * (by_ - ay) > 0))),
    h AS (SELECT label, sum(ax * by_ - bx * ay) / 2 AS hull FROM (SELECT * FROM v EXCEPT SELECT * FROM bad) GROUP BY label),
    f AS (SELECT greatest(3, 0.2 * median(area)) AS least FROM o)
    SELECT label AS id, area, round(area / hull, 6) AS solidity FROM o JOIN h USING (label), f WHERE area >= least AND area / hull >= 0.7""",
)
def flt_solidity(spark, sf):
    """Objects that are large enough (a floor and a share of the median) and fill 0.7 of their convex hull (FLT-14)."""
    cu = read(spark, sf, "customer").select(C("c_custkey").alias("i"), "c_acctbal")
    width = F.broadcast(cu.agg(F.ceil(F.sqrt(F.max("i") + 1)).cast("bigint").alias("w")))
    own = cu.join(width).filter("c_acctbal > 4500").select(F.floor(C("i") / C("w")).cast("bigint").alias("row"), (C("i") % C("w")).alias("col"))
    labels = checkpointed(layout.labelled(own))
    return relief.solid(labels, 3.0, 0.2, 0.7).select(C("label").alias("id"), "area", F.round("solidity", 6).alias("solidity"))


def objects(spark, sf):
    """Connected objects of an image of all customers; a pixel of one has a balance above 4500."""
    cu = read(spark, sf, "customer").select(C("c_custkey").alias("i"), "c_acctbal")
    width = F.broadcast(cu.agg(F.ceil(F.sqrt(F.max("i") + 1)).cast("bigint").alias("w")))
    own = cu.join(width).filter("c_acctbal > 4500").select(F.floor(C("i") / C("w")).cast("bigint").alias("row"), (C("i") % C("w")).alias("col"))
    return checkpointed(layout.labelled(own))


def _edges_sql() -> str:
    """Edges of the objects' outlines, by side, each with what follows it."""
    has = lambda i, j: f"bool_or(b.r = a.r + {i} AND b.c = a.c + {j}) AS h{i + 1}{j + 1}"
    around = ", ".join(has(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1))
    ident = lambda i, j, side: f"((r + {i}) * 4294967296 + c + {j}) * 4 + {side}"
    parts = []
    for side in range(4):
        (br, bc), (ar, ac), (sr, sc) = outline.BEYOND[side], outline.AHEAD[side], outline.START[side]
        ahead, corner = f"h{ar + 1}{ac + 1}", f"h{ar + br + 1}{ac + bc + 1}"
        follows = f"CASE WHEN NOT {ahead} THEN {ident(0, 0, (side + 1) % 4)} WHEN NOT {corner} THEN {ident(ar, ac, side)} ELSE {ident(ar + br, ac + bc, (side + 3) % 4)} END"
        parts.append(f"SELECT label, {ident(0, 0, side)} AS id, {follows} AS next, c + {sc} AS x, r + {sr} AS y, {side} AS side FROM n WHERE NOT h{br + 1}{bc + 1}")
    return f"n AS (SELECT a.r, a.c, a.label, {around} FROM l a JOIN l b ON b.label = a.label AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY ALL), g AS ({' UNION ALL '.join(parts)})"


OBJECTS = """s AS (SELECT CAST(ceil(sqrt(max(c_custkey) + 1)) AS BIGINT) AS w FROM customer),
    k AS (SELECT c_custkey // s.w AS r, c_custkey % s.w AS c, (c_custkey // s.w) * 4294967296 + c_custkey % s.w AS id FROM customer, s WHERE c_acctbal > 4500),
    e AS (SELECT a.id AS a, b.id AS b FROM k a JOIN k b ON (b.r = a.r AND abs(a.c - b.c) = 1) OR (b.c = a.c AND abs(a.r - b.r) = 1)),
    w AS (SELECT id, id AS label FROM k UNION SELECT e.b, w.label FROM w JOIN e ON e.a = w.id WHERE w.label < e.b),
    l AS (SELECT k.r, k.c, min(w.label) AS label FROM w JOIN k USING (id) GROUP BY ALL)"""


@R.add(
    "up_outlines",
    f"""WITH RECURSIVE {OBJECTS}, {_edges_sql()}, q AS (SELECT id, id AS ring FROM g UNION SELECT g.next, q.ring FROM q JOIN g ON g.id = q.id WHERE q.ring < g.next),
    o AS (SELECT id, min(ring) AS ring FROM q GROUP BY id)
    SELECT g.label, o.ring, count(*) AS length, count(*) FILTER (WHERE g.side <> f.side) AS corners, CAST(sum(g.x * f.y - f.x * g.y) / 2 AS DOUBLE) AS area
    FROM g JOIN o ON o.id = g.id JOIN g f ON f.id = g.next GROUP BY ALL""",
)
def up_outlines(spark, sf):
    """Length, corners and signed area of the rings around objects and their holes (UP-16, SNK-6)."""
    rings = checkpointed(outline.outlines(objects(spark, sf)))
    sizes = rings.groupBy("label", "ring").agg(F.max("length").alias("length"))
    return sizes.join(outline.ring_areas(rings).hint("merge"), "ring").select("label", "ring", "length", "corners", "area")


@R.add("up_polygons")
def up_polygons(spark, sf):
    """Outer rings as polygons that leave out corners within 1 % of the ring's length: one text an object, as in a polygon file (UP-16, SNK-6)."""
    rings = checkpointed(outline.outlines(objects(spark, sf)))
    outer = rings.join(outline.ring_areas(rings).filter("area > 0").select("ring").hint("merge"), "ring")
    own = outline.simplified(outer).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("k", "x", "y"))).alias("p"))
    text = F.array_join(F.transform("p", lambda p: F.concat(p["x"].cast("bigint").cast("string"), F.lit(" "), p["y"].cast("bigint").cast("string"))), ", ")
    return own.select("label", F.size("p").alias("corners"), text.alias("polygon"))


#: Rows of three discs each that run together, with holes, from orders in key order; the least size of an object.
DISCS = "(col % 11 - 5) * (col % 11 - 5) + (r % 17 - 8) * (r % 17 - 8) <= 36 AND (col // 11 + 2 * (r // 17)) % 4 <> 3 AND CAST(round(o_totalprice * 100) AS BIGINT) % 97 <> 0"
LEAST_DISC = 40


def _labels(name: str, of: str) -> str:
    """CTEs of the connected components of the pixels ``of`` that have enough pixels."""
    return f"""{name}_k AS (SELECT r, col, r * 4294967296 + col AS id FROM {of}),
    {name}_e AS (SELECT a.id AS a, b.id AS b FROM {name}_k a JOIN {name}_k b ON (b.r = a.r AND abs(a.col - b.col) = 1) OR (b.col = a.col AND abs(a.r - b.r) = 1)),
    {name}_w AS (SELECT id, id AS label FROM {name}_k UNION SELECT e.b, w.label FROM {name}_w w JOIN {name}_e e ON e.a = w.id WHERE w.label < e.b),
    {name}_l AS (SELECT id, min(label) AS label FROM {name}_w GROUP BY id),
    {name} AS (SELECT r, col, label FROM {name}_l JOIN {name}_k USING (id) QUALIFY count(*) OVER (PARTITION BY label) >= {LEAST_DISC})"""


@R.add(
    "up_row_splits",
    f"""WITH RECURSIVE s AS (SELECT CAST(ceil(sqrt(max(o_orderkey) + 1)) AS BIGINT) AS w FROM orders), g AS (SELECT o_orderkey // w AS r, o_orderkey % w AS col, o_totalprice FROM orders, s),
    px AS (SELECT DISTINCT r, col FROM g WHERE {DISCS}), {_labels("f", "px")},
    z AS (SELECT label, avg(r) AS y, avg(col) AS x FROM f GROUP BY label), ray(deg, co, si) AS (VALUES {", ".join(f"({d}, {cos(radians(d))!r}::DOUBLE, {sin(radians(d))!r}::DOUBLE)" for d in range(0, 180, 15))}),
    c AS (SELECT f.*, deg, co, si, y, x, unnest(range(CAST(floor((col - x) * co + (r - y) * si) AS BIGINT) - 1, CAST(floor((col - x) * co + (r - y) * si) AS BIGINT) + 3)) AS n FROM f JOIN z USING (label), ray),
    h AS (SELECT label, deg, n, row_number() OVER (PARTITION BY label, deg ORDER BY n) - 1 AS i FROM c WHERE n >= 0 AND round_even(x + n * co, 0) = col AND round_even(y + n * si, 0) = r),
    u AS (SELECT label, deg, count(*) FILTER (h.n = h.i) AS radius FROM z CROSS JOIN ray LEFT JOIN h USING (label, deg) GROUP BY ALL),
    b AS (SELECT label, (quantile_cont(radius, 0.35) + quantile_cont(radius, 0.65)) / 2 AS base FROM u GROUP BY label),
    j AS (SELECT deg // 5 * 5 AS deg, count(*) AS n FROM u JOIN b USING (label) WHERE radius > 1.45 * base GROUP BY 1),
    fr AS (SELECT (SELECT greatest(1.0::DOUBLE, coalesce(median(base), 3.0)) FROM b) AS size, CASE WHEN (SELECT sum(n) FROM j) >= 3 THEN (SELECT deg FROM j ORDER BY n DESC, deg LIMIT 1) + 2.5::DOUBLE ELSE 0.0 END AS angle),
    ax AS (SELECT size, i AS turn, radians((angle + 90 * i) % 180) AS a FROM fr, range(2) t(i)),
    p AS (SELECT f.*, turn, size, col * cos(a) + r * sin(a) AS t, r * cos(a) - col * sin(a) AS s FROM f, ax),
    sp AS (SELECT turn, label, min(t) AS t0, max(t) - min(t) AS long, max(s) - min(s) + 1e-6 AS wide, round_even((max(t) - min(t)) / greatest(2 * any_value(size) * 0.98, 1.0), 0) AS fit FROM p GROUP BY ALL),
    o AS (SELECT *, CAST(least(greatest(round_even(long, 0), 48), 256) AS BIGINT) AS bins FROM sp WHERE fit >= 2 AND long / wide >= 1.2),
    q AS (SELECT turn, label, least(CAST(floor((t - t0) / (long + 1e-6) * bins) AS BIGINT), bins - 1) AS bin, count(*) AS n FROM p JOIN o USING (turn, label) GROUP BY ALL),
    v AS (SELECT turn, label, bins, fit, greatest(1.0::DOUBLE, 0.02 * bins) AS sigma, unnest(range(bins)) AS bin FROM o),
    k AS (SELECT *, unnest(range(-CAST(floor(4 * sigma + 0.5) AS BIGINT), CAST(floor(4 * sigma + 0.5) AS BIGINT) + 1)) AS d FROM v),
    m AS (SELECT k.turn, k.label, k.bin, any_value(fit) AS fit, round(sum(exp(-0.5 * d * d / (sigma * sigma)) * coalesce(q.n, 0)) / sum(exp(-0.5 * d * d / (sigma * sigma))), 9) AS y
      FROM k LEFT JOIN q ON q.turn = k.turn AND q.label = k.label AND q.bin = least(greatest(k.bin + d, 0), bins - 1) GROUP BY k.turn, k.label, k.bin),
    va AS (SELECT *, coalesce(y < lag(y) OVER w, true) AND coalesce(y < lead(y) OVER w, true) AS valley FROM m WINDOW w AS (PARTITION BY turn, label ORDER BY bin)),
    de AS (SELECT *, row_number() OVER (PARTITION BY turn, label ORDER BY y, bin) AS i FROM va WHERE valley),
    cu AS (SELECT turn, label, t0 + (bin + 0.5) * (long / bins) AS bound, greatest(1.0::DOUBLE, 0.1 * wide) AS half FROM de JOIN o USING (turn, label) WHERE i <= de.fit - 1),
    re AS (SELECT r, col FROM f EXCEPT SELECT r, col FROM p JOIN cu USING (turn, label) WHERE abs(t - bound) <= half), {_labels("n", "re")}
    SELECT r AS "row", col, label FROM n""",
)
def up_row_splits(spark, sf):
    """Objects that run together along rows, cut at the valleys of their width (UP-14)."""
    own = read(spark, sf, "orders").select(C("o_orderkey").alias("i"), "o_totalprice")
    width = F.broadcast(own.agg(F.ceil(F.sqrt(F.max("i") + 1)).cast("bigint").alias("w")))
    g = own.join(width).select(F.floor(C("i") / C("w")).cast("bigint").alias("row"), (C("i") % C("w")).alias("col"), F.round(C("o_totalprice") * 100).cast("long").alias("cents"))
    disc = (C("col") % 11 - 5) * (C("col") % 11 - 5) + (C("row") % 17 - 8) * (C("row") % 17 - 8) <= 36
    there = (F.floor(C("col") / 11) + 2 * F.floor(C("row") / 17)) % 4 != 3
    return rows.split(g.filter(disc & there & (C("cents") % 97 != 0)), LEAST_DISC, opening=False)
