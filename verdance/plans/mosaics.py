"""Queries over images and polygons of one map: footprints, boundary, seamlines, blend, clips."""

from __future__ import annotations

from math import cos, pi, sin

from pyspark.sql import functions as F

from verdance.operators import clip, mosaic
from verdance.plans.registry import Registry, read, rounded

R = Registry()
C = F.col
#: Images are squares of SIDE pixels, one every STEP pixels; so a pixel is in up to four of them.
SIDE, STEP, BLEND = 20, 15, 10


def frames(spark, sf):
    """Pixels of all customers in key order, in the images that cover them; each image has a brightness of its own."""
    cu = read(spark, sf, "customer").select(C("c_custkey").alias("i"), "c_acctbal")
    width = F.broadcast(cu.agg(F.ceil(F.sqrt(F.max("i") + 1)).cast("bigint").alias("w")))
    own = cu.join(width).select(F.floor(C("i") / C("w")).cast("bigint").alias("row"), (C("i") % C("w")).alias("col"), "c_acctbal")
    over = lambda c: F.filter(F.array(F.floor(C(c) / STEP), F.floor(C(c) / STEP) - 1), lambda k: (k >= 0) & (C(c) - k * STEP < SIDE))
    own = own.withColumn("a", F.explode(over("row"))).withColumn("b", F.explode(over("col")))
    image = (C("a") * 1_000_000 + C("b")).alias("image")
    return own.select(image, "row", "col", (C("c_acctbal") + C("a") * 10 - C("b") * 7).alias("value"))


FRAMES = f"""s AS (SELECT CAST(ceil(sqrt(max(c_custkey) + 1)) AS BIGINT) AS w FROM customer), p AS (SELECT c_custkey // w AS r, c_custkey % w AS c, c_acctbal AS v FROM customer, s),
    k AS (SELECT unnest([0, 1]) AS d), fr AS (SELECT (r // {STEP} - x.d) * 1000000 + (c // {STEP} - y.d) AS image, r, c, v + (r // {STEP} - x.d) * 10 - (c // {STEP} - y.d) * 7 AS value FROM p, k x, k y
      WHERE r // {STEP} - x.d >= 0 AND c // {STEP} - y.d >= 0 AND r - (r // {STEP} - x.d) * {STEP} < {SIDE} AND c - (c // {STEP} - y.d) * {STEP} < {SIDE}),
    fp AS (SELECT image, min(r) AS top, min(c) AS "left", max(r) AS bottom, max(c) AS "right", (min(r) + max(r)) / 2 AS centre_row, (min(c) + max(c)) / 2 AS centre_col, count(*) AS pixels FROM fr GROUP BY image),
    zn AS (SELECT r, c, min(struct_pack(d := pow(r - centre_row, 2) + pow(c - centre_col, 2), i := image)).i AS image FROM fr JOIN fp USING (image) GROUP BY r, c)"""


@R.add("up_footprints", f"WITH {FRAMES} SELECT * FROM fp")
def up_footprints(spark, sf):
    """Footprints of overlapping images (UP-10)."""
    return mosaic.footprints(frames(spark, sf))


@R.add("up_seamlines", f'WITH {FRAMES} SELECT r AS "row", c AS col, image FROM zn')
def up_seamlines(spark, sf):
    """The image of each pixel of a mosaic: that with the closest centre (UP-10)."""
    return mosaic.seamlines(frames(spark, sf))


@R.add(
    "up_boundary",
    f"""WITH {FRAMES} SELECT r AS "row", c AS col FROM zn z WHERE (SELECT count(*) FROM zn o WHERE (o.r = z.r AND abs(o.c - z.c) = 1) OR (o.c = z.c AND abs(o.r - z.r) = 1)) < 4""",
)
def up_boundary(spark, sf):
    """Pixels at the rim of a mosaic (UP-10)."""
    return mosaic.boundary(mosaic.seamlines(frames(spark, sf)))


@R.add(
    "up_mosaic",
    f"""WITH {FRAMES}, q AS (SELECT z.r, z.c, z.image, min(struct_pack(d := (o.r - z.r) * (o.r - z.r) + (o.c - z.c) * (o.c - z.c), i := o.image)) AS m
      FROM zn z LEFT JOIN zn o ON o.image <> z.image AND (o.r - z.r) * (o.r - z.r) + (o.c - z.c) * (o.c - z.c) <= {(BLEND // 2) ** 2} GROUP BY ALL),
    j AS (SELECT q.r, q.c, q.image, m.i AS other, a.value AS a, b.value AS b, CASE WHEN b.value IS NULL THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 0.5::DOUBLE + (sqrt(m.d) - 0.5::DOUBLE) / {BLEND}) END AS w
      FROM q JOIN fr a ON a.image = q.image AND a.r = q.r AND a.c = q.c LEFT JOIN fr b ON b.image = m.i AND b.r = q.r AND b.c = q.c)
    SELECT r AS "row", c AS col, image, CASE WHEN w < 1 THEN other END AS other, round(w, 6) AS weight, round(w * a + (1 - w) * coalesce(b, 0), 4) AS value FROM j""",
)
def up_mosaic(spark, sf):
    """A mosaic of overlapping images, blended across its seams (UP-10)."""
    out = mosaic.blended(frames(spark, sf), BLEND)
    return rounded(out.withColumn("value", F.round("value", 4)))


#: Corners of a star, around its centre.
STAR = [(round((9.0 if i % 2 == 0 else 3.5) * cos(2 * pi * i / 11 + 0.2), 3), round((9.0 if i % 2 == 0 else 3.5) * sin(2 * pi * i / 11 + 0.2), 3)) for i in range(11)]


def stars(spark, sf):
    """A star-shaped polygon around a place of each supplier; the map is as wide as that of the customers."""
    width = F.broadcast(read(spark, sf, "customer").agg(F.ceil(F.sqrt(F.max("c_custkey") + 1)).cast("bigint").alias("w")))
    corners = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(x).alias("dx"), F.lit(y).alias("dy")) for i, (x, y) in enumerate(STAR)))
    k = C("s_suppkey")
    own = read(spark, sf, "supplier").join(width).select(k.alias("id"), (k * 7 % C("w")).alias("cx"), (k * 13 % C("w")).alias("cy"), F.inline(corners))
    return own.select("id", "i", (C("cx") + C("dx")).alias("x"), (C("cy") + C("dy")).alias("y"))


STARS = f"""k(i, dx, dy) AS (VALUES {", ".join(f"({i}, {x!r}::DOUBLE, {y!r}::DOUBLE)" for i, (x, y) in enumerate(STAR))}),
    v AS (SELECT s_suppkey AS id, i, s_suppkey * 7 % w + dx AS x, s_suppkey * 13 % w + dy AS y FROM supplier, s, k),
    e AS (SELECT a.id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM v a JOIN v b ON a.id = b.id AND b.i = (a.i + 1) % {len(STAR)})"""


@R.add(
    "src_clip",
    f"""WITH s AS (SELECT CAST(ceil(sqrt(max(c_custkey) + 1)) AS BIGINT) AS w FROM customer), p AS (SELECT c_custkey // w AS r, c_custkey % w AS c, c_acctbal AS v FROM customer, s), {STARS},
    a AS (SELECT e.id, r, c, v,
      CASE WHEN y1 <> y2 AND r + 0.5::DOUBLE >= least(y1, y2) AND r + 0.5::DOUBLE < greatest(y1, y2) AND round(x1 + (r + 0.5::DOUBLE - y1) * (x2 - x1) / (y2 - y1), 9) <= c + 0.5::DOUBLE THEN 1 ELSE 0 END AS crossed,
      r BETWEEN floor(least(y1, y2)) AND floor(greatest(y1, y2)) AS meets,
      CASE WHEN y1 = y2 THEN x1 ELSE round(x1 + (greatest(least(y1, y2), r::DOUBLE) - y1) * (x2 - x1) / (y2 - y1), 9) END AS xa,
      CASE WHEN y1 = y2 THEN x2 ELSE round(x1 + (least(greatest(y1, y2), r + 1.0::DOUBLE) - y1) * (x2 - x1) / (y2 - y1), 9) END AS xb FROM p, e),
    i AS (SELECT id, r, c, v, sum(crossed) % 2 = 1 AS inside, bool_or(meets AND c BETWEEN floor(least(xa, xb)) AND floor(greatest(xa, xb))) AS touched FROM a GROUP BY ALL)
    SELECT id, count(*) AS pixels, count(*) FILTER (WHERE inside) AS centres, round(sum(v), 2) AS total FROM i WHERE inside OR touched GROUP BY id""",
)
def src_clip(spark, sf):
    """Pixels of the customers' image clipped to polygons, with all that an edge touches (SRC-12): pixels, those with their centre inside, sum."""
    cu = read(spark, sf, "customer").select(C("c_custkey").alias("k"), "c_acctbal")
    width = F.broadcast(cu.agg(F.ceil(F.sqrt(F.max("k") + 1)).cast("bigint").alias("w")))
    own = cu.join(width).select(F.floor(C("k") / C("w")).cast("bigint").alias("row"), (C("k") % C("w")).alias("col"), C("c_acctbal").alias("v"))
    corners = stars(spark, sf)
    every = clip.clipped(own, corners).groupBy("id").agg(F.count(F.lit(1)).alias("pixels"), F.round(F.sum("v"), 2).alias("total"))
    inner = clip.clipped(own, corners, all_touched=False).groupBy("id").agg(F.count(F.lit(1)).alias("centres"))
    return every.join(inner, "id", "left").select("id", "pixels", F.coalesce("centres", F.lit(0)).alias("centres"), "total")
