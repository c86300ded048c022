"""Queries over points, pixels and texts: hulls, thinning, labels, grids, calibration, lint."""

from __future__ import annotations

from math import cos, pi, sin

from pyspark.sql import functions as F

from verdance.operators import calibrate, layout, match, register
from verdance.operators.timeseries import gaussian_kernel
from verdance.plans.pixels import UTM, utm
from verdance.plans.registry import SPOTS, Registry, read, rounded, spots

R = Registry()
C = F.col


@R.add(
    "agg_hull",
    f"""WITH {SPOTS}, p AS (SELECT DISTINCT nation, x, y FROM cu),
    e AS (SELECT a.nation, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM p a JOIN p b ON a.nation = b.nation AND (a.x <> b.x OR a.y <> b.y)),
    bad AS (SELECT DISTINCT e.* FROM e JOIN p c ON c.nation = e.nation WHERE (bx - ax) * (c.y - ay) - (by_ - ay) * (c.x - ax) < 0
      OR ((bx - ax) * (c.y - ay) - (by_ - ay) * (c.x - ax) = 0 AND ((c.x - ax) * (bx - ax) + (c.y - ay) * (by_ - ay) < 0
        OR (c.x - bx) * (bx - ax) + (c.y - by_) * (by_ - ay) > 0))),
    v AS (SELECT nation, ax AS x, ay AS y FROM (SELECT * FROM e EXCEPT SELECT * FROM bad) UNION ALL SELECT nation, min(x), min(y) FROM p GROUP BY nation HAVING count(*) = 1),
    m AS (SELECT nation, avg(x) AS mx, avg(y) AS my, min(struct_pack(x := x, y := y)) AS s FROM v GROUP BY nation),
    o AS (SELECT v.nation, x, y, atan2(y - my, x - mx) - atan2(s.y - my, s.x - mx) AS t, s FROM v JOIN m USING (nation)),
    r AS (SELECT nation, x, y, CASE WHEN t < -1e-12 THEN t + 2 * pi() ELSE t END AS t, s FROM o)
    SELECT nation, CAST(count(*) + 1 AS INTEGER) AS corners, string_agg(x || ',' || y, ' ' ORDER BY t) || ' ' || min(s.x || ',' || s.y) AS ring FROM r GROUP BY nation""",
)
def agg_hull(spark, sf):
    """Convex hull by group (AGG-28)."""
    return layout.hulls(spots(spark, sf)[0].select("nation", "x", "y"), "nation").select("nation", F.size("ring").alias("corners"), F.concat_ws(" ", F.transform("ring", lambda p: F.concat_ws(",", p.x.cast("string"), p.y.cast("string")))).alias("ring"))


@R.add("flt_thinning", f"WITH RECURSIVE {SPOTS}, o AS (SELECT id, x, y, row_number() OVER (ORDER BY id) AS i FROM su), g AS (SELECT 0::BIGINT AS i, []::STRUCT(id BIGINT, x DOUBLE, y DOUBLE)[] AS kept UNION ALL SELECT g.i + 1, CASE WHEN len(list_filter(kept, lambda k: round(sqrt(pow(k.x - o.x, 2) + pow(k.y - o.y, 2)), 6) < 90)) > 0 THEN kept ELSE list_append(kept, struct_pack(id := o.id, x := o.x, y := o.y)) END FROM g JOIN o ON o.i = g.i + 1) SELECT k.id AS id FROM (SELECT unnest(kept) AS k FROM (SELECT kept FROM g ORDER BY i DESC LIMIT 1))")
def flt_thinning(spark, sf):
    """Greedy spatial thinning in id order (FLT-16)."""
    return layout.thinned(spots(spark, sf)[1], 90.0)


def foreground(spark, sf):
    """Pixels of all customers in key order, as rows of a square image; the foreground has a balance above 1000."""
    cu = read(spark, sf, "customer").select(C("c_custkey").alias("i"), "c_acctbal")
    width = F.broadcast(cu.agg(F.ceil(F.sqrt(F.max("i") + 1)).cast("bigint").alias("w")))
    return cu.join(width).filter("c_acctbal > 1000").select(F.floor(C("i") / C("w")).cast("bigint").alias("row"), (C("i") % C("w")).alias("col"))


@R.add(
    "up_labels",
    """WITH RECURSIVE s AS (SELECT CAST(ceil(sqrt(max(c_custkey) + 1)) AS BIGINT) AS w FROM customer),
    k AS (SELECT c_custkey // s.w AS r, c_custkey % s.w AS c, (c_custkey // s.w) * 4294967296 + c_custkey % s.w AS id FROM customer, s WHERE c_acctbal > 1000),
    e AS (SELECT a.id AS a, b.id AS b FROM k a JOIN k b ON (b.r = a.r AND abs(a.c - b.c) = 1) OR (b.c = a.c AND abs(a.r - b.r) = 1)),
    w AS (SELECT id, id AS label FROM k UNION SELECT e.b, w.label FROM w JOIN e ON e.a = w.id WHERE w.label < e.b)
    SELECT k.r AS row, k.c AS col, min(w.label) AS label FROM w JOIN k USING (id) GROUP BY ALL""",
)
def up_labels(spark, sf):
    """Connected-component labels of an image of all customers (UP-5, UP-13)."""
    return layout.labelled(foreground(spark, sf))


@R.add(
    "up_allocation",
    f"""WITH {SPOTS}, d AS (SELECT cu.id AS id, su.id AS i, round(sqrt(pow(cu.x - su.x, 2) + pow(cu.y - su.y, 2)), 6) AS d FROM cu, su),
    b AS (SELECT id, min(struct_pack(d := d, i := i)).i AS zone FROM d GROUP BY id) SELECT cu.id AS id, zone FROM cu LEFT JOIN b USING (id)""",
)
def up_allocation(spark, sf):
    """Every point to its closest seed, at any distance (UP-6, JOI-14)."""
    cu, su = spots(spark, sf)
    return match.closest(cu, su).select(C("left_id").alias("id"), C("right_id").alias("zone")).join(cu.select("id"), "id", "right")


@R.add("up_grid", f"WITH {SPOTS}, a(angle) AS (VALUES (0.0::DOUBLE), (30.0::DOUBLE), (45.0::DOUBLE)), t AS (SELECT angle, (x * cos(radians(angle)) + y * sin(radians(angle))) * 2 * pi() / 50 AS u, (y * cos(radians(angle)) - x * sin(radians(angle))) * 2 * pi() / 50 AS v FROM cu, a) SELECT angle, round(sqrt(pow(avg(cos(u)), 2) + pow(avg(sin(u)), 2)), 6) AS strength_u, round(sqrt(pow(avg(cos(v)), 2) + pow(avg(sin(v)), 2)), 6) AS strength_v FROM t GROUP BY angle")
def up_grid(spark, sf):
    """Period strength of rows at given angles and a given period, as where both are set by hand (UP-7); found ones: up_grid_scan."""
    return rounded(layout.grid_angles(spots(spark, sf)[0], 50.0, [0.0, 30.0, 45.0]).select("angle", "strength_u", "strength_v"))


@R.add("up_strips", f"WITH {SPOTS} SELECT CASE WHEN x * cos(radians(30)) + y * sin(radians(30)) >= 900 THEN 2 WHEN x * cos(radians(30)) + y * sin(radians(30)) >= 450 THEN 1 ELSE 0 END AS strip, count(*) AS n FROM cu GROUP BY 1")
def up_strips(spark, sf):
    """Turned coordinates cut into strips of given centres (UP-9)."""
    return layout.strips(layout.rotated(spots(spark, sf)[0], 30.0), [300.0, 600.0, 1200.0], "u").groupBy("strip").agg(F.count(F.lit(1)).alias("n"))


TURNS = ", ".join(f"({a}.0::DOUBLE, {cos(a * pi / 180)!r}::DOUBLE, {sin(a * pi / 180)!r}::DOUBLE)" for a in range(90))
#: Periods that the scan tries.
LOW, HIGH = 20.0, 80.0


@R.add(
    "up_grid_scan",
    f"""WITH {SPOTS}, a(angle, c, s) AS (VALUES {TURNS}),
    t AS (SELECT angle, round(x * c + y * s, 6) AS u, round(y * c - x * s, 6) AS v FROM cu, a),
    f AS (SELECT angle, 'u' AS axis, u AS p FROM t UNION ALL SELECT angle, 'v', v FROM t),
    e AS (SELECT angle, axis, min(p) AS lo, max(p) - min(p) AS span, greatest(floor(max(p) - min(p)), 32) AS n, count(*) AS m FROM f GROUP BY ALL),
    b AS (SELECT angle, axis, lo, span, n, least(floor((p - lo) / (span / n)), n - 1) AS bin, count(*) AS c FROM f JOIN e USING (angle, axis)
      WHERE m >= 200 AND span >= 2 * {LOW} GROUP BY ALL),
    k AS (SELECT angle, axis, unnest(range(1, CAST(n AS BIGINT) // 2 + 1)) AS k FROM e),
    w AS (SELECT angle, axis, span, k, round(sqrt(pow(sum(c * cos(2 * pi() * k * bin / n)), 2) + pow(sum(c * sin(2 * pi() * k * bin / n)), 2)), 6) AS size
      FROM b JOIN k USING (angle, axis) WHERE span / k BETWEEN {LOW} AND {HIGH} GROUP BY ALL),
    s AS (SELECT angle, axis, max(size) / (avg(size) + 1e-9) AS score, min(struct_pack(z := -size, p := -span / k)).p * -1 AS period FROM w GROUP BY angle, axis HAVING max(size) > 0),
    h AS (SELECT angle, axis, min(struct_pack(z := -c, p := lo + (bin + 0.5) * span / n)).p AS phase FROM b GROUP BY angle, axis),
    r AS (SELECT angle, max(period) FILTER (axis = 'u') AS period_u, max(phase) FILTER (axis = 'u') AS phase_u, max(period) FILTER (axis = 'v') AS period_v,
      max(phase) FILTER (axis = 'v') AS phase_v, round(sum(score), 6) AS score FROM a LEFT JOIN s USING (angle) LEFT JOIN h USING (angle, axis) GROUP BY angle),
    o AS (SELECT * REPLACE (CASE WHEN period_u IS NOT NULL AND period_v IS NOT NULL THEN score ELSE 0 END AS score) FROM r)
    SELECT angle, round(period_u, 6) AS period_u, round(phase_u, 6) AS phase_u, round(period_v, 6) AS period_v, round(phase_v, 6) AS phase_v, score,
      coalesce(angle = (SELECT angle FROM o WHERE score > 0 ORDER BY score DESC, angle LIMIT 1), false) AS best FROM o""",
)
def up_grid_scan(spark, sf):
    """Period and phase of both axes at 90 angles, and the angle whose rows are the most regular (UP-7)."""
    return rounded(layout.grid_scan(spots(spark, sf)[0], LOW, HIGH))


#: Extent of the spots, and the turned frame of their strips.
EXTENT, FRAME = (0.0, 0.0, 999.0, 996.0), {"angle": 30.0, "period": 50.0, "phase": 10.0, "least_gap": 20.0}
AT = layout.strip_frame(**FRAME, extent=EXTENT)
SMOOTH = ", ".join(f"({i - 6}, {k!r}::DOUBLE)" for i, k in enumerate(gaussian_kernel(2.0, 6)))
BINS = f"((({AT.high!r}::DOUBLE) - ({AT.low!r}::DOUBLE)) / {AT.n})"
STRIPS = f"""{SPOTS}, k(d, w) AS (VALUES {SMOOTH}),
    p AS (SELECT CAST(floor((round(y * {AT.c!r}::DOUBLE - x * {AT.s!r}::DOUBLE, 6) - ({AT.start!r}::DOUBLE)) / 50.0::DOUBLE) AS INTEGER) AS strip,
      CAST(least(floor((round(x * {AT.c!r}::DOUBLE + y * {AT.s!r}::DOUBLE, 6) - ({AT.low!r}::DOUBLE)) / {BINS}), {AT.n - 1}) AS INTEGER) AS bin FROM cu),
    h AS (SELECT strip, bin, count(*) AS c FROM p WHERE bin BETWEEN 0 AND {AT.n - 1} GROUP BY ALL),
    m AS (SELECT strip, bin + d AS bin, round(sum(c * w), 9) AS h FROM h, k WHERE bin + d BETWEEN 0 AND {AT.n - 1} GROUP BY ALL),
    t AS (SELECT m.strip, m.bin, m.h, row_number() OVER (PARTITION BY m.strip ORDER BY m.bin) AS i FROM m LEFT JOIN m a ON a.strip = m.strip AND a.bin = m.bin - 1
      LEFT JOIN m b ON b.strip = m.strip AND b.bin = m.bin + 1 WHERE m.h >= coalesce(a.h, 0) AND m.h >= coalesce(b.h, 0) AND m.h > 0
      AND m.bin BETWEEN 1 AND {AT.n - 2} AND m.strip IN (SELECT strip FROM h GROUP BY strip HAVING sum(c) >= 3)),
    f AS (SELECT DISTINCT strip, 0::BIGINT AS i, []::STRUCT(bin INTEGER, h DOUBLE)[] AS g FROM t UNION ALL
      SELECT f.strip, f.i + 1, CASE WHEN len(g) = 0 OR t.bin - g[-1].bin >= 8 THEN list_append(g, struct_pack(bin := t.bin, h := t.h))
        WHEN t.h > g[-1].h THEN list_append(list_slice(g, 1, len(g) - 1), struct_pack(bin := t.bin, h := t.h)) ELSE g END FROM f JOIN t ON t.strip = f.strip AND t.i = f.i + 1),
    u AS (SELECT strip, ({AT.low!r}::DOUBLE) + g.bin * {BINS} + {AT.step!r}::DOUBLE / 2 AS a FROM (SELECT strip, unnest(arg_max(g, i)) AS g FROM f GROUP BY strip)),
    w AS (SELECT strip, a, lead(a) OVER (PARTITION BY strip ORDER BY a) - a AS w FROM u),
    q AS (SELECT strip, a, w, greatest(1, CAST(floor(w / 50.0::DOUBLE + 0.5) AS INTEGER)) AS n FROM w WHERE w IS NOT NULL),
    o AS (SELECT strip, a + w * (j + 0.5) / n AS centre FROM (SELECT *, unnest(range(n)) AS j FROM q)),
    z AS (SELECT *, ({AT.start!r}::DOUBLE) + (strip + 0.5) * 50.0::DOUBLE AS across FROM o),
    seeds AS (SELECT strip, CAST(row_number() OVER (PARTITION BY strip ORDER BY centre) AS INTEGER) AS i, centre, centre * {AT.c!r}::DOUBLE - across * {AT.s!r}::DOUBLE AS x,
      centre * {AT.s!r}::DOUBLE + across * {AT.c!r}::DOUBLE AS y FROM z)"""


def seeds(spark, sf):
    return layout.strip_centres(spots(spark, sf)[0], **FRAME, extent=EXTENT, support=3)


@R.add("up_strip_centres", f"WITH RECURSIVE {STRIPS} SELECT strip, i, round(centre, 6) AS centre, round(x, 6) AS x, round(y, 6) AS y FROM seeds")
def up_strip_centres(spark, sf):
    """Places along each strip, from the gaps found in it (UP-8)."""
    return rounded(seeds(spark, sf))


@R.add(
    "up_seed_pixels",
    f"""WITH RECURSIVE {STRIPS}, c AS (SELECT x, y, unnest(range(CAST(floor(x) AS BIGINT) - 6, CAST(ceil(x) AS BIGINT) + 7)) AS col FROM seeds),
    r AS (SELECT *, unnest(range(CAST(floor(y) AS BIGINT) - 6, CAST(ceil(y) AS BIGINT) + 7)) AS "row" FROM c)
    SELECT DISTINCT "row", col FROM r WHERE abs((col - x) * {AT.c!r}::DOUBLE + ("row" - y) * {AT.s!r}::DOUBLE) < 3.5 AND abs(("row" - y) * {AT.c!r}::DOUBLE - (col - x) * {AT.s!r}::DOUBLE) < 3.5
      AND col BETWEEN 0 AND 999 AND "row" BETWEEN 0 AND 996""",
)
def up_seed_pixels(spark, sf):
    """Pixels of the turned squares around the places found (UP-8, UP-9)."""
    return layout.seed_pixels(seeds(spark, sf), FRAME["angle"], 7.0, (0, 0, 999, 996))


@R.add("up_rolling", "WITH e AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal END AS dx, CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal / 2 END AS dy FROM supplier) SELECT k, round(CASE WHEN count(dx) OVER w >= 3 THEN avg(dx) OVER w END, 6) AS roll_x, round(CASE WHEN count(dy) OVER w >= 3 THEN avg(dy) OVER w END, 6) AS roll_y FROM e WINDOW w AS (ORDER BY k ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)")
def up_rolling(spark, sf):
    """Rolling mean of the last offsets (UP-11)."""
    ok = C("s_suppkey") % 4 != 0
    s = read(spark, sf, "supplier").select(C("s_suppkey").alias("k"), F.when(ok, C("s_acctbal")).alias("dx"), F.when(ok, C("s_acctbal") / 2).alias("dy"))
    return rounded(layout.rolling_offsets(s, "k", "dx", "dy").select("k", "roll_x", "roll_y"))


#: Images of 25 series from orders: residuals of 0 to 17 m, moves around a drift of the series, brightness differences, residuals after matching.
IMAGES = """im AS (SELECT o_custkey % 25 AS series, o_orderkey AS k, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) % 1700 / 100 END AS rms,
    CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey % 25 + o_orderkey * 7919 % 997 / 50 END AS dx, o_orderkey * 6151 % 991 / 60 AS dy, o_orderkey * 31 % 61 AS tone,
    CAST(round(o_totalprice * 100) AS BIGINT) % 2300 / 100 AS hist_rms FROM orders)"""


@R.add(
    "up_ladder",
    f"""WITH {IMAGES}, good AS (SELECT series, k, CASE WHEN count(*) OVER w >= 3 THEN avg(dx) OVER w END AS mx, avg(dy) OVER w AS my FROM im WHERE rms <= 10 AND dx IS NOT NULL AND dy IS NOT NULL
      WINDOW w AS (PARTITION BY series ORDER BY k ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
    h AS (SELECT im.*, mx, my, sqrt(pow(dx - mx, 2) + pow(dy - my, 2)) AS rest FROM im ASOF LEFT JOIN good ON im.series = good.series AND im.k > good.k),
    m AS (SELECT *, CASE WHEN rms <= 10 THEN 'direct' WHEN rest <= 10 THEN 'offset' WHEN coalesce(tone <= 30, false) AND rms <= 15 THEN 'relaxed'
      WHEN NOT coalesce(tone <= 30, false) AND hist_rms <= 15 THEN 'hist' ELSE 'failed' END AS method FROM h),
    r AS (SELECT *, CASE method WHEN 'direct' THEN rms WHEN 'relaxed' THEN rms WHEN 'offset' THEN rest WHEN 'hist' THEN hist_rms END AS residual FROM m)
    SELECT series, k, method, CASE WHEN residual <= 2 THEN 2.0::DOUBLE WHEN residual <= 5 THEN 5.0 WHEN residual <= 10 THEN 10.0 WHEN residual <= 15 THEN 15.0 END AS "limit", round(residual, 6) AS residual,
      CASE WHEN method = 'offset' THEN round(mx, 6) END AS dx, CASE WHEN method = 'offset' THEN round(my, 6) END AS dy FROM r""",
)
def up_ladder(spark, sf):
    """Ladder of registration attempts with the mean of the last ten direct moves as a hint (UP-11)."""
    k, cents = C("o_orderkey"), F.round(C("o_totalprice") * 100).cast("long")
    series = C("o_custkey") % 25
    images = read(spark, sf, "orders").select(
        series.alias("series"), k.alias("k"), F.when(k % 11 != 0, cents % 1700 / 100).alias("rms"), F.when(k % 13 != 0, series + k * 7919 % 997 / 50).alias("dx"),
        (k * 6151 % 991 / 60).alias("dy"), (k * 31 % 61).cast("double").alias("tone"), (cents % 2300 / 100).alias("hist_rms"),
    )
    return rounded(register.ladder(images, "series", "k"))


def _grid_sql(name: str, offsets: str) -> str:
    """CTE of (o, s): the mean distance, at most one second, of late clicks moved by o to their nearest trigger."""
    return f"""{name}_o AS ({offsets}), {name}_a AS (SELECT o, i, a + o AS t FROM late, {name}_o),
    {name}_d AS (SELECT a.o, a.i, least(1.0, min(abs(a.t - b.t))) AS d FROM {name}_a a LEFT JOIN near b ON b.c = CAST(floor(a.t) AS BIGINT) GROUP BY a.o, a.i),
    {name} AS (SELECT o, round(avg(coalesce(d, 1.0)), 9) AS s FROM {name}_d GROUP BY o ORDER BY s, abs(o), o LIMIT 1)"""


@R.add(
    "ts_clock_offset",
    f"""WITH ev AS (SELECT epoch_us(ts) / 1e6 AS b, epoch_us(ts) AS us FROM events WHERE event_type = 'click'),
    late AS (SELECT (us + 3350000) / 1e6 AS a, row_number() OVER () AS i FROM ev), near AS (SELECT b AS t, CAST(floor(b) AS BIGINT) + s.i AS c FROM (SELECT DISTINCT b FROM ev), (VALUES (-1), (0), (1)) s(i)),
    {_grid_sql("coarse", "SELECT (i - 12) * 0.5::DOUBLE AS o FROM range(25) t(i)")},
    {_grid_sql("fine", "SELECT coarse.o + (i - 40) * 0.05::DOUBLE AS o FROM range(81) t(i), coarse")}
    SELECT CASE WHEN abs(o) <= 8 THEN round(o, 6) END AS "offset", round(s, 6) AS score FROM fine""",
)
def ts_clock_offset(spark, sf):
    """Clock calibration on a coarse and then a fine grid of offsets (TS-13)."""
    e = read(spark, sf, "events").filter("event_type = 'click'").select("ts")
    late = e.select((C("ts") + F.expr("interval 3 seconds 350 milliseconds")).alias("ts"))
    o, s = layout.clock_offset(late, e, "ts", span=6.0)
    return spark.createDataFrame([(None if o is None else round(o, 6), None if s is None else round(s, 6))], "offset double, score double")


#: Flights of 500 events each: fixes along an uneven course, photos (clicks) by a clock that is 3.35 s slow, and triggers in every other flight.
FLIGHTS = """own AS (SELECT event_id AS e, event_id // 500 AS flight, event_type AS kind, event_id % 500 + (event_id * 7919 % 997) / 2000 AS t, coalesce(value, 0) AS value FROM events WHERE event_id IS NOT NULL),
    course AS (SELECT e, flight, kind, CAST(floor(t * 1e6) AS BIGINT) AS tm, 8 * t + 60 * sin(t / 20) AS x, value / 10 AS y, 100 + value AS alt, 8 + 3 * cos(t / 20) + value / 50 AS speed FROM own),
    log AS (SELECT flight, tm, x, y, CASE WHEN e % 500 < 3 THEN 40 ELSE alt END AS alt, speed FROM course WHERE kind <> 'click' AND e % 500 NOT BETWEEN 200 AND 240),
    photos AS (SELECT flight, tm - 3350000 AS tm FROM course WHERE kind = 'click'),
    triggers AS (SELECT flight, tm, x, y FROM course WHERE kind = 'click' AND e % 3 = 0 AND flight % 2 = 0)"""


def flights(spark, sf):
    t = C("e") % 500 + (C("e") * 7919 % 997) / 2000
    own = read(spark, sf, "events").filter("event_id is not null").select(C("event_id").alias("e"), F.floor(C("event_id") / 500).alias("flight"), C("event_type").alias("kind"), F.coalesce("value", F.lit(0.0)).alias("value"))
    course = own.select("e", "flight", "kind", F.floor(t * 1e6).alias("at"), (8 * t + 60 * F.sin(t / 20)).alias("x"), (C("value") / 10).alias("y"), (100 + C("value")).alias("alt"), (8 + 3 * F.cos(t / 20) + C("value") / 50).alias("speed"))
    clicks = course.filter("kind = 'click'")
    log = course.filter((C("kind") != "click") & ~(C("e") % 500).between(200, 240)).withColumn("alt", F.when(C("e") % 500 < 3, 40.0).otherwise(C("alt")))
    return clicks.select("flight", (C("at") - 3350000).alias("at")), log.select("flight", "at", "x", "y", "alt", "speed"), clicks.filter("e % 3 = 0 and flight % 2 = 0").select("flight", "at", "x", "y")


def _pass_sql(n: str, centres: str, reach: int, step: int) -> str:
    """CTEs of one grid: photos placed by an as-of join, both scores, and the best offset of each flight."""
    return f"""{n}_g AS (SELECT flight, anchored, o + (i - {reach}) * {step} AS o FROM {centres}, range({2 * reach + 1}) r(i)),
    {n}_q AS (SELECT g.flight, anchored, o, p.tm + o AS tm FROM {n}_g g JOIN photos p ON p.flight = g.flight),
    {n}_p AS (SELECT q.flight, anchored, o, q.tm, CASE WHEN q.tm = f.tm THEN f.x WHEN nat - f.tm <= 30000000 THEN f.x + (q.tm - f.tm) / (nat - f.tm) * (nx - f.x) END AS x,
      CASE WHEN q.tm = f.tm THEN f.y WHEN nat - f.tm <= 30000000 THEN f.y + (q.tm - f.tm) / (nat - f.tm) * (ny - f.y) END AS y,
      CASE WHEN q.tm = f.tm THEN f.alt WHEN nat - f.tm <= 30000000 THEN f.alt + (q.tm - f.tm) / (nat - f.tm) * (nalt - f.alt) END AS alt,
      CASE WHEN q.tm = f.tm THEN f.speed WHEN nat - f.tm <= 30000000 THEN f.speed + (q.tm - f.tm) / (nat - f.tm) * (nspeed - f.speed) END AS speed
      FROM {n}_q q ASOF LEFT JOIN fixes f ON q.flight = f.flight AND q.tm >= f.tm),
    {n}_near AS (SELECT t.flight, p.o, t.tm, t.x, t.y, p.x AS px, p.y AS py, row_number() OVER (PARTITION BY t.flight, p.o, t.tm, t.x, t.y ORDER BY abs(p.tm - t.tm), p.tm) AS i
      FROM triggers t JOIN {n}_p p ON p.flight = t.flight WHERE anchored),
    {n}_enough AS (SELECT flight, o FROM {n}_p WHERE anchored GROUP BY ALL HAVING count(x) >= 3),
    {n}_a AS (SELECT flight, o, avg(sqrt(pow(px - x, 2) + pow(py - y, 2))) AS s FROM {n}_near JOIN {n}_enough USING (flight, o) WHERE i = 1 GROUP BY ALL),
    {n}_n AS (SELECT flight, o, count(x) AS n, count(*) FILTER (alt > ground + 50 AND speed > 1.5) AS m FROM {n}_p JOIN grounds USING (flight) WHERE NOT anchored GROUP BY ALL),
    {n}_w AS (SELECT flight, o, (speed + lead(speed) OVER w) / 2 AS v, sqrt(pow(lead(x) OVER w - x, 2) + pow(lead(y) OVER w - y, 2)) AS d
      FROM {n}_p JOIN grounds USING (flight) WHERE NOT anchored AND alt > ground + 50 AND speed > 1.5 WINDOW w AS (PARTITION BY flight, o ORDER BY tm)),
    {n}_r AS (SELECT flight, o, CASE WHEN stddev_pop(v) >= 1e-6 AND stddev_pop(d) >= 1e-6 THEN -corr(v, d) ELSE 0 END AS s FROM {n}_w WHERE d IS NOT NULL GROUP BY ALL),
    {n}_s AS (SELECT * FROM {n}_a UNION ALL SELECT flight, o, CASE WHEN n >= 5 AND m >= 10 THEN coalesce(s, 0) ELSE 0 END FROM {n}_n LEFT JOIN {n}_r USING (flight, o)),
    {n}_t AS (SELECT flight, min(struct_pack(s := round(s, 9), o := o)) AS m FROM {n}_s GROUP BY flight),
    {n} AS (SELECT flight, anchored, coalesce(m.o, c.o) AS o, m.s AS s FROM {centres} c LEFT JOIN {n}_t USING (flight))"""


@R.add(
    "ts_calibrated",
    f"""WITH {FLIGHTS}, own_fixes AS (SELECT flight, tm, avg(x) AS x, avg(y) AS y, avg(alt) AS alt, avg(speed) AS speed FROM log GROUP BY ALL),
    fixes AS (SELECT *, lead(tm) OVER w AS nat, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(alt) OVER w AS nalt, lead(speed) OVER w AS nspeed FROM own_fixes WINDOW w AS (PARTITION BY flight ORDER BY tm)),
    grounds AS (SELECT flight, arg_min(alt, tm) AS ground FROM own_fixes GROUP BY flight),
    start AS (SELECT flight, coalesce(n, 0) >= 2 AS anchored, 2000000::BIGINT AS o FROM (SELECT DISTINCT flight FROM photos) LEFT JOIN (SELECT flight, count(*) AS n FROM triggers GROUP BY flight) USING (flight)),
    {_pass_sql("coarse", "start", 30, 500000)}, {_pass_sql("fine", "coarse", 40, 50000)}
    SELECT flight, CASE WHEN NOT anchored AND abs(o - 2000000) > 8000000 THEN 2.0 ELSE o / 1e6 END AS "offset", round(s, 6) AS score,
      CASE WHEN anchored THEN 'anchors' ELSE 'speed' END AS method, NOT anchored AND abs(o - 2000000) > 8000000 AS fell_back FROM fine""",
)
def ts_calibrated(spark, sf):
    """Clock calibration by flight: triggers in metres, else speed against distance, on one time line for all offsets (TS-13)."""
    return rounded(calibrate.calibrated(*flights(spark, sf), "flight", manual=2.0))


@R.add("flt_lint", "WITH l AS (SELECT page_id AS file, html AS value FROM pages), r AS (SELECT file, 'script' AS rule FROM l WHERE contains(value, '<script') UNION ALL SELECT file, 'table' FROM l WHERE contains(value, '<table')) SELECT file, rule, count(*) AS hits FROM r GROUP BY ALL")
def flt_lint(spark, sf):
    """Pattern lint over texts (FLT-17)."""
    return layout.linted(read(spark, sf, "pages").select(C("page_id").alias("file"), C("html").alias("value")), {"script": "<script", "table": "<table"})


@R.add("grd_coordinates", f"WITH {UTM} SELECT round(median(residual), 5) AS median, round(max(residual), 5) AS maximum FROM u")
def grd_coordinates(spark, sf):
    """Coordinate guard: residuals of a round trip (GRD-1)."""
    return rounded(layout.guarded(utm(spark, sf), "residual"), 5)
