"""Grid overlays, match variants, station features and detection sweeps, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdance.operators import contrast, detect, match, stats
from verdance.operators import timeseries as ts
from verdance.operators.ordering import quantiles
from verdance.plans.joins import PAIRS
from verdance.plans.models import BOXES, boxes
from verdance.plans.registry import PX, SPOTS, Registry, num, pixels, read, rounded, spots
from verdance.plans.series import HR, station
from verdance.plans.statistics import t_sql

R = Registry()
C = F.col
#: Origin and pixel sizes of a zone grid and of a season's grid, and the rows and columns of the latter.
ZONE_PX, SEASON_PX, SIDE = 25.0, 10.0, 40


@R.add(
    "joi_grid_overlay",
    f"""WITH {SPOTS}, z AS (SELECT CAST(floor((1000 - y) / {ZONE_PX}) AS BIGINT) AS zr, CAST(floor(x / {ZONE_PX}) AS BIGINT) AS zc, min(id) AS zone FROM su GROUP BY ALL),
    g AS (SELECT r.i AS row, c.i AS col, 205 + (c.i + 0.5) * {SEASON_PX} AS x, 795 - (r.i + 0.5) * {SEASON_PX} AS y FROM range({SIDE}) r(i), range({SIDE}) c(i))
    SELECT row, col, coalesce(zone, 0) AS zone FROM g LEFT JOIN z ON zr = CAST(floor((1000 - y) / {ZONE_PX}) AS BIGINT) AND zc = CAST(floor(x / {ZONE_PX}) AS BIGINT)""",
)
def joi_grid_overlay(spark, sf):
    """Zones of one grid laid over another grid: every pixel gets the zone whose pixel holds its centre, 0 outside (JOI-24)."""
    su = spots(spark, sf)[1]
    cell = lambda x, y: (F.floor((1000 - y) / ZONE_PX).alias("zr"), F.floor(x / ZONE_PX).alias("zc"))
    zones = su.groupBy(*cell(C("x"), C("y"))).agg(F.min("id").alias("zone"))
    grid = spark.range(SIDE * SIDE).select(F.floor(C("id") / SIDE).alias("row"), (C("id") % SIDE).alias("col"))
    grid = grid.select("row", "col", *cell(205 + (C("col") + 0.5) * SEASON_PX, 795 - (C("row") + 0.5) * SEASON_PX))
    return grid.join(zones, ["zr", "zc"], "left").select("row", "col", F.coalesce("zone", F.lit(0)).alias("zone"))


@R.add(
    "joi_grid_agreement",
    f"""WITH {SPOTS}, n AS (SELECT left_id, m.right_id AS right_id FROM (SELECT cu.id AS left_id, min(struct_pack(d := round(sqrt(pow(cu.x - su.x, 2) + pow(cu.y - su.y, 2)), 6), right_id := su.id)) AS m
      FROM cu, su WHERE round(sqrt(pow(cu.x - su.x, 2) + pow(cu.y - su.y, 2)), 6) <= 60 GROUP BY cu.id)),
    j AS (SELECT floor(cu.y / 20) - floor(su.y / 20) AS dr, floor(cu.x / 20) - floor(su.x / 20) AS dc FROM n JOIN cu ON cu.id = left_id JOIN su ON su.id = right_id)
    SELECT count(*) AS matched, count(*) FILTER (WHERE dr = 0 AND dc = 0) AS same, count(*) FILTER (WHERE abs(dr) <= 1) AS row_within_1, count(*) FILTER (WHERE abs(dr) <= 1 AND abs(dc) <= 1) AS within_1 FROM j""",
)
def joi_grid_agreement(spark, sf):
    """Whether matched rows lie in the same grid row and column, or one beside it (JOI-28)."""
    cu, su = spots(spark, sf)
    place = lambda df, p: df.select(C("id").alias(f"{p}_id"), F.floor(C("y") / 20).alias(f"{p}_row"), F.floor(C("x") / 20).alias(f"{p}_col"))
    j = match.nearest(cu, su, 60.0).join(place(cu, "left"), "left_id").join(place(su, "right"), "right_id")
    dr, dc = F.abs(C("left_row") - C("right_row")), F.abs(C("left_col") - C("right_col"))
    counts = {"same": (dr == 0) & (dc == 0), "row_within_1": dr <= 1, "within_1": (dr <= 1) & (dc <= 1)}
    return j.agg(F.count(F.lit(1)).alias("matched"), *(F.count_if(c).alias(n) for n, c in counts.items()))


@R.add(
    "joi_knn_greedy",
    f"""WITH RECURSIVE {SPOTS}, {PAIRS}, k AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY d, right_id) AS rank FROM pr WHERE d <= 30),
    o AS (SELECT *, row_number() OVER (ORDER BY d, left_id, right_id) AS i FROM k WHERE rank <= 4),
    g AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS ls, []::BIGINT[] AS rs UNION ALL
      SELECT g.i + 1, CASE WHEN list_contains(ls, left_id) OR list_contains(rs, right_id) THEN ls ELSE list_append(ls, left_id) END,
        CASE WHEN list_contains(ls, left_id) OR list_contains(rs, right_id) THEN rs ELSE list_append(rs, right_id) END FROM g JOIN o ON o.i = g.i + 1),
    e AS (SELECT unnest(ls) AS left_id, unnest(rs) AS right_id FROM (SELECT ls, rs FROM g ORDER BY i DESC LIMIT 1)) SELECT left_id, right_id, d FROM e JOIN pr USING (left_id, right_id)""",
)
def joi_knn_greedy(spark, sf):
    """The four closest within a cap, then one to one by distance (JOI-12)."""
    cu, su = spots(spark, sf)
    return match.greedy_nearest(cu, su, 4, 30.0)


@R.add(
    "joi_nearest_kept",
    f"""WITH {SPOTS}, {PAIRS}, m AS (SELECT left_id, min(struct_pack(d := d, right_id := right_id)) AS m FROM pr WHERE d <= 15 GROUP BY left_id)
    SELECT cu.id AS left_id, m.right_id AS right_id, m.d AS d FROM cu LEFT JOIN m ON cu.id = left_id""",
)
def joi_nearest_kept(spark, sf):
    """Closest within a radius; rows without a match stay, with nulls (JOI-11)."""
    cu, su = spots(spark, sf)
    return cu.select(C("id").alias("left_id")).join(match.nearest(cu, su, 15.0), "left_id", "left")


@R.add(
    "joi_group_means",
    """WITH m AS (SELECT o_custkey, avg(o_totalprice) AS m, count(*) AS n FROM orders GROUP BY 1)
    SELECT c_mktsegment AS segment, count(*) AS subjects, round(avg(m), 4) AS mean, round(stddev_samp(m), 4) AS sd FROM m JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
)
def joi_group_means(spark, sf):
    """Rows to subject means to group means, by an index join (JOI-5)."""
    m = read(spark, sf, "orders").groupBy(C("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("m"))
    j = m.join(read(spark, sf, "customer").select("c_custkey", C("c_mktsegment").alias("segment")), "c_custkey")
    return rounded(j.groupBy("segment").agg(F.count(F.lit(1)).alias("subjects"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd")), 4)


def _fold_sql(where: str) -> str:
    """Recursive CTEs of the whole-portion chill fold over the hours that ``where`` keeps."""
    return f"""{HR}, o AS (SELECT row_number() OVER (ORDER BY hour) AS i, t FROM hr WHERE {where}),
    q AS (SELECT i, 139500.0::DOUBLE * exp(-4153.5::DOUBLE / (t + 273.15)) AS k0, 2.567e18::DOUBLE * exp(-12888.8::DOUBLE / (t + 273.15)) AS k1 FROM o),
    s AS (SELECT 0::BIGINT AS i, 0.0::DOUBLE AS x, 0.0::DOUBLE AS p UNION ALL SELECT i, CASE WHEN x >= 1 THEN x - 1 ELSE x END, CASE WHEN x >= 1 THEN p + 1 ELSE p END
      FROM (SELECT q.i, s.x * exp(-k1) + k0 / k1 * (1 - exp(-k1)) AS x, s.p FROM s JOIN q ON q.i = s.i + 1))"""


@R.add("ts_late_chill", f"WITH RECURSIVE {_fold_sql('month(hour) IN (1, 2)')} SELECT round(max(p), 6) AS late, (SELECT count(*) FROM o) AS hours FROM s")
def ts_late_chill(spark, sf):
    """Chill portions of January and February alone: the state starts anew there (TS-9)."""
    h = station(spark, sf).filter(F.month("hour").isin(1, 2)).withColumn("s", F.lit(1))
    return ts.chill_portions(h, ["s"], "hour", "t").crossJoin(h.agg(F.count(F.lit(1)).alias("hours"))).select(F.round("portions", 6).alias("late"), "hours")


#: Names of the season's features, and their SQL over hours (h) or days (d).
FEATURES_SQL = """SELECT count(*) FILTER (WHERE t <= 7) AS cold_7, count(*) FILTER (WHERE t BETWEEN 0 AND 7.2) AS cold_0_7, count(*) FILTER (WHERE t <= 0) AS frost,
  count(*) FILTER (WHERE t > 25) AS heat, sum(rain) AS rain, count(*) FILTER (WHERE wind > 5) AS windy, sum(rh) * 3600 / 1e6 AS radiation, avg(rh) AS rh,
  count(*) FILTER (WHERE rh < 35) AS dry FROM hr"""


@R.add(
    "ts_features_to_trees",
    f"""WITH {HR}, h AS ({FEATURES_SQL}), d AS (SELECT CAST(hour AS DATE) AS day, max(tmax) AS high, min(tmin) AS low FROM hr GROUP BY 1),
    g AS (SELECT sum(greatest((high + low) / 2 - 4.5, 0)) AS gdd, sum(CASE WHEN month(day) = 2 THEN greatest((high + low) / 2 - 4.5, 0) END) AS gdd_feb,
      avg(CASE WHEN month(day) = 2 THEN high - low END) AS dtr_feb FROM d)
    SELECT s_suppkey AS tree, cold_7, cold_0_7, frost, heat, round(rain, 4) AS rain, windy, round(radiation, 6) AS radiation, round(rh, 6) AS rh, dry, round(gdd, 4) AS gdd,
    round(gdd_feb, 4) AS gdd_feb, round(dtr_feb, 4) AS dtr_feb, round(CASE WHEN gdd > 0 THEN cold_7 / gdd ELSE 0 END, 6) AS ratio FROM supplier, h, g""",
)
def ts_features_to_trees(spark, sf):
    """Thirteen features of a season on every tree; one row is broadcast (TS-12)."""
    h = station(spark, sf)
    when = lambda c: F.count_if(c)
    a = h.agg(
        when(C("t") <= 7).alias("cold_7"), when(C("t").between(0, 7.2)).alias("cold_0_7"), when(C("t") <= 0).alias("frost"), when(C("t") > 25).alias("heat"), F.sum("rain").alias("rain"),
        when(C("wind") > 5).alias("windy"), (F.sum("rh") * 3600 / 1e6).alias("radiation"), F.avg("rh").alias("rh"), when(C("rh") < 35).alias("dry"),
    )
    feb = F.month("day") == 2
    d = ts.daily(h, [], "hour", "tmax", "tmin").agg(F.sum("gdd").alias("gdd"), F.sum(F.when(feb, C("gdd"))).alias("gdd_feb"), F.avg(F.when(feb, C("dtr"))).alias("dtr_feb"))
    one = a.crossJoin(d).withColumn("ratio", F.when(C("gdd") > 0, C("cold_7") / C("gdd")).otherwise(0.0))
    digits = {"rain": 4, "radiation": 6, "rh": 6, "gdd": 4, "gdd_feb": 4, "dtr_feb": 4, "ratio": 6}
    trees = read(spark, sf, "supplier").select(C("s_suppkey").alias("tree"))
    return trees.crossJoin(F.broadcast(one)).select("tree", *(F.round(c, digits[c]).alias(c) if c in digits else c for c in one.columns))


@R.add(
    "ts_offset_stats",
    """WITH e AS (SELECT user_id, ts FROM events WHERE event_type = 'click'), v AS (SELECT user_id, ts FROM events WHERE event_type = 'view'),
    j AS (SELECT e.user_id, e.ts, min(struct_pack(d := abs(epoch_us(v.ts) - epoch_us(e.ts)), t := v.ts)) AS m FROM e JOIN v USING (user_id) GROUP BY ALL),
    o AS (SELECT (epoch_us(m.t) - epoch_us(ts)) / 1e6 AS s FROM j)
    SELECT count(*) AS n, round(median(s), 3) AS median, round(quantile_cont(s, 0.1), 3) AS p10, round(quantile_cont(s, 0.9), 3) AS p90, round(stddev_pop(s), 3) AS sd FROM o""",
)
def ts_offset_stats(spark, sf):
    """Offsets of rows to external positions in time: median, tenth and ninetieth percentile, deviation (TS-14)."""
    e = read(spark, sf, "events")
    own = e.filter("event_type = 'click'").select("user_id", "ts").distinct()
    j = match.as_of(own, e.filter("event_type = 'view'").select("user_id", "ts"), ["user_id"], "ts", [])
    us = lambda c: F.unix_micros(C(c).cast("timestamp"))
    o = j.filter("ts_match is not null").select(((us("ts_match") - us("ts")) / 1e6).alias("s"))
    low, mid, high = quantiles(o, "s", (0.1, 0.5, 0.9))
    return o.agg(F.count(F.lit(1)).alias("n"), F.lit(mid).alias("median"), F.lit(low).alias("p10"), F.lit(high).alias("p90"), F.stddev_pop("s").alias("sd")).select("n", *(F.round(c, 3).alias(c) for c in ("median", "p10", "p90", "sd")))


CUTS = [0.1 * i for i in range(1, 10)]


@R.add(
    "dt_probability_sweep",
    f"""WITH {PX}, t AS (SELECT r / 50 AS p, status = 'O' AS y FROM px), c(cut) AS (VALUES {", ".join(f"({c!r}::DOUBLE)" for c in CUTS)}),
    a AS (SELECT cut, count(*) FILTER (WHERE p >= cut AND y) AS tp, count(*) FILTER (WHERE p >= cut AND NOT y) AS fp, count(*) FILTER (WHERE p < cut AND y) AS fn FROM t, c GROUP BY cut)
    SELECT round(cut, 1) AS cut, tp, fp, fn, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS dice, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
    round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall FROM a""",
)
def dt_probability_sweep(spark, sf):
    """Pixel scores at each probability threshold, in one pass over cumulative counts (DT-4)."""
    px = pixels(spark, sf).select((C("r") / 50).alias("p"), (C("status") == "O").alias("y"))
    return rounded(detect.probability_sweep(px, "p", "y", CUTS).withColumn("cut", F.round("cut", 1)))


IOUS = [0.5 + 0.05 * i for i in range(10)]


@R.add(
    "dt_mean_f1",
    f"""WITH RECURSIVE {BOXES}, pa AS (SELECT image, pred, sum(px) AS pa FROM bx WHERE pred > 0 GROUP BY ALL), ga AS (SELECT image, gt, sum(px) AS ga FROM bx WHERE gt > 0 GROUP BY ALL),
    m AS (SELECT image, pred, gt, px / (pa + ga - px) AS iou FROM bx JOIN pa USING (image, pred) JOIN ga USING (image, gt)), h AS (SELECT * FROM m WHERE iou > 0.5),
    t(cut) AS (VALUES {", ".join(f"({c!r}::DOUBLE)" for c in IOUS)}), n AS (SELECT (SELECT count(*) FROM pa) AS np, (SELECT count(*) FROM ga) AS ng),
    s AS (SELECT cut, (SELECT count(*) FROM h WHERE iou >= cut) AS tp FROM t)
    SELECT round(avg(2 * tp / (np + ng)), 6) AS mean_f1, round(max(2 * tp / (np + ng)), 6) AS best_f1 FROM s, n""",
)
def dt_mean_f1(spark, sf):
    """Object F1 at overlaps of 0.50 to 0.95 and its mean; above one half the match is unique (DT-3)."""
    s = detect.sweep(boxes(spark, sf), IOUS)
    f1 = 2 * C("tp") / (2 * C("tp") + C("fp") + C("fn"))
    return s.agg(F.round(F.avg(f1), 6).alias("mean_f1"), F.round(F.max(f1), 6).alias("best_f1"))


@R.add(
    "dt_variants",
    f"""WITH {PX}, t AS (SELECT status AS camera, r / 50 >= 0.3 AS a, r / 50 >= 0.6 AS z, g >= 5 AS y FROM px), l AS (SELECT camera, 'low' AS variant, a AS p, y FROM t UNION ALL SELECT camera, 'high', z, y FROM t)
    SELECT variant, camera, round(avg(CASE WHEN p THEN 1.0 ELSE 0.0 END), 6) AS fraction,
    round(2 * count(*) FILTER (WHERE p AND y) / (count(*) FILTER (WHERE p) + count(*) FILTER (WHERE y)), 6) AS dice FROM l GROUP BY ALL""",
)
def dt_variants(spark, sf):
    """Predicted fraction and Dice by variant and camera (DT-5)."""
    px = pixels(spark, sf).select(C("status").alias("camera"), (C("g") >= 5).alias("y"), F.explode(F.array(*(F.struct(F.lit(n).alias("variant"), (C("r") / 50 >= c).alias("p")) for n, c in (("low", 0.3), ("high", 0.6))))).alias("v"))
    dice = F.try_divide(2 * F.count_if(C("v.p") & C("y")), F.count_if(C("v.p")) + F.count_if("y"))
    return rounded(px.groupBy("v.variant", "camera").agg(F.avg(C("v.p").cast("double")).alias("fraction"), dice.alias("dice")))


@R.add(
    "agg_reliability",
    f"""WITH {PX}, z AS (SELECT zone, avg(v) AS m, stddev_samp(v) / sqrt(count(*)) AS se FROM px GROUP BY zone HAVING count(*) > 1)
    SELECT count(*) AS zones, round(avg(se), 4) AS mean_se, round(stddev_samp(m), 4) AS sd_means, round(avg(se) / stddev_samp(m), 6) AS share FROM z""",
)
def agg_reliability(spark, sf):
    """How sure zone means are: mean standard error over the deviation of the means (AGG-24)."""
    z = pixels(spark, sf).groupBy("zone").agg(F.avg("v").alias("m"), (F.stddev_samp("v") / F.sqrt(F.count("v"))).alias("se"), F.count("v").alias("n")).filter("n > 1")
    out = z.agg(F.count(F.lit(1)).alias("zones"), F.avg("se").alias("mean_se"), F.stddev_samp("m").alias("sd_means"))
    return out.select("zones", F.round("mean_se", 4).alias("mean_se"), F.round("sd_means", 4).alias("sd_means"), F.round(C("mean_se") / C("sd_means"), 6).alias("share"))


@R.add(
    "agg_value_map",
    f"""WITH {PX}, z AS (SELECT zone, avg(v) AS m FROM px GROUP BY zone), t AS (SELECT zone, m FROM z WHERE zone % 4 <> 0)
    SELECT px.k, px.n, px.zone, round(coalesce(m, -1), 4) AS value FROM px LEFT JOIN t USING (zone)""",
)
def agg_value_map(spark, sf):
    """Zone values laid back on pixels through a lookup table; pixels of zones without a value get -1 (AGG-31)."""
    px = pixels(spark, sf)
    lookup = px.groupBy("zone").agg(F.avg("v").alias("m")).filter("zone % 4 <> 0")
    return px.join(lookup, "zone", "left").select("k", "n", "zone", F.round(F.coalesce("m", F.lit(-1.0)), 4).alias("value"))


@R.add(
    "agg_image_means",
    f"""WITH {PX}, i AS (SELECT zone, avg(r) AS mr, stddev_pop(r) AS sr, avg(g) AS mg, stddev_pop(g) AS sg FROM px GROUP BY zone)
    SELECT round(avg(mr), 6) AS mean_r, round(avg(sr), 6) AS sd_r, round(avg(mg), 6) AS mean_g, round(avg(sg), 6) AS sd_g FROM i""",
)
def agg_image_means(spark, sf):
    """Dataset channel statistics as means of the images' own (AGG-32)."""
    i = pixels(spark, sf).groupBy("zone").agg(*(f(c).alias(f"{n}_{c}") for c in ("r", "g") for n, f in (("mean", F.avg), ("sd", F.stddev_pop))))
    return rounded(i.agg(*(F.avg(c).alias(c) for c in i.columns[1:])))


@R.add(
    "agg_global_percentile",
    f"""WITH {PX}, s AS (SELECT v FROM px WHERE (k * 2654435761 + n * 40503) % 1000003 < 500002) SELECT count(*) AS n, round(quantile_cont(v, 0.01), 4) AS p1, round(quantile_cont(v, 0.99), 4) AS p99 FROM s""",
)
def agg_global_percentile(spark, sf):
    """Percentiles of a deterministic sample, chosen by a hash of the row's key (AGG-8, whose feature is the sample)."""
    own = pixels(spark, sf).filter((C("k") * 2_654_435_761 + C("n") * 40_503) % 1_000_003 < 500_002)
    low, high = quantiles(own, "v", (0.01, 0.99))
    return own.agg(F.count(F.lit(1)).alias("n")).select("n", F.round(F.lit(low), 4).alias("p1"), F.round(F.lit(high), 4).alias("p99"))


@R.add(
    "flt_outliers",
    f"""WITH {PX}, z AS (SELECT zone, year, sum(v) AS v FROM px GROUP BY ALL), m AS (SELECT year, median(v) AS med FROM z GROUP BY year),
    d AS (SELECT year, median(abs(v - med)) AS mad FROM z JOIN m USING (year) GROUP BY year), x AS (SELECT zone, year, v, CASE WHEN mad < 1e-9 THEN 0 ELSE 0.6745 * (v - med) / mad END AS mz FROM z JOIN m USING (year) JOIN d USING (year)),
    bad AS (SELECT DISTINCT zone FROM x WHERE abs(mz) > 2.5) SELECT zone, year, round(v, 2) AS v, round(mz, 5) + 0.0 AS mz FROM x WHERE abs(mz) <= 3.5 AND v >= 1.0 AND zone NOT IN (SELECT zone FROM bad)""",
)
def flt_outliers(spark, sf):
    """Rows whose modified z-score by season is small and value large enough, without an excluded list of zones (FLT-9)."""
    z = pixels(spark, sf).groupBy("zone", "year").agg(F.sum("v").alias("v"))
    near = z.join(z.groupBy("year").agg(F.median("v").alias("med")), "year")
    mad = near.groupBy("year").agg(F.median(F.abs(C("v") - C("med"))).alias("mad"))
    mz = F.when(C("mad") < 1e-9, 0.0).otherwise(0.6745 * (C("v") - C("med")) / C("mad"))
    x = near.join(mad, "year").select("zone", "year", "v", mz.alias("mz"))
    excluded = x.filter("abs(mz) > 2.5").select("zone").distinct()
    kept = x.filter("abs(mz) <= 3.5 and v >= 1.0").join(excluded, "zone", "left_anti")
    return kept.select("zone", "year", F.round("v", 2).alias("v"), (F.round("mz", 5) + F.lit(0.0)).alias("mz"))


@R.add(
    "win_ranked_lists",
    """WITH s AS (SELECT l_suppkey AS k, sum(CASE WHEN year(l_shipdate) = 1996 THEN l_extendedprice ELSE 0 END) AS a, sum(CASE WHEN year(l_shipdate) = 1997 THEN l_extendedprice ELSE 0 END) AS b FROM lineitem GROUP BY 1),
    r AS (SELECT k, row_number() OVER (ORDER BY a DESC, k) AS ra, row_number() OVER (ORDER BY b DESC, k) AS rb, row_number() OVER (ORDER BY a, k) AS la, row_number() OVER (ORDER BY b, k) AS lb, row_number() OVER (ORDER BY abs(b - a) DESC, k) AS rm, b - a AS gain FROM s)
    SELECT 'top' AS list, k, round(gain, 2) AS gain FROM r WHERE ra <= 20 AND rb <= 20 UNION ALL SELECT 'bottom', k, round(gain, 2) FROM r WHERE la <= 20 AND lb <= 20 UNION ALL SELECT 'movers', k, round(gain, 2) FROM r WHERE rm <= 10""",
)
def win_ranked_lists(spark, sf):
    """Overlap of two seasons' top and bottom lists, and the biggest movers (WIN-13, WIN-14); the lists' lengths are the feature."""
    year = lambda y: F.sum(F.when(F.year("l_shipdate") == y, C("l_extendedprice")).otherwise(0.0))
    s = read(spark, sf, "lineitem").groupBy(C("l_suppkey").alias("k")).agg(year(1996).alias("a"), year(1997).alias("b")).withColumn("gain", C("b") - C("a"))
    first = lambda order, n: s.orderBy(order, "k").limit(n).select("k", "gain")
    both = lambda name, a, b: first(a, 20).join(first(b, 20).select("k"), "k").select(F.lit(name).alias("list"), "k", F.round("gain", 2).alias("gain"))
    movers = first(F.desc(F.abs(C("gain"))), 10).select(F.lit("movers").alias("list"), "k", F.round("gain", 2).alias("gain"))
    return both("top", F.desc("a"), F.desc("b")).unionByName(both("bottom", F.asc("a"), F.asc("b"))).unionByName(movers)


@R.add(
    "st_pair",
    f"""WITH {PX}, a AS (SELECT zone, count(*) AS n, corr(g, v) AS r, regr_slope(v, g) AS slope, regr_intercept(v, g) AS intercept FROM px GROUP BY zone),
    e AS (SELECT zone, avg(abs(v - intercept - slope * g)) AS mae FROM px JOIN a USING (zone) GROUP BY zone)
    SELECT zone, n, round(r, 6) AS r, round(r * r, 6) AS r2, round({t_sql("(r * sqrt((n - 2) / (1 - r * r)))", "(n - 2)")}, 5) AS p, round(slope, 3) AS slope, round(intercept, 2) AS intercept, round(mae, 3) AS mae FROM a JOIN e USING (zone)""",
)
def st_pair(spark, sf):
    """Correlation, line and mean absolute error of a pair by group (ST-22)."""
    px = pixels(spark, sf)
    line = px.groupBy("zone").agg(F.regr_slope("v", "g").alias("slope"), F.regr_intercept("v", "g").alias("intercept"))
    mae = px.join(line, "zone").groupBy("zone").agg(F.avg(F.abs(C("v") - C("intercept") - C("slope") * C("g"))).alias("mae"))
    out = stats.pearson(px, "g", "v", ("zone",)).join(line, "zone").join(mae, "zone")
    digits = {"r": 6, "r2": 6, "p": 5, "slope": 3, "intercept": 2, "mae": 3}
    return out.withColumn("r2", C("r") * C("r")).select("zone", "n", *(F.round(c, d).alias(c) for c, d in digits.items()))


@R.add(
    "st_kendall_exact",
    """WITH RECURSIVE t AS (SELECT CAST(r_regionkey AS INTEGER) AS i, CAST((r_regionkey * 17) % 11 AS DOUBLE) AS x, CAST((r_regionkey * 23) % 13 AS DOUBLE) AS y FROM region),
    p AS (SELECT []::INTEGER[] AS q UNION ALL SELECT list_append(q, i) FROM p, t WHERE len(q) < 5 AND NOT list_contains(q, i)), f AS (SELECT row_number() OVER () AS id, q FROM p WHERE len(q) = 5),
    c AS (SELECT id, sum(sign(a.x - z.x) * sign(ya.y - yz.y)) / 10 AS tau FROM f, t a, t z, t ya, t yz WHERE a.i < z.i AND ya.i = q[a.i + 1] AND yz.i = q[z.i + 1] GROUP BY id),
    o AS (SELECT sum(sign(a.x - z.x) * sign(a.y - z.y)) / 10 AS t0 FROM t a, t z WHERE a.i < z.i)
    SELECT round(min(t0), 6) AS tau, round(count(*) FILTER (WHERE abs(tau) >= abs(t0) - 1e-9) / count(*), 6) AS p FROM c, o""",
)
def st_kendall_exact(spark, sf):
    """Kendall's tau of five values with its exact permutation p over all orders (ST-6, SET-6)."""
    t = read(spark, sf, "region").select(C("r_regionkey").cast("int").alias("i"), num((C("r_regionkey") * 17) % 11).alias("x"), num((C("r_regionkey") * 23) % 13).alias("y"))
    p = spark.createDataFrame([([],)], "q array<int>")
    for _ in range(5):
        p = p.join(t.select("i"), ~F.array_contains("q", C("i"))).select(F.array_append("q", C("i")).alias("q"))
    rows = p.withColumn("id", F.concat_ws(",", C("q").cast("array<string>"))).select("id", F.posexplode("q").alias("i", "to"))
    dealt = rows.join(t.select("i", "x"), "i").join(t.select(C("i").alias("to"), "y"), "to").select("id", "i", "x", "y")
    tau = stats.kendall(dealt, "x", "y", "i", ("id",)).select("id", "tau")
    own = tau.filter("id = '0,1,2,3,4'").select(C("tau").alias("t0"))
    return tau.crossJoin(F.broadcast(own)).agg(F.round(F.min("t0"), 6).alias("tau"), F.round(F.count_if(F.abs("tau") >= F.abs("t0") - 1e-9) / F.count(F.lit(1)), 6).alias("p"))


@R.add(
    "joi_spacing_radius",
    f"""WITH {SPOTS}, n AS (SELECT a.id, min(round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6)) AS d FROM su a JOIN su b ON a.id <> b.id GROUP BY a.id),
    q AS (SELECT cu.id, su.id AS crown, {"round(sqrt(pow(cu.x - su.x, 2) + pow(cu.y - su.y, 2)), 6)"} AS d FROM cu, su), m AS (SELECT id, min(struct_pack(d := d, crown := crown)) AS m FROM q GROUP BY id)
    SELECT m.m.crown AS crown, count(*) AS points FROM m JOIN n ON n.id = m.m.crown WHERE m.m.d <= least(30, n.d / 2) GROUP BY 1""",
)
def joi_spacing_radius(spark, sf):
    """Each point to its closest crown, kept within that crown's own radius (JOI-13, JOI-14)."""
    cu, su = spots(spark, sf)
    # A crown whose next one is 60 or more away has the full radius of 30.
    gaps = match.spacing(su, 60.0).select(C("id").alias("right_id"), C("d").alias("gap"))
    own = match.closest(cu, su).join(gaps, "right_id", "left")
    return own.filter(C("d") <= F.least(F.lit(30.0), F.coalesce("gap", F.lit(60.0)) / 2)).groupBy(C("right_id").alias("crown")).agg(F.count(F.lit(1)).alias("points"))


#: Three images of 72 x 50 pixels from keys; a pixel's level is the largest quantity there, times five.
IMAGE = """im AS (SELECT l_linenumber % 3 AS image, l_orderkey % 50 AS row, (l_orderkey // 50) % 72 AS col, CAST(max(l_quantity) * 5 AS INTEGER) AS v,
      CAST(max(l_quantity) * 5 AS INTEGER) AS r, CAST(min(l_quantity) * 4 AS INTEGER) AS g, CAST(max(l_partkey) % 256 AS INTEGER) AS b FROM lineitem GROUP BY ALL)"""


def image(spark, sf):
    li, k = read(spark, sf, "lineitem"), C("l_orderkey")
    by = [(C("l_linenumber") % 3).alias("image"), (k % 50).alias("row"), (F.floor(k / 50) % 72).alias("col")]
    top = (F.max("l_quantity") * 5).cast("int")
    return li.groupBy(*by).agg(top.alias("v"), top.alias("r"), (F.min("l_quantity") * 4).cast("int").alias("g"), (F.max("l_partkey") % 256).cast("int").alias("b"))


@R.add(
    "prj_equalised",
    f"""WITH {IMAGE}, d AS (SELECT 10 AS tw, 7 AS th), lim AS (SELECT image, greatest(floor(least(greatest(2.0 + (0.8 - stddev_pop(v) / 255), 1.5), 3.0) * 70 / 256), 1) AS lim FROM im GROUP BY image),
    px AS (SELECT image, v, x, y FROM im, LATERAL (SELECT unnest([col, 142 - col]) AS x), LATERAL (SELECT unnest([row, 98 - row]) AS y)
      WHERE (x = col OR x BETWEEN 72 AND 79) AND (y = row OR y BETWEEN 50 AND 55)),
    h AS (SELECT image, y // 7 AS ty, x // 10 AS tx, v, count(*) AS c FROM px GROUP BY ALL),
    n AS (SELECT image, lim, ty, tx, v FROM lim, range(8) a(ty), range(8) b(tx), range(256) l(v)),
    f AS (SELECT n.*, coalesce(h.c, 0) AS c FROM n LEFT JOIN h USING (image, ty, tx, v)),
    e AS (SELECT *, sum(greatest(c - lim, 0)) OVER (PARTITION BY image, ty, tx) AS cut FROM f),
    s AS (SELECT *, greatest(floor(256 / greatest(cut % 256, 1)), 1) AS step FROM e),
    g AS (SELECT image, ty, tx, v, least(c, lim) + floor(cut / 256) + CASE WHEN v % step = 0 AND floor(v / step) < cut % 256 THEN 1 ELSE 0 END AS c FROM s),
    l AS (SELECT image, ty, tx, v, least(round_even(sum(c) OVER (PARTITION BY image, ty, tx ORDER BY v) * (255.0::DOUBLE / 70), 0), 255) AS l FROM g),
    p AS (SELECT image, row, col, v, row / 7.0::DOUBLE - 0.5 AS fy, col / 10.0::DOUBLE - 0.5 AS fx FROM im),
    q AS (SELECT *, fy - floor(fy) AS ya, fx - floor(fx) AS xa, greatest(CAST(floor(fy) AS BIGINT), 0) AS y1, least(CAST(floor(fy) AS BIGINT) + 1, 7) AS y2,
      greatest(CAST(floor(fx) AS BIGINT), 0) AS x1, least(CAST(floor(fx) AS BIGINT) + 1, 7) AS x2 FROM p)
    SELECT q.image, q.row, q.col, q.v, CAST(round_even((a.l * (1 - xa) + b.l * xa) * (1 - ya) + (c.l * (1 - xa) + d.l * xa) * ya, 0) AS INTEGER) AS out FROM q
    JOIN l a ON a.image = q.image AND a.v = q.v AND a.ty = y1 AND a.tx = x1 JOIN l b ON b.image = q.image AND b.v = q.v AND b.ty = y1 AND b.tx = x2
    JOIN l c ON c.image = q.image AND c.v = q.v AND c.ty = y2 AND c.tx = x1 JOIN l d ON d.image = q.image AND d.v = q.v AND d.ty = y2 AND d.tx = x2""",
)
def prj_equalised(spark, sf):
    """Contrast-limited equalisation in tiles, with a limit by the image's spread (PRJ-45)."""
    return contrast.equalised(image(spark, sf), 72, 50)


@R.add(
    "prj_gamma",
    f"""WITH {IMAGE}, m AS (SELECT image, 1 / least(greatest(ln(least(greatest(avg(greatest(r, g, b) / 255.0::DOUBLE), 0.05), 0.95)) / ln(0.5::DOUBLE), 0.8), 1.3) AS e FROM im GROUP BY image)
    SELECT image, row, col, {", ".join(f"CAST(floor(least(greatest(pow({c} / 255.0::DOUBLE, e) * 255, 0), 255)) AS INTEGER) AS {c}" for c in "rgb")} FROM im JOIN m USING (image)""",
)
def prj_gamma(spark, sf):
    """Gamma by the mean brightness of the image, within bounds (PRJ-45)."""
    return contrast.flattened(image(spark, sf))
