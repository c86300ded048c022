"""Colour, scaling, filters and zonal queries on the pixel stand-in."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from verdance.functions import colour, geo, scalar
from verdance.operators import zonal
from verdance.operators.ordering import quantiles
from verdance.plans.registry import PX, Registry, pixels, read, rounded

R = Registry()
C = F.col
EBI = "CASE WHEN g / (b + 256) * (r - b + 256) <> 0 THEN (r + g + b) / (g / (b + 256) * (r - b + 256)) ELSE 0.0 END"


@R.add(
    "zonal_bloom",
    f"""WITH {PX}, e AS (SELECT *, {EBI} AS ebi FROM px), q AS (SELECT quantile_cont(ebi, 0.01) AS lo, quantile_cont(ebi, 0.99) AS hi FROM e),
    z AS (SELECT zone, greatest(lo, least(hi, ebi)) AS w, ebi FROM e, q)
    SELECT zone, s_name, count(*) AS n, round(avg(w), 6) AS mean, round(quantile_cont(w, 0.5), 6) AS p50, round(quantile_cont(w, 0.9), 6) AS p90
    FROM z LEFT JOIN supplier ON zone = s_suppkey GROUP BY zone, s_name""",
)
def zonal_bloom(spark, sf):
    """Flagship: pixels, bloom index, winsorised, aggregated by zone, joined to the zone's attributes (PRJ-1, PRJ-11, AGG-1, AGG-5, JOI-1)."""
    px = pixels(spark, sf).select("zone", colour.bloom(C("r"), C("g"), C("b")).alias("ebi"))
    per = zonal.winsorised(px, "ebi").groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.avg("ebi_w").alias("mean"), F.percentile("ebi_w", F.array(F.lit(0.5), F.lit(0.9))).alias("q"))
    sup = read(spark, sf, "supplier").select(C("s_suppkey").alias("zone"), "s_name")
    return rounded(per.join(sup, "zone", "left").select("zone", "s_name", "n", "mean", F.get("q", F.lit(0)).alias("p50"), F.get("q", F.lit(1)).alias("p90")))


@R.add(
    "prj_colour",
    f"""WITH {PX}, t AS (SELECT *, r + g + b + 1e-6 AS s FROM px), c AS (SELECT *, r / s AS rn, g / s AS gn, b / s AS bn, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM t)
    SELECT k, n, round({EBI}, 6) AS ebi, round(CASE WHEN g / (b + 1e-6) * (r - b + 1e-6) <> 0 THEN (r + g + b) / (g / (b + 1e-6) * (r - b + 1e-6)) ELSE 0 END, 4) + 0.0 AS ebi_small,
    round(CASE WHEN g + r <> 0 THEN (g - r) / (g + r) ELSE 0 END, 6) + 0.0 AS ngrdi, round((g - r) / (g + r + 256), 6) + 0.0 AS ngrdi_means, CAST(trunc(2 * b - (r + g)) AS SMALLINT) AS blue2,
    round(2 * gn - rn - bn, 6) + 0.0 AS exg, round(2 * gn - rn - bn - (1.4 * rn - gn), 6) + 0.0 AS exgr, round((g - r) / (g + r - b + 1e-6), 4) + 0.0 AS vari, round((2 * g - r - b) / (2 * g + r + b + 1e-6), 6) + 0.0 AS gli,
    round(0.441 * r - 0.811 * g + 0.385 * b + 18.78745, 6) + 0.0 AS cive, round((g * g - r * b) / (g * g + r * b + 1e-6), 6) + 0.0 AS rgbvi, round(1 - (hi - lo) / (hi + 1e-6), 6) + 0.0 AS unsat,
    round((r + g + b) / 3.0 * (1 - (hi - lo) / (hi + 1e-6)), 6) + 0.0 AS white FROM c""",
)
def prj_colour(spark, sf):
    """All colour expressions (PRJ-1, 2, 3, 5, 6, 7)."""
    px = pixels(spark, sf)
    r, g, b = C("r"), C("g"), C("b")
    own = {**colour.indices(r, g, b), "ebi": colour.bloom(r, g, b), "ngrdi": colour.greenness(r, g), "ngrdi_means": colour.greenness_of_means(r, g)}
    four = {"ebi_small": colour.bloom(r, g, b, 1e-6), "vari": own.pop("vari")}
    zero = lambda c, d: F.round(c, d) + F.lit(0.0)
    return px.select("k", "n", colour.blueness(r, g, b).alias("blue2"), *(zero(c, 6).alias(n) for n, c in own.items()), *(zero(c, 4).alias(n) for n, c in four.items()))


@R.add(
    "prj_of_means",
    f"""WITH {PX}, m AS (SELECT zone, year, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM px GROUP BY ALL)
    SELECT zone, year, round((r + g + b) / nullif(g / (b + 256) * (r - b + 256), 0), 6) AS ebi_of_means, round((g - r) / (g + r + 256), 6) AS ngrdi_of_means FROM m""",
)
def prj_of_means(spark, sf):
    """Indices of zone means (PRJ-3, PRJ-4)."""
    m = pixels(spark, sf).groupBy("zone", "year").agg(*(F.avg(c).alias(c) for c in "rgb"))
    return rounded(m.select("zone", "year", colour.bloom_of_means(C("r"), C("g"), C("b")).alias("ebi_of_means"), colour.greenness_of_means(C("r"), C("g")).alias("ngrdi_of_means")))


MATCH = """st AS (SELECT year, avg(r) AS mr, avg(g) AS mg, avg(b) AS mb, (stddev_pop(r) + stddev_pop(g) + stddev_pop(b)) / 3 AS sd FROM px {where} GROUP BY year),
    rf AS (SELECT mr AS rr, mg AS rg, mb AS rb, sd AS rsd FROM st WHERE year = 1998)"""


@R.add(
    "prj_radiometric",
    f"""WITH {PX}, {MATCH.format(where="WHERE status = 'O'")}
    SELECT k, n, round(greatest(0.0, (r - mr) * (rsd / greatest(sd, 1e-6)) + rr), 6) AS r_matched, round(greatest(0.0, (g - mg) * (rsd / greatest(sd, 1e-6)) + rg), 6) AS g_matched,
    round(greatest(0.0, (b - mb) * (rsd / greatest(sd, 1e-6)) + rb), 6) AS b_matched FROM px JOIN st USING (year), rf""",
)
def prj_radiometric(spark, sf):
    """Cross-season match with statistics of masked pixels (PRJ-8, JOI-23)."""
    out = zonal.radiometric_match(pixels(spark, sf), ["r", "g", "b"], "year", 1998, C("status") == "O")
    return rounded(out.select("k", "n", "r_matched", "g_matched", "b_matched"))


@R.add(
    "prj_radiometric_whole",
    f"""WITH {PX}, {MATCH.format(where="")}
    SELECT zone, year, round(avg(greatest(0.0, (r - mr) * (rsd / greatest(sd, 1e-6)) + rr)), 6) AS r_matched, round(avg(greatest(0.0, (g - mg) * (rsd / greatest(sd, 1e-6)) + rg)), 6) AS g_matched,
    round(avg(greatest(0.0, (b - mb) * (rsd / greatest(sd, 1e-6)) + rb)), 6) AS b_matched FROM px JOIN st USING (year), rf GROUP BY zone, year""",
)
def prj_radiometric_whole(spark, sf):
    """Whole-image statistics, and crown means of matched pixels (PRJ-9, PRJ-10)."""
    out = zonal.radiometric_match(pixels(spark, sf), ["r", "g", "b"], "year", 1998)
    return rounded(out.groupBy("zone", "year").agg(*(F.avg(f"{c}_matched").alias(f"{c}_matched") for c in "rgb")))


@R.add(
    "prj_reference_years",
    f"""WITH {PX}, m AS (SELECT zone, year, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM px GROUP BY ALL), st AS (SELECT year, avg(r) AS mr, avg(g) AS mg, avg(b) AS mb, (stddev_pop(r) + stddev_pop(g) + stddev_pop(b)) / 3 AS sd FROM px GROUP BY year),
    j AS (SELECT zone, m.year, rf.year AS ref, greatest(0.0, (r - s.mr) * (rf.sd / greatest(s.sd, 1e-6)) + rf.mr) AS r, greatest(0.0, (g - s.mg) * (rf.sd / greatest(s.sd, 1e-6)) + rf.mg) AS g, greatest(0.0, (b - s.mb) * (rf.sd / greatest(s.sd, 1e-6)) + rf.mb) AS b
      FROM m JOIN st s ON m.year = s.year, st rf)
    SELECT zone, year, ref, round({EBI}, 6) AS ebi FROM j""",
)
def prj_reference_years(spark, sf):
    """Crown means matched to every reference year (PRJ-10, CV-13). Both year tables have one row a year."""
    px = pixels(spark, sf)
    m = px.groupBy("zone", "year").agg(*(F.avg(c).alias(c) for c in "rgb"))
    st = px.groupBy("year").agg(*(F.avg(c).alias(f"m{c}") for c in "rgb"), ((F.stddev_pop("r") + F.stddev_pop("g") + F.stddev_pop("b")) / 3).alias("sd"))
    ref = st.select(C("year").alias("ref"), *(C(f"m{c}").alias(f"f{c}") for c in "rgb"), C("sd").alias("fsd"))
    j = m.join(F.broadcast(st), "year").crossJoin(F.broadcast(ref))
    moved = {c: F.greatest(F.lit(0.0), (C(c) - C(f"m{c}")) * (C("fsd") / F.greatest(C("sd"), F.lit(1e-6))) + C(f"f{c}")) for c in "rgb"}
    return rounded(j.select("zone", "year", "ref", *(v.alias(c) for c, v in moved.items())).select("zone", "year", "ref", colour.bloom(C("r"), C("g"), C("b")).alias("ebi")))


@R.add(
    "prj_scaling",
    f"""WITH {PX}, q AS (SELECT quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi, avg(v) AS mu, stddev_pop(v) AS sd FROM px)
    SELECT k, n, round(greatest(lo, least(hi, v)), 6) AS wins, round(least(1.0, greatest(0.0, (v - lo) / CASE WHEN hi - lo = 0 THEN 1e-6 ELSE hi - lo END)), 6) AS norm,
    round((v - mu) / CASE WHEN sd = 0 THEN 1.0 ELSE sd END, 6) + 0.0 AS z, round(v - avg(v) OVER (PARTITION BY year), 4) + 0.0 AS within_year, round(v - avg(v) OVER (PARTITION BY zone), 4) + 0.0 AS within_zone FROM px, q""",
)
def prj_scaling(spark, sf):
    """Winsorised, normalised, z-scored and demeaned values (PRJ-11..15). The one-row statistics are broadcast."""
    px = pixels(spark, sf)
    low, high = quantiles(px, "v", (0.01, 0.99))
    st = px.agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd"))
    j = px.crossJoin(F.broadcast(st)).withColumns({"lo": F.lit(low), "hi": F.lit(high)})
    span = C("hi") - C("lo")
    out = j.select(
        "k", "n", F.round(scalar.clip(C("v"), C("lo"), C("hi")), 6).alias("wins"), F.round(scalar.clip((C("v") - C("lo")) / F.when(span == 0, 1e-6).otherwise(span), F.lit(0.0), F.lit(1.0)), 6).alias("norm"),
        (F.round((C("v") - C("mu")) / F.when(C("sd") == 0, 1.0).otherwise(C("sd")), 6) + F.lit(0.0)).alias("z"),
        (F.round(scalar.demeaned("v", "year"), 4) + F.lit(0.0)).alias("within_year"), (F.round(scalar.demeaned("v", "zone"), 4) + F.lit(0.0)).alias("within_zone"),
    )
    return out


@R.add(
    "prj_modified_z",
    f"""WITH {PX}, m AS (SELECT zone, median(v) AS med FROM px GROUP BY zone), d AS (SELECT px.zone, median(abs(v - med)) AS mad FROM px JOIN m USING (zone) GROUP BY px.zone)
    SELECT k, n, round(CASE WHEN mad < 1e-9 THEN 0 ELSE 0.6745 * (v - med) / mad END, 6) + 0.0 AS modz FROM px JOIN m USING (zone) JOIN d USING (zone)""",
)
def prj_modified_z(spark, sf):
    """Modified z-score by zone (PRJ-16)."""
    px = pixels(spark, sf)
    m = px.groupBy("zone").agg(F.median("v").alias("med"))
    near = px.join(m, "zone")
    d = near.groupBy("zone").agg(F.median(F.abs(C("v") - C("med"))).alias("mad"))
    return rounded(near.join(d, "zone").select("k", "n", F.when(C("mad") < 1e-9, 0.0).otherwise(0.6745 * (C("v") - C("med")) / C("mad")).alias("modz")))


@R.add(
    "prj_geometry",
    """WITH p AS (SELECT c_custkey AS k, 31.5 + (c_custkey % 700) / 1000.0 AS lat, 34.2 + (c_custkey % 900) / 1000.0 AS lon, CAST(640000 + (c_custkey * 37) % 60000 AS DOUBLE) AS e, CAST(3480000 + (c_custkey * 91) % 60000 AS DOUBLE) AS n FROM customer)
    SELECT k, round(2 * 6371000.0 * asin(sqrt(least(1.0, greatest(0.0, pow(sin(radians(31.75 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(31.75)) * pow(sin(radians(34.8 - lon) / 2), 2))))), 3) AS hav,
    round(sqrt((e - 650000) * (e - 650000) + (n - 3500000) * (n - 3500000)), 4) AS planar, round(sqrt(pow((31.75 - lat) * 111320.0, 2) + pow((34.8 - lon) * 111320.0 * cos(radians(lat)), 2)), 3) AS flat_m,
    CAST(floor((3540000 - n) / 0.5) AS INTEGER) AS px_row, CAST(floor((e - 640000) / 0.5) AS INTEGER) AS px_col, CAST(floor(abs(lat)) AS BIGINT) AS deg, CAST(floor((abs(lat) - floor(abs(lat))) * 60) AS BIGINT) AS min FROM p""",
)
def prj_geometry(spark, sf):
    """Distances, pixel positions and sexagesimal parts (PRJ-17, 18, 19, 22, 24)."""
    k = C("c_custkey")
    p = read(spark, sf, "customer").select(k.alias("k"), (31.5 + (k % 700) / 1000.0).alias("lat"), (34.2 + (k % 900) / 1000.0).alias("lon"), (640_000 + (k * 37) % 60_000).cast("double").alias("e"), (3_480_000 + (k * 91) % 60_000).cast("double").alias("n"))
    row, col = geo.pixel(C("e"), C("n"), 640_000.0, 3_540_000.0, 0.5, 0.5)
    parts = geo.degrees_to_rational(C("lat"))
    at, to = F.lit(31.75), F.lit(34.8)
    return p.select("k", F.round(geo.haversine(C("lat"), C("lon"), at, to), 3).alias("hav"), F.round(F.hypot(C("e") - 650_000, C("n") - 3_500_000), 4).alias("planar"), F.round(geo.flat(C("lat"), C("lon"), at, to), 3).alias("flat_m"), row.alias("px_row"), col.alias("px_col"), F.get(parts, 0)["num"].alias("deg"), F.get(parts, 1)["num"].alias("min"))


def _utm_sql() -> str:
    """CTEs g (k, e, n, lat, lon) and u (k, lat, lon, residual): the series of the transverse Mercator grid there and back."""
    a, e2, ep2, k0 = geo.A, geo.E2, geo.EP2, geo.K0
    e1 = (1 - (1 - e2) ** 0.5) / (1 + (1 - e2) ** 0.5)
    arc = 1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256
    d = lambda x: f"{x!r}::DOUBLE"
    return f"""p AS (SELECT c_custkey AS k, CAST(640000 + (c_custkey * 37) % 60000 AS DOUBLE) AS e, CAST(3480000 + (c_custkey * 91) % 60000 AS DOUBLE) AS n FROM customer),
    m AS (SELECT *, n / {d(k0)} / {d(a * arc)} AS mu FROM p),
    f AS (SELECT *, mu + {d(1.5 * e1 - 27 * e1**3 / 32)} * sin(2 * mu) + {d(21 * e1**2 / 16 - 55 * e1**4 / 32)} * sin(4 * mu)
      + {d(151 * e1**3 / 96)} * sin(6 * mu) + {d(1097 * e1**4 / 512)} * sin(8 * mu) AS q FROM m),
    h AS (SELECT *, {d(ep2)} * pow(cos(q), 2) AS c1, pow(tan(q), 2) AS t1, {d(a)} / sqrt(1 - {d(e2)} * pow(sin(q), 2)) AS n1,
      {d(a * (1 - e2))} / pow(1 - {d(e2)} * pow(sin(q), 2), 1.5) AS r1 FROM f),
    i AS (SELECT *, (e - 500000) / (n1 * {d(k0)}) AS d FROM h),
    g AS (SELECT k, e, n, degrees(q - n1 * tan(q) / r1 * (d * d / 2 - (5 + 3 * t1 + 10 * c1 - 4 * c1 * c1 - {d(9 * ep2)}) * pow(d, 4) / 24
        + (61 + 90 * t1 + 298 * c1 + 45 * t1 * t1 - {d(252 * ep2)} - 3 * c1 * c1) * pow(d, 6) / 720)) AS lat,
      33 + degrees((d - (1 + 2 * t1 + c1) * pow(d, 3) / 6 + (5 - 2 * c1 + 28 * t1 - 3 * c1 * c1 + {d(8 * ep2)} + 24 * t1 * t1) * pow(d, 5) / 120) / cos(q)) AS lon FROM i),
    b AS (SELECT *, radians(lat) AS f, radians(lon - 33) * cos(radians(lat)) AS a, pow(tan(radians(lat)), 2) AS t1, {d(ep2)} * pow(cos(radians(lat)), 2) AS c1,
      {d(a)} / sqrt(1 - {d(e2)} * pow(sin(radians(lat)), 2)) AS nn FROM g),
    o AS (SELECT *, {d(a)} * ({d(arc)} * f - {d(3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024)} * sin(2 * f)
      + {d(15 * e2**2 / 256 + 45 * e2**3 / 1024)} * sin(4 * f) - {d(35 * e2**3 / 3072)} * sin(6 * f)) AS arc FROM b),
    u AS (SELECT k, lat, lon, sqrt(pow(e - 500000 - {d(k0)} * nn * (a + (1 - t1 + c1) * pow(a, 3) / 6 + (5 - 18 * t1 + t1 * t1 + 72 * c1 - {d(58 * ep2)}) * pow(a, 5) / 120), 2)
      + pow(n - {d(k0)} * (arc + nn * tan(f) * (a * a / 2 + (5 - t1 + 9 * c1 + 4 * c1 * c1) * pow(a, 4) / 24
        + (61 - 58 * t1 + t1 * t1 + 600 * c1 - {d(330 * ep2)}) * pow(a, 6) / 720)), 2)) AS residual FROM o)"""


UTM = _utm_sql()


@R.add("prj_utm", f"WITH {UTM} SELECT k, round(lat, 9) AS lat, round(lon, 9) AS lon, round(residual, 5) AS residual FROM u")
def prj_utm(spark, sf):
    """UTM to degrees and back, with the residual in metres (PRJ-20, PRJ-21, GRD-1)."""
    return utm(spark, sf).select("k", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), F.round("residual", 5).alias("residual"))


def utm(spark, sf):
    k = C("c_custkey")
    p = read(spark, sf, "customer").select(k.alias("k"), (640_000 + (k * 37) % 60_000).cast("double").alias("e"), (3_480_000 + (k * 91) % 60_000).cast("double").alias("n"))
    lat, lon = geo.utm_to_latlon(C("e"), C("n"))
    p = p.withColumns({"lat": lat, "lon": lon})
    e2, n2 = geo.latlon_to_utm(C("lat"), C("lon"))
    return p.select("k", "lat", "lon", F.hypot(C("e") - e2, C("n") - n2).alias("residual"))


@R.add(
    "prj_text",
    """SELECT c_custkey AS k, printf('Tree_%04d', c_custkey) AS tree, 'KEDMA-A-' || CAST(c_custkey AS VARCHAR) AS code, CAST(nullif(regexp_extract(c_name, '([0-9]+)', 1), '') AS BIGINT) AS serial,
    CASE WHEN contains(upper(c_mktsegment), 'AUTO') THEN 'auto' WHEN contains(upper(c_mktsegment), 'BUILD') THEN 'build' END AS kind, CAST(dayofyear(strptime(lpad(CAST(1 + c_custkey % 28 AS VARCHAR), 2, '0') || '/' || lpad(CAST(1 + c_custkey % 12 AS VARCHAR), 2, '0') || '/2023', '%d/%m/%Y')) AS INTEGER) AS doy,
    round_even(c_acctbal, 1) AS acct, starts_with(c_mktsegment, 'M') AS starts_m FROM customer""",
)
def prj_text(spark, sf):
    """Ids, codes, patterns, categories and dates (PRJ-26..30, PRJ-42)."""
    k = C("c_custkey")
    seg = F.upper("c_mktsegment")
    day = F.concat_ws("/", F.lpad((1 + k % 28).cast("string"), 2, "0"), F.lpad((1 + k % 12).cast("string"), 2, "0"), F.lit("2023"))
    return read(spark, sf, "customer").select(
        k.alias("k"), scalar.tree_id(k).alias("tree"), F.concat(F.lit("KEDMA-A-"), k.cast("string")).alias("code"), F.expr("try_cast(nullif(regexp_extract(c_name, '([0-9]+)', 1), '') as bigint)").alias("serial"),
        F.when(seg.contains("AUTO"), "auto").when(seg.contains("BUILD"), "build").alias("kind"), scalar.day_of_year(day).alias("doy"), F.bround("c_acctbal", 1).alias("acct"), F.startswith("c_mktsegment", F.lit("M")).alias("starts_m"),
    )


@R.add(
    "prj_terms",
    f"""WITH {PX}, z AS (SELECT *, CASE WHEN flag = 'R' THEN NULL ELSE v END AS h FROM px)
    SELECT k, n, CAST(flag = 'A' AS DOUBLE) AS is_a, CAST(year = 1994 AS DOUBLE) AS is_1994, round(r * g, 6) AS r_x_g, round(r * b, 6) AS r_x_b, round(g * b, 6) AS g_x_b, round(pow(g, 2), 6) AS g_2, round(pow(g, 3), 6) AS g_3,
    round(r - g, 6) + 0.0 AS delta, round(coalesce(h, avg(h) OVER (PARTITION BY year)), 6) AS filled, CASE WHEN h IS NULL THEN NULL ELSE round(h * r / (g + 1), 6) END AS volume, round((r + g + b) / 3.0, 6) AS ensemble,
    round(CASE WHEN g <= 0 THEN 0.0 WHEN g <= 4 THEN g * 5 WHEN g <= 8 THEN 20 + (g - 4) * 15 ELSE 80 - (least(g, 10) - 8) * 25 END, 6) AS cover FROM z""",
)
def prj_terms(spark, sf):
    """Dummies, interactions, powers, deltas, imputation, null-strict features, ensembles, lookup (PRJ-31..39)."""
    px = pixels(spark, sf).withColumn("h", F.when(C("flag") != "R", C("v")))
    # A window would sort all rows of a year in one task; the means are one row a year.
    means = px.groupBy(C("year").alias("_year")).agg(F.avg("h").alias("_mean"))
    px = px.join(F.broadcast(means), C("year").eqNullSafe(C("_year")), "left")
    anchors = [(0.0, 0.0), (4.0, 20.0), (8.0, 80.0), (10.0, 30.0)]
    return px.select(
        "k", "n", (C("flag") == "A").cast("double").alias("is_a"), (C("year") == 1994).cast("double").alias("is_1994"), *(F.round(c, 6).alias(n) for n, c in scalar.products(["r", "g", "b"]).items()), *(F.round(c, 6).alias(n) for n, c in scalar.powers("g", 3).items()),
        (F.round(C("r") - C("g"), 6) + F.lit(0.0)).alias("delta"), F.round(F.coalesce("h", "_mean"), 6).alias("filled"), F.round(C("h") * C("r") / (C("g") + 1), 6).alias("volume"), F.round((C("r") + C("g") + C("b")) / 3.0, 6).alias("ensemble"), F.round(scalar.piecewise(C("g"), anchors), 6).alias("cover"),
    )


@R.add(
    "prj_peak_and_stars",
    f"""WITH {PX}, m AS (SELECT zone, year, avg(g) * 10 AS cover, avg(b) / 100 AS p FROM px GROUP BY ALL)
    SELECT zone, year, round(80 / nullif(cover, 0), 6) AS factor, cover >= 30 AS reliable, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars FROM m""",
)
def prj_peak_and_stars(spark, sf):
    """Peak-bloom factor and significance stars (PRJ-40, PRJ-41)."""
    m = pixels(spark, sf).groupBy("zone", "year").agg((F.avg("g") * 10).alias("cover"), (F.avg("b") / 100).alias("p"))
    factor, fine = scalar.peak_factor(C("cover"))
    return rounded(m.select("zone", "year", factor.alias("factor"), fine.alias("reliable"), scalar.stars(C("p")).alias("stars")))


@R.add(
    "prj_stretch",
    f"""WITH {PX}, q AS (SELECT quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi, min(v) AS mn, max(v) AS mx FROM px WHERE v > 0)
    SELECT k, n, CAST(floor(least(255.0, greatest(0.0, (v - lo) / (hi - lo) * 255.0))) AS INTEGER) AS p2_98, CAST(floor(least(255.0, greatest(0.0, (v - mn) / (mx - mn) * 255.0))) AS INTEGER) AS minmax FROM px, q""",
)
def prj_stretch(spark, sf):
    """Percentile and min-max stretch to 0..255 (PRJ-43)."""
    px = pixels(spark, sf)
    low, high = quantiles(px.filter("v > 0"), "v", (0.02, 0.98))
    j = px.crossJoin(F.broadcast(px.filter("v > 0").agg(F.min("v").alias("mn"), F.max("v").alias("mx"))))
    return j.select("k", "n", colour.stretch(C("v"), F.lit(low), F.lit(high)).alias("p2_98"), colour.stretch(C("v"), C("mn"), C("mx")).alias("minmax"))


@R.add(
    "prj_histogram_match",
    f"""WITH {PX}, a AS (SELECT r AS x, count(*) AS c FROM px WHERE flag = 'A' GROUP BY r), ra AS (SELECT x, sum(c) OVER (ORDER BY x) / sum(c) OVER () AS f FROM a),
    t AS (SELECT round(g * 5) AS x, count(*) AS c FROM px WHERE flag = 'R' GROUP BY 1), rt AS (SELECT x, sum(c) OVER (ORDER BY x) / sum(c) OVER () AS f FROM t)
    SELECT ra.x AS value, coalesce((SELECT min(rt.x) FROM rt WHERE rt.f >= ra.f - 1e-12), (SELECT max(x) FROM rt)) AS matched FROM ra""",
)
def prj_histogram_match(spark, sf):
    """Lookup table that maps one distribution to another by their cumulative shares (PRJ-44). Both sides have one row a level."""
    px = pixels(spark, sf)

    def shares(df, v):
        h = df.groupBy(v.alias("x")).agg(F.count(F.lit(1)).alias("c"))
        return h.select("x", (F.sum("c").over(Window.orderBy("x")) / F.sum("c").over(Window.partitionBy())).alias("f"))

    src, ref = shares(px.filter("flag = 'A'"), C("r")), shares(px.filter("flag = 'R'"), F.round(C("g") * 5))
    steps = ref.agg(F.sort_array(F.collect_list(F.struct("f", "x"))).alias("s"))  # one entry a level
    hit = F.element_at(F.filter("s", lambda e: e.f >= C("f") - 1e-12), 1)["x"]
    return src.crossJoin(F.broadcast(steps)).select(C("x").alias("value"), F.coalesce(F.when(F.exists("s", lambda e: e.f >= C("f") - 1e-12), hit), F.element_at("s", -1)["x"]).alias("matched"))


@R.add(
    "prj_gray_world",
    f"""WITH {PX}, m AS (SELECT zone, avg(r) AS mr, avg(g) AS mg, avg(b) AS mb, (avg(r) + avg(g) + avg(b)) / 3 AS mm FROM px GROUP BY zone)
    SELECT k, n, round(r * mm / greatest(mr, 1e-6), 4) AS r_wb, round(g * mm / greatest(mg, 1e-6), 4) AS g_wb, round(b * mm / greatest(mb, 1e-6), 4) AS b_wb, round(255 * pow(r / 255, ln(0.5) / ln(greatest(mr / 255, 1e-6))), 4) AS r_gamma FROM px JOIN m USING (zone)""",
)
def prj_gray_world(spark, sf):
    """Gray-world balance and adaptive gamma by image (PRJ-45)."""
    px = pixels(spark, sf)
    m = px.groupBy("zone").agg(*(F.avg(c).alias(f"m{c}") for c in "rgb")).withColumn("mm", (C("mr") + C("mg") + C("mb")) / 3)
    j = px.join(m, "zone")
    gamma = F.lit(255.0) * F.pow(C("r") / 255, F.log(F.lit(0.5)) / F.log(F.greatest(C("mr") / 255, F.lit(1e-6))))
    return rounded(j.select("k", "n", *((C(c) * C("mm") / F.greatest(C(f"m{c}"), F.lit(1e-6))).alias(f"{c}_wb") for c in "rgb"), gamma.alias("r_gamma")), 4)


@R.add(
    "agg_zonal",
    f"""WITH {PX} SELECT zone, count(*) AS n, round(sum(v), 2) AS sum_v, round(avg(v), 6) AS mean_v, round(sum(r), 2) AS sum_r, round(avg(r), 6) AS mean_r FROM px GROUP BY zone""",
)
def agg_zonal(spark, sf):
    """Zonal sum, count and mean (AGG-1, AGG-2, AGG-15)."""
    out = zonal.zonal(pixels(spark, sf), ["zone"], ["v", "r"])
    return out.select("zone", "n", *(F.round(c, 2 if c[0] == "s" else 6).alias(c) for c in out.columns[2:]))


@R.add(
    "agg_moments",
    f"""WITH {PX}, m AS (SELECT *, avg(v) OVER (PARTITION BY zone) AS mu FROM px)
    SELECT zone, round(stddev_pop(v), 4) AS sd, round(var_pop(v), 1) AS var, round(avg(pow(v - mu, 3)) / pow(avg(pow(v - mu, 2)), 1.5), 6) + 0.0 AS skew, round(avg(pow(v - mu, 4)) / pow(avg(pow(v - mu, 2)), 2) - 3, 6) + 0.0 AS kurt, round(stddev_pop(v) / avg(v), 6) AS cv FROM m GROUP BY zone""",
)
def agg_moments(spark, sf):
    """Zonal moments (AGG-4)."""
    out = zonal.moments(pixels(spark, sf), ["zone"], "v")
    return out.select("zone", F.round("sd", 4).alias("sd"), F.round("var", 1).alias("var"), *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("skew", "kurt", "cv")))


@R.add(
    "agg_percentiles",
    f"""WITH {PX} SELECT zone, year, round(quantile_cont(v, 0.1), 4) AS p10, round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.75), 4) AS p75, round(quantile_cont(v, 0.9), 4) AS p90, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 4) AS iqr FROM px GROUP BY ALL""",
)
def agg_percentiles(spark, sf):
    """Zonal percentiles (AGG-5, AGG-8)."""
    return rounded(zonal.percentiles(pixels(spark, sf), ["zone", "year"], "v"), 4)


@R.add(
    "agg_year_matrix",
    """SELECT o_custkey, """ + ", ".join(f"coalesce(sum(CASE WHEN year(o_orderdate) = {y} THEN 1 END), 0)::BIGINT AS y{y}" for y in range(1995, 2002)) + " FROM orders GROUP BY o_custkey",
)
def agg_year_matrix(spark, sf):
    """Wide year matrix, missing is 0 (AGG-3, SNK-1)."""
    o = read(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), F.lit(1).cast("bigint").alias("one"))
    return zonal.pivot_years(o, "o_custkey", "y", "one", list(range(1995, 2002)))


@R.add(
    "agg_robust_mean",
    f"""WITH {PX}, m AS (SELECT zone, median(r) AS mr, median(g) AS mg, median(b) AS mb FROM px GROUP BY zone), d AS (SELECT zone, median(abs(r - mr)) AS dr, median(abs(g - mg)) AS dg, median(abs(b - mb)) AS db FROM px JOIN m USING (zone) GROUP BY zone),
    f AS (SELECT px.*, (dr < 1e-9 OR abs(0.6745 * (r - mr) / dr) <= 1.2) AND (dg < 1e-9 OR abs(0.6745 * (g - mg) / dg) <= 1.2) AND (db < 1e-9 OR abs(0.6745 * (b - mb) / db) <= 1.2) AS keep FROM px JOIN m USING (zone) JOIN d USING (zone))
    SELECT zone, round(CASE WHEN count(*) FILTER (WHERE keep) >= 5 THEN avg(v) FILTER (WHERE keep) ELSE avg(v) END, 4) AS v_robust, round(100.0 * (count(*) - count(*) FILTER (WHERE keep)) / count(*), 4) AS pct_out FROM f GROUP BY zone""",
)
def agg_robust_mean(spark, sf):
    """Outlier-robust zonal mean with fallback (AGG-6)."""
    return rounded(zonal.robust_mean(pixels(spark, sf), ["zone"], ["r", "g", "b"], ["v"], 1.2), 4)


@R.add(
    "agg_trimmed_mean",
    f"""WITH {PX}, l AS (SELECT *, (r + g + b) / 3.0 AS light FROM px), c AS (SELECT zone, quantile_cont(light, 0.05) AS lo, quantile_cont(light, 0.95) AS hi FROM l GROUP BY zone)
    SELECT zone, round(avg(v), 4) AS v_trim FROM l JOIN c USING (zone) WHERE light BETWEEN lo AND hi GROUP BY zone""",
)
def agg_trimmed_mean(spark, sf):
    """Brightness-trimmed zonal mean (AGG-7)."""
    return rounded(zonal.trimmed_mean(pixels(spark, sf), ["zone"], colour.brightness(C("r"), C("g"), C("b")), ["v"]), 4)


@R.add(
    "agg_otsu",
    f"""WITH {PX}, e AS (SELECT flag, min(v) AS a, max(v) AS z, (max(v) - min(v)) / 256 AS w FROM px GROUP BY flag), h AS (SELECT flag, a, w, CAST(least(255, floor((v - a) / w)) AS INTEGER) AS bin, count(*)::DOUBLE AS c FROM px JOIN e USING (flag) GROUP BY ALL),
    m AS (SELECT flag, bin, c, a + (bin + 0.5) * w AS mid FROM h), s AS (SELECT flag, bin, mid, sum(c) OVER p AS w0, sum(c * mid) OVER p AS s0, sum(c) OVER (PARTITION BY flag) AS n, sum(c * mid) OVER (PARTITION BY flag) AS s FROM m WINDOW p AS (PARTITION BY flag ORDER BY bin)),
    t AS (SELECT flag, bin, mid, round(CASE WHEN w0 > 0 AND n - w0 > 0 THEN w0 * (n - w0) * pow(s0 / w0 - (s - s0) / (n - w0), 2) ELSE 0 END / greatest(n * n, 1), 6) AS score FROM s),
    o AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY score DESC, bin) AS i FROM t) SELECT flag, round(mid, 4) AS threshold FROM o WHERE i = 1""",
)
def agg_otsu(spark, sf):
    """Otsu threshold by group (AGG-9, WIN-9)."""
    return rounded(zonal.otsu(pixels(spark, sf), ["flag"], "v"), 4)


@R.add(
    "agg_fractions",
    f"""WITH {PX} SELECT zone, """ + ", ".join(f"round(avg(CASE WHEN r > {t} THEN 1.0 ELSE 0.0 END), 6) AS frac_{i}, round(count(*) FILTER (WHERE r > {t}) / (count(*) * 0.25), 6) AS dens_{i}" for i, t in enumerate((20, 30, 45))) + " FROM px GROUP BY zone",
)
def agg_fractions(spark, sf):
    """Exceedance fractions and densities (AGG-12, FLT-15)."""
    return rounded(zonal.fractions(pixels(spark, sf), ["zone"], "r", (20.0, 30.0, 45.0), F.count(F.lit(1)) * 0.25))


@R.add(
    "agg_scene_stats",
    f"""WITH {PX}, s AS (SELECT 'whole' AS scope, * FROM px UNION ALL SELECT 'canopy', * FROM px WHERE status = 'O' UNION ALL SELECT 'ground', * FROM px WHERE status <> 'O')
    SELECT scope, year, count(*) AS n, round(avg(r), 6) AS mean_r, round(stddev_pop(r), 6) AS sd_r, round(avg(g), 6) AS mean_g, round(stddev_pop(g), 6) AS sd_g FROM s GROUP BY ALL""",
)
def agg_scene_stats(spark, sf):
    """Channel statistics for canopy, ground and whole scene in one scan (AGG-13, AGG-32, FLT-1, FLT-2)."""
    masks = {"whole": F.lit(True), "canopy": C("status") == "O", "ground": C("status") != "O"}
    return rounded(zonal.scene_stats(pixels(spark, sf), masks, ["r", "g"], ["year"]))


@R.add(
    "agg_canopy",
    f"""WITH {PX} SELECT zone, count(*) FILTER (WHERE status = 'O') AS canopy_px, round(count(*) FILTER (WHERE status = 'O') * 0.0025::DOUBLE, 6) AS area, CASE WHEN count(*) FILTER (WHERE status <> 'O') >= 20 THEN round(avg(CASE WHEN r < 10 THEN 1.0 ELSE 0.0 END) FILTER (WHERE status <> 'O'), 6) END AS shadow,
    round(count(*) FILTER (WHERE status = 'O') / count(*)::DOUBLE, 6) AS cover, round(640000 + (avg(n) + 0.5) * 0.05, 6) AS x, round(3540000 - (avg(k % 1000) + 0.5) * 0.05, 6) AS y FROM px GROUP BY zone""",
)
def agg_canopy(spark, sf):
    """Canopy area, shadow and cover fractions with support guards, and zone centroids (AGG-10, AGG-11, FLT-10, FLT-11)."""
    canopy, ground = C("status") == "O", C("status") != "O"
    x, y = geo.world(F.avg(C("k") % 1000), F.avg("n"), 640_000.0, 3_540_000.0, 0.05, 0.05)
    return rounded(pixels(spark, sf).groupBy("zone").agg(
        F.count_if(canopy).alias("canopy_px"), (F.count_if(canopy) * 0.0025).alias("area"), F.when(F.count_if(ground) >= 20, F.avg(F.when(ground, (C("r") < 10).cast("double")))).alias("shadow"), (F.count_if(canopy) / F.count(F.lit(1))).alias("cover"), x.alias("x"), y.alias("y")))


@R.add(
    "agg_resample",
    f"""WITH {PX} SELECT CAST(floor(zone / 4.0) AS BIGINT) AS gx, CAST(floor(n / 2.0) AS BIGINT) AS gy, round(avg(v), 4) AS v, count(*) AS n_px FROM px GROUP BY 1, 2""",
)
def agg_resample(spark, sf):
    """Averaging resample to a coarser grid (SRC-13, UP-9)."""
    return rounded(pixels(spark, sf).groupBy(F.floor(C("zone") / 4.0).alias("gx"), F.floor(C("n") / 2.0).alias("gy")).agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("n_px")), 4)


@R.add(
    "flt_polygon",
    """WITH p AS (SELECT c_custkey AS k, CAST((c_custkey * 37) % 1000 AS DOUBLE) AS x, CAST((c_custkey * 91) % 1000 AS DOUBLE) AS y FROM customer),
    e(x1, y1, x2, y2) AS (VALUES (100.0, 120.0, 900.0, 80.0), (900.0, 80.0, 820.0, 900.0), (820.0, 900.0, 150.0, 780.0), (150.0, 780.0, 100.0, 120.0))
    SELECT k FROM p, e GROUP BY k HAVING sum(CASE WHEN (y1 > y) <> (y2 > y) AND x < (y - y1) * ((x2 - x1) / (y2 - y1)) + x1 THEN 1 ELSE 0 END) % 2 = 1""",
)
def flt_polygon(spark, sf):
    """Points within a four-corner plot (FLT-3, SRC-12)."""
    k = C("c_custkey")
    inside = geo.in_polygon(((k * 37) % 1000).cast("double"), ((k * 91) % 1000).cast("double"), [(100.0, 120.0), (900.0, 80.0), (820.0, 900.0), (150.0, 780.0)])
    return read(spark, sf, "customer").filter(inside).select(k.alias("k"))


@R.add(
    "flt_rows",
    """SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate <= TIMESTAMP '1996-12-31 23:59:59' AND month(o_orderdate) IN (1, 2) AND o_orderstatus IN ('O', 'F') AND o_totalprice BETWEEN 50000 AND 400000
    AND o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""",
)
def flt_rows(spark, sf):
    """Closed time range, months, categories, ranges, complete rows and an excluded list (FLT-4..9, SRC-21)."""
    o = read(spark, sf, "orders").filter(C("o_orderdate").between(F.lit("1996-01-01 00:00:00").cast("timestamp_ntz"), F.lit("1996-12-31 23:59:59").cast("timestamp_ntz")) & F.month("o_orderdate").isin(1, 2) & C("o_orderstatus").isin("O", "F") & C("o_totalprice").between(50_000, 400_000))
    out = read(spark, sf, "customer").filter("c_acctbal < 0").select(C("c_custkey").alias("o_custkey"))
    return o.dropna(subset=["o_custkey"]).join(out, "o_custkey", "left_anti").select("o_orderkey", "o_orderpriority")


@R.add(
    "flt_small_objects",
    """WITH a AS (SELECT l_suppkey AS img, l_partkey AS obj, CAST(sum(l_quantity) AS DOUBLE) AS area FROM lineitem GROUP BY ALL), m AS (SELECT img, greatest(10.0, 0.8 * median(area)) AS least_area FROM a GROUP BY img) SELECT img, obj, area FROM a JOIN m USING (img) WHERE area >= least_area""",
)
def flt_small_objects(spark, sf):
    """Objects under a minimum that follows their image's median area go (FLT-14)."""
    a = read(spark, sf, "lineitem").groupBy(C("l_suppkey").alias("img"), C("l_partkey").alias("obj")).agg(F.sum("l_quantity").alias("area"))
    m = a.groupBy("img").agg(F.greatest(F.lit(10.0), 0.8 * F.median("area")).alias("least_area"))
    return a.join(m, "img").filter("area >= least_area").select("img", "obj", "area")


@R.add(
    "flt_quality_gate",
    """WITH g AS (SELECT l_suppkey AS img, count(*) AS n, avg(l_quantity) AS mean_shift, max(l_quantity) AS max_shift, max(l_extendedprice) AS width FROM lineitem GROUP BY 1), m AS (SELECT median(width) AS med FROM g)
    SELECT s_suppkey AS img FROM supplier LEFT JOIN g ON s_suppkey = img, m WHERE n IS NULL OR n < 10 OR mean_shift > 25.5 OR max_shift > 50 OR width > 1.5 * med""",
)
def flt_quality_gate(spark, sf):
    """Images rejected for missing or weak registration (FLT-18, SRC-26)."""
    g = read(spark, sf, "lineitem").groupBy(C("l_suppkey").alias("img")).agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("mean_shift"), F.max("l_quantity").alias("max_shift"), F.max("l_extendedprice").alias("width"))
    all_ = read(spark, sf, "supplier").select(C("s_suppkey").alias("img")).join(g, "img", "left").crossJoin(F.broadcast(g.agg(F.median("width").alias("med"))))
    return all_.filter("n is null or n < 10 or mean_shift > 25.5 or max_shift > 50 or width > 1.5 * med").select("img")


@R.add(
    "prj_frame_offsets",
    f"""WITH {PX}, o(year, dx, dy) AS (VALUES (1996, 1.5, -2.0), (1997, 0.25, 4.0), (1998, 66.15, 0.0)) SELECT k, n, round(r + CAST(dx AS DOUBLE), 6) AS x, round(g + CAST(dy AS DOUBLE), 6) AS y FROM px JOIN o USING (year)""",
)
def prj_frame_offsets(spark, sf):
    """Constant frame offsets a season (PRJ-23). The offsets are three literal rows."""
    o = spark.createDataFrame([(1996, 1.5, -2.0), (1997, 0.25, 4.0), (1998, 66.15, 0.0)], "year int, dx double, dy double")
    return pixels(spark, sf).join(F.broadcast(o), "year").select("k", "n", F.round(C("r") + C("dx"), 6).alias("x"), F.round(C("g") + C("dy"), 6).alias("y"))


@R.add(
    "prj_latency",
    "WITH s AS (SELECT event_id, CAST(user_id AS DOUBLE) AS x, value / 100 AS speed FROM events) SELECT event_id, round(x - speed * 0.35, 6) AS x, round(0.5 * speed, 6) AS uncertainty, CASE WHEN 0.5 * speed > 1 THEN 'HIGH' ELSE 'OK' END AS flag FROM s",
)
def prj_latency(spark, sf):
    """Velocity and latency correction with uncertainty (PRJ-25)."""
    s = read(spark, sf, "events").select("event_id", C("user_id").cast("double").alias("x"), (C("value") / 100).alias("speed"))
    return s.select("event_id", F.round(C("x") - C("speed") * 0.35, 6).alias("x"), F.round(0.5 * C("speed"), 6).alias("uncertainty"), F.when(0.5 * C("speed") > 1, "HIGH").otherwise("OK").alias("flag"))


@R.add(
    "flt_flight_phase",
    "WITH f AS (SELECT user_id, min_by(value, struct_pack(t := ts, e := event_id)) AS v0 FROM events GROUP BY user_id) SELECT event_id FROM events JOIN f USING (user_id) WHERE trim(event_type) = 'view' AND value > v0 + 50",
)
def flt_flight_phase(spark, sf):
    """Phase and altitude over the start of the flight (FLT-12)."""
    e = read(spark, sf, "events")
    f = e.groupBy("user_id").agg(F.min_by("value", F.struct("ts", "event_id")).alias("v0"))
    return e.join(f, "user_id").filter((F.trim("event_type") == "view") & (C("value") > C("v0") + 50)).select("event_id")
