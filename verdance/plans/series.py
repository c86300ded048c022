"""Window, time-series and set queries on events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from verdance.operators import timeseries as ts
from verdance.plans.registry import Registry, micros, read, rounded

R = Registry()
C = F.col
#: Hourly station stand-in: temperature, humidity, rain and wind from events.
HR = """hr AS (SELECT date_trunc('hour', ts) AS hour, avg(value % 30) - 2 AS t, max(value % 30) - 2 AS tmax, min(value % 30) - 2 AS tmin, avg(value % 100) AS rh, coalesce(sum(CASE WHEN event_type = 'view' THEN value / 100 END), 0) AS rain, avg(value % 12) AS wind FROM events GROUP BY 1)"""


def station(spark, sf):
    e = read(spark, sf, "events").select("ts", (C("value") % 30 - 2).alias("t"), (C("value") % 100).alias("rh"), F.when(C("event_type") == "view", C("value") / 100).alias("rain"), (C("value") % 12).alias("wind"))
    return ts.hourly(e, [], "ts", {"t": ("t", "avg"), "tmax": ("t", "max"), "tmin": ("t", "min"), "rh": ("rh", "avg"), "rain": ("rain", "sum"), "wind": ("wind", "avg")}, "t")


@R.add("ts_hourly", f"WITH {HR} SELECT epoch_us(hour) AS hour, round(t, 6) AS t, round(tmax, 6) AS tmax, round(tmin, 6) AS tmin, round(rh, 6) AS rh, round(rain, 6) AS rain, round(wind, 6) AS wind FROM hr")
def ts_hourly(spark, sf):
    """Hourly resample (TS-1, TS-2, SRC-5)."""
    return rounded(station(spark, sf).withColumn("hour", micros("hour")))


@R.add("ts_daily", f"WITH {HR}, d AS (SELECT CAST(hour AS DATE) AS day, max(tmax) AS high, min(tmin) AS low FROM hr GROUP BY 1) SELECT CAST(day AS VARCHAR) AS day, round(high, 6) AS high, round(low, 6) AS low, round(greatest((high + low) / 2 - 4.5, 0), 6) AS gdd, round(high - low, 6) AS dtr FROM d")
def ts_daily(spark, sf):
    """Daily extremes, degree days and range (TS-3, TS-4)."""
    return rounded(ts.daily(station(spark, sf), [], "hour", "tmax", "tmin").withColumn("day", C("day").cast("string")))


FOLD1 = "s.x * exp(-k1) + k0 / k1 * (1 - exp(-k1))"


@R.add(
    "ts_chill",
    f"""WITH RECURSIVE {HR}, o AS (SELECT row_number() OVER (ORDER BY hour) AS i, t FROM hr), p AS (SELECT i, 139500.0::DOUBLE * exp(-4153.5::DOUBLE / (t + 273.15)) AS k0, 2.567e18::DOUBLE * exp(-12888.8::DOUBLE / (t + 273.15)) AS k1,
      exp(1.6::DOUBLE * 277 * (t + 273 - 277) / (t + 273)) AS sr, 139500.0::DOUBLE / 2.567e18::DOUBLE * exp((12888.8::DOUBLE - 4153.5::DOUBLE) / (t + 273)) AS xs, 2.567e18::DOUBLE * exp(-12888.8::DOUBLE / (t + 273)) AS ak FROM o),
    s AS (SELECT 0::BIGINT AS i, 0.0::DOUBLE AS x, 0.0::DOUBLE AS p, 0.0::DOUBLE AS x2, 0.0::DOUBLE AS p2 UNION ALL
      SELECT i, CASE WHEN x >= 1 THEN x - 1 ELSE x END, CASE WHEN x >= 1 THEN p + 1 ELSE p END, CASE WHEN x2 >= 1 THEN x2 - x2 * xi ELSE x2 END, CASE WHEN x2 >= 1 THEN p2 + x2 * xi ELSE p2 END
      FROM (SELECT p.i, s.x * exp(-k1) + k0 / k1 * (1 - exp(-k1)) AS x, s.p, xs - (xs - s.x2) * exp(-ak) AS x2, s.p2, sr / (1 + sr) AS xi FROM s JOIN p ON p.i = s.i + 1))
    SELECT round(max(p), 6) AS whole, round(max(p2), 4) AS partial FROM s""",
)
def ts_chill(spark, sf):
    """Both dynamic chill models (TS-5, TS-6)."""
    h = station(spark, sf)
    a = ts.chill_portions(h.withColumn("s", F.lit(1)), ["s"], "hour", "t").withColumnRenamed("portions", "whole")
    b = ts.chill_portions_partial(h.withColumn("s", F.lit(1)), ["s"], "hour", "t").withColumnRenamed("portions", "partial")
    return a.join(b, "s").select(F.round("whole", 6).alias("whole"), F.round("partial", 4).alias("partial"))


@R.add(
    "ts_season",
    f"""WITH {HR}, u AS (SELECT *, CASE WHEN t <= 1.4 THEN 0 WHEN t <= 2.4 THEN 0.5 WHEN t <= 9.1 THEN 1 WHEN t <= 12.4 THEN 0.5 WHEN t <= 15.9 THEN 0 WHEN t <= 18 THEN -0.5 ELSE -1 END AS cu FROM hr)
    SELECT CAST(month(hour) AS INTEGER) AS month, CAST(round(sum(cu), 2) AS DOUBLE) AS utah, count(*) FILTER (WHERE t <= 7) AS cold_7, count(*) FILTER (WHERE t BETWEEN 0 AND 7.2) AS cold_0_7, count(*) FILTER (WHERE t <= 0) AS frost, count(*) FILTER (WHERE t > 25) AS heat,
    round(sum(rain), 4) AS rain, count(*) FILTER (WHERE wind > 5) AS windy, round(sum(rh) * 3600 / 1e6, 6) AS radiation FROM u GROUP BY 1""",
)
def ts_season(spark, sf):
    """Seasonal hours and sums (TS-7, TS-8, TS-10)."""
    h = station(spark, sf)
    return h.groupBy(F.month("hour").alias("month")).agg(
        F.round(F.sum(ts.utah(C("t"))), 2).alias("utah"), F.count_if(C("t") <= 7).alias("cold_7"), F.count_if(C("t").between(0, 7.2)).alias("cold_0_7"), F.count_if(C("t") <= 0).alias("frost"), F.count_if(C("t") > 25).alias("heat"),
        F.round(F.sum("rain"), 4).alias("rain"), F.count_if(C("wind") > 5).alias("windy"), F.round(F.sum("rh") * 3600 / 1e6, 6).alias("radiation"),
    )


@R.add(
    "ts_ratio_to_trees",
    f"""WITH {HR}, d AS (SELECT CAST(hour AS DATE) AS day, max(tmax) AS high, min(tmin) AS low FROM hr GROUP BY 1), g AS (SELECT sum(greatest((high + low) / 2 - 4.5, 0)) AS gdd FROM d), c AS (SELECT count(*) FILTER (WHERE t <= 7) AS cold FROM hr)
    SELECT s_suppkey AS tree, cold, round(CASE WHEN gdd > 0 THEN cold / gdd ELSE 0 END, 6) AS ratio FROM supplier, g, c""",
)
def ts_ratio_to_trees(spark, sf):
    """Chill to heat ratio, a season's value on every tree (TS-11). One row is broadcast."""
    h = station(spark, sf)
    one = h.agg(F.count_if(C("t") <= 7).alias("cold")).crossJoin(ts.daily(h, [], "hour", "tmax", "tmin").agg(F.sum("gdd").alias("gdd")))
    return read(spark, sf, "supplier").select(C("s_suppkey").alias("tree")).crossJoin(F.broadcast(one)).select("tree", "cold", F.round(F.when(C("gdd") > 0, C("cold") / C("gdd")).otherwise(0.0), 6).alias("ratio"))


@R.add(
    "win_longest_run",
    """WITH e AS (SELECT user_id, ts, event_id, value % 100 < 35 AS dry FROM events), g AS (SELECT *, sum(CASE WHEN dry THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS grp FROM e), n AS (SELECT user_id, grp, count(*) FILTER (WHERE dry) AS n FROM g GROUP BY ALL) SELECT user_id, max(n) AS longest FROM n GROUP BY user_id""",
)
def win_longest_run(spark, sf):
    """Longest dry run (WIN-8)."""
    return ts.longest_run(read(spark, sf, "events"), ["user_id"], "event_id", C("value") % 100 < 35)


@R.add("win_gaps", "WITH e AS (SELECT user_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS start, ts AS \"end\" FROM events) SELECT user_id, epoch_us(start) AS start, epoch_us(\"end\") AS \"end\", (epoch_us(\"end\") - epoch_us(start)) / 1e6 AS seconds FROM e WHERE epoch_us(\"end\") - epoch_us(start) > 100000 * 1e6")
def win_gaps(spark, sf):
    """Gaps between flights (WIN-3)."""
    return ts.gaps(read(spark, sf, "events"), ["user_id"], "ts", 100_000.0).select("user_id", micros("start").alias("start"), micros("end").alias("end"), "seconds")


@R.add(
    "win_ranks",
    """SELECT event_id, rank() OVER w + (count(*) OVER (PARTITION BY event_type, CAST(value AS INTEGER)) - 1) / 2 AS avg_rank, CAST(row_number() OVER (PARTITION BY event_type ORDER BY CAST(value AS INTEGER), event_id) AS INTEGER) AS ordinal FROM events WINDOW w AS (PARTITION BY event_type ORDER BY CAST(value AS INTEGER))""",
)
def win_ranks(spark, sf):
    """Average-tie and ordinal ranks (WIN-1, WIN-2)."""
    e = read(spark, sf, "events").withColumn("v", F.bround("value").cast("int"))
    w = Window.partitionBy("event_type").orderBy("v")
    return e.select("event_id", (F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy("event_type", "v")) - 1) / 2).alias("avg_rank"), F.row_number().over(Window.partitionBy("event_type").orderBy("v", "event_id")).alias("ordinal"))


@R.add(
    "win_within_hour",
    """SELECT event_id, CAST(row_number() OVER w - 1 AS DOUBLE) / count(*) OVER (PARTITION BY user_id, date_trunc('day', ts)) AS fraction, round((epoch_us(lead(ts) OVER u) - epoch_us(ts)) / 1e6, 6) AS to_next, round(abs(value - lag(value) OVER u) / nullif((epoch_us(ts) - epoch_us(lag(ts) OVER u)) / 1e6, 0), 9) AS speed,
    last_value(CASE WHEN event_type = 'error' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS state FROM events WINDOW w AS (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id), u AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def win_within_hour(spark, sf):
    """Sequence within a period, lead and lag rates, forward fill (WIN-4..7, SRC-18)."""
    day = F.date_trunc("day", C("ts"))
    w, u = Window.partitionBy("user_id", day).orderBy("ts", "event_id"), Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return read(spark, sf, "events").select(
        "event_id", ((F.row_number().over(w) - 1) / F.count(F.lit(1)).over(Window.partitionBy("user_id", day))).alias("fraction"), F.round((us(F.lead("ts").over(u)) - us(C("ts"))) / 1e6, 6).alias("to_next"),
        F.round(F.try_divide(F.abs(C("value") - F.lag("value").over(u)), (us(C("ts")) - us(F.lag("ts").over(u))) / 1e6), 9).alias("speed"), F.last(F.when(C("event_type") == "error", C("value")), ignorenulls=True).over(u.rowsBetween(Window.unboundedPreceding, 0)).alias("state"),
    )


CURVE = "cv AS (SELECT user_id, CAST(dayofyear(ts) AS INTEGER) AS d, sum(value) AS v FROM events GROUP BY ALL), cc AS (SELECT user_id, d, sum(v) OVER (PARTITION BY user_id ORDER BY d) * 100 / sum(v) OVER (PARTITION BY user_id) AS pct FROM cv)"


def curve(spark, sf):
    v = read(spark, sf, "events").groupBy("user_id", F.dayofyear("ts").alias("d")).agg(F.sum("value").alias("v"))
    w = Window.partitionBy("user_id")
    return v.select("user_id", "d", (F.sum("v").over(w.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)) * 100 / F.sum("v").over(w)).alias("pct"))


def _cross(level):
    return f"min(CASE WHEN px IS NULL AND pct >= {level} THEN d WHEN py < {level} AND pct >= {level} THEN px + ({level} - py) / (pct - py) * (d - px) END)"


@R.add("win_crossing", f"WITH {CURVE}, l AS (SELECT *, CAST(lag(d) OVER w AS DOUBLE) AS px, lag(pct) OVER w AS py FROM cc WINDOW w AS (PARTITION BY user_id ORDER BY d)) SELECT user_id, round({_cross(10)}, 6) AS t10, round({_cross(50)}, 6) AS t50, round({_cross(90)}, 6) AS t90, round({_cross(90)} - {_cross(10)}, 6) AS duration FROM l GROUP BY user_id")
def win_crossing(spark, sf):
    """Crossing days and duration (WIN-10, WIN-12)."""
    c = curve(spark, sf)
    out = None
    for level in (10.0, 50.0, 90.0):
        own = ts.crossing(c, ["user_id"], "d", "pct", level).withColumnRenamed("at", f"t{level:.0f}")
        out = own if out is None else out.join(own, "user_id")
    return rounded(out.withColumn("duration", C("t90") - C("t10")))


@R.add("win_interpolate_at", f"WITH {CURVE}, b AS (SELECT user_id, max(CASE WHEN d <= 15 THEN d END) AS lx, min(CASE WHEN d >= 15 THEN d END) AS hx FROM cc GROUP BY user_id) SELECT b.user_id, round(CASE WHEN lx IS NULL THEN h.pct WHEN hx IS NULL OR lx = hx THEN l.pct ELSE l.pct + (15.0 - lx) / (hx - lx) * (h.pct - l.pct) END, 6) AS y FROM b LEFT JOIN cc l ON l.user_id = b.user_id AND l.d = lx LEFT JOIN cc h ON h.user_id = b.user_id AND h.d = hx")
def win_interpolate_at(spark, sf):
    """Value at a day, clamped (WIN-11)."""
    return rounded(ts.interpolate_at(curve(spark, sf), ["user_id"], "d", "pct", 15.0))


@R.add("win_movers", "WITH a AS (SELECT l_suppkey AS k, sum(l_extendedprice) AS v FROM lineitem WHERE year(l_shipdate) = 1996 GROUP BY 1 ORDER BY v DESC, k LIMIT 30), b AS (SELECT l_suppkey AS k, sum(l_extendedprice) AS v FROM lineitem WHERE year(l_shipdate) = 1997 GROUP BY 1 ORDER BY v DESC, k LIMIT 30) SELECT k FROM a INTERSECT SELECT k FROM b")
def win_movers(spark, sf):
    """Overlap of two seasons' top lists (SET-3)."""
    top = lambda y: read(spark, sf, "lineitem").filter(F.year("l_shipdate") == y).groupBy(C("l_suppkey").alias("k")).agg(F.sum("l_extendedprice").alias("v")).orderBy(F.desc("v"), "k").limit(30).select("k")
    return top(1996).intersect(top(1997))


KERNEL = ts.gaussian_kernel(1.0, 2)


@R.add("win_smooth", "WITH h AS (SELECT event_type, CAST(floor(value / 10) AS BIGINT) AS bin, CAST(count(*) AS DOUBLE) AS c FROM events GROUP BY ALL), s AS (SELECT event_type, bin, " + " + ".join(f"coalesce({'lag' if i < 0 else 'lead'}(c, {abs(i)}) OVER w, 0) * {k!r}::DOUBLE" for i, k in zip(range(-2, 3), KERNEL, strict=True)) + " AS smooth FROM h WINDOW w AS (PARTITION BY event_type ORDER BY bin)), m AS (SELECT *, lag(smooth) OVER w AS a, lead(smooth) OVER w AS b FROM s WINDOW w AS (PARTITION BY event_type ORDER BY bin)) SELECT event_type, bin, round(smooth, 6) AS smooth FROM m WHERE smooth > a AND smooth >= b")
def win_smooth(spark, sf):
    """Smoothed histogram and its local maxima (WIN-15, AGG-30)."""
    h = read(spark, sf, "events").groupBy("event_type", F.floor(C("value") / 10).alias("bin")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    return rounded(ts.local_maxima(ts.smoothed(h, ["event_type"], "bin", "c"), ["event_type"], "bin", "smooth").select("event_type", "bin", "smooth"))


@R.add("set_operations", "SELECT 'union' AS op, count(*) AS n FROM (SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer) UNION ALL SELECT 'all', count(*) FROM (SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer) UNION ALL SELECT 'rest', count(*) FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'pairs', count(*) FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey UNION ALL SELECT 'grid', count(*) FROM region, (VALUES (1), (2), (3))")
def set_operations(spark, sf):
    """Unions, difference, pairs and a parameter grid (SET-1, 2, 4, 7, 8)."""
    o, c, r = read(spark, sf, "orders").select(C("o_custkey").alias("k")), read(spark, sf, "customer").select(C("c_custkey").alias("k")), read(spark, sf, "region").select("r_regionkey")
    pairs = r.alias("a").join(r.alias("b"), C("a.r_regionkey") < C("b.r_regionkey"))
    made = {"union": o.union(c).distinct(), "all": o.unionByName(c), "rest": c.subtract(o), "pairs": pairs.select(F.lit(1)), "grid": r.crossJoin(spark.range(3))}
    out = None
    for name, df in made.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@R.add("set_permutations", "WITH RECURSIVE n AS (SELECT count(*) AS n FROM region), p AS (SELECT []::BIGINT[] AS perm UNION ALL SELECT list_append(perm, r_regionkey) FROM p, region, n WHERE len(perm) < n AND NOT list_contains(perm, r_regionkey)) SELECT array_to_string(perm, ',') AS perm FROM p, n WHERE len(perm) = n")
def set_permutations(spark, sf):
    """All orders of the regions (SET-6)."""
    r = F.broadcast(read(spark, sf, "region").select("r_regionkey"))  # five rows
    out = spark.createDataFrame([([],)], "p array<bigint>")
    for _ in range(r.count()):
        out = out.join(r, ~F.array_contains("p", C("r_regionkey"))).select(F.array_append("p", C("r_regionkey")).alias("p"))
    return out.select(F.array_join(C("p").cast("array<string>"), ",").alias("perm"))
