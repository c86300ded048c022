"""Source, sink and streaming queries: tables are written in a kind and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from verdance.plans.registry import Registry, micros, read, rounded
from verdance.sources import rasters, readers, writers

R = Registry()
C = F.col


def scratch(spark) -> str:
    """A folder that all executors share."""
    from verdance.session import checkpoint_dir

    return f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


@R.add("src_csv", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def src_csv(spark, sf):
    """CSV with header, declared types (SRC-3, SNK-2)."""
    to = scratch(spark)
    writers.csv(read(spark, sf, "supplier"), to)
    return readers.csv(spark, to, "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double")


@R.add("src_positional_csv", "SELECT CAST(n_nationkey AS VARCHAR) AS a, trim(n_name) AS b FROM nation")
def src_positional_csv(spark, sf):
    """Headerless CSV with trimmed strings (SRC-4)."""
    to = scratch(spark)
    read(spark, sf, "nation").select("n_nationkey", F.concat(F.lit("  "), C("n_name"), F.lit(" ")).alias("n")).write.csv(to)
    return readers.positional_csv(spark, to, ["a", "b"])


@R.add("src_station", "SELECT epoch_us(date_trunc('minute', ts)) AS ts, round(value, 2) AS t FROM events")
def src_station(spark, sf):
    """Station CSV with banner rows and unreadable stamps, assigned to its season (SRC-5, SRC-6)."""
    to = scratch(spark)
    e = read(spark, sf, "events").select(F.date_format("ts", "dd/MM/yyyy HH:mm").alias("a"), F.round("value", 2).cast("string").alias("b"))
    banner = spark.createDataFrame([("Station X", "metadata"), ("Date", "Temp")], "a string, b string")
    banner.unionByName(e).coalesce(1).write.csv(to)
    got = readers.station_csv(spark, to, ["a", "t"])
    return readers.modal_spring(got, (1, 2)).select(micros("ts").alias("ts"), "t")


@R.add("src_json_events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def src_json_events(spark, sf):
    """JSON strings to columns (SRC-20, SRC-21)."""
    return read(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@R.add("src_coco", "SELECT 'img' || CAST(s_nationkey AS VARCHAR) || '.jpg' AS image, s_suppkey AS category_id, s_acctbal AS area FROM supplier")
def src_coco(spark, sf):
    """Annotation documents to rows (SRC-20)."""
    to = scratch(spark)
    s = read(spark, sf, "supplier")
    doc = s.agg(
        F.collect_set(F.struct(C("s_nationkey").cast("bigint").alias("id"), F.concat(F.lit("img"), C("s_nationkey").cast("string"), F.lit(".jpg")).alias("file_name"))).alias("images"),
        F.collect_list(F.struct(C("s_suppkey").alias("id"), C("s_nationkey").cast("bigint").alias("image_id"), C("s_suppkey").alias("category_id"), C("s_acctbal").alias("area"), F.array(F.array(F.lit(0.0), F.lit(1.0))).alias("segmentation"))).alias("annotations"),
    )
    doc.coalesce(1).write.json(to)
    return readers.coco(spark, to).select("image", "category_id", "area")


@R.add("src_flight_log", "SELECT event_id, epoch_us(date_trunc('second', ts)) + (event_id % 1000) * 1000 AS t FROM events WHERE value < 400")
def src_flight_log(spark, sf):
    """Flight log with millisecond times (SRC-17)."""
    e = read(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("datetime(utc)"), (C("event_id") + 7000).alias("time(millisecond)"), F.when(C("value") < 400, C("value")).alias("latitude"), C("value").alias("longitude"))
    return readers.flight_log(e).select("event_id", micros("exact_time").alias("t"))


@R.add(
    "src_world_and_exif",
    """WITH w AS (SELECT n_nationkey AS nation, 0.05::DOUBLE + n_nationkey / 100 AS xs, -0.05::DOUBLE - n_nationkey / 100 AS ys, 640000.5::DOUBLE + n_nationkey AS x, 3480000.25::DOUBLE - n_nationkey AS y FROM nation)
    SELECT c_custkey AS k, round(x + xs * (c_custkey % 1000), 6) AS x, round(y + ys * (c_custkey // 1000), 6) AS y,
      round((c_custkey % 90 + (c_custkey % 60) / 60 + (c_custkey * 37 % 60000) / 1000.0::DOUBLE / 3600) * CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE -1 END, 9) AS lat FROM customer JOIN w ON nation = c_nationkey""",
)
def src_world_and_exif(spark, sf):
    """World files, one a nation, that place the customers' pixels, and rational coordinates (SRC-15, SRC-19)."""
    from verdance.functions.geo import rational_to_degrees

    to, n = scratch(spark), C("n_nationkey")
    lines = (0.05 + n / 100, F.lit(0.0), F.lit(0.0), -0.05 - n / 100, 640000.5 + n, 3480000.25 - n)
    files = read(spark, sf, "nation").select("n_nationkey", F.concat_ws("\n", *(c.cast("string") for c in lines)).alias("value"))
    files.write.partitionBy("n_nationkey").text(to)
    world = readers.world_file(spark, f"{to}/*/*.txt").select(F.regexp_extract("file", "n_nationkey=([0-9]+)", 1).cast("int").alias("nation"), "xs", "ys", "x", "y")
    k = C("c_custkey")
    frac = lambda num, den: F.struct(num.alias("num"), F.lit(den).alias("den"))
    lat = rational_to_degrees(F.array(frac(k % 90, 1), frac(k % 60, 1), frac(k * 37 % 60_000, 1000)), F.when(k % 2 == 0, "N").otherwise("S"))
    own = read(spark, sf, "customer").join(F.broadcast(world), C("c_nationkey") == C("nation"))  # one row a nation
    return own.select(k.alias("k"), F.round(C("x") + C("xs") * (k % 1000), 6).alias("x"), F.round(C("y") + C("ys") * F.floor(k / 1000), 6).alias("y"), F.round(lat, 9).alias("lat"))


@R.add("snk_upsert", "SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'new' ELSE 'old' END AS stage, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal * 2 ELSE s_acctbal END AS v FROM supplier")
def snk_upsert(spark, sf):
    """Keyed upsert of result rows (SNK-3, SNK-4, CV-14)."""
    s = read(spark, sf, "supplier").select(C("s_suppkey").alias("k"), F.lit("old").alias("stage"), C("s_acctbal").alias("v"))
    new = s.filter("k % 3 = 0").select("k", F.lit("new").alias("stage"), (C("v") * 2).alias("v"))
    to = scratch(spark)
    writers.json_document(writers.upserted(s, new, ["k"]), to)
    return readers.json_result(spark, to, "k bigint, stage string, v double")


@R.add("snk_wide", "SELECT o_custkey, CAST(count(*) FILTER (WHERE year(o_orderdate) = 1996) AS BIGINT) AS n_1996, CAST(count(*) FILTER (WHERE year(o_orderdate) = 1997) AS BIGINT) AS n_1997 FROM orders WHERE year(o_orderdate) IN (1996, 1997) GROUP BY o_custkey")
def snk_wide(spark, sf):
    """Wide table with a column a season, kept as CSV and as a new table (SNK-1, SNK-2, SNK-8, SNK-10)."""
    to = scratch(spark)
    o = read(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    writers.wide_csv(o.filter("y in (1996, 1997)"), to, "o_custkey", "y", ["n"], [1996, 1997])
    got = readers.csv(spark, to, "o_custkey bigint, n_1996 bigint, n_1997 bigint").na.fill(0)
    writers.once(got, f"{to}-kept")
    return spark.read.parquet(f"{to}-kept")


@R.add(
    "snk_geotiff",
    """WITH p AS (SELECT c_nationkey AS image, c_custkey % 40 AS col, (c_custkey // 40) % 150 AS row, c_custkey % 256 AS r, c_mktsegment = 'BUILDING' AS m FROM customer),
    d AS (SELECT image, row, col, max(r) AS r, CASE WHEN bool_or(m) THEN 200 ELSE 0 END AS m FROM p GROUP BY ALL),
    i AS (SELECT DISTINCT image FROM p), g AS (SELECT image, r.row, c.col FROM i, range(150) r(row), range(40) c(col))
    SELECT image || '.tif' AS path, g.row, g.col, 1000.0 * image - 10 + (g.col + 0.5) * 0.5 AS x, 500.0 + 37.5 - (g.row + 0.5) * 0.5 AS y,
      CAST(coalesce(r, 0) AS DOUBLE) AS red, CAST(coalesce(m, 0) AS DOUBLE) AS mask FROM g LEFT JOIN d USING (image, row, col)
    WHERE 500.0 + 37.5 - g.row * 0.5 >= 495 AND 500.0 + 37.5 - (g.row + 1) * 0.5 <= 505""",
)
def snk_geotiff(spark, sf):
    """Georeferenced images of two bands, written and read back in a window (SNK-5, SRC-12)."""
    cu = read(spark, sf, "customer")
    px = cu.select(C("c_nationkey").alias("image"), F.floor(C("c_custkey") / 40).alias("_r"), (C("c_custkey") % 40).alias("col"), (C("c_custkey") % 256).alias("red"), F.when(C("c_mktsegment") == "BUILDING", 200).otherwise(0).alias("mask"))
    px = px.groupBy("image", (C("_r") % 150).alias("row"), "col").agg(F.max("red").alias("red"), F.max("mask").alias("mask"))
    centres = px.select("image").distinct().select("image", (C("image") * 1000.0).alias("e"), F.lit(500.0).alias("n"))
    to = scratch(spark)
    rasters.geotiffs(px, centres, ["red", "mask"], 40, 150, 0.5, 32636).write.parquet(to)
    got = rasters.geotiff_pixels(spark.read.parquet(to), (-1e9, 495.0, 1e9, 505.0))
    return got.select(C("file").alias("path"), "row", "col", "x", "y", C("bands")[0].alias("red"), C("bands")[1].alias("mask"))


@R.add("stream_hourly", "SELECT epoch_us(date_trunc('hour', ts)) AS hour, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def stream_hourly(spark, sf):
    """Hourly windows over a stream, run to its end (TS-1 as a stream)."""
    from verdance.streaming import stations

    out = stations.hourly(stations.stream(spark, sf, "events"), "ts", ["event_type"], "value")
    return rounded(stations.collected(out, f"hourly_{uuid.uuid4().hex}").withColumn("hour", micros("hour")))


@R.add("stream_flights", "WITH l AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 36000 * 1000000::BIGINT THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM l) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM g GROUP BY user_id, s")
def stream_flights(spark, sf):
    """Session windows over a stream (WIN-3 as a stream)."""
    from verdance.streaming import stations

    out = stations.flights(stations.stream(spark, sf, "events"), "ts", ["user_id"], "36000 seconds")
    return stations.collected(out, f"flights_{uuid.uuid4().hex}").select("user_id", micros("start").alias("start"), "n")


@R.add(
    "stream_chill",
    """WITH RECURSIVE o AS (SELECT user_id % 5 AS station, value % 15 AS t, row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts, value % 15) AS i FROM events WHERE value IS NOT NULL),
    q AS (SELECT station, i, 139500.0::DOUBLE * exp(-4153.5::DOUBLE / (t + 273.15)) AS k0, 2.567e18::DOUBLE * exp(-12888.8::DOUBLE / (t + 273.15)) AS k1 FROM o),
    s AS (SELECT DISTINCT station, 0::BIGINT AS i, 0.0::DOUBLE AS x, 0.0::DOUBLE AS p FROM o UNION ALL SELECT station, i, CASE WHEN x >= 1 THEN x - 1 ELSE x END, CASE WHEN x >= 1 THEN p + 1 ELSE p END
      FROM (SELECT q.station, q.i, s.x * exp(-k1) + k0 / k1 * (1 - exp(-k1)) AS x, s.p FROM s JOIN q ON q.station = s.station AND q.i = s.i + 1))
    SELECT station, max(p) AS portions FROM s GROUP BY station""",
)
def stream_chill(spark, sf):
    """Chill portions kept as state of a stream (TS-5 as a stream)."""
    from verdance.streaming import stations

    e = stations.stream(spark, sf, "events").select((C("user_id") % 5).alias("station"), "ts", (C("value") % 15).alias("t"))
    return stations.collected(stations.chill(e, "station", "ts", "t"), f"chill_{uuid.uuid4().hex}", "update")
