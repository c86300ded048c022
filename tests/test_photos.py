"""Photo headers built by hand: read, placed and read again; results that resume."""

from __future__ import annotations

import datetime as dt
import struct

import pytest
from pyspark.sql import functions as F

from verdance.sources import photos, writers

PICTURE = b"\xff\xdb\x00\x04\x01\x02\xff\xda\x00\x02rest of the picture\xff\xd9"


def photo(order: str, time: str | None, part: str | None) -> bytes:
    top = {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 8)
    fields = [(photos.TIME, time), (photos.SUBSECOND, part)]
    fields = [(tag, v.encode() + b"\0") for tag, v in fields if v is not None]
    maker = b"Maker\0"
    first = struct.pack(order + "H", 2) + struct.pack(order + "HHII", 0x010F, 2, len(maker), 38) + struct.pack(order + "HHII", photos.EXIF, 4, 1, 44) + struct.pack(order + "I", 0)
    inner, at, tail = struct.pack(order + "H", len(fields)), 44 + 2 + 12 * len(fields) + 4, b""
    for tag, raw in fields:
        inner += struct.pack(order + "HHI", tag, 2, len(raw))
        inner += raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", at + len(tail))
        tail += raw if len(raw) > 4 else b""
    t = top + first + maker + inner + struct.pack(order + "I", 0) + tail
    jfif = b"\xff\xe0\x00\x04\x01\x01"
    return b"\xff\xd8" + jfif + b"\xff\xe1" + struct.pack(">H", len(t) + 8) + photos.HEAD + t + PICTURE


def table(spark, rows):
    return spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")


@pytest.mark.parametrize("order", ["<", ">"])
def test_places_are_put_in_and_all_else_stays(spark, order):
    files = table(spark, [("a", photo(order, "2024:03:01 10:20:30", "25")), ("b", b"\xff\xd8" + PICTURE), ("c", b"no photo"), ("d", photo(order, None, None))])
    places = spark.createDataFrame([("a", 31.7505, -34.5, 120.25), ("b", -31.0, 34.25, -3.5), ("c", 1.0, 1.0, 1.0), ("d", None, 1.0, 1.0)], "path string, lat double, lon double, alt double")
    got = {r["path"]: r for r in photos.with_places(files, places).collect()}
    assert got.keys() == {"a", "b", "c"}
    assert got["c"]["error"] and bytes(got["c"]["content"]) == b"no photo"
    time, part, lat, lon, alt = photos.noted(bytes(got["a"]["content"]))
    assert (time, part, alt) == ("2024:03:01 10:20:30", 0.25, 120.25) and abs(lat - 31.7505) < 1e-9 and lon == -34.5
    assert photos.noted(bytes(got["b"]["content"])) == (None, None, -31.0, 34.25, -3.5)
    assert all(bytes(got[p]["content"]).endswith(PICTURE) for p in "ab") and b"Maker" in bytes(got["a"]["content"])
    again = photos.placed(bytes(got["a"]["content"]), 1.0, 2.0, 3.0)
    assert photos.noted(again) == (time, part, 1.0, 2.0, 3.0)


def test_times_carry_their_part_of_a_second(spark):
    second = "2024:03:01 10:20:30"
    files = table(spark, [("a", photo("<", second, "5")), ("b", photo(">", second, None)), ("c", b""), ("d", photo("<", "nothing", "1"))])
    at = dt.datetime(2024, 3, 1, 10, 20, 30)
    assert {r["path"]: r["ts"] for r in photos.photo_times(files).collect()} == {"a": at + dt.timedelta(seconds=0.5), "b": at}


def test_photos_of_one_second_are_spread_where_none_notes_a_part(spark):
    files = table(spark, [(p, photo("<", "2024:03:01 10:20:30", None)) for p in "abcd"])
    at = dt.datetime(2024, 3, 1, 10, 20, 30)
    assert {r["path"]: r["ts"] for r in photos.photo_times(files).collect()} == {p: at + dt.timedelta(seconds=i / 4) for i, p in enumerate("abcd")}
    assert photos.photo_times(files.limit(0)).count() == 0


def test_results_resume(spark, tmp_path):
    path, seen = str(tmp_path / "results"), []

    def work(rows):
        seen.append(sorted(r["k"] for r in rows.collect()))
        return rows.withColumn("v", F.col("k") * 10)

    make = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k int")
    assert writers.resumed(make(1, 2), path, ["k"], work).count() == 2
    got = writers.resumed(make(1, 2, 3), path, ["k"], work).collect()
    assert writers.resumed(make(1, 3), path, ["k"], work).count() == 3
    assert sorted((r["k"], r["v"]) for r in got) == [(1, 10), (2, 20), (3, 30)] and seen == [[1, 2], [3]]
