"""Rasters, saved arrays and dBase tables: round trips and files built by hand."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest

from verdance.sources import rasters, readers


def test_geotiff_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    images = {n: rng.integers(0, 256, (50, 30, 4)) for n in ("a", "b")}
    rows = [(n, r, c, *map(int, v[r, c])) for n, v in images.items() for r in range(50) for c in range(30) if r not in (20, 21)]
    px = spark.createDataFrame([*rows, ("a", 50, 0, 1, 1, 1, 1), ("none", 0, 0, 1, 1, 1, 1)], "image string, row int, col int, r int, g int, b int, m int")
    centres = spark.createDataFrame([("a", 1000.0, 2000.0), ("b", 0.0, 0.0), ("empty", 1.0, 1.0)], "image string, e double, n double")
    files = rasters.geotiffs(px, centres, ["r", "g", "b", "m"], 30, 50, 0.5, 32636, rows=10)
    rasters.saved(files, str(tmp_path / "out"))
    rasters.saved(files, f"file://{tmp_path}/out")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.tif", "b.tif"]
    got = rasters.geotiff(spark, str(tmp_path / "out")).collect()
    assert len(got) == 2 * 50 * 30
    for r in got:
        v = images[r["file"].rsplit("/", 1)[1][0]]
        want = np.zeros(4) if r["row"] in (20, 21) else v[r["row"], r["col"]]
        assert r["bands"] == list(want) and r["nodata"] == 0
    first = next(r for r in got if r["file"].endswith("a.tif") and r["row"] == r["col"] == 0)
    assert (first["x"], first["y"]) == (1000 - 7.5 + 0.25, 2000 + 12.5 - 0.25)
    assert readers.tiff_sizes(spark, str(tmp_path / "out")).select("width", "height").distinct().collect() == [(30, 50)]
    box = rasters.geotiff(spark, str(tmp_path / "out"), (993.1, 2011.6, 994.0, 2012.4)).select("row", "col").collect()
    assert sorted(map(tuple, box)) == [(r, c) for r in (0, 1) for c in (1, 2, 3)]
    assert rasters.geotiff(spark, str(tmp_path / "out"), level=1).count() == 0


def tiled(order: str, big: bool) -> bytes:
    """A tiled 16-bit image of 20 x 18 with horizontal differences, and an overview of 10 x 9 in one plain strip."""
    image = np.arange(18 * 20).reshape(18, 20)
    kind, word = np.dtype(order + "u2"), "Q" if big else "I"
    blocks = []
    for r, c in ((0, 0), (0, 16), (16, 0), (16, 16)):
        t = np.zeros((16, 16), np.int64)
        part = image[r : r + 16, c : c + 16]
        t[: part.shape[0], : part.shape[1]] = part
        blocks.append(zlib.compress(np.diff(t, axis=1, prepend=0).astype(kind).tobytes()))
    small = image[::2, ::2].astype(kind).tobytes()
    data, at = b"".join(blocks) + small, 16 if big else 8
    offsets = [at + sum(map(len, blocks[:i])) for i in range(5)]
    long = 16 if big else 4
    full = [(256, 3, (20,)), (257, 3, (18,)), (258, 3, (16,)), (259, 3, (8,)), (277, 3, (1,)), (317, 3, (2,)), (322, 3, (16,)), (323, 3, (16,)), (324, long, offsets[:4]), (325, long, [len(x) for x in blocks]), (33550, 12, (2.0, 2.0, 0.0)), (33922, 12, (0.0, 0.0, 0.0, 100.0, 200.0, 0.0))]
    less = [(256, 3, (10,)), (257, 3, (9,)), (258, 3, (16,)), (273, long, offsets[4:]), (278, 3, (9,)), (279, long, [len(small)])]
    out = data
    start = at + len(data)
    for i, fields in enumerate((full, less)):
        head, room = struct.pack(order + ("Q" if big else "H"), len(fields)), 8 if big else 4
        size = len(head) + len(fields) * (20 if big else 12) + room
        tail = b""
        for tag, code, value in fields:
            raw = struct.pack(f"{order}{len(value)}{rasters.FIELDS[code]}", *value)
            if len(raw) > room:
                raw, tail = struct.pack(order + word, start + size + len(tail)), tail + raw
            head += struct.pack(order + "HH" + word, tag, code, len(value)) + raw.ljust(room, b"\0")
        start += size + len(tail)
        out += head + struct.pack(order + word, 0 if i else start) + tail
    top = {"<": b"II", ">": b"MM"}[order] + (struct.pack(order + "HHHQ", 43, 8, 0, at + len(data)) if big else struct.pack(order + "HI", 42, at + len(data)))
    return top + out


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
def test_tiles_differences_and_overviews(spark, order, big):
    files = spark.createDataFrame([("t.tif", bytearray(tiled(order, big)))], "path string, content binary")
    got = rasters.geotiff_pixels(files).collect()
    assert sorted((r["row"], r["col"], r["bands"][0]) for r in got) == [(r, c, 20.0 * r + c) for r in range(18) for c in range(20)]
    assert all((r["x"], r["y"]) == (101 + 2 * r["col"], 199 - 2 * r["row"]) for r in got)
    small = rasters.geotiff_pixels(files, level=1).collect()
    assert sorted((r["row"], r["col"], r["bands"][0], r["x"]) for r in small) == [(r, c, 40.0 * r + 2 * c, 102.0 + 4 * c) for r in range(9) for c in range(10)]
    assert rasters.geotiff_pixels(files.limit(0)).count() == 0


def test_saved_arrays_with_a_shape_check(spark, tmp_path):
    one, two = np.arange(6.0).reshape(2, 3), np.ones((2, 3), np.float32)
    np.savez_compressed(tmp_path / "p.npz", p0=one, p1=two)
    rows = rasters.arrays(spark, str(tmp_path / "p.npz"), (2, 3)).collect()
    assert {(r["name"], r["row"], r["col"]): r["value"] for r in rows} == {(n, r, c): v[r, c] for n, v in (("p0", one), ("p1", two)) for r in range(2) for c in range(3)}
    np.save(tmp_path / "q.npy", one)
    assert rasters.arrays(spark, str(tmp_path / "q.npy")).count() == 6
    with pytest.raises(Exception, match="shape"):
        rasters.arrays(spark, str(tmp_path / "q.npy"), (3, 2)).collect()


def test_dbf(spark, tmp_path):
    fields = [(b"VALUE", b"N", 6), (b"SUM", b"F", 10), (b"NAME", b"C", 5), (b"DAY", b"D", 8)]
    records = [b" " + b"     7" + b"     12.50" + b"ab   " + b"20240301", b"*" + b"     8" + b"      1.00" + b"x    " + b"        ", b" " + b"     9" + b" " * 10 + b" " * 5 + b" " * 8]
    head = b"".join(n.ljust(11, b"\0") + t + b"\0" * 4 + bytes([w]) + b"\0" * 15 for n, t, w in fields) + b"\r"
    (tmp_path / "a.dbf").write_bytes(struct.pack("<BBBBIHH20x", 3, 24, 1, 1, len(records), 32 + len(head), 30) + head + b"".join(records) + b"\x1a")
    got = readers.dbf(spark, str(tmp_path / "a.dbf"), {"VALUE": "bigint", "SUM": "double", "NAME": "string", "DAY": "string", "NONE": "double"})
    assert sorted(tuple(r)[1:] for r in got.collect()) == [(7, 12.5, "ab", "20240301", None), (9, None, None, None, None)]
