"""Rasters as pixel rows: GeoTIFF in and out, and saved arrays.

A file is a row (path, content); it is decoded block by block where it is read,
and only blocks that meet the asked window become rows. Images are written from
strips that are packed apart, so no task holds the pixels of a whole image as rows.
"""

from __future__ import annotations

import io
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the TIFF format: field types by code, and sample kinds by (format, bits).
FIELDS = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
SAMPLES = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}
#: Fixed tag numbers of TIFF and GeoTIFF.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, BANDS, STRIP_ROWS, STRIP_SIZES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANES, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES, FORMAT = 284, 317, 322, 323, 324, 325, 339
SCALE, TIE, KEYS, NODATA = 33550, 33922, 34735, 42113

PIXELS = "file string, row bigint, col bigint, x double, y double, nodata double, bands array<double>"


def directories(b: bytes) -> list[tuple[str, dict[int, tuple]]]:
    """(byte order, tags) of every image of a classic or big TIFF file: the full one, then its overviews."""
    order = {b"II": "<", b"MM": ">"}[bytes(b[:2])]
    big = struct.unpack_from(order + "H", b, 2)[0] == 43
    word, count, head, size = ("Q", "Q", 8, 20) if big else ("I", "H", 2, 12)
    at = struct.unpack_from(order + word, b, 8 if big else 4)[0]
    out, seen = [], set()
    while at and at not in seen:
        seen.add(at)
        n, tags = struct.unpack_from(order + count, b, at)[0], {}
        for i in range(n):
            e = at + head + size * i
            tag, kind = struct.unpack_from(order + "HH", b, e)
            if kind not in FIELDS:
                continue
            many = struct.unpack_from(order + word, b, e + 4)[0]
            form = f"{order}{many}{FIELDS[kind]}"
            place = e + (12 if big else 8)
            if struct.calcsize(form) > struct.calcsize(word):
                place = struct.unpack_from(order + word, b, place)[0]
            tags[tag] = struct.unpack_from(form, b, place)
        out.append((order, tags))
        at = struct.unpack_from(order + word, b, at + head + size * n)[0]
    return out


def _blocks(b: bytes, level: int) -> Iterator[tuple[np.ndarray, np.ndarray, Callable[[], np.ndarray], tuple | None, float | None]]:
    """(rows, columns, values by row, column and band, placing, nodata) of each block of an image; values are decoded when called."""
    found = directories(b)
    order, t = found[level]
    full = found[0][1]
    w, h, many = t[WIDTH][0], t[HEIGHT][0], t.get(BANDS, (1,))[0]
    packed, predictor = t.get(COMPRESSION, (1,))[0], t.get(PREDICTOR, (1,))[0]
    if packed not in (1, 8, 32946) or predictor not in (1, 2) or t.get(PLANES, (1,))[0] != 1:
        raise ValueError(f"this kind of TIFF is not read: compression {packed}, predictor {predictor}, planes {t.get(PLANES)}")
    kind = np.dtype(SAMPLES[t.get(FORMAT, (1,))[0], t[BITS][0]]).newbyteorder(order)
    tiled = TILE_OFFSETS in t
    bw, bh = (t[TILE_WIDTH][0], t[TILE_HEIGHT][0]) if tiled else (w, min(h, t.get(STRIP_ROWS, (h,))[0]))
    sizes, offsets = (t[TILE_SIZES], t[TILE_OFFSETS]) if tiled else (t[STRIP_SIZES], t[STRIP_OFFSETS])
    place = None
    if SCALE in full and TIE in full:
        tie, shrunk = full[TIE], full[WIDTH][0] / w
        sx, sy = full[SCALE][0], full[SCALE][1]
        place = (tie[3] - tie[0] * sx, tie[4] + tie[1] * sy, sx * shrunk, sy * (full[HEIGHT][0] / h))
    text = b"".join(full.get(NODATA, ())).rstrip(b"\0 ")
    across = ceil(w / bw)
    for i, (size, at) in enumerate(zip(sizes, offsets, strict=True)):
        row, col = i // across * bh, i % across * bw

        def values(row=row, size=size, at=at):
            raw = bytes(b[at : at + size]) if packed == 1 else zlib.decompress(b[at : at + size])
            v = np.frombuffer(raw, kind, count=(bh if tiled else min(bh, h - row)) * bw * many).reshape(-1, bw, many)
            return np.cumsum(v, axis=1, dtype=v.dtype) if predictor == 2 else v

        yield np.arange(row, min(row + bh, h)), np.arange(col, min(col + bw, w)), values, place, float(text) if text else None


def geotiff_pixels(files: DataFrame, box: tuple[float, float, float, float] | None = None, level: int = 0) -> DataFrame:
    """Pixel rows of GeoTIFF files (path, content): place of the pixel's centre, nodata value and the bands.

    ``box`` (x0, y0, x1, y1) keeps pixels that touch it, and blocks outside it are not decoded. ``level`` reads an
    overview, of which a file that has fewer gives no rows. Plain and deflated blocks are read, other kinds raise an
    error; without a placing x and y are null and ``box`` is not applied.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, b in zip(batch["path"], batch["content"], strict=True):
                if level >= len(directories(b)):
                    continue
                for rows, cols, values, place, nodata in _blocks(b, level):
                    row, col, x, y = rows[0], cols[0], None, None
                    if place:
                        x, y = place[0] + (cols + 0.5) * place[2], place[1] - (rows + 0.5) * place[3]
                        if box:
                            inx, iny = (x + place[2] / 2 >= box[0]) & (x - place[2] / 2 <= box[2]), (y + place[3] / 2 >= box[1]) & (y - place[3] / 2 <= box[3])
                            rows, cols, x, y = rows[iny], cols[inx], x[inx], y[iny]
                    if not len(rows) or not len(cols):
                        continue
                    v = values()[np.ix_(rows - row, cols - col)].astype(float)
                    n = len(cols)
                    yield pd.DataFrame(
                        {
                            "file": file,
                            "row": np.repeat(rows, n),
                            "col": np.tile(cols, len(rows)),
                            "x": None if x is None else np.tile(x, len(rows)),
                            "y": None if y is None else np.repeat(y, n),
                            "nodata": nodata,
                            "bands": list(v.reshape(-1, v.shape[2])),
                        }
                    ).astype({"x": "float64", "y": "float64", "nodata": "float64"})

    return files.select("path", "content").mapInPandas(run, PIXELS)


def geotiff(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, level: int = 0) -> DataFrame:
    """Pixel rows of the GeoTIFF files of a folder; see ``geotiff_pixels``."""
    return geotiff_pixels(spark.read.format("binaryFile").load(path), box, level)


def _tiff(strips: list[bytes], width: int, height: int, bands: int, rows: int, west: float, north: float, size: float, epsg: int, nodata: int) -> bytes:
    """A TIFF file of 8-bit bands from deflated strips."""
    fields = [
        (WIDTH, 4, (width,)),
        (HEIGHT, 4, (height,)),
        (BITS, 3, (8,) * bands),
        (COMPRESSION, 3, (8,)),
        (PHOTOMETRIC, 3, (2 if bands >= 3 else 1,)),
        (STRIP_OFFSETS, 4, (0,) * len(strips)),
        (BANDS, 3, (bands,)),
        (STRIP_ROWS, 4, (rows,)),
        (STRIP_SIZES, 4, tuple(map(len, strips))),
        (PLANES, 3, (1,)),
        *([(338, 3, (0,) * (bands - 3))] if bands > 3 else []),
        (FORMAT, 3, (1,) * bands),
        (SCALE, 12, (size, size, 0.0)),
        (TIE, 12, (0.0, 0.0, 0.0, west, north, 0.0)),
        # One version line, then: projected model, pixels are areas, the code of the reference system.
        (KEYS, 3, (1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, epsg)),
        (NODATA, 2, tuple(bytes([c]) for c in str(nodata).encode() + b"\0")),
    ]

    def body(offsets: tuple[int, ...]) -> bytes:
        head, tail, at = struct.pack("<H", len(fields)), b"", 8 + 2 + 12 * len(fields) + 4
        for tag, kind, value in fields:
            raw = struct.pack(f"<{len(value)}{FIELDS[kind]}", *(offsets if tag == STRIP_OFFSETS else value))
            if len(raw) > 4:
                head += struct.pack("<HHII", tag, kind, len(value), at + len(tail))
                tail += raw + b"\0" * (len(raw) % 2)
            else:
                head += struct.pack("<HHI", tag, kind, len(value)) + raw.ljust(4, b"\0")
        return b"II*\0" + struct.pack("<I", 8) + head + struct.pack("<I", 0) + tail

    first = len(body((0,) * len(strips)))
    offsets = tuple(first + sum(map(len, strips[:i])) for i in range(len(strips)))
    return body(offsets) + b"".join(strips)


def geotiffs(pixels: DataFrame, centres: DataFrame, bands: list[str], width: int, height: int, size: float, epsg: int, nodata: int = 0, rows: int = 64) -> DataFrame:
    """(path, content): a GeoTIFF of 8-bit bands for each image of ``pixels`` (image, row, col and the bands).

    ``centres`` (image, e, n) has where the middle of each image lies; the file is placed by its upper left corner.
    Values are cut to 0..255; absent pixels and null bands are ``nodata``, pixels outside the image are left out, of a
    pixel that comes twice any stays. Strips of ``rows`` rows are packed apart; only packed strips meet in an image's row.
    Images without a centre get no file.
    """
    kind = pixels.schema["image"].dataType.simpleString()

    def strip(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["block"].iloc[0])
        v = np.full((min(rows, height - block * rows), width, len(bands)), nodata, np.uint8)
        v[pdf["row"].to_numpy() - block * rows, pdf["col"].to_numpy()] = pdf[bands].fillna(nodata).clip(0, 255).to_numpy().astype(np.uint8)
        return pd.DataFrame({"image": [pdf["image"].iloc[0]], "block": [block], "strip": [zlib.compress(v.tobytes())]})

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = []
            for strips, e, n in zip(b["strips"], b["e"], b["n"], strict=True):
                own = {s["block"]: bytes(s["strip"]) for s in strips}
                for k in range(ceil(height / rows)):
                    if k not in own:
                        own[k] = zlib.compress(bytes([nodata]) * (min(rows, height - k * rows) * width * len(bands)))
                corner = (e - width * size / 2, n + height * size / 2)
                made.append(_tiff([own[k] for k in sorted(own)], width, height, len(bands), rows, *corner, size, epsg, nodata))
            yield pd.DataFrame({"path": b["image"].astype(str) + ".tif", "content": made})

    inside = F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)
    own = pixels.filter(inside).select("image", F.col("row").cast("bigint"), F.col("col").cast("bigint"), *(F.col(b).cast("double") for b in bands))
    own = own.withColumn("block", F.floor(F.col("row") / rows))
    strips = own.groupBy("image", "block").applyInPandas(strip, f"image {kind}, block bigint, strip binary")
    images = strips.groupBy("image").agg(F.collect_list(F.struct("block", "strip")).alias("strips"))
    return images.join(centres.select("image", "e", "n"), "image").mapInPandas(whole, "path string, content binary")


def saved(files: DataFrame, folder: str) -> None:
    """Files (path, content) into a folder that all executors see; a task that runs again puts the same file in its place."""
    to = folder.removeprefix("file://")

    def put(rows) -> None:
        os.makedirs(to, exist_ok=True)
        for r in rows:
            name = os.path.join(to, r["path"])
            part = f"{name}.{uuid.uuid4().hex}"
            with open(part, "wb") as f:
                f.write(r["content"])
            os.replace(part, name)

    files.foreachPartition(put)


def arrays(spark: SparkSession, path: str, shape: tuple[int, int] | None = None) -> DataFrame:
    """(file, name, row, col, value) of saved two-dimensional arrays (.npy, .npz); an array of another ``shape`` is an error."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, content in zip(b["path"], b["content"], strict=True):
                got = np.load(io.BytesIO(content), allow_pickle=False)
                for name in got.files if hasattr(got, "files") else [""]:
                    v = got[name] if name else got
                    if v.ndim != 2 or (shape and v.shape != tuple(shape)):
                        raise ValueError(f"{file} {name}: shape {v.shape}, not {shape or 'two-dimensional'}")
                    step = max(1, (1 << 20) // max(1, v.shape[1]))
                    for r in range(0, v.shape[0], step):
                        part = v[r : r + step]
                        row, col = np.indices(part.shape)
                        yield pd.DataFrame({"file": file, "name": name, "row": row.ravel() + r, "col": col.ravel(), "value": part.ravel().astype(float)})

    return files.mapInPandas(run, "file string, name string, row bigint, col bigint, value double")
