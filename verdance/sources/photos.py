"""Time and place of photos: read from, and put into, the header of JPEG files.

A photo is a row (path, content). Headers are read where the file is; a place is put in by a new header
segment, so the picture's own bytes stay as they are.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdance.sources.readers import spread_within_second

#: Fixed tag numbers of the Exif format, and the sizes of its field types.
TIME, SUBSECOND, EXIF, GPS = 0x9003, 0x9291, 0x8769, 0x8825
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
HEAD = b"Exif\0\0"


def header(b: bytes) -> tuple[int, int]:
    """Start and end of the Exif segment of a JPEG file; both the place for a new one where there is none."""
    if b[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at = 2
    while at + 4 <= len(b) and b[at] == 0xFF and b[at + 1] != 0xDA:
        end = at + 2 + struct.unpack_from(">H", b, at + 2)[0]
        if b[at + 1] == 0xE1 and b[at + 4 : at + 10] == HEAD:
            return at, end
        at = end
    return 2, 2


def entries(t: bytes, order: str, at: int) -> tuple[dict[int, bytes], bytes]:
    """(12 bytes by tag, link to the next directory) of the directory at ``at``."""
    n = struct.unpack_from(order + "H", t, at)[0]
    found = {struct.unpack_from(order + "H", t, at + 2 + 12 * i)[0]: t[at + 2 + 12 * i : at + 14 + 12 * i] for i in range(n)}
    return found, t[at + 2 + 12 * n : at + 6 + 12 * n]


def field(t: bytes, order: str, entry: bytes | None) -> bytes:
    """The bytes of an entry's value; none if it is absent."""
    if entry is None:
        return b""
    kind, count = struct.unpack_from(order + "HI", entry, 2)
    size = SIZES.get(kind, 1) * count
    return entry[8 : 8 + size] if size <= 4 else t[(at := struct.unpack_from(order + "I", entry, 8)[0]) : at + size]


def _degrees(raw: bytes, order: str, negative: bool) -> float | None:
    if len(raw) != 24:
        return None
    parts = struct.unpack(order + "6I", raw)
    if 0 in parts[1::2]:
        return None
    v = parts[0] / parts[1] + parts[2] / parts[3] / 60 + parts[4] / parts[5] / 3600
    return -v if negative else v


def noted(b: bytes) -> tuple[str | None, float | None, float | None, float | None, float | None]:
    """(time as text, part of a second, latitude, longitude, altitude) of a file; None for what its header lacks."""
    try:
        start, end = header(b)
        t = b[start + 10 : end]
        order = {b"II": "<", b"MM": ">"}[t[:2]]
        main, _ = entries(t, order, struct.unpack_from(order + "I", t, 4)[0])
        inner = lambda tag: entries(t, order, struct.unpack(order + "I", field(t, order, main[tag]))[0])[0] if tag in main else {}
        own, gps = inner(EXIF), inner(GPS)
        time = field(t, order, own.get(TIME)).rstrip(b"\0 ").decode("latin-1") or None
        part = field(t, order, own.get(SUBSECOND)).rstrip(b"\0 ").decode("latin-1")
        lat = _degrees(field(t, order, gps.get(2)), order, field(t, order, gps.get(1))[:1] == b"S")
        lon = _degrees(field(t, order, gps.get(4)), order, field(t, order, gps.get(3))[:1] == b"W")
        high = field(t, order, gps.get(6))
        alt = None
        if len(high) == 8 and any(high[4:]):
            num, den = struct.unpack(order + "2I", high)
            alt = num / den * (-1 if field(t, order, gps.get(5))[:1] == b"\1" else 1)
        return time, (float(f"0.{part}") if part.isdigit() else None), lat, lon, alt
    except (KeyError, ValueError, struct.error, IndexError):
        return None, None, None, None, None


def placed(b: bytes, lat: float, lon: float, alt: float) -> bytes:
    """The file with a new place in its header, all other fields kept; an error where the header has no room."""
    start, end = header(b)
    t = b[start + 10 : end] if end > start else b"II*\0" + struct.pack("<IHI", 8, 0, 0)
    order = {b"II": "<", b"MM": ">"}[t[:2]]
    main, link = entries(t, order, struct.unpack_from(order + "I", t, 4)[0])
    t += b"\0" * (len(t) % 2)

    def rational(v: float) -> bytes:
        degree = int(abs(v))
        minute = int((abs(v) - degree) * 60)
        second = round(((abs(v) - degree) * 60 - minute) * 60 * 1_000_000)
        return struct.pack(order + "6I", degree, 1, minute, 1, second, 1_000_000)

    fields = [
        (0, 1, 4, b"\2\3\0\0"),
        (1, 2, 2, b"N\0" if lat >= 0 else b"S\0"),
        (2, 5, 3, rational(lat)),
        (3, 2, 2, b"E\0" if lon >= 0 else b"W\0"),
        (4, 5, 3, rational(lon)),
        (5, 1, 1, b"\0" if alt >= 0 else b"\1"),
        (6, 5, 1, struct.pack(order + "2I", int(abs(alt) * 100), 100)),
        (18, 2, 7, b"WGS-84\0"),
    ]
    gps, at = struct.pack(order + "H", len(fields)), len(t) + 2 + 12 * len(fields) + 4
    tail = b""
    for tag, kind, count, raw in fields:
        gps += struct.pack(order + "HHI", tag, kind, count)
        gps += raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", at + len(tail))
        tail += raw + b"\0" * (len(raw) % 2) if len(raw) > 4 else b""
    main[GPS] = struct.pack(order + "HHII", GPS, 4, 1, len(t))
    t += gps + b"\0" * 4 + tail
    # The first directory is written again behind all else, with the new entry; the places its entries point to stay.
    new = t[:4] + struct.pack(order + "I", len(t)) + t[8:] + struct.pack(order + "H", len(main)) + b"".join(main[k] for k in sorted(main)) + link
    if len(new) + len(HEAD) + 2 > 0xFFFF:
        raise ValueError("no room in the header")
    return b[:start] + b"\xff\xe1" + struct.pack(">H", len(new) + len(HEAD) + 2) + HEAD + new + b[end:]


def photo_times(files: DataFrame) -> DataFrame:
    """(path, ts, lat, lon, alt) of photos (path, content) that have a readable time.

    Times carry the noted part of a second; if no photo notes one, photos of one second are spread evenly in it by name.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(p, *noted(bytes(c) if c is not None else b"")) for p, c in zip(b["path"], b["content"], strict=True)]
            yield pd.DataFrame(got, columns=["path", "time", "part", "lat", "lon", "alt"]).astype({c: "float64" for c in ("part", "lat", "lon", "alt")})

    nulls = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    raw = files.select("path", "content").mapInPandas(run, "path string, time string, part double, lat double, lon double, alt double")
    base = F.try_to_timestamp("time", F.lit("yyyy:MM:dd HH:mm:ss")).cast("timestamp_ntz")
    own = raw.select("path", base.alias("base"), *(nulls(c) for c in ("part", "lat", "lon", "alt"))).filter("base is not null")
    has = F.broadcast(own.agg(F.coalesce(F.max("part") > 0, F.lit(False)).alias("_has")))
    second = F.when(F.col("_has"), F.coalesce("part", F.lit(0.0))).otherwise(spread_within_second(own, [], "base", "path"))
    ts = F.col("base") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), second.cast("decimal(18,6)"))
    return own.join(has).select("path", ts.alias("ts"), "lat", "lon", "alt")


def with_places(files: DataFrame, places: DataFrame) -> DataFrame:
    """(path, content, error): photos with the place of ``places`` (path, lat, lon, alt) in their header.

    Only photos with a place come back; one whose header cannot be read or has no room comes back as it was, with the reason.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content, *place in b.itertuples(index=False):
                try:
                    out.append((path, placed(bytes(content), *place), None))
                except (KeyError, ValueError, struct.error, IndexError) as e:
                    out.append((path, content, str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["path", "content", "error"])

    own = places.dropna().select("path", *(F.col(c).cast("double") for c in ("lat", "lon", "alt")))
    both = files.filter("content is not null").join(own, "path").select("path", "content", "lat", "lon", "alt")
    return both.mapInPandas(run, "path string, content binary, error string")
