"""Distances and coordinate changes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6_371_000.0
#: The WGS84 ellipsoid and the transverse Mercator grid.
A, FLAT, K0, FALSE_EAST = 6_378_137.0, 1 / 298.257223563, 0.9996, 500_000.0
E2 = FLAT * (2 - FLAT)
EP2 = E2 / (1 - E2)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres."""
    p = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))))


def flat(lat1: Column, lon1: Column, lat2: Column, lon2: Column, metres: float = 111_320.0) -> Column:
    """Flat-earth metres at a scale of ``metres`` a degree."""
    return F.hypot((lat2 - lat1) * metres, (lon2 - lon1) * metres * F.cos(F.radians(lat1)))


def utm_to_latlon(east: Column, north: Column, zone: int = 36) -> tuple[Column, Column]:
    """(latitude, longitude) in degrees, by the footpoint-latitude series of the northern hemisphere."""
    m = north / K0
    mu = m / (A * (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256))
    e1 = (1 - (1 - E2) ** 0.5) / (1 + (1 - E2) ** 0.5)
    foot = mu + (1.5 * e1 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + (151 * e1**3 / 96) * F.sin(6 * mu) + (1097 * e1**4 / 512) * F.sin(8 * mu)
    s, c, t = F.sin(foot), F.cos(foot), F.tan(foot)
    c1, t1 = EP2 * c * c, t * t
    w = 1 - E2 * s * s
    n1, r1 = A / F.sqrt(w), A * (1 - E2) / F.pow(w, 1.5)
    d = (east - FALSE_EAST) / (n1 * K0)
    lat = foot - (n1 * t / r1) * (d * d / 2 - (5 + 3 * t1 + 10 * c1 - 4 * c1 * c1 - 9 * EP2) * F.pow(d, 4) / 24 + (61 + 90 * t1 + 298 * c1 + 45 * t1 * t1 - 252 * EP2 - 3 * c1 * c1) * F.pow(d, 6) / 720)
    lon = (d - (1 + 2 * t1 + c1) * F.pow(d, 3) / 6 + (5 - 2 * c1 + 28 * t1 - 3 * c1 * c1 + 8 * EP2 + 24 * t1 * t1) * F.pow(d, 5) / 120) / c
    return F.degrees(lat), F.degrees(lon) + (zone * 6 - 183)


def latlon_to_utm(lat: Column, lon: Column, zone: int = 36) -> tuple[Column, Column]:
    """(east, north) in metres."""
    f, dl = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    s, c, t = F.sin(f), F.cos(f), F.tan(f)
    n, t1, c1, a = A / F.sqrt(1 - E2 * s * s), t * t, EP2 * c * c, dl * c
    m = A * ((1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256) * f - (3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024) * F.sin(2 * f) + (15 * E2**2 / 256 + 45 * E2**3 / 1024) * F.sin(4 * f) - (35 * E2**3 / 3072) * F.sin(6 * f))
    east = FALSE_EAST + K0 * n * (a + (1 - t1 + c1) * F.pow(a, 3) / 6 + (5 - 18 * t1 + t1 * t1 + 72 * c1 - 58 * EP2) * F.pow(a, 5) / 120)
    north = K0 * (m + n * t * (a * a / 2 + (5 - t1 + 9 * c1 + 4 * c1 * c1) * F.pow(a, 4) / 24 + (61 - 58 * t1 + t1 * t1 + 600 * c1 - 330 * EP2) * F.pow(a, 6) / 720))
    return east, north


def world(row: Column, col: Column, x0: float, y0: float, px: float, py: float) -> tuple[Column, Column]:
    """Pixel centre to map coordinates for an origin at the upper left corner."""
    return x0 + (col + 0.5) * px, y0 - (row + 0.5) * py


def pixel(x: Column, y: Column, x0: float, y0: float, px: float, py: float) -> tuple[Column, Column]:
    """(row, column) of a map position."""
    return F.floor((y0 - y) / py).cast("int"), F.floor((x - x0) / px).cast("int")


def degrees_to_rational(deg: Column) -> Column:
    """Degrees, minutes and seconds as three fractions, seconds in millionths."""
    a = F.abs(deg)
    d = F.floor(a)
    m = F.floor((a - d) * 60)
    s = F.round(((a - d) * 60 - m) * 60 * 1_000_000).cast("long")
    part = lambda n, q: F.struct(n.cast("long").alias("num"), F.lit(q).cast("long").alias("den"))
    return F.array(part(d, 1), part(m, 1), part(s, 1_000_000))


def rational_to_degrees(parts: Column, ref: Column) -> Column:
    """Degrees from three fractions; south and west are negative."""
    v = lambda i: F.get(parts, i)["num"] / F.get(parts, i)["den"]
    return (v(0) + v(1) / 60 + v(2) / 3600) * F.when(ref.isin("S", "W"), -1).otherwise(1)


def in_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Ray casting against a polygon of a few corners."""
    inside = F.lit(False)
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1], strict=True):
        if y1 != y2:
            crosses = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (y - y1) * ((x2 - x1) / (y2 - y1)) + x1)
            inside = inside != crosses
    return inside
