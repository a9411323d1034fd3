"""EPSG:4326, 3413 (polar stereographic, WGS 84, true at 70 N, meridian 45 W) and 3857 in closed form (Snyder, 1987).

Each formula is written once over a set of functions, so that it serves columns and plain numbers alike.
"""

from __future__ import annotations

import math
from types import SimpleNamespace

from pyspark.sql import functions as F

#: WGS 84 and the parameters of EPSG:3413.
A, FLATTENING = 6378137.0, 1 / 298.257223563
E = math.sqrt(FLATTENING * (2 - FLATTENING))
TRUE_AT, MERIDIAN = math.radians(70.0), math.radians(-45.0)

COLUMNS = SimpleNamespace(sin=F.sin, cos=F.cos, tan=F.tan, atan=F.atan, atan2=F.atan2, sqrt=F.sqrt, pow=F.pow, log=F.log, exp=F.exp, radians=F.radians, degrees=F.degrees)
NUMBERS = SimpleNamespace(sin=math.sin, cos=math.cos, tan=math.tan, atan=math.atan, atan2=math.atan2, sqrt=math.sqrt, pow=math.pow, log=math.log, exp=math.exp, radians=math.radians, degrees=math.degrees)


def _t(lat, m):
    return m.tan(math.pi / 4 - lat / 2) / m.pow((1 - m.sin(lat) * E) / (1 + m.sin(lat) * E), E / 2 if m is NUMBERS else F.lit(E / 2))


SCALE = math.cos(TRUE_AT) / math.sqrt(1 - (E * math.sin(TRUE_AT)) ** 2) / _t(TRUE_AT, NUMBERS)


def to_polar(lon, lat, m=COLUMNS):
    """EPSG:4326 to EPSG:3413."""
    rho, turn = _t(m.radians(lat), m) * (A * SCALE), m.radians(lon) - MERIDIAN
    return rho * m.sin(turn), -(rho * m.cos(turn))


def from_polar(x, y, m=COLUMNS):
    """EPSG:3413 to EPSG:4326. The series for the latitude is exact to well under 1e-9 degrees."""
    chi = math.pi / 2 - m.atan(m.sqrt(x * x + y * y) / (A * SCALE)) * 2
    e2 = E * E
    lat = (
        chi
        + m.sin(chi * 2) * (e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360)
        + m.sin(chi * 4) * (7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520)
        + m.sin(chi * 6) * (7 * e2**3 / 120 + 81 * e2**4 / 1120)
        + m.sin(chi * 8) * (4279 * e2**4 / 161280)
    )
    lon = m.degrees(m.atan2(x, -y) + MERIDIAN)
    if m is NUMBERS:
        lon = lon + 360 if lon < -180 else lon
    else:
        lon = F.when(lon < -180, lon + 360).otherwise(lon)
    return lon, m.degrees(lat)


def to_mercator(lon, lat, m=COLUMNS):
    """EPSG:4326 to EPSG:3857."""
    return m.radians(lon) * A, m.log(m.tan(m.radians(lat) / 2 + math.pi / 4)) * A


def from_mercator(x, y, m=COLUMNS):
    return m.degrees(x / A), m.degrees(m.atan(m.exp(y / A)) * 2 - math.pi / 2)


INTO = {4326: lambda x, y, m=COLUMNS: (x, y), 3413: to_polar, 3857: to_mercator}
FROM = {4326: lambda x, y, m=COLUMNS: (x, y), 3413: from_polar, 3857: from_mercator}


def reproject(x, y, source: int, target: int, m=COLUMNS):
    """Between any two of the three systems, through EPSG:4326."""
    if source == target:
        return x, y
    if source not in FROM or target not in INTO:
        raise ValueError(f"no transformation from EPSG:{source} to EPSG:{target}")
    return INTO[target](*FROM[source](x, y, m), m)


def reproject_ring(ring: list[tuple[float, float]], source: int, target: int, between: int = 20) -> list[tuple[float, float]]:
    """A polygon in another system. Edges become curves, so `between` points are put on each before they are moved."""
    if source == target:
        return list(ring)
    out = []
    for (x0, y0), (x1, y1) in zip(ring, [*ring[1:], ring[0]], strict=True):
        for i in range(between + 1):
            f = i / (between + 1)
            out.append(reproject(x0 + (x1 - x0) * f, y0 + (y1 - y0) * f, source, target, NUMBERS))
    return out


def unwrap(x, tile_left):
    """Shift x by a full turn where a tile of a world grid begins west of -180 degrees."""
    return F.when(tile_left < -180, x - 360).otherwise(x)
