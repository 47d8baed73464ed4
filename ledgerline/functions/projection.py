"""Map projections and datum shifts as column expressions: Cassini-Soldner coordinates to longitude and latitude."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import let, xy


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    inverse_flattening: float

    @property
    def e2(self) -> float:
        f = 1 / self.inverse_flattening
        return f * (2 - f)

    @property
    def b(self) -> float:
        return self.a * (1 - 1 / self.inverse_flattening)


@dataclass(frozen=True)
class Cassini:
    """Origin in degrees, false easting and northing."""

    ellipsoid: Ellipsoid
    lat: float
    lon: float
    easting: float
    northing: float


@dataclass(frozen=True)
class Shift:
    """Seven parameters, position vector: metres, seconds of arc, parts per million."""

    x: float
    y: float
    z: float
    rx: float = 0.0
    ry: float = 0.0
    rz: float = 0.0
    scale: float = 0.0


# Published ellipsoids, the Berlin Soldner system (EPSG 3068) and the shift of its datum to WGS 84 (EPSG 1777).
BESSEL = Ellipsoid(6377397.155, 299.1528128)
WGS84 = Ellipsoid(6378137.0, 298.257223563)
BERLIN = Cassini(BESSEL, 52.41864827777778, 13.62720366666667, 40000.0, 10000.0)
DHDN = Shift(598.1, 73.7, 418.2, 0.202, 0.045, -2.455, 6.7)


def meridian_arc(e: Ellipsoid, lat: float) -> float:
    """Length of the meridian from the equator (radians)."""
    e2 = e.e2
    return e.a * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * lat
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * math.sin(2 * lat)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * math.sin(4 * lat)
        - 35 * e2**3 / 3072 * math.sin(6 * lat)
    )


def geographic(x: Column, y: Column, p: Cassini) -> Column:
    """(x: longitude, y: latitude), in radians, of projected coordinates on the projection's own ellipsoid."""
    e2 = p.ellipsoid.e2
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    unit = p.ellipsoid.a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256)
    mu = (y - p.northing + meridian_arc(p.ellipsoid, math.radians(p.lat))) / unit
    series = (3 * e1 / 2 - 27 * e1**3 / 32, 21 * e1**2 / 16 - 55 * e1**4 / 32, 151 * e1**3 / 96, 1097 * e1**4 / 512)

    def foot(m: Column) -> Column:
        out = m
        for k, c in enumerate(series, 1):
            out = out + c * F.sin(2 * k * m)
        return out

    def place(s: Column) -> Column:
        # s: foot latitude, square of its tangent, radius along the meridian over that across, distance from the meridian over the latter.
        d, t = s["d"], s["t"]
        lat = s["foot"] - F.tan(s["foot"]) / s["ratio"] * (d * d / 2 - (1 + 3 * t) * d * d * d * d / 24)
        lon = math.radians(p.lon) + (d - t * d * d * d / 3 + (1 + 3 * t) * t * d * d * d * d * d / 15) / F.cos(s["foot"])
        return xy(lon, lat)

    def about(f: Column) -> Column:
        w2 = 1 - e2 * F.sin(f) * F.sin(f)
        d = (x - p.easting) * F.sqrt(w2) / p.ellipsoid.a
        return let(F.struct(f.alias("foot"), (F.tan(f) * F.tan(f)).alias("t"), ((1 - e2) / w2).alias("ratio"), d.alias("d")), place)

    return let(let(mu, foot), about)


def earth_centred(lon: Column, lat: Column, e: Ellipsoid) -> Column:
    """(x, y, z) in metres of a place on the ellipsoid."""
    radius = e.a / F.sqrt(1 - e.e2 * F.sin(lat) * F.sin(lat))
    return let(radius, lambda n: F.struct((n * F.cos(lat) * F.cos(lon)).alias("x"), (n * F.cos(lat) * F.sin(lon)).alias("y"), (n * (1 - e.e2) * F.sin(lat)).alias("z")))


def shifted(v: Column, s: Shift) -> Column:
    rx, ry, rz = (math.radians(r / 3600) for r in (s.rx, s.ry, s.rz))
    m = 1 + s.scale * 1e-6
    return F.struct(
        (s.x + m * (v["x"] - rz * v["y"] + ry * v["z"])).alias("x"), (s.y + m * (rz * v["x"] + v["y"] - rx * v["z"])).alias("y"), (s.z + m * (-ry * v["x"] + rx * v["y"] + v["z"])).alias("z")
    )


def on_ellipsoid(v: Column, e: Ellipsoid) -> Column:
    """(x: longitude, y: latitude), in radians, of an earth-centred place near the surface; within a millimetre."""
    second = (e.a**2 - e.b**2) / e.b**2

    def place(s: Column) -> Column:
        sin, cos = F.sin(s["angle"]), F.cos(s["angle"])
        lat = F.atan2(v["z"] + second * e.b * sin * sin * sin, s["r"] - e.e2 * e.a * cos * cos * cos)
        return xy(F.atan2(v["y"], v["x"]), lat)

    def reduced(r: Column) -> Column:
        return let(F.struct(r.alias("r"), F.atan2(v["z"] * e.a, r * e.b).alias("angle")), place)

    return let(F.sqrt(v["x"] * v["x"] + v["y"] * v["y"]), reduced)


def to_wgs84(x: Column, y: Column, projection: Cassini = BERLIN, shift: Shift = DHDN) -> Column:
    """(x: longitude, y: latitude), in degrees on WGS 84, of projected coordinates. NULL for missing ones."""
    moved = lambda g: let(earth_centred(g["x"], g["y"], projection.ellipsoid), lambda v: let(shifted(v, shift), lambda w: on_ellipsoid(w, WGS84)))
    degrees = let(let(geographic(x.cast("double"), y.cast("double"), projection), moved), lambda g: xy(F.degrees(g["x"]), F.degrees(g["y"])))
    return F.when(x.isNotNull() & y.isNotNull(), degrees)


def line_to_wgs84(line: Column, projection: Cassini = BERLIN, shift: Shift = DHDN) -> Column:
    """All points of an array."""
    return F.transform(line, lambda p: to_wgs84(p["x"], p["y"], projection, shift))
