"""The inverse problem on the WGS84 ellipsoid, and transverse Mercator zones, as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from driftlode.functions.geo import WGS84_A, WGS84_F, haversine_km

ROUNDS, SETTLED = 20, 1e-13


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def inverse(lat1: Column, lon1: Column, lat2: Column, lon2: Column, rounds: int = ROUNDS) -> Column:
    """struct<metres,azimuth,settled>: distance and initial azimuth (radians) by Vincenty's inverse, of degrees.

    At most ``rounds`` rounds, none after the longitude has settled. Nearly antipodal points, for which it doesn't, get the
    great-circle distance and azimuth on the sphere.
    """
    k = 1 - WGS84_F
    reduced = lambda lat: F.atan(k * F.tan(F.radians(lat)))

    def solve(p: Column) -> Column:
        def step(a: Column, _: Column) -> Column:
            def angles(t: Column) -> Column:
                sin_s = F.sqrt(F.pow(p["c2"] * t["s"], 2) + F.pow(p["c1"] * p["s2"] - p["s1"] * p["c2"] * t["c"], 2))
                return F.struct(sin_s.alias("sin_s"), (p["s1"] * p["s2"] + p["c1"] * p["c2"] * t["c"]).alias("cos_s"), (p["c1"] * p["c2"] * t["s"]).alias("top"))

            def bend(x: Column) -> Column:
                sin_a = F.when(x["sin_s"] > 0, x["top"] / F.when(x["sin_s"] > 0, x["sin_s"]).otherwise(1.0)).otherwise(0.0)
                return F.struct(x["sin_s"].alias("sin_s"), x["cos_s"].alias("cos_s"), F.atan2(x["sin_s"], x["cos_s"]).alias("sig"), sin_a.alias("sin_a"), (1 - sin_a * sin_a).alias("cos2_a"))

            def mid(x: Column) -> Column:
                flat = x["cos2_a"] > 1e-15
                return F.struct(*(x[c].alias(c) for c in ("sin_s", "cos_s", "sig", "sin_a", "cos2_a")), F.when(flat, x["cos_s"] - 2 * p["s1"] * p["s2"] / F.when(flat, x["cos2_a"]).otherwise(1.0)).otherwise(0.0).alias("m"))

            def ahead(x: Column) -> Column:
                c = WGS84_F / 16 * x["cos2_a"] * (4 + WGS84_F * (4 - 3 * x["cos2_a"]))
                new = lambda c: p["span"] + (1 - c) * WGS84_F * x["sin_a"] * (x["sig"] + c * x["sin_s"] * (x["m"] + c * x["cos_s"] * (2 * x["m"] * x["m"] - 1)))
                return bound(bound(c, new), lambda n: F.struct(n.alias("lam"), (F.abs(n - a["lam"]) < SETTLED).alias("settled"), *(x[c].alias(c) for c in ("sin_s", "cos_s", "sig", "cos2_a", "m"))))

            turned = F.struct(F.sin(a["lam"]).alias("s"), F.cos(a["lam"]).alias("c"))
            return F.when(a["settled"], a).otherwise(bound(bound(bound(bound(turned, angles), bend), mid), ahead))

        def told(a: Column) -> Column:
            b = WGS84_A * k
            u2 = a["cos2_a"] * ((WGS84_A**2 - b**2) / b**2)

            def metres(u: Column) -> Column:
                big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
                small = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
                m2 = a["m"] * a["m"]
                fix = small * a["sin_s"] * (a["m"] + small / 4 * (a["cos_s"] * (2 * m2 - 1) - small / 6 * a["m"] * (4 * a["sin_s"] * a["sin_s"] - 3) * (4 * m2 - 3)))
                return b * big * (a["sig"] - fix)

            azimuth = F.atan2(p["c2"] * F.sin(a["lam"]), p["c1"] * p["s2"] - p["s1"] * p["c2"] * F.cos(a["lam"]))
            around = F.atan2(p["c2"] * F.sin(p["span"]), p["c1"] * p["s2"] - p["s1"] * p["c2"] * F.cos(p["span"]))
            return F.struct(
                F.when(a["settled"], bound(u2, metres)).otherwise(haversine_km(lat1, lon1, lat2, lon2) * 1000).alias("metres"),
                F.when(a["settled"], azimuth).otherwise(around).alias("azimuth"), a["settled"].alias("settled"),
            )

        start = F.struct(p["span"].alias("lam"), F.lit(False).alias("settled"), *(F.lit(0.0).alias(c) for c in ("sin_s", "cos_s", "sig", "cos2_a", "m")))
        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, told)

    at = bound(F.struct(reduced(lat1).alias("u1"), reduced(lat2).alias("u2")), lambda u: F.struct(F.sin(u["u1"]).alias("s1"), F.cos(u["u1"]).alias("c1"), F.sin(u["u2"]).alias("s2"), F.cos(u["u2"]).alias("c2"), F.radians(lon2 - lon1).alias("span")))
    return F.when(lat1.isNotNull() & lon1.isNotNull() & lat2.isNotNull() & lon2.isNotNull(), bound(at, solve))


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return inverse(lat1, lon1, lat2, lon2)["metres"] / 1000


# Transverse Mercator by the series in the third flattening, to its fourth power. The published coefficients.
N3 = WGS84_F / (2 - WGS84_F)
RECTIFIED = WGS84_A / (1 + N3) * (1 + N3**2 / 4 + N3**4 / 64)
FORWARD = (
    N3 / 2 - 2 * N3**2 / 3 + 5 * N3**3 / 16 + 41 * N3**4 / 180,
    13 * N3**2 / 48 - 3 * N3**3 / 5 + 557 * N3**4 / 1440,
    61 * N3**3 / 240 - 103 * N3**4 / 140,
    49561 * N3**4 / 161280,
)
BACK = (
    N3 / 2 - 2 * N3**2 / 3 + 37 * N3**3 / 96 - N3**4 / 360,
    N3**2 / 48 + N3**3 / 15 - 437 * N3**4 / 1440,
    17 * N3**3 / 480 - 37 * N3**4 / 840,
    4397 * N3**4 / 161280,
)
LATITUDE = (
    2 * N3 - 2 * N3**2 / 3 - 2 * N3**3 + 116 * N3**4 / 45,
    7 * N3**2 / 3 - 8 * N3**3 / 5 - 227 * N3**4 / 45,
    56 * N3**3 / 15 - 136 * N3**4 / 35,
    4279 * N3**4 / 630,
)
SCALE, EASTING, NORTHING = 0.9996, 500_000.0, 10_000_000.0
ECCENTRICITY = 2 * math.sqrt(N3) / (1 + N3)


class _Columns:
    sin, cos, sinh, cosh, asin, atan2, atanh, hypot = (staticmethod(getattr(F, n)) for n in ("sin", "cos", "sinh", "cosh", "asin", "atan2", "atanh", "hypot"))
    bound = staticmethod(bound)
    pair = staticmethod(lambda a, b: F.struct(a.alias("a"), b.alias("b")))


class _Arrays:
    sin, cos, sinh, cosh, asin, atan2, atanh, hypot = np.sin, np.cos, np.sinh, np.cosh, np.arcsin, np.arctan2, np.arctanh, np.hypot
    bound = staticmethod(lambda value, body: body(value))
    pair = staticmethod(lambda a, b: {"a": a, "b": b})


def _from_plane(m, x, y, north):
    """Latitude and longitude from the middle meridian, in radians, of easting and northing."""

    def series(p):
        a = p["a"] - sum(c * m.sin(2 * (j + 1) * p["a"]) * m.cosh(2 * (j + 1) * p["b"]) for j, c in enumerate(BACK))
        b = p["b"] - sum(c * m.cos(2 * (j + 1) * p["a"]) * m.sinh(2 * (j + 1) * p["b"]) for j, c in enumerate(BACK))
        return m.pair(a, b)

    def degrees(p):
        chi = m.asin(m.sin(p["a"]) / m.cosh(p["b"]))
        lat = m.bound(chi, lambda c: c + sum(k * m.sin(2 * (j + 1) * c) for j, k in enumerate(LATITUDE)))
        return m.pair(lat, m.atan2(m.sinh(p["b"]), m.cos(p["a"])))

    start = m.pair((y - north) / (SCALE * RECTIFIED), (x - EASTING) / (SCALE * RECTIFIED))
    return m.bound(m.bound(start, series), degrees)


def _to_plane(m, lat, lon, north):
    """Easting and northing of latitude and longitude from the middle meridian, in radians."""
    s = m.sin(lat)
    t = m.bound(m.atanh(s) - ECCENTRICITY * m.atanh(ECCENTRICITY * s), m.sinh)
    start = m.bound(t, lambda t: m.pair(m.atan2(t, m.cos(lon)), m.atanh(m.sin(lon) / m.hypot(t, 1.0 + 0 * t))))

    def series(p):
        a = p["a"] + sum(c * m.sin(2 * (j + 1) * p["a"]) * m.cosh(2 * (j + 1) * p["b"]) for j, c in enumerate(FORWARD))
        b = p["b"] + sum(c * m.cos(2 * (j + 1) * p["a"]) * m.sinh(2 * (j + 1) * p["b"]) for j, c in enumerate(FORWARD))
        return m.pair(EASTING + SCALE * RECTIFIED * b, north + SCALE * RECTIFIED * a)

    return m.bound(start, series)


def utm_zone(crs: str) -> tuple[int, bool] | None:
    """Zone and whether it is a southern one, of EPSG:326zz or EPSG:327zz; None for any other system."""
    code = crs.upper().removeprefix("EPSG:")
    ok = len(code) == 5 and code.isdigit() and code[:3] in ("326", "327") and 1 <= int(code[3:]) <= 60
    return (int(code[3:]), code[2] == "7") if ok else None


def lonlat_of_utm(x: np.ndarray, y: np.ndarray, zone: int, south: bool) -> tuple[np.ndarray, np.ndarray]:
    """Longitude and latitude in degrees, for arrays."""
    p = _from_plane(_Arrays, np.asarray(x, float), np.asarray(y, float), NORTHING if south else 0.0)
    return (np.degrees(p["b"]) + 6 * zone + 357) % 360 - 180, np.degrees(p["a"])


def _known(crs: Column) -> tuple[Column, Column, Column, Column]:
    """Whether a system is that of degrees, whether a UTM zone, and the zone's middle meridian and false northing."""
    code = F.upper(crs)
    plain = crs.isNull() | code.isin("EPSG:4326", "OGC:CRS84")
    zone = F.regexp_extract(code, "^EPSG:32[67](\\d\\d)$", 1).try_cast("int")
    return plain, zone.between(1, 60), 6.0 * zone - 183, F.when(code.startswith("EPSG:327"), NORTHING).otherwise(0.0)


def _or_error(plain: Column, utm: Column, crs: Column, as_is: Column, moved: Column) -> Column:
    wrong = F.raise_error(F.concat(F.lit("coordinates in "), crs, F.lit(" aren't supported"))).cast("struct<x:double,y:double>")
    return F.when(plain, as_is).when(F.coalesce(utm, F.lit(False)), moved).otherwise(wrong)


def to_wgs84(x: Column, y: Column, crs: Column) -> Column:
    """struct<x,y>: longitude and latitude of a place in ``crs``: EPSG:4326 (or null), or a UTM zone of WGS84, EPSG:326zz and 327zz. Any other is an error."""
    plain, utm, middle, north = _known(crs)
    found = bound(_from_plane(_Columns, x, y, north), lambda p: F.struct((F.pmod(F.degrees(p["b"]) + middle + 540, F.lit(360.0)) - 180).alias("x"), F.degrees(p["a"]).alias("y")))
    return _or_error(plain, utm, crs, F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")), found)


def from_wgs84(lon: Column, lat: Column, crs: Column) -> Column:
    """struct<x,y>: the place in ``crs`` of longitude and latitude."""
    plain, utm, middle, north = _known(crs)
    found = bound(_to_plane(_Columns, F.radians(lat), F.radians(lon - middle), north), lambda p: F.struct(p["a"].alias("x"), p["b"].alias("y")))
    return _or_error(plain, utm, crs, F.struct(lon.cast("double").alias("x"), lat.cast("double").alias("y")), found)
