"""Geodesy and planar geometry as column expressions, and the ellipsoidal inverse for Arrow UDFs."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_RADIUS_KM = 6371.0088
METRES_PER_DEGREE = 111_320.0
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(h))


def metres_per_degree_lon(lat) -> Column:
    c = F.cos(F.radians(lat))
    return METRES_PER_DEGREE * F.when(F.abs(c) < 1e-6, F.when(c < 0, -1e-6).otherwise(1e-6)).otherwise(c)


def to_degrees_per_second(u, v, lat) -> tuple[Column, Column]:
    """Eastward and northward m/s to degrees of latitude and longitude a second."""
    return v / METRES_PER_DEGREE, u / metres_per_degree_lon(lat)


def elongation(var_x: Column, var_y: Column, cov: Column, floor: float = 1e-9) -> Column:
    """sqrt of the ratio of the eigenvalues of a 2x2 covariance, each at least ``floor``."""
    mid, half = (var_x + var_y) / 2, F.sqrt(F.pow((var_x - var_y) / 2, 2) + cov * cov)
    return F.sqrt(F.greatest(mid + half, F.lit(floor)) / F.greatest(mid - half, F.lit(floor)))


def ring_area2(ring: Column) -> Column:
    """Twice the signed planar area of a ring array<struct<x,y>>, closed or not."""
    return F.aggregate(F.transform(ring, lambda p, i: _cross(p, F.get(ring, (i + 1) % F.size(ring)))), F.lit(0.0), lambda a, x: a + x)


def _cross(p: Column, q: Column) -> Column:
    return p["x"] * q["y"] - q["x"] * p["y"]


def ring_centroid(ring: Column) -> Column:
    """struct<x,y>: the planar centroid of a ring. Moments are taken about the first vertex: about 0 they lose half the digits of a small ring."""
    first = F.get(ring, F.lit(0))
    own = F.transform(ring, lambda p: F.struct((p["x"] - first["x"]).alias("x"), (p["y"] - first["y"]).alias("y")))

    def moment(own: Column, axis: str) -> Column:
        terms = F.transform(own, lambda p, i: (p[axis] + F.get(own, (i + 1) % F.size(own))[axis]) * _cross(p, F.get(own, (i + 1) % F.size(own))))
        return first[axis] + F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / (3 * ring_area2(own))

    return F.element_at(F.transform(F.array(own), lambda o: F.struct(moment(o, "x").alias("x"), moment(o, "y").alias("y"))), 1)


def vertices(rings: Column) -> Column:
    """The vertices of all exterior rings (array of rings), each closed: its first vertex comes twice."""
    return F.flatten(F.transform(rings, close_ring))


def require_wgs84(crs: Column) -> Column:
    """EPSG:4326 (or null, taken for it); an error for any other system, for what works in degrees alone; geodesic.to_wgs84 reprojects."""
    known = crs.isNull() | F.upper(crs).isin("EPSG:4326", "OGC:CRS84")
    return F.when(known, F.lit("EPSG:4326")).otherwise(F.raise_error(F.concat(F.lit("coordinates in "), crs, F.lit(" aren't supported"))).cast("string"))


def close_ring(ring: Column) -> Column:
    """The ring with its first vertex repeated at the end, if it isn't yet."""
    return F.when((F.size(ring) > 0) & (F.element_at(ring, 1) != F.element_at(ring, -1)), F.concat(ring, F.slice(ring, 1, 1))).otherwise(ring)


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Ray cast: whether the point lies in the ring."""

    def crosses(p: Column, i: Column) -> Column:
        q = F.get(ring, (i + 1) % F.size(ring))
        return ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.when(q["y"] == p["y"], 1.0).otherwise(q["y"] - p["y"]) + p["x"])

    return F.size(F.filter(F.transform(ring, crosses), lambda c: c)) % 2 == 1


def bbox(ring: Column, pad: float = 0.0) -> Column:
    x, y = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct((F.array_min(x) - pad).alias("min_lon"), (F.array_min(y) - pad).alias("min_lat"), (F.array_max(x) + pad).alias("max_lon"), (F.array_max(y) + pad).alias("max_lat"))


def pixel_to_latlon(col, row, width, height, top, left, bottom, right) -> tuple[Column, Column]:
    u, v = col / F.greatest(width - 1, F.lit(1)), row / F.greatest(height - 1, F.lit(1))
    return top - v * (top - bottom), left + u * (right - left)


def solve_bbox(u, v, lat, lon, span_lat: float, span_lon: float) -> Column:
    """The box that maps the normalised pixel (u, v) to (lat, lon), to 6 decimals."""
    top, left = lat + v * span_lat, lon - u * span_lon
    return F.struct(F.round(top, 6).alias("top"), F.round(left, 6).alias("left"), F.round(top - span_lat, 6).alias("bottom"), F.round(left + span_lon, 6).alias("right"))


def geodesic(lat1, lon1, lat2, lon2) -> tuple[np.ndarray, np.ndarray]:
    """Distance in metres and initial azimuth in radians on the WGS84 ellipsoid (Vincenty's inverse).

    Nearly antipodal points, for which the iteration doesn't settle, get the last iterate.
    """
    lat1, lon1, lat2, lon2 = np.broadcast_arrays(*(np.radians(np.asarray(v, float)) for v in (lat1, lon1, lat2, lon2)))
    b = WGS84_A * (1 - WGS84_F)
    u1, u2 = np.arctan((1 - WGS84_F) * np.tan(lat1)), np.arctan((1 - WGS84_F) * np.tan(lat2))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    span = lon2 - lon1
    lam = span.copy()
    for _ in range(100):
        sl, cl = np.sin(lam), np.cos(lam)
        sin_s = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
        cos_s = s1 * s2 + c1 * c2 * cl
        sig = np.arctan2(sin_s, cos_s)
        sin_a = np.where(sin_s > 0, c1 * c2 * sl / np.where(sin_s > 0, sin_s, 1), 0)
        cos2_a = 1 - sin_a**2
        cos_2m = np.where(cos2_a > 1e-15, cos_s - 2 * s1 * s2 / np.where(cos2_a > 1e-15, cos2_a, 1), 0)
        c = WGS84_F / 16 * cos2_a * (4 + WGS84_F * (4 - 3 * cos2_a))
        new = span + (1 - c) * WGS84_F * sin_a * (sig + c * sin_s * (cos_2m + c * cos_s * (2 * cos_2m**2 - 1)))
        done, lam = np.max(np.abs(new - lam), initial=0) < 1e-12, new
        if done:
            break
    k = cos2_a * (WGS84_A**2 - b**2) / b**2
    big = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
    small = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
    fix = small * sin_s * (cos_2m + small / 4 * (cos_s * (2 * cos_2m**2 - 1) - small / 6 * cos_2m * (4 * sin_s**2 - 3) * (4 * cos_2m**2 - 3)))
    return b * big * (sig - fix), np.arctan2(c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam))


def polygon_area_km2(lon: np.ndarray, lat: np.ndarray) -> float:
    """Area of a lon/lat ring on the azimuthal equidistant plane about its centroid."""
    return polygon_areas_km2([np.column_stack([lon, lat])])[0]


def polygon_areas_km2(rings: list[np.ndarray]) -> list[float]:
    """polygon_area_km2() of each ring (n x 2, lon and lat); the distances of all of them are taken together."""
    out, known = [0.0] * len(rings), []
    for k, ring in enumerate(rings):
        if len(ring) < 3:
            continue
        # the ring is shifted to its first vertex, as the products of degrees lose digits
        (x, y), (nx, ny) = (ring - ring[0]).T, (np.roll(ring, -1, axis=0) - ring[0]).T
        cross = x * ny - nx * y
        if abs(cross.sum()) >= 1e-18:
            known.append((k, ring, ring[0] + np.array([((x + nx) * cross).sum(), ((y + ny) * cross).sum()]) / (3 * cross.sum())))
    if known:
        sizes = [len(ring) for _, ring, _ in known]
        (lon, lat), (cx, cy) = np.vstack([ring for _, ring, _ in known]).T, np.repeat([c for *_, c in known], sizes, axis=0).T
        s, az = geodesic(cy, cx, lat, lon)
        ends = np.cumsum(sizes)[:-1]
        for (k, *_), px, py in zip(known, np.split(s * np.sin(az), ends), np.split(s * np.cos(az), ends), strict=True):
            out[k] = float(abs((px * np.roll(py, -1) - np.roll(px, -1) * py).sum()) / 2e6)
    return out


def convex_hull(x: np.ndarray, y: np.ndarray) -> np.ndarray | None:
    """Vertices (n x 2) of the hull, counter-clockwise; None for fewer than three or collinear points."""
    points = sorted(set(zip(x.tolist(), y.tolist(), strict=True)))

    def half(seq):
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    ring = half(points) + half(points[::-1])
    return np.array(ring) if len(ring) > 2 else None


def simplify(points: np.ndarray, most: int = 40, fraction: float = 0.012) -> np.ndarray:
    """A closed outline with at most ``most`` vertices: Douglas-Peucker, the tolerance grown by 1.4 until it holds."""
    edge = np.hypot(*(np.roll(points, -1, axis=0) - points).T).sum()
    eps = fraction * edge
    while True:
        keep = _kept(points, eps)
        if len(keep) <= most or eps <= 0 or eps > edge:
            return points[keep]
        eps *= 1.4


def _kept(points: np.ndarray, eps: float) -> list[int]:
    n = len(points)
    if n < 4:
        return list(range(n))
    far = int(np.argmax(np.hypot(*(points - points[0]).T)))
    keep, todo = {0, far}, [(0, far), (far, n)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        p, q, mid = points[a], points[b % n], points[a + 1 : b]
        d = q - p
        dist = np.hypot(*(mid - p).T) if not d.any() else np.abs(d[0] * (mid[:, 1] - p[1]) - d[1] * (mid[:, 0] - p[0])) / math.hypot(*d)
        k = int(np.argmax(dist))
        if dist[k] > eps:
            keep.add(a + 1 + k)
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return sorted(keep)
