"""Polygons with holes and several parts as columns: array<array<ring>>, ring = array<struct<x,y>>.

A part is its shell followed by its holes; rings may be closed or not, and run either way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftlode.functions.geo import vertices
from driftlode.functions.geodesic import bound, inverse

KIND = "array<array<array<struct<x:double,y:double>>>>"


def of_ring(ring: Column) -> Column:
    """The polygon with that shell alone."""
    return F.array(F.array(ring))


def rings(polygon: Column) -> Column:
    return F.flatten(polygon)


def shells(polygon: Column) -> Column:
    return F.transform(polygon, lambda part: F.get(part, F.lit(0)))


def shell_vertices(polygon: Column) -> Column:
    """The vertices of all shells, each closed."""
    return vertices(shells(polygon))


def moved(polygon: Column, to: Callable[[Column], Column]) -> Column:
    """The polygon with every vertex replaced by ``to`` (struct<x,y>) of it."""
    return F.transform(polygon, lambda part: F.transform(part, lambda ring: F.transform(ring, to)))


def _next(ring: Column, i: Column) -> Column:
    return F.get(ring, (i + 1) % F.size(ring))


def _moments(polygon: Column) -> Column:
    """struct<x0,y0,area2,mx,my>: the first vertex, and twice the area and six times the first moments about it; holes count against."""
    none = F.struct(*(F.lit(0.0).alias(c) for c in ("area2", "mx", "my")))
    plus = lambda a, b: F.struct(*((a[c] + b[c]).alias(c) for c in ("area2", "mx", "my")))

    def of(first: Column) -> Column:
        def side(ring: Column):
            def term(p: Column, i: Column) -> Column:
                q = _next(ring, i)
                x, y, u, v = p["x"] - first["x"], p["y"] - first["y"], q["x"] - first["x"], q["y"] - first["y"]
                return bound(x * v - u * y, lambda c: F.struct(c.alias("area2"), ((x + u) * c).alias("mx"), ((y + v) * c).alias("my")))

            return term

        def ring_sums(ring: Column, k: Column) -> Column:
            role = lambda m: F.signum(m["area2"]) * F.when(k == 0, 1.0).otherwise(-1.0)
            return bound(F.aggregate(F.transform(ring, side(ring)), none, plus), lambda m: F.struct(*((m[c] * role(m)).alias(c) for c in ("area2", "mx", "my"))))

        each = F.flatten(F.transform(polygon, lambda part: F.transform(part, ring_sums)))
        return bound(F.aggregate(each, none, plus), lambda m: F.struct(first["x"].alias("x0"), first["y"].alias("y0"), *(m[c].alias(c) for c in ("area2", "mx", "my"))))

    return bound(F.get(F.get(F.get(polygon, F.lit(0)), F.lit(0)), F.lit(0)), of)


def area(polygon: Column) -> Column:
    """Planar area without the holes; null without a vertex."""
    return _moments(polygon)["area2"] / 2


def centroid(polygon: Column) -> Column:
    """struct<x,y>: the planar centroid of what lies in the polygon; null if that has no area."""
    share = lambda m, k: m[f"{k}0"] + m[f"m{k}"] / F.nullif(3 * m["area2"], F.lit(0.0))
    return bound(_moments(polygon), lambda m: F.struct(share(m, "x").alias("x"), share(m, "y").alias("y")))


def contains(x: Column, y: Column, polygon: Column) -> Column:
    """Ray cast over all rings: whether the point lies in a part and in none of its holes."""

    def crossings(ring: Column) -> Column:
        def crosses(p: Column, i: Column) -> Column:
            q = _next(ring, i)
            return ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.when(q["y"] == p["y"], 1.0).otherwise(q["y"] - p["y"]) + p["x"])

        return F.size(F.filter(F.transform(ring, crosses), lambda c: c))

    return F.aggregate(F.transform(rings(polygon), crossings), F.lit(0), lambda a, n: a + n) % 2 == 1


def area_km2(polygon: Column) -> Column:
    """Area of a lon/lat polygon on the azimuthal equidistant plane of the ellipsoid about its centroid."""

    def about(c: Column) -> Column:
        def put(p: Column) -> Column:
            return bound(inverse(c["y"], c["x"], p["y"], p["x"]), lambda g: F.struct((g["metres"] * F.sin(g["azimuth"])).alias("x"), (g["metres"] * F.cos(g["azimuth"])).alias("y")))

        return area(moved(polygon, put)) / 1e6

    return F.coalesce(bound(centroid(polygon), about), F.lit(0.0))
