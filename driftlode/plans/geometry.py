"""Registered queries of polygons with holes, of reference systems, of land and of distances on the ellipsoid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlode.functions import geodesic, polygon
from driftlode.operators import hull, posterior, raster
from driftlode.plans.queries import LABELLED, MEMBERS, PIXELS, labelled, members, query, r
from driftlode.plans.views import sql, view


@query(
    f"""{LABELLED},
quads as (select label, row + dr as y, col + dc as x, count(*) as n, sum(case when dr = dc then 1 else 0 end) as same from lab
    cross join (select unnest([0, 1]) as dr) p cross join (select unnest([0, 1]) as dc) q group by 1, 2, 3),
turns as (select label, sum(case when n in (1, 3) then 1 when n = 2 and same in (0, 2) then 2 else 0 end) as corners from quads group by 1),
z as (select label, count(*) as n, avg(col) + 0.5e0 as x, avg(row) + 0.5e0 as y from lab group by 1)
select label, n + 0e0 as area, cast(corners as bigint) as corners, round(x, 6) as x, round(y, 6) as y from z join turns using (label)"""
)
def slick_polygons(s, d):
    """Blobs as polygons with holes and parts: their area is that of the pixels, their corners those of the outline."""
    shape = F.col("polygon")
    n = F.aggregate(F.transform(polygon.rings(shape), F.size), F.lit(0), lambda a, x: a + x)
    out = raster.blob_polygons(labelled(s, d)).select("label", r(polygon.area(shape)).alias("area"), n.cast("long").alias("corners"), polygon.centroid(shape).alias("c"))
    return out.select("label", "area", "corners", r("c.x").alias("x"), r("c.y").alias("y"))


#: A quadrangle with a three-cornered lake, by the key k of a polygon, around (x, y): dx, dy of each corner.
LAND = [[("-9.5e0 - k % 5", "-7.25e0"), ("8.5e0", "-6.5e0 + k % 3"), ("7.25e0", "9.5e0"), ("-6.5e0", "8.25e0")], [("-2.5e0", "-2.25e0"), ("2.5e0", "-1.5e0"), ("1.25e0", "2.5e0")]]
PLACES = "select s_suppkey as k, (s_suppkey * 37) % 200 + 0e0 as x, (s_suppkey * 53) % 997 + 0e0 as y from {supplier}"
SIDES = " union all ".join(f"select k, x + ({a}) as ax, y + ({b}) as ay, x + ({c}) as bx, y + ({e}) as by_ from places" for ring in LAND for (a, b), (c, e) in zip(ring, ring[1:] + ring[:1], strict=True))


def land(s, d) -> DataFrame:
    """An island with a lake for each supplier, in columns and rows of the mosaic."""
    ring = lambda corners: "array(" + ", ".join(f"named_struct('x', cast(x + ({a}) as double), 'y', cast(y + ({b}) as double))" for a, b in corners) + ")"
    places = s.sql(PLACES, supplier=s.read.parquet(f"{d}/supplier.parquet"))
    return places.selectExpr("0L as scene_id", f"array(array({', '.join(map(ring, LAND))})) as polygon")


@query(
    f"""{PIXELS}, places as ({PLACES.format(supplier="supplier")}), sides as ({SIDES}),
hit as (select row, col, k from raster join sides on (ay > row) <> (by_ > row) and col < (bx - ax) * (row - ay) / (by_ - ay) + ax group by 1, 2, 3 having count(*) % 2 = 1)
select row, col, not exists (select 1 from hit where hit.row = raster.row and hit.col = raster.col) as water from raster"""
)
def land_water(s, d):
    return raster.water_mask(view(s, d, "raster"), land(s, d)).select("row", "col", "water")


def plane_sql(lat: str, lon: str) -> tuple[str, str]:
    """Northing and easting above the equator of radians from the middle meridian: the series, written out."""
    e = repr(geodesic.ECCENTRICITY)
    t = f"sinh(atanh(sin({lat})) - {e} * atanh({e} * sin({lat})))"
    a, b = f"atan2({t}, cos({lon}))", f"atanh(sin({lon}) / sqrt({t} * {t} + 1))"
    north = " + ".join(f"{c!r} * sin({2 * j + 2} * a) * cosh({2 * j + 2} * b)" for j, c in enumerate(geodesic.FORWARD))
    east = " + ".join(f"{c!r} * cos({2 * j + 2} * a) * sinh({2 * j + 2} * b)" for j, c in enumerate(geodesic.FORWARD))
    return f"{a} as a, {b} as b", f"{geodesic.EASTING!r} + {geodesic.SCALE * geodesic.RECTIFIED!r} * (b + {east}) as x, {geodesic.SCALE * geodesic.RECTIFIED!r} * (a + {north}) as y"


def degrees_sql() -> tuple[str, str, str]:
    """The way back, in three steps: a, b; c (conformal latitude) and lon; lat."""
    size = repr(geodesic.SCALE * geodesic.RECTIFIED)
    a = " ".join(f"- {c!r} * sin({2 * j + 2} * n / {size}) * cosh({2 * j + 2} * e / {size})" for j, c in enumerate(geodesic.BACK))
    b = " ".join(f"- {c!r} * cos({2 * j + 2} * n / {size}) * sinh({2 * j + 2} * e / {size})" for j, c in enumerate(geodesic.BACK))
    lat = " ".join(f"+ {c!r} * sin({2 * j + 2} * c)" for j, c in enumerate(geodesic.LATITUDE))
    return f"n / {size} {a} as a, e / {size} {b} as b", "asin(sin(a) / cosh(b)) as c, degrees(atan2(sinh(b), cos(a))) as lon", f"degrees(c {lat}) as lat"


UTM = """utm as (select o_orderkey as k, 1 + o_orderkey % 60 as zone, o_orderkey % 3 = 0 as south, (o_orderkey * 37) % 8400 / 1e2 as far, (o_orderkey * 53) % 700 / 1e2 - 3.5e0 as aside,
    166000e0 + (o_orderkey * 7919) % 668000 as east, (o_orderkey * 104729) % 9300000 + 0e0 as north from {orders})"""


@query(
    f"""with {UTM.format(orders="orders")},
f0 as (select *, radians(case when south then -far else far end) as la, radians(aside) as lo from utm), f1 as (select *, {plane_sql("la", "lo")[0]} from f0), f2 as (select *, {plane_sql("la", "lo")[1]} from f1),
b0 as (select k, zone, south, case when south then north - 1e7 else north end as n, east - 500000e0 as e from utm), b1 as (select *, {degrees_sql()[0]} from b0),
b2 as (select *, {degrees_sql()[1]} from b1), b3 as (select *, {degrees_sql()[2]} from b2)
select f2.k, round(x, 4) as x, round(case when f2.south then y + 1e7 else y end, 4) as y, round((lon + 6 * b3.zone + 357 + 360) % 360 - 180, 8) as lon, round(lat, 8) as lat from f2 join b3 using (k)"""
)
def utm_places(s, d):
    """Degrees to a zone's plane, and a plane's places to degrees, in zones of both hemispheres."""
    k = s.sql(f"with {UTM} select * from utm", orders=s.read.parquet(f"{d}/orders.parquet"))
    crs = F.concat(F.when(F.col("south"), "EPSG:327").otherwise("EPSG:326"), F.lpad(F.col("zone").cast("string"), 2, "0"))
    to = geodesic.from_wgs84(F.col("aside") + 6 * F.col("zone") - 183, F.when(F.col("south"), -F.col("far")).otherwise(F.col("far")), crs)
    back = k.select("k", to.alias("p"), geodesic.to_wgs84(F.col("east"), F.col("north"), crs).alias("q"))
    return back.select("k", r("p.x", 4).alias("x"), r("p.y", 4).alias("y"), r("q.x", 8).alias("lon"), r("q.y", 8).alias("lat"))


def vincenty_sql(source: str, rounds: int = 7) -> str:
    """CTEs i0 ... and ``far`` (metres): the inverse of la1, lo1, la2, lo2 of ``source``, rounds written out."""
    f, b = repr(geodesic.WGS84_F), repr(geodesic.WGS84_A * (1 - geodesic.WGS84_F))
    k = repr((geodesic.WGS84_A**2 - (geodesic.WGS84_A * (1 - geodesic.WGS84_F)) ** 2) / (geodesic.WGS84_A * (1 - geodesic.WGS84_F)) ** 2)
    u = lambda x: f"atan((1 - {f}) * tan(radians({x})))"
    out = [f"i0 as (select *, sin({u('la1')}) as s1, cos({u('la1')}) as c1, sin({u('la2')}) as s2, cos({u('la2')}) as c2, radians(lo2 - lo1) as span, radians(lo2 - lo1) as lam from {source})"]
    for i in range(rounds):
        keep = "* exclude (lam, ss, cs, sig, sa, c2a, m, c)" if i else "* exclude (lam)"
        out.append(f"""p{i} as (select {keep}, sqrt(power(c2 * sin(lam), 2) + power(c1 * s2 - s1 * c2 * cos(lam), 2)) as ss, s1 * s2 + c1 * c2 * cos(lam) as cs, c1 * c2 * sin(lam) as top from i{i}),
q{i} as (select *, atan2(ss, cs) as sig, case when ss > 0 then top / ss else 0 end as sa from p{i}), r{i} as (select * exclude (top), 1 - sa * sa as c2a from q{i}),
s{i} as (select *, case when c2a > 1e-15 then cs - 2 * s1 * s2 / c2a else 0 end as m, {f} / 16 * c2a * (4 + {f} * (4 - 3 * c2a)) as c from r{i}),
i{i + 1} as (select *, span + (1 - c) * {f} * sa * (sig + c * ss * (m + c * cs * (2 * m * m - 1))) as lam from s{i})""")
    out.append(f"ell as (select *, c2a * {k} as uu from i{rounds}), g as (select *, 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu))) as big, uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu))) as small from ell)")
    out.append(f"far as (select *, {b} * big * (sig - small * ss * (m + small / 4 * (cs * (2 * m * m - 1) - small / 6 * m * (4 * ss * ss - 3) * (4 * m * m - 3)))) as metres from g)")
    return ",\n".join(out)


@query(
    f"""with {MEMBERS},
pairs as (select detection, p, sum(lat * p) over o / sum(p) over o as la1, sum(lon * p) over o / sum(p) over o as lo1, lat as la2, lon as lo2 from mp window o as (partition by detection)),
{vincenty_sql("pairs")}
select detection, round(sqrt(sum(p * metres * metres) / sum(p)) / 1e3, 5) as radius_km from far group by 1"""
)
def posterior_radius_wgs84(s, d):
    """The weighted RMS distance from the mean, on the ellipsoid."""
    return posterior.uncertainty_radius(members(s, d), True).select("detection", r("radius_km", 5).alias("radius_km"))


@query(
    f"""with {sql("fix")}, p as (select distinct ship_id, cast(round(lon * 1000) as bigint) as x, cast(round(lat * 1000) as bigint) as y from fix),
side as (select a.ship_id, a.x, a.y, b.x as u, b.y as v from p a join p b on a.ship_id = b.ship_id and (a.x <> b.x or a.y <> b.y)),
edge as (select side.ship_id, side.x, side.y, u, v from side join p c on c.ship_id = side.ship_id group by all
    having bool_and((u - side.x) * (c.y - side.y) - (v - side.y) * (c.x - side.x) > 0
        or (u - side.x) * (c.y - side.y) = (v - side.y) * (c.x - side.x) and (c.x - side.x) * (c.x - u) + (c.y - side.y) * (c.y - v) <= 0)),
n as (select ship_id, count(*) as n from fix group by 1), h as (select ship_id, count(*) as corners, sum(x * v - u * y) / 2e6 as area from edge group by 1 having count(*) > 2)
select n.ship_id, n.n, h.corners, round(h.area, 9) as area from n left join h using (ship_id)"""
)
def track_hulls(s, d):
    """The convex hull of each vessel's track, in square degrees, from partial hulls."""
    out = hull.hulls(view(s, d, "fix").select("ship_id", F.round(F.col("lon") * 1000).alias("x"), F.round(F.col("lat") * 1000).alias("y")), "ship_id")
    corners = F.when(F.col("ring").isNotNull(), F.size("ring").cast("long"))
    return out.select("ship_id", "n", corners.alias("corners"), r(polygon.area(polygon.of_ring(F.col("ring"))) / 1e6, 9).alias("area"))
