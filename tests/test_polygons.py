"""Polygons with holes and parts, land by scanlines, reference systems and distances on the ellipsoid."""

import math
import random
import warnings
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlode.functions import geo, geodesic, polygon
from driftlode.operators import drift, posterior, raster


def blob(spark, picture, scene=0):
    """A labelled table of the # of a picture."""
    return spark.createDataFrame([(scene, 1, r, c) for r, line in enumerate(picture) for c, x in enumerate(line) if x == "#"], "scene_id long, label long, row int, col int")


def square(a, b, c, e):
    return [(float(a), float(b)), (float(c), float(b)), (float(c), float(e)), (float(a), float(e))]


PICTURES = {
    "whole": ["###", "###"],
    "hole": ["#####", "#...#", "#.#.#", "#...#", "#####"],
    "pinch": ["##..", "##..", "..##", "..##"],
    "bay closed in a corner": ["###.", "#.#.", "##.#", "####"],
    "two holes in a row": ["#######", "#.#.#.#", "#######"],
    "holes that touch": ["#####", "#.###", "##.##", "###.#", "#####"],
    "ring of corners": [".#.", "#.#", ".#."],
}


@pytest.mark.parametrize("name", PICTURES)
def test_polygons_of_blobs(spark, name):
    picture = PICTURES[name]
    pixels = [(r, c) for r, line in enumerate(picture) for c, x in enumerate(line) if x == "#"]
    shape = F.col("polygon")
    out = raster.blob_polygons(blob(spark, picture)).withColumn("c", polygon.centroid(shape)).withColumn("a", polygon.area(shape)).first()
    assert out.a == pytest.approx(len(pixels)) and (out.c.y, out.c.x) == pytest.approx(tuple(np.mean(pixels, axis=0) + 0.5))
    for part in out.polygon:
        for ring in part:
            assert len({(p.x, p.y) for p in ring}) == len(ring)  # no ring touches itself
    at = spark.createDataFrame([(r, c) for r in range(len(picture)) for c in range(len(picture[0]))], "row int, col int").crossJoin(raster.blob_polygons(blob(spark, picture)).select("polygon"))
    inside = {(x.row, x.col) for x in at.where(polygon.contains(F.col("col") + 0.5, F.col("row") + 0.5, shape)).collect()}
    assert inside == set(pixels)


def test_parts_and_holes_of_random_masks():
    rng = np.random.default_rng(3)
    for _ in range(60):
        mask = rng.random((9, 11)) < rng.uniform(0.3, 0.9)
        if not mask.any():
            continue
        r, c = np.nonzero(mask)
        edges = [(*a, *b) for ring in raster.outline(r, c) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
        parts = raster.parts_of(np.array(edges))
        area = lambda p: abs((p[:, 0] * np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) * p[:, 1]).sum()) / 2
        assert sum(area(p[0]) - sum(area(h) for h in p[1:]) for p in parts) == mask.sum()
        for shell, *holes in parts:  # a hole lies in its own shell and in no other hole of it
            for h in holes:
                middle = h[np.lexsort((h[:, 1], h[:, 0]))[0]] + 0.5
                assert drift.inside(middle[:1], middle[1:], shell.astype(float))[0]
                assert sum(drift.inside(middle[:1], middle[1:], x.astype(float))[0] for x in holes) == 1


def test_detections_and_backtrack_with_a_hole(spark):
    ring_of_9 = ["#########"] * 2 + ["##.....##"] * 5 + ["#########"] * 2
    found = raster.detections_from_blobs(blob(spark, ring_of_9), 28.5, -89.3, 0.002, 0.002).withColumn("detection", F.lit(7)).withColumn("t", F.lit(0.0))
    row = found.select("*", polygon.area_km2(F.col("polygon")).alias("a"), F.size(polygon.shell_vertices(F.col("polygon"))).alias("n")).first()
    solid = raster.detections_from_blobs(blob(spark, ["#" * 9] * 9), 28.5, -89.3, 0.002, 0.002).first()
    assert row.rings == 2 and row.n == 5 and row.area_km2 == pytest.approx(solid.area_km2 * 56 / 81, rel=1e-5) and row.a == pytest.approx(row.area_km2, rel=1e-6)
    parts = [[np.array([(p.x, p.y) for p in r]) for r in part] for part in row.polygon]
    lat, lon = drift.seed_polygon(parts, 400, np.random.default_rng(1))
    assert len(lat) == 400 and not drift.inside(lon, lat, parts[0][1]).any() and drift.inside(lon, lat, parts[0][0]).all()
    assert drift.whole_centroid(parts) == pytest.approx([row.lon, row.lat])
    small = drift.Config(max_hours=3.0, particles_back=40, particles_forward=30)
    members = drift.backtrack(found, drift.Constant(0.1, 0.0), cfg=small).collect()
    assert [m.hour for m in members] == [1.0, 3.0] and all(0 <= m.weight <= 1 for m in members)


def test_backtrack_of_parts_with_rings_of_different_lengths(spark):
    """Two parts, one of them with a hole: all as the operator without Spark gives it, and the whole way of the query to its result."""
    picture = ["####....", "#..#....", "#.##....", "####.###", ".....##.", "....####"]
    found = raster.detections_from_blobs(blob(spark, picture), 28.5, -89.3, 0.002, 0.002).withColumn("detection", F.lit(7)).withColumn("t", F.lit(1704067200.0))
    row = found.first()
    assert len({len(r) for part in row.polygon for r in part}) > 1
    small = drift.Config(max_hours=3.0, particles_back=40, particles_forward=30)
    got = drift.backtrack(found, drift.Constant(0.1, 0.0), cfg=small)
    parts = [[np.array([(p.x, p.y) for p in r]) for r in part] for part in row.polygon]
    use = replace(small, seed_radius_km=drift.release_radius_km(row.area_km2))
    want = drift.backtrack_one(7, parts, row.t, row.area_km2, drift.Constant(0.1, 0.0), drift.Constant(), use, (row.lon, row.lat))
    assert np.allclose(got.orderBy("seq").toPandas().to_numpy(float), want.to_numpy(float))
    (doc,) = posterior.result(posterior.normalised(got), found).collect()
    assert doc.n_ensemble_members == 2


def test_detections_in_a_utm_zone(spark):
    picture = ["###", "#.#", "###"]
    east, north = 444_000.0, 3_685_000.0
    out = raster.detections_from_blobs(blob(spark, picture), north, east, 100.0, 100.0, crs="EPSG:32638").first()
    assert out.area_km2 == pytest.approx(0.08 / geodesic.SCALE**2, rel=2e-4)
    lon, lat = geodesic.lonlat_of_utm(east + 150, north - 150, 38, False)
    assert (out.lon, out.lat) == pytest.approx((float(lon), float(lat)), abs=1e-7)
    with pytest.raises(ValueError, match="EPSG:3857"):
        raster.detections_from_blobs(blob(spark, picture), 0, 0, 1, 1, crs="EPSG:3857")


def test_utm_places(spark):
    """A published place, the width of a zone on the equator, both hemispheres there and back."""
    rng = random.Random(4)
    rows = [(44.4, 33.3, "EPSG:32638"), (12.0, 0.0, "EPSG:32632"), (9.0, 0.0, "EPSG:32632"), (5.0, 7.0, None), (5.0, 7.0, "OGC:CRS84")]
    rows += [(6 * z - 183 + rng.uniform(-2.9, 2.9), rng.uniform(0, 84) * s, f"EPSG:32{6 if s > 0 else 7}{z:02}") for z in range(1, 61) for s in (1, -1)]
    df = spark.createDataFrame(rows, "lon double, lat double, crs string").withColumn("p", geodesic.from_wgs84(F.col("lon"), F.col("lat"), F.col("crs")))
    out = df.withColumn("q", geodesic.to_wgs84(F.col("p.x"), F.col("p.y"), F.col("crs"))).collect()
    assert (out[0].p.x, out[0].p.y) == pytest.approx((444140.54, 3684706.36), abs=0.02)
    assert out[1].p.x == pytest.approx(833978.557, abs=0.001) and (out[2].p.x, out[2].p.y) == pytest.approx((500000.0, 0.0), abs=1e-6)
    assert (out[3].p.x, out[3].p.y) == (5.0, 7.0) == (out[4].q.x, out[4].q.y)
    assert all(abs(r.q.x - r.lon) < 1e-8 and abs(r.q.y - r.lat) < 1e-8 for r in out)
    assert all((r.p.y > 1e6) for r in out[5:] if r.crs.startswith("EPSG:327"))
    for wrong in ("EPSG:3857", "EPSG:32661", "EPSG:32600", "x"):
        with pytest.raises(Exception, match="aren't supported"):
            df.select(geodesic.to_wgs84(F.col("lon"), F.col("lat"), F.lit(wrong))).collect()


def test_geodesic_columns(spark):
    rng = random.Random(8)
    rows = [(rng.uniform(-89, 89), rng.uniform(-180, 180), rng.uniform(-89, 89), rng.uniform(-180, 180)) for _ in range(200)]
    rows = [r for r in rows if math.hypot(r[0] + r[2], (r[1] - r[3]) % 360 - 180) > 15]
    rows += [(5.0, 6.0, 5.0, 6.0), (0.0, 0.0, 0.0, 1.0), (0.0, 10.0, 0.0, 10.001), (90.0, 0.0, 89.0, 0.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = df.select(geodesic.inverse(*(F.col(x) for x in "abcd")).alias("g")).collect()
    metres, azimuth = geo.geodesic(*np.array(rows).T)
    assert all(r.g.settled for r in got) and np.allclose([r.g.metres for r in got], metres, atol=1e-3)
    assert np.allclose([r.g.azimuth for r in got][:-4], azimuth[:-4], atol=1e-8)
    assert got[-3].g.metres == pytest.approx(111319.491, abs=1e-3)
    far = spark.createDataFrame([(0.0, 0.0, 0.5, 179.7), (1.0, None, 2.0, 3.0)], "a double, b double, c double, d double").select(geodesic.inverse(*(F.col(x) for x in "abcd")).alias("g")).collect()
    assert not far[0].g.settled and far[0].g.metres == pytest.approx(19_936_288, rel=5e-3) and far[1].g is None


def test_radius_on_the_ellipsoid(spark):
    m = spark.createDataFrame([(1, 10.0, 20.0, 0.5), (1, 10.2, 20.0, 0.5), (None, 1.0, 1.0, 1.0)], "detection long, lat double, lon double, p double")
    got = {r.detection: r.radius_km for r in posterior.uncertainty_radius(m, True).collect()}
    assert got[1] == pytest.approx(float(geo.geodesic(10.1, 20, 10.2, 20)[0]) / 1000, rel=1e-4) and got[None] == 0
    flat = {r.detection: r.radius_km for r in posterior.uncertainty_radius(m).collect()}
    assert flat[1] == pytest.approx(0.1 * math.pi / 180 * geo.EARTH_RADIUS_KM, rel=1e-9)


def test_members_of_a_null_detection_keep_their_share(spark):
    m = spark.createDataFrame([(None, 1.0), (None, 3.0), (1, 0.0), (1, 0.0)], "detection long, weight double")
    got = sorted((r.detection or 0, r.weight, r.p) for r in posterior.normalised(m).collect())
    assert got == [(0, 1.0, 0.25), (0, 3.0, 0.75), (1, 0.0, 0.5), (1, 0.0, 0.5)]


@pytest.mark.parametrize("cell", [3, 256])
def test_land_equals_the_ray_cast(spark, cell):
    rng = random.Random(6)
    shapes = []
    for k in range(12):
        cx, cy = rng.uniform(0, 24), rng.uniform(0, 20)
        star = lambda r, n: [(cx + r * rng.uniform(0.4, 1) * math.cos(a), cy + r * rng.uniform(0.4, 1) * math.sin(a)) for a in np.arange(n) * 2 * math.pi / n]  # noqa: B023, E731
        shapes.append((k % 2, [[star(7, 7), star(1.5, 4)], [square(cx + 8, cy, cx + 10, cy + 2)]]))
    shapes.append((0, [[square(2, 3, 6, 7)]]))  # corners on centres
    land = spark.createDataFrame(shapes, f"scene_id long, polygon {polygon.KIND}")
    px = spark.createDataFrame([(s, r, c, "x") for s in (0, 1, 2) for r in range(20) for c in range(24)], "scene_id long, row int, col int, other string")
    got = {(r.scene_id, r.row, r.col) for r in raster.water_mask(px, land, cell=cell, height=20).where("not water").collect()}
    want = px.join(land, "scene_id").where(polygon.contains(F.col("col"), F.col("row"), F.col("polygon"))).select("scene_id", "row", "col").distinct()
    assert got == {(r.scene_id, r.row, r.col) for r in want.collect()} and len(got) > 50
    assert raster.water_mask(px, land, cell=cell).columns == ["scene_id", "row", "col", "other", "water"]


def test_no_land_warns(spark):
    px = spark.createDataFrame([(0, 0, 0)], "scene_id long, row int, col int")
    with pytest.warns(UserWarning, match="no polygons of land"):
        assert raster.water_mask(px, None).first().water
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert raster.water_mask(px, spark.createDataFrame([], f"scene_id long, polygon {polygon.KIND}")).first().water
