"""Outlines, results, times, styles, sources and the streaming log against hand values."""

import json
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftlode.functions import geo, style
from driftlode.functions.times import duration_text, iso_epoch, stamp_text
from driftlode.operators import correlate, detect, drift, field, posterior, raster
from driftlode.sources import catalog
from driftlode.streaming import incremental


def pixels(spark, mask, label=1):
    rows = [(0, label, int(r), int(c)) for r, c in zip(*np.nonzero(mask), strict=True)]
    return spark.createDataFrame(rows, "scene_id long, label long, row long, col long")


def test_blobs_become_detections(spark):
    mask = np.zeros((12, 20), bool)
    mask[2:8, 3:13] = True
    mask[4:6, 6:9] = False  # a hole
    (got,) = raster.detections_from_blobs(pixels(spark, mask), 28.0, -89.0, 0.01, 0.01).collect()
    rows, cols = np.nonzero(mask)
    assert got.lat == pytest.approx(28.0 - 0.01 * (rows.mean() + 0.5)) and got.lon == pytest.approx(-89.0 + 0.01 * (cols.mean() + 0.5))
    cell = 0.01**2 * 111.2 * 111.2 * np.cos(np.radians(27.95))
    assert got.area_km2 == pytest.approx(mask.sum() * cell, rel=0.01) and got.rings == 2 and got.vertices == 4
    assert {(round(p.x, 6), round(p.y, 6)) for p in got.ring} == {(-88.97, 27.98), (-88.87, 27.98), (-88.87, 27.92), (-88.97, 27.92)}


def test_pinched_blobs_and_outline_size(spark):
    edges = raster.boundary_edges(pixels(spark, np.eye(2, dtype=bool)))
    assert edges.count() == 8
    assert raster.boundary_edges(pixels(spark, np.ones((30, 30), bool))).count() == 120
    (got,) = raster.detections_from_blobs(pixels(spark, np.eye(2, dtype=bool)), 1.0, 0.0, 1.0, 1.0).collect()
    assert got.rings == 2 and got.lat == pytest.approx(0.0) and got.lon == pytest.approx(1.0)


def test_from_mask_to_origin(spark):
    mask = np.zeros((9, 30), bool)
    mask[3:6, 4:26] = True
    found = raster.detections_from_blobs(pixels(spark, mask), 28.1, -89.1, 0.01, 0.01).select(F.col("label").alias("detection"), "ring", "lat", "lon", F.lit(1704067200.0).alias("t"), "area_km2")
    cfg = drift.Config(max_hours=6.0, hour_step=2.0, particles_back=40, particles_forward=30)
    members = posterior.normalised(drift.backtrack(found, field.Constant(0.2, 0.1), cfg=cfg))
    (doc,) = posterior.result(members, found).collect()
    assert doc.n_ensemble_members == 3 and sum(c.probability for c in doc.origin_probability_grid) == pytest.approx(1.0, abs=1e-9)
    assert doc.release_time_window[0] <= doc.most_likely_origin.time_estimate <= doc.release_time_window[1] and doc.most_likely_origin.time_estimate.endswith("Z")
    shares = [c.probability for c in doc.origin_probability_grid]
    assert shares == sorted(shares, reverse=True) and doc.uncertainty_radius_km >= 0


def test_offsets_are_from_the_centroid_whether_the_ring_is_closed_or_not():
    ring = np.array([(0.0, 28.0), (0.1, 28.0), (0.1, 28.02), (0.05, 28.021), (0.0, 28.02)])
    cfg = drift.Config(max_hours=1.0, particles_back=30, particles_forward=20)
    still = field.Constant()
    a, b = (drift.backtrack_one(1, r, 0.0, None, still, still, cfg) for r in (ring, np.vstack([ring, ring[:1]])))
    pd.testing.assert_frame_equal(a, b)
    assert a.offset_km[0] < 2
    far = drift.backtrack_one(1, ring, 0.0, None, still, still, cfg, (1.0, 28.0))
    assert far.offset_km[0] > 80
    with pytest.raises(ValueError, match="no area"):
        drift.backtrack_one(1, ring, 0.0, 0.0, still, still, cfg)
    with pytest.raises(ValueError, match="no area"):
        drift.backtrack_one(1, np.array([(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)]), 0.0, None, still, still, cfg)


def test_windows_across_strips_and_scenes_of_two_sizes(spark, monkeypatch):
    monkeypatch.setattr(raster, "STRIP", 4)
    rng, sizes = np.random.default_rng(3), {0: (9, 13), 1: (5, 6)}
    images = {k: rng.normal(size=s) for k, s in sizes.items()}
    rows = [(k, r, c, float(x[r, c]), *sizes[k]) for k, x in images.items() for r in range(x.shape[0]) for c in range(x.shape[1])]
    df = spark.createDataFrame(rows, "scene_id int, row int, col int, v double, scene_height int, scene_width int")
    got = raster.box_means(df, {"m": F.col("v"), "q": F.col("v") * 2}, 5).toPandas()
    assert len(got) == len(rows)
    for k, x in images.items():
        p = np.pad(x, 2, mode="symmetric")
        want = sum(p[i : i + x.shape[0], j : j + x.shape[1]] for i in range(5) for j in range(5)) / 25
        mine = got[got.scene_id == k]
        assert np.allclose(mine.pivot(index="row", columns="col", values="m").to_numpy(), want) and np.allclose(mine.q, 2 * mine.m)


def test_land_polygons(spark):
    px = spark.createDataFrame([(s, r, c) for s in (0, 1) for r in range(6) for c in range(6)], "scene_id long, row int, col int")
    ring = [(0.5, 0.5), (3.5, 0.5), (3.5, 2.5), (0.5, 2.5)]
    land = spark.createDataFrame([(0, ring)], "scene_id long, ring array<struct<x:double,y:double>>")
    got = raster.water_mask(px, land, cell=2).where("not water").collect()
    assert {(r.scene_id, r.row, r.col) for r in got} == {(0, r, c) for r in (1, 2) for c in (1, 2, 3)}
    assert raster.water_mask(px, land.limit(0)).where("water").count() == 72


def test_padded_boxes(spark):
    df = pixels(spark, np.pad(np.ones((2, 3), bool), ((0, 4), (2, 0)))).select("*", *[F.lit(1.0).alias(c) for c in ("vv_db", "vh_db", "local_var", "prob")])
    (got,) = raster.blob_features(df, 6, 5).collect()
    assert (got.box_top, got.box_bottom, got.box_left, got.box_right) == (0, 2, 1, 4) and got.pixel_count == 6


def test_primary_place(spark):
    mask = np.zeros((11, 21), bool)
    mask[3:8, 5:16] = True
    mask[0, 0] = True  # goes with the opening
    px = spark.createDataFrame([(0, r, c, bool(mask[r, c])) for r in range(11) for c in range(21)], "scene_id long, row int, col int, m boolean")
    (got,) = raster.primary_uv(px, "m", 11, 21).collect()
    assert (got.u, got.v) == (0.5, 0.5)


def test_nearest_wind_by_brute_force(spark):
    rng = np.random.default_rng(5)
    points = [(k, float(a), float(b)) for k, (a, b) in enumerate(rng.uniform([27, -90], [29, -88], (60, 2)))]
    recs = [(k, float(a), float(b), None if k % 5 == 0 else float(k), "scene" if k % 9 == 0 else "other") for k, (a, b) in enumerate(rng.uniform([27, -90], [29, -88], (50, 2)))] + [(99, 27.5, -89.5, 1.0, "other"), (98, 27.5, -89.5, 2.0, "other")]
    got = {r.id: (r.record, r.wind) for r in detect.nearest_wind(spark.createDataFrame(points, "id long, lat double, lon double"), spark.createDataFrame(recs, "seq long, lat double, lon double, wind double, ts string"), F.lit("scene"), 0.4, 6).collect()}
    for k, a, b in points:
        near = [(np.hypot(a - x, b - y) - 1000 * (ts == "scene"), s, w) for s, x, y, w, ts in recs if np.hypot(a - x, b - y) <= 0.4]
        assert got[k] == (min(near)[1:] if near else (None, None))


@pytest.mark.parametrize(
    ("text", "want"),
    [("2024-01-01T00:00:00Z", 1704067200.0), ("2024-01-01T02:00:00+02:00", 1704067200.0), ("2024-01-01T00:00:00", 1704067200.0), ("2024-01-01", 1704067200.0), ("2024-01-01 00:00", 1704067200.0), ("2023-12-31T22:30:00.5-0130", 1704067200.5), ("2024-13-01T00:00:00Z", None), ("yesterday", None), ("", None), (None, None)],
)
def test_iso_texts(spark, text, want):
    assert spark.createDataFrame([(text,)], "s string").select(iso_epoch(F.col("s"))).first()[0] == want


def test_formats(spark):
    one = spark.range(1)
    assert one.select(stamp_text(F.lit("2024-09-02T00:30:00Z")), stamp_text(F.lit(None).cast("string")), duration_text(F.lit(9.96)), duration_text(F.lit(10.5)), duration_text(F.lit(47.0))).first()[:] == ("09-02 00:30", "—", "10.0 h", "11 h", "47 h")
    got = one.select(style.cell_colour(F.lit(0.5), F.lit(190)), style.cell_colour(F.lit(2.0), F.lit(70)), style.vessel_colour(F.lit(100.0), F.lit(True)), style.vessel_radius_px(F.lit(50.0), F.lit(False)), style.cell_opacity(F.lit(20), F.lit(False))).first()
    assert got[0] == [35, 173, 174, 190] and got[1] == [188, 255, 244, 70] and got[2] == [255, 90, 95, 235] and got[3] == 8.0 and got[4] == 70


def test_vessel_documents(spark):
    path = lambda *p: [{"timestamp": t, "lat": a, "lon": b} for t, a, b in p]
    rows = [("a", "A", "tanker", path(("2024-01-01T00:00:00Z", 28.0, -89.0), ("bad", 28.0, -89.0), ("2024-01-01T01:00:00Z", 28.1, -89.0))), ("b", "B", "tug", path(("bad", 28.0, -89.0))), ("c", "C", "tug", path(("2024-01-01T00:30:00Z", 29.5, -89.0)))]
    vessels = spark.createDataFrame(rows, "ship_id string, name string, type string, path array<struct<timestamp:string,lat:double,lon:double>>")
    grid = spark.createDataFrame([(28.0, -89.0, 1.0)], "lat double, lon double, p double")
    assert tuple(correlate.weighted_origin(grid).first()) == (28.0, -89.0)
    got = correlate.ranked_documents(vessels, grid, 1704067200.0, 1704070800.0).collect()
    twice = correlate.fixes_from_paths(vessels)
    assert [r.suspicion_score for r in correlate.rank_vessels(twice.union(twice), grid, 1704067200.0, 1704070800.0).collect()] == [r.suspicion_score for r in got]
    assert [(r.ship_id, r.name, r.type) for r in got] == [("a", "A", "tanker"), ("c", "C", "tug")]
    assert [(p.lon, p.lat) for p in got[0].line] == [(-89.0, 28.0), (-89.0, 28.1)] and got[1].line is None and got[0].closest_time == "2024-01-01T00:00:00Z"
    assert [r.ship_id for r in correlate.sweep_order(correlate.rank_vessels(correlate.fixes_from_paths(vessels), grid, 1704067200.0, 1704070800.0)).collect()] == ["c", "a"]


def test_packed_fields(spark):
    rows = [(float(t), 28 + i * 0.1, -89 + j * 0.1, float("nan") if (t, i, j) == (0, 0, 0) else 1.0 * i, None if j == 0 else 2.0 * t) for t in (3600, 0) for i in (1, 0) for j in (0, 1, 2)]
    table = spark.createDataFrame(rows, "t double, lat double, lon double, u double, v double")
    f = field.pack(table)
    assert f.u.shape == (2, 2, 3) and f.u[0, 0, 0] == 0 and f.v[1, 0, 1] == 7200 and f.v[1, 0, 0] == 0
    u, v = f.velocity(np.array([28.05]), np.array([-88.9]), 1800.0)
    assert u[0] == pytest.approx(0.5) and v[0] == pytest.approx(3600.0)
    with pytest.raises(ValueError, match="no full grid"):
        field.pack(table.where("lat < 28.05 or lon < -88.95"))
    with pytest.raises(ValueError, match="isn't regular"):
        field.pack(table.withColumn("t", F.col("t")).union(table.where("t = 0").withColumn("t", F.lit(9000.0))))


def test_stores(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, x string, y int")
    new = spark.createDataFrame([(1, None), (3, "c")], "id int, x string")
    assert sorted(map(tuple, catalog.upsert(old, new, "id").collect())) == [(1, None, 5), (2, "b", 6), (3, "c", None)]
    path = str(tmp_path / "t")
    old.write.parquet(path)
    catalog.replace_table(catalog.upsert(spark.read.parquet(path), new, "id"), path)
    assert spark.read.parquet(path).count() == 3
    catalog.write_json(old, str(tmp_path / "j"))
    assert sorted(json.loads(x)["x"] for f in (tmp_path / "j").glob("part-*.json") for x in f.read_text().splitlines()) == ["a", "b"]
    assert catalog.without_id(old.withColumn("_id", F.lit("q"))).columns == old.columns
    samples = spark.createDataFrame([(str(k),) for k in range(300)], "sample_id string")
    words = spark.createDataFrame([("1", "validation"), ("2", "test"), ("3", "holdout"), ("4", None)], "sample_id string, split string")
    got = {r.sample_id: r.split for r in catalog.assign_splits(samples, words).collect()}
    assert got["1"] == "val" and got["2"] == "test" and {got["3"], got["4"]} <= {"train", "val"} and 10 <= sum(v == "val" for v in got.values()) <= 60


def test_cached_fields(spark):
    cache = spark.createDataFrame([("d1", "old", 100.0)], "key string, payload string, at double")
    assert catalog.cached_field(cache, "d1", 500.0, 1800.0, lambda: 1 / 0)[0] == "old"
    got, now = catalog.cached_field(cache, "d1", 5000.0, 1800.0, lambda: "new")
    assert got == "new" and [(r.payload, r["at"]) for r in now.collect()] == [("new", 5000.0)]
    with pytest.warns(UserWarning, match="last payload"):
        assert catalog.cached_field(cache, "d1", 5000.0, 1800.0, lambda: 1 / 0)[0] == "old"
    with pytest.raises(ZeroDivisionError):
        catalog.cached_field(cache, "d2", 5000.0, 1800.0, lambda: 1 / 0)


def test_geometry(spark):
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    df = spark.createDataFrame([([ring((0, 0), (1, 0), (1, 1)), ring((5, 5), (6, 5), (6, 6), (5, 5))], "EPSG:4326")], "rings array<array<struct<x:double,y:double>>>, crs string")
    got = df.select(geo.vertices(F.col("rings")).alias("v"), geo.require_wgs84(F.col("crs")).alias("c")).first()
    assert len(got.v) == 8 and got.v[0] == got.v[3] and got.c == "EPSG:4326"
    with pytest.raises(Exception, match="aren't supported"):
        df.select(geo.require_wgs84(F.lit("EPSG:3857"))).collect()


def test_stage_log(spark, tmp_path):
    spark.createDataFrame([("r1", "started", 1.0), ("r1", "detection_done", 2.0)], "run_id string, stage string, at double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("run_id string, stage string, at double").parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second start finds nothing new
        q = incremental.stage_events(stream, str(tmp_path / "log"), str(tmp_path / "mark")).start()
        q.processAllAvailable()
        q.stop()
    assert [r.stage for r in spark.read.parquet(str(tmp_path / "log")).orderBy("at").collect()] == ["started", "detection_done"]


def test_scenes_need_two_bands(spark, tmp_path):
    both = spark.createDataFrame([(1, 0, 0, 0.1, 0.2)], "scene_id long, row int, col int, vv double, vh double")
    both.write.parquet(str(tmp_path / "a"))
    both.drop("vh").write.parquet(str(tmp_path / "b"))
    assert dict(catalog.read_scene(spark, str(tmp_path / "a")).dtypes)["vh"] == "float"
    with pytest.raises(ValueError, match="no vh"):
        catalog.read_scene(spark, str(tmp_path / "b"))


def test_answers_and_fields_as_columns(spark):
    points = field.grid_points(28.0, -89.0, 28.1, -88.9, 2)
    answers = [{"time": [0, 3600], "speed": [3.6, None], "direction": [90.0, 0.0]}] * 4
    rows = field.from_answers(points, answers)
    assert len(rows) == 8 and rows[0] == (0.0, 28.0, -89.0, 3.6, 90.0)
    with pytest.raises(ValueError, match="3 came back"):
        field.from_answers(points, answers[:3])
    u, v = field.uv(F.col("s"), F.col("d"))
    packed = field.pack(spark.createDataFrame(rows, "t double, lat double, lon double, s double, d double").select("t", "lat", "lon", u.alias("u"), v.alias("v")))
    got = spark.createDataFrame([(28.05, -88.95, 1800.0), (28.0, -89.0, 0.0)], "lat double, lon double, t double").select(field.velocity_column(packed, F.col("lat"), F.col("lon"), F.col("t")).alias("x")).collect()
    assert [round(r.x.u, 9) for r in got] == [0.5, 1.0] and abs(got[0].x.v) < 1e-9
    beyond = field.Gridded(0.0, 1.0, 0.0, 0.0, 1.0, np.array([[[0.0, 1.0], [2.0, 3.0]]]), np.zeros((1, 2, 2)), hold=False)
    assert beyond.velocity(np.array([2.0]), np.array([0.0]), 0.0)[0][0] == 4.0


def test_stages_have_a_time_limit():
    log, now = [], iter([0.0, 5.0, 50.0])
    assert incremental.run_stages([("a", lambda: None), ("b", lambda: None)], log.append, 10, lambda: next(now)) == "error"
    assert log == ["started", "a", "error: b: over 10 s"]


def test_fields_take_a_time_for_each_place():
    rng = np.random.default_rng(3)
    packed = field.Gridded(0.0, 3600.0, 28.0, -89.0, 0.1, rng.normal(size=(4, 5, 6)), rng.normal(size=(4, 5, 6)))
    lat, lon, t = rng.uniform(27.9, 28.6, (7, 9)), rng.uniform(-89.1, -88.3, (7, 9)), rng.uniform(-4000, 16000, (7, 1))
    for source in (packed, field.Gyre(28.2, -89.15)):
        got = source.velocity(lat, lon, t)
        for k in range(7):
            for a, b in zip(got, source.velocity(lat[k], lon[k], float(t[k, 0])), strict=True):
                assert np.allclose(a[k], b, rtol=0, atol=1e-12)


def test_forward_moves_releases_together(spark):
    """More releases than fit into one array, of different times, one id twice: as when each is integrated by itself."""
    gyre, cfg = field.Gyre(28.2, -89.15), drift.Config(particles_forward=20)
    rows = [(k % 69, 28.0 + k % 7 * 0.05, -89.3 + k % 5 * 0.05, 1e6 + 7000.0 * k, 0.3 + k % 3) for k in range(70)]
    got = drift.forward(spark.createDataFrame(rows, "origin long, lat double, lon double, t double, radius_km double").coalesce(1), gyre, hours=2, cfg=cfg).where("hours_elapsed = 2").collect()
    assert len(got) == 70
    for r in rows:
        rng = np.random.default_rng([cfg.seed, zlib.crc32(str(r[0]).encode())])
        a, b = drift.integrate(*drift.seed_disk(r[1], r[2], r[4], 20, rng), r[3], 7200.0, cfg.dt, cfg.windage, gyre, field.Constant())
        want = (a.mean(), b.mean(), drift.hull_area_km2(a, b))
        assert any(np.allclose((g.lat, g.lon, g.hull_area_km2), want, rtol=1e-9) for g in got if g.origin == r[0] and abs(g.t - r[3] - 7200) < 1)


@pytest.mark.parametrize("stretch", [1.0, 1e-3, 0.0])
def test_hulls_lose_no_corner(stretch):
    rng = np.random.default_rng(5)
    for n in (3, 17, 40, 300):
        x, y = rng.normal(size=n), rng.normal(size=n) * stretch
        may, whole = drift.outer(x, y), geo.convex_hull(x, y)
        assert whole is None and geo.convex_hull(x[may], y[may]) is None or (geo.convex_hull(x[may], y[may]) == whole).all()
    grid = np.array([(a, b) for a in range(9) for b in range(9)], float)
    assert (geo.convex_hull(*grid[drift.outer(*grid.T)].T) == geo.convex_hull(*grid.T)).all() and drift.outer(*grid.T).sum() < 81


def test_points_and_records_of_one_place_meet_once(spark):
    """Many points and records on few places: the first record of the nearest place wins, and no more pairs are made than places meet."""
    records = [(k, 28.0 + k % 5 / 50, -89.0 + k % 7 / 50, float(k), "scene" if k % 3 == 0 else "other") for k in range(700)]
    points = [(k, 28.01 + k % 4 / 40, -89.01 + k % 3 / 40) for k in range(600)]
    at = spark.createDataFrame(points, "id long, lat double, lon double")
    found = detect.nearest_wind(at, spark.createDataFrame(records, "seq long, lat double, lon double, wind double, ts string"), F.lit("scene"))
    for r in found.collect():
        _, lat, lon = points[r.id]
        want = min((((lat - a) ** 2 + (lon - b) ** 2) ** 0.5 - (1000.0 if ts == "scene" else 0.0), k) for k, a, b, _, ts in records)
        assert r.record == want[1] and r.wind == float(want[1])
    rows = []

    def walk(node):
        if "Join" in node.nodeName():
            rows.append(node.metrics().apply("numOutputRows").value())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    spark.conf.set("spark.sql.adaptive.enabled", "false")  # its stages hide the joins
    try:
        plan = found.select("*")._jdf.queryExecution().executedPlan()
        plan.executeCollect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    walk(plan)
    assert 0 < max(rows) < 50_000  # 600 points by 700 records are 420,000 pairs


def test_a_sheared_cloud_is_near_its_centre(spark, tmp_path):
    """The mean of these clouds lies over the bound away from their centres' ways, their particles don't."""
    from driftlode.plans import tracks

    spark.createDataFrame([(872,), (4876,), (1,)], "s_suppkey long").coalesce(1).write.parquet(f"{tmp_path}/a/supplier.parquet")
    assert [r.near for r in tracks.forecast_centres(spark, f"{tmp_path}/a").collect()] == [True] * 3
    spark.createDataFrame([(366,)], "s_suppkey long").coalesce(1).write.parquet(f"{tmp_path}/b/supplier.parquet")
    assert {r.hour: r.near for r in tracks.ensemble_centres(spark, f"{tmp_path}/b").collect()} == {1.0: True, 23.0: True, 47.0: True}


def test_centroid_of_a_small_ring_far_from_zero(spark):
    corners = [(-0.05, -0.01), (0.05, -0.02), (0.06, 0.01), (-0.04, 0.02)]
    ring = F.array(*[F.struct(F.lit(-88.8 + a).alias("x"), F.lit(28.1 + b).alias("y")) for a, b in corners])
    c = spark.range(1).select(geo.ring_centroid(ring).alias("c")).first().c
    assert (c.x, c.y) == pytest.approx((-88.795, 28.1), abs=1e-12)  # moments about 0 gave -88.79499999874761


@pytest.mark.parametrize("clouds", [(), (1.0, 3.0)])
def test_clouds_come_along(spark, clouds):
    at = spark.createDataFrame([(1, 28.2, -89.1, 0.0, 1.0)], "origin long, lat double, lon double, t double, radius_km double")
    cfg = drift.Config(dt=1800.0, particles_forward=20, particles_back=30, max_hours=6.0)
    track = drift.forward(at, field.Constant(0.2, 0.1), hours=4, cfg=cfg, clouds=clouds).collect()
    ring = spark.createDataFrame([(1, 0.0, 4.0, [(-89.1, 28.2), (-89.0, 28.2), (-89.0, 28.3)])], "detection long, t double, area_km2 double, ring array<struct<x double, y double>>")
    members = drift.backtrack(ring, field.Constant(0.2, 0.1), cfg=cfg, clouds=clouds).collect()
    for rows, hour, n in ((track, "hours_elapsed", 20), (members, "hour", 30)):
        told = {r[hour]: r for r in rows}
        if not clouds:
            assert "lats" not in rows[0]
            continue
        assert {h for h, r in told.items() if r.lats is not None} == set(clouds)
        for h in clouds:
            assert len(told[h].lats) == len(told[h].lons) == n
            assert (np.mean(told[h].lats), np.mean(told[h].lons)) == pytest.approx((told[h].lat, told[h].lon), abs=1e-9)
