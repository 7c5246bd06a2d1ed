"""Hand values and invariants of what SQL doesn't check."""

import json
import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlode.functions import geo
from driftlode.operators import correlate, detect, drift, field, posterior, raster
from driftlode.sources import catalog
from driftlode.streaming import incremental


def test_geodesic_line():
    # published test line: Flinders Peak to Buninyong, GDA ellipsoid differs from WGS84 by under a millimetre here
    d, az = geo.geodesic(-(37 + 57 / 60 + 3.72030 / 3600), 144 + 25 / 60 + 29.52440 / 3600, -(37 + 39 / 60 + 10.15610 / 3600), 143 + 55 / 60 + 35.38390 / 3600)
    assert abs(float(d) - 54972.271) < 0.01 and abs(math.degrees(float(az)) % 360 - 306.8681583) < 1e-4


def test_geodesic_same_point_and_meridian():
    assert float(geo.geodesic(10, 20, 10, 20)[0]) == 0
    assert abs(float(geo.geodesic(0, 0, 1, 0)[0]) - 110574.39) < 0.1


def test_area_of_a_square():
    lon, lat = np.array([0, 0.1, 0.1, 0.0]), np.array([0, 0, 0.1, 0.1])
    assert abs(geo.polygon_area_km2(lon, lat) - 11.1319 * 11.0574) < 0.01
    assert geo.polygon_area_km2(lon[:2], lat[:2]) == 0 and geo.polygon_area_km2(np.arange(4.0), np.arange(4.0)) == 0


def test_hull():
    x, y = np.array([0, 1, 1, 0, 0.5, 0.2]), np.array([0, 0, 1, 1, 0.5, 0.9])
    assert {tuple(p) for p in geo.convex_hull(x, y)} == {(0, 0), (1, 0), (1, 1), (0, 1)}
    assert geo.convex_hull(np.arange(5.0), np.arange(5.0)) is None and geo.convex_hull(x[:2], y[:2]) is None


def test_simplify_bounds_vertices():
    a = np.linspace(0, 2 * math.pi, 400, endpoint=False)
    ring = np.column_stack([np.cos(a), np.sin(a)]) * 50
    assert len(geo.simplify(ring, 40)) <= 40 and len(geo.simplify(ring[:3])) == 3


def test_outline_area_and_hole():
    rows, cols = np.nonzero(np.array([[1, 1, 1], [1, 0, 1], [1, 1, 1]]))
    rings = raster.outline(rows, cols)

    def area(ring):
        return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2

    assert sorted(abs(area(r)) for r in rings) == [1, 9] and abs(sum(area(r) for r in rings)) == 8
    pinched = raster.outline(np.array([0, 1]), np.array([0, 1]))
    assert len(pinched) == 2


def test_labels_in_raster_order():
    mask = np.array([[0, 1, 0, 1], [1, 0, 0, 1], [0, 0, 0, 0], [1, 0, 0, 0]], bool)
    assert raster.label_mask(mask).tolist() == [[0, 1, 0, 2], [1, 0, 0, 2], [0, 0, 0, 0], [3, 0, 0, 0]]
    joined = np.array([[1, 0, 1], [1, 0, 1], [1, 1, 1]], bool)
    assert raster.label_mask(joined).max() == 1 and raster.label_mask(np.zeros((2, 2), bool)).max() == 0


def test_elongation_of_shapes(spark):
    rows = [("line", r, 0) for r in range(30)] + [("dot", 0, 0)] + [("disc", r, c) for r in range(41) for c in range(41) if (r - 20) ** 2 + (c - 20) ** 2 <= 400]
    df = spark.createDataFrame(rows, "k string, r int, c int").groupBy("k").agg(F.var_pop("r").alias("a"), F.var_pop("c").alias("b"), F.covar_pop("r", "c").alias("x"))
    got = dict(df.select("k", raster.ellipse_elongation(F.col("a"), F.col("b"), F.col("x"))).collect())
    assert got["line"] is None and got["dot"] == 1 and abs(got["disc"] - 1) < 0.1


@pytest.mark.parametrize(("wind", "flag"), [(None, False), (2.9, True), (3.0, False), (4.2, False)])
def test_low_wind(spark, wind, flag):
    assert spark.range(1).select(detect.low_wind(F.lit(wind).cast("double"))).first()[0] is flag


def test_window_filters_by_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(9, 12))
    df = spark.createDataFrame([(0, r, c, float(x[r, c])) for r in range(9) for c in range(12)], "scene_id int, row int, col int, v double")
    p = np.pad(x, 3, mode="symmetric")
    want = sum(p[i : i + 9, j : j + 12] for i in range(7) for j in range(7)) / 49
    got = raster.box_sums(df, "v", 7, "m", 9, 12).toPandas().pivot(index="row", columns="col", values="m").to_numpy()
    assert np.allclose(got, want)
    with pytest.raises(ValueError):
        raster.lee_filter(df, "v", "m", 9, 12, 4)


def test_calibration_guards(spark):
    df = spark.createDataFrame([(2.0, 2.0), (1.0, 0.0), (None, 1.0), (float("inf"), 1.0)], "a double, b double")
    assert [r[0] for r in df.select(raster.calibrate(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_steady_field_returns_to_its_start():
    flow, still = field.Constant(0.3, -0.1), field.Constant()
    lat, lon = np.array([28.0, 28.1]), np.array([-89.0, -89.2])
    for way in ("rk4", "euler"):
        p = drift.integrate(lat, lon, 0.0, 36000, 300, 0.03, flow, still, False, way)
        q = drift.integrate(*p, 36000.0, 36000, 300, 0.03, flow, still, True, way)
        assert np.allclose(q[0], lat, atol=1e-6) and np.allclose(q[1], lon, atol=1e-4)


def test_steps_round_half_even_and_rest():
    flow, still = field.Constant(0.0, 1.0), field.Constant()
    move = lambda s: (drift.integrate([0.0], [0.0], 0.0, s, 100, 0, flow, still)[0] * geo.METRES_PER_DEGREE)[0]
    assert abs(move(250) - 250) < 1e-6 and abs(move(370) - 400) < 1e-6 and abs(move(0)) < 1e-9
    with pytest.raises(ValueError):
        drift.integrate([0.0], [0.0], 0.0, 3600, 3600, 0, flow, still, snapshots=(3600, 3700))


def test_known_origin_is_found():
    gyre = field.Gyre(22.40, 68.95, background=(0.12, -0.05), strain=3e-5)
    rng = np.random.default_rng(7)
    t = 1787205600.0
    lat, lon = drift.integrate(*drift.seed_disk(22.40, 68.95, 0.3, 400, rng), t - 14 * 3600, 14 * 3600, 300, 0.0, gyre, field.Constant())
    ring = geo.convex_hull(lon, lat)
    cfg = drift.Config(min_hours=2, max_hours=24, hour_step=2, particles_back=120, particles_forward=80, dt=600)
    got = drift.backtrack_one(1, ring, t, geo.polygon_area_km2(ring[:, 0], ring[:, 1]), gyre, field.Constant(), cfg)
    p = got.weight / got.weight.sum()
    error = float(geo.geodesic((got.lat * p).sum(), (got.lon * p).sum(), 22.40, 68.95)[0]) / 1000
    rank = int((got.weight > got.weight[got.hour == 14].iloc[0]).sum())
    assert error < 40 and p.max() > 1.1 * p.min() and rank < 0.6 * len(got)


def test_forward_track(spark):
    gyre = field.Gyre(28.20, -89.15, background=(0.12, -0.05), strain=3e-5)
    at = spark.createDataFrame([(1, 28.2007, -89.1503, 1788462344.0, 1.0)], "origin long, lat double, lon double, t double, radius_km double")
    track = drift.forward(at, gyre, hours=12, step_hours=2, cfg=drift.Config(dt=600)).orderBy("hours_elapsed").toPandas()
    assert len(track) == 7 and track.distance_from_origin_km.iloc[-1] > 0.5 and track.distance_from_origin_km.iloc[-1] >= track.distance_from_origin_km.iloc[1]
    with pytest.raises(ValueError):
        drift.forward(at, gyre, hours=0)


def test_seeding_and_config():
    rng = np.random.default_rng(1)
    ring = np.array([[0, 0], [1, 0], [1, 1], [0, 1.0]])
    lat, lon = drift.seed_polygon(ring, 50, rng)
    assert len(lat) == 50 and (lat > 0).all() and (lon < 1).all()
    flat = drift.seed_polygon(np.array([[0, 0], [1, 1], [2, 2.0]]), 5, rng)
    assert len(flat[0]) == 5
    cfg = drift.Config().with_overrides({"max_hours": 12, "dt": None, "other": 3})
    assert cfg.max_hours == 12 and cfg.dt == 300
    assert drift.hour_grid(1, 48, 2).tolist() == list(range(1, 48, 2)) and len(drift.windage_grid(0.03, 0.3, 1)) == 1
    assert drift.release_radius_km(0.0) == 0.3 and drift.release_radius_km(1e6) == 25


def test_gridded_field():
    u = np.arange(2 * 3 * 3, dtype=float).reshape(2, 3, 3)
    f = field.Gridded(0.0, 3600.0, 10.0, 20.0, 1.0, u, -u)
    got = f.velocity(np.array([10.5, 50.0]), np.array([20.5, 50.0]), 1800.0)[0]
    assert np.allclose(got, [2 + 4.5, 8 + 4.5])
    assert np.allclose(f.velocity(np.array([10.0]), np.array([20.0]), 1e9)[0], [9.0])
    assert len(field.grid_points(0, 0, 1, 1, 4)) == 16


def fixes(spark, rows):
    return spark.createDataFrame(rows, "ship_id string, seq long, t double, lat double, lon double")


def test_ranking_edges(spark):
    grid = spark.createDataFrame([(28.0, -89.0, 1.0)], "lat double, lon double, p double")
    rows = [("at", 0, 100.0, 28.0, -89.0), ("at", 1, 100.0, 28.0, -89.0), ("late", 0, 500.0, 28.0, -89.0), ("none", 0, None, 28.0, -89.0), ("far", 0, 100.0, 38.0, -80.0)]
    got = {r.ship_id: r for r in correlate.rank_vessels(fixes(spark, rows), grid, 200.0, 0.0).collect()}
    assert set(got) == {"at", "late", "far"} and got["at"].suspicion_score == 100.0 and got["at"].positions_in_window == 2
    assert not got["late"].in_release_window and got["late"].suspicion_score == 70.0 and got["late"].time_centrality == 0
    narrow = correlate.rank_vessels(fixes(spark, rows[:1]), grid, 100.0, 100.0).first()
    assert narrow.suspicion_score == 100.0
    assert correlate.rank_vessels(fixes(spark, []), grid, 0.0, 1.0).count() == 0
    with pytest.raises(Exception, match="empty"):
        correlate.rank_vessels(fixes(spark, rows), grid.limit(0), 0.0, 1.0).collect()
    assert 0 <= got["far"].suspicion_score <= 100


def test_posterior_degenerate(spark):
    m = spark.createDataFrame([(1, 0, 0.0), (1, 1, 0.0), (2, 0, 5.0)], "detection int, seq int, weight double").selectExpr("*", "1.0D as hour", "0.0D as alpha", "1.0D as lat", "2.0D as lon")
    got = posterior.means(posterior.normalised(m)).orderBy("detection").collect()
    assert [r.ess for r in got] == [2.0, 1.0]


def test_catalog(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"detections": [{"a": 1}, {"a": 2}, {"a": 3}]}))
    assert [r.a for r in catalog.read_detections(spark, str(tmp_path / "d.json"), 2).collect()] == [1, 2]
    (tmp_path / "w1.json").write_text(json.dumps([{"lat": 1.0, "lon": 2.0, "timestamp_utc": "t", "wind_speed_ms": 4.0}]))
    (tmp_path / "w2.json").write_text(json.dumps({"records": [{"lat": 1.0, "lon": 2.0, "timestamp_utc": "t", "wind_speed_ms": 5.0}]}))
    assert [catalog.read_wind_cache(spark, str(tmp_path / f"w{k}.json")).first().wind_speed_ms for k in (1, 2)] == [4.0, 5.0]
    (tmp_path / "s.xml").write_text("<r><sample><sample_id> a </sample_id><split> VAL </split></sample><sample><sample_id>b</sample_id><split>train</split></sample></r>")
    assert {tuple(r) for r in catalog.read_splits(spark, str(tmp_path / "s.xml")).collect()} == {("a", "val"), ("b", "train")}
    (tmp_path / "scene_7.json").write_text(json.dumps({"timestamp_utc": "2024-01-01T00:00:00Z", "satellite_pass_id": "p", "incidence_angle": 30.0}))
    assert catalog.read_sidecars(spark, str(tmp_path / "scene_7.json")).first().stem == "scene_7"
    with pytest.raises(KeyError, match="known"):
        catalog.scene_by_id(spark.createDataFrame([(1,)], "scene_id int"), 2)
    bad = spark.createDataFrame([(1, "", None, None, "x", None, None, None, None, None)], "scene_id int, o_timestamp string, s_timestamp string, t_timestamp string, o_pass_id string, s_pass_id string, t_pass_id string, o_incidence double, s_incidence double, t_incidence double")
    with pytest.raises(Exception, match="no timestamp"):
        catalog.resolve_metadata(bad).collect()


def test_field_sources_fall_back():
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        got = catalog.resolve_field([("cache", lambda: None), ("grid", lambda: 1 / 0)], "x")
    assert got == ("x", "synthetic", True) and len(seen) == 1
    assert catalog.resolve_field([("cache", lambda: 5)], "x") == (5, "cache", False)


def test_stages_stop_at_the_first_failure():
    log = []
    assert incremental.run_stages([("a", lambda: None), ("b", lambda: 1 / 0), ("c", lambda: None)], log.append) == "error"
    assert log[:2] == ["started", "a"] and log[2].startswith("error: b")


def test_stream_scores(spark, tmp_path):
    grid = spark.createDataFrame([(28.0, -89.0, 1.0)], "lat double, lon double, p double")
    rows = spark.createDataFrame([("a", "2024-01-01 00:10:00", 28.0, -89.0), ("a", "2024-01-01 00:20:00", 29.0, -89.0), ("b", "2024-01-01 09:00:00", 28.0, -89.0)], "ship_id string, ts string, lat double, lon double")
    rows.withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ship_id string, ts timestamp, lat double, lon double").parquet(str(tmp_path / "in"))
    q = incremental.score_stream(stream, grid).writeStream.outputMode("complete").format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    got = {r.ship_id: r for r in spark.table("scored").collect()}
    assert got["a"].fixes == 2 and abs(got["a"].proximity - 1) < 1e-9
