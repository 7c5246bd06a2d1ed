"""Steps whose memory or disk once grew faster than their input."""

import dataclasses

import numpy as np
import pytest

from pyspark.sql import functions as F

from driftlode.llm import collisions, common
from driftlode.operators import correlate, drift, field, raster


def test_times_broadcast_no_table(spark):
    # Spark takes what is exploded from a few rows to be small, and once sent all of it to the driver
    obs = spark.range(4).selectExpr("id % 2 as i", "floor(id / 2) as j", "explode(sequence(0L, 71L)) as h").selectExpr("i", "j", "h * 3600e0 as t", "h + i as u", "cast(h - j as double) as v")
    asked = obs.selectExpr("i", "j", "t + 1800e0 as t")
    got = field.at_times(obs.selectExpr("i", "j", "t", "cast(u as double) as u", "v"), asked)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    rows = {(r.i, r.j, r.t): (r.u, r.v) for r in got.collect()}
    assert len(rows) == 4 * 72
    assert rows[1, 0, 1800.0] == (1.5, 0.5) and rows[0, 1, 70 * 3600 + 1800.0] == (70.5, 69.5) and rows[0, 0, 71 * 3600 + 1800.0] == (71.0, 71.0)


@pytest.mark.parametrize("strip", [4, 256])
def test_windows_over_gaps(spark, monkeypatch, strip):
    # a window reaches a pixel in a line that has none in the window's own column
    monkeypatch.setattr(raster, "STRIP", strip)
    rng = np.random.default_rng(5)
    v = np.where(rng.random((13, 17)) < 0.45, rng.random((13, 17)), np.nan)
    v[8:, 6:] = np.nan
    v[:, 0] = np.nan
    there = [(0, int(r), int(c), float(v[r, c])) for r, c in zip(*np.nonzero(~np.isnan(v)), strict=True)]
    px = spark.createDataFrame(there, "scene_id long, row int, col int, v double")
    wide = np.nan_to_num(np.pad(v, 2, mode="symmetric"))
    got = raster.box_sums(px, "v", 5, "m", 13, 17).collect()
    assert len(got) == len(there) and set(got[0].asDict()) == {"scene_id", "row", "col", "v", "m"}
    for x in got:
        assert np.isclose(x.m, wide[x.row : x.row + 5, x.col : x.col + 5].sum() / 25), (x.row, x.col)


def _fixes(spark):
    rows = [(s, k, float(t), 28.0 + s / 10 + k / 50, -89.0 - k / 30) for s, times in {97: [0, 10, 10, 5e6, 9e6], 98: [40]}.items() for k, t in enumerate(times)]
    return spark.createDataFrame(rows, "ship_id int, seq long, t double, lat double, lon double").selectExpr("concat('v', ship_id) as ship_id", "seq", "t", "lat", "lon")


def test_rank_outside_windows_shuffles_no_pairs(spark):
    # names as ids, tracks in several parts, equal times, windows before, between and after all fixes
    windows = [("w0", -9.0, -1.0), ("w1", 20.0, 30.0), ("w2", 10.0, 12.0), ("w3", 6e6, 6.1e6), ("w4", 1e9, 1.1e9), ("w5", 5e6, 5e6)]
    asked = spark.createDataFrame(windows, "detection string, start double, end double")
    grids = asked.selectExpr("detection", "explode(array(28.0, 28.5)) as lat", "-89.1 as lon", "0.5 as p")
    fixes = _fixes(spark)
    got = {(x.detection, x.ship_id): x for x in correlate.score_detections(fixes, grids, asked, fallback=True).collect()}
    assert len(got) == 2 * len(windows)
    outside = correlate.nearest_outside(fixes, asked.selectExpr("detection", "start as low", "end as high")).collect()
    want = {(x.detection, x.ship_id): x.seq for x in outside}
    cells = grids.groupBy("detection").agg(F.collect_list(F.struct("lat", "lon", "p")).alias("cells"), F.avg("lat").alias("o_lat"), F.avg("lon").alias("o_lon"), F.lit(1.0).alias("reference"))
    away = correlate.score_outside(fixes, asked.selectExpr("detection", "start as low", "end as high"), cells)
    plan = away._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Exchange" not in plan.split("CartesianProduct")[0].replace("isFinalPlan", "")
    rows = {(x.detection, x.ship_id): x.seq for x in away.collect()}
    inside = {("w2", "v97"), ("w5", "v97")}
    assert rows == {k: v for k, v in want.items() if k not in inside}
    assert all(got[k].positions_in_window == (0 if k in rows else got[k].positions_in_window) and (k in rows) == (got[k].positions_in_window == 0) for k in got)


def test_sketches_meet_nodes_once(spark):
    # 40 nodes share five values each; half of them are alike, the others alike among themselves
    sets = {k: np.arange(60, dtype=np.uint64) + np.uint64(1000 * (k % 2) + k // 8) for k in range(1, 41)}
    rows = [(k, [1, 2, 3, 4, 5], bytearray(collisions.sketch(60, np.full(8, k % 2, np.uint8)))) for k in sets]
    items = spark.createDataFrame(rows, "node long, coords array<long>, sketch binary")
    full = spark.createDataFrame([(k, bytearray(v.tobytes())) for k, v in sets.items()], "node long, full binary")
    counts, scratch = {}, common.Scratch()
    keep = scratch.keep
    scratch.keep = lambda df, name: (table := keep(df, name), counts.setdefault(name, table.count()))[0]
    got = collisions.linked(items, 4, 80, lambda nodes: full.join(nodes, "node"), lambda xs: [np.frombuffer(x, np.uint64) for x in xs], scratch)
    assert {(x.node, x.component) for x in got.collect()} == {(k, 2 - k % 2) for k in sets}
    assert 0 < counts["long"] <= len(sets)


def test_particles_of_one_phase_share_their_steps():
    # each particle once took every step of its own; near the eddy's middle it still does
    taken = []

    class Counted(field.Gyre):
        def velocity(self, lat, lon, t):
            taken.append(np.size(lat))
            return super().velocity(lat, lon, t)

    rng, gyre, still = np.random.default_rng(4), Counted(28.2, -89.15), field.Constant()
    lat, lon = 28.2 + rng.uniform(-0.3, 0.3, (4, 15_000)), -89.15 + rng.uniform(-0.4, 0.4, (4, 15_000))
    for backward, t in ((True, 5e6), (False, 5e6), (False, 5e6 + gyre.period_s)):
        taken.clear()
        got = drift.integrate(lat, lon, t, 7200.0, 300.0, 0.03, gyre, still, backward)
        want, sign = (lat, lon), -1.0 if backward else 1.0
        for k in range(24):
            want = drift.step_by(*want, t + sign * k * 300.0, sign * 300.0, 0.03, field.Gyre(28.2, -89.15), still, "rk4")
        assert np.abs(np.array(got) - np.array(want)).max() < 1e-10  # degrees
    assert sum(taken) < 4 * 24 * lat.size / 2  # those that came a period later


def test_detections_of_one_phase_move_as_alone(spark):
    # more than move together, of two phases and several periods; one comes twice
    gyre, cfg = field.Gyre(28.2, -89.15), drift.Config(particles_back=300, particles_forward=40, max_hours=10.0)
    rows = [(k, 1e6 + k % 2 * 5000.0 + k // 10 * gyre.period_s, None if k % 3 else 20.0, [(-89.2 + k / 100, 28.1), (-89.1 + k / 100, 28.1), (-89.1 + k / 100, 28.2)]) for k in range(40)]
    seen = spark.createDataFrame([*rows, rows[7]], "detection long, t double, area_km2 double, ring array<struct<x double, y double>>")
    got = drift.backtrack(seen, gyre, cfg=cfg).toPandas().sort_values(["detection", "seq"])
    assert len(got) == 40 * 5
    for k, t, area, ring in rows:
        use = dataclasses.replace(cfg, seed_radius_km=drift.release_radius_km(area)) if area else cfg
        want, own = drift.backtrack_one(k, np.array(ring), t, area, gyre, field.Constant(), use), got[got.detection == k]
        for c in want.columns:
            assert np.allclose(own[c], want[c], rtol=1e-6, atol=1e-9), c


def test_centres_are_dealt_and_clouds_not_broadcast(spark, tmp_path):
    # a file of suppliers was one task for all steps, and Spark took the clouds for as small as the detections
    from driftlode.plans import tracks

    spark.range(1, 200).withColumnRenamed("id", "s_suppkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    way = drift.euler_track(tracks.centres(spark, str(tmp_path)), field.Gyre(28.2, -89.15), 3, 300.0)
    assert way.rdd.getNumPartitions() == 4 and way.count() == 199
    assert "Broadcast" not in tracks.ensemble_centres(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


def test_tracks_meet_windows_of_their_time_in_groups(spark):
    # a row for each pair of a track and a pack of windows once sent the pack's cells for every track
    windows = spark.range(0, 300).selectExpr("id as detection", "id * 40000e0 as low", "id * 40000e0 + 9000e0 as high")
    cells = windows.selectExpr("detection", "array(struct(28.0 as lat, -89.0 as lon, 1e0 as p)) as cells", "28.0 as o_lat", "-89.0 as o_lon", "1e0 as reference")
    fixes = spark.range(0, 3000).selectExpr("id % 100 as ship_id", "id as seq", "id * 400e0 as t", "28.0 + id % 7 / 9 as lat", "-89.0 + id % 5 / 9 as lon")
    away = correlate.score_outside(fixes, windows, cells)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # its stages hide the joins
    try:
        plan = away.select("*")._jdf.queryExecution().executedPlan()
        plan.executeCollect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    met, todo = [], [plan]
    while todo:
        node = todo.pop()
        met += [node.metrics().apply("numOutputRows").value()] if "CartesianProduct" in node.nodeName() else []
        todo += [node.children().apply(k) for k in range(node.children().size())]
    assert len(met) == 1 and 0 < met[0] < 100  # 100 tracks by 3 packs were 300 at least
    got = away.toPandas()
    assert len(got) == got.groupby(["detection", "ship_id"]).ngroups
    r = got[(got.detection == 299) & (got.ship_id == 7)].iloc[0]
    p, q, dx = np.radians(28.0), np.radians(28.0 + 2907 % 7 / 9), np.radians(2907 % 5 / 9)
    km = 2 * 6371.0088 * np.arcsin(np.sqrt(np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(dx / 2) ** 2))
    assert r.seq == 2907 and np.isclose(r.km, km, rtol=1e-12) and np.isclose(r.prox, np.exp(-km / 8), rtol=1e-9)


def test_rounding_is_that_of_spark(spark):
    rng = np.random.default_rng(1)
    values = [0.0, 0.5, 0.05, 0.15, 0.25, 2.675, 1.005, 1e15, -0.05, -3.3, 9.95, float("nan"), float("inf"), None, *rng.uniform(0, 100, 2000).tolist(), *(rng.integers(0, 10**7, 2000) / 2e6).tolist()]
    x = spark.createDataFrame([(v,) for v in values], "x double")
    for n in (1, 2, 6):
        assert x.where(~correlate._rounded(F.col("x"), n).eqNullSafe(F.round("x", n))).count() == 0


def test_ensembles_of_one_phase_ask_the_field_less():
    taken = []

    class Counted(field.Gyre):
        def velocity(self, lat, lon, t):
            taken.append(np.size(lat))
            return super().velocity(lat, lon, t)

    gyre, cfg, ring = Counted(28.2, -89.15), drift.Config(max_hours=12.0), np.array([(-0.05, -0.01), (0.05, -0.02), (0.06, 0.01), (-0.04, 0.02)])
    for day in range(8):
        taken.clear()
        seen = [drift.Seen(100 * day + k, [[ring + (-89.3 + k % 11 * 0.05, 28.0 + k % 7 * 0.05)]], 25.0, 2.8) for k in range(16)]
        got = drift.backtrack_alike(seen, 1e6 + day * gyre.period_s, gyre, field.Constant(), cfg)
        assert len(got) == 16 * 6
    own = 4 * 12 * (500 * 11 + 150 * sum(range(1, 12, 2)))  # asked by a detection that takes all its steps alone
    assert sum(taken) < 16 * own / 2
