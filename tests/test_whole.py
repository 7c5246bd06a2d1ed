"""The registered queries do the whole job: every row of their tables, with the operators' own parameters."""

import numpy as np

from driftlode.functions import geo
from driftlode.operators import drift, field, raster
from driftlode.plans.queries import GYRE, QUERIES


def suppliers(spark, folder):
    spark.createDataFrame([(1,), (41,), (5000,)], "s_suppkey long").write.parquet(f"{folder}/supplier.parquet")
    return str(folder)


def test_drift_queries_take_every_detection(spark, tmp_path):
    d = suppliers(spark, tmp_path)
    got = QUERIES["backtrack_ensemble"](spark, d).toPandas()
    assert sorted(set(got.detection)) == [1, 41, 5000]
    for _, g in got.groupby("detection"):
        assert sorted(g.hour) == list(range(1, 48, 2)) and np.isclose(g.p.sum(), 1)
    track = QUERIES["forecast_track"](spark, d).toPandas()
    assert sorted(track.origin) == [1, 41, 5000] and (track.snapshots == 13).all()


def test_clouds_move_together_as_alone():
    rng, still = np.random.default_rng(3), field.Constant(2.0, 1.0)
    hours = np.array([3.0, 1.0, 0.0, 2.0])
    clouds = [drift.seed_disk(28.1, -89.2, 2.0, n, rng) for n in (5, 7, 3, 4)]
    for dt in (300.0, 700.0):
        for got, c, h in zip(drift.together(clouds, hours, 1e9, dt, 0.03, GYRE, still), clouds, hours, strict=True):
            want = drift.integrate(*c, 1e9 - h * 3600, h * 3600, dt, 0.03, GYRE, still)
            assert np.allclose(geo.geodesic(got[0], got[1], want[0], want[1])[0], 0, atol=1e-4)


def test_components_cross_tiles(spark):
    rng = np.random.default_rng(8)
    masks = {0: rng.random((30, 17)) < 0.42, -3: rng.random((9, 26)) < 0.35}
    masks[0][:, 3] = True
    rows = [(k, r, c, bool(m[r, c])) for k, m in masks.items() for r in range(m.shape[0]) for c in range(m.shape[1])]
    px = spark.createDataFrame(rows, "scene_id long, row int, col int, mask boolean")
    got = {(x.scene_id, x.row, x.col): x.label for x in raster.components(px, "mask", 3, tile=4).collect()}
    want = {}
    for k, m in masks.items():
        labels, number = raster.label_mask(m), {}
        for r, c in zip(*np.nonzero(labels), strict=True):
            if (labels == labels[r, c]).sum() >= 3:
                want[k, r, c] = number.setdefault(labels[r, c], len(number) + 1)
    assert got == want
