"""Fields in boxes against the packed field, and the batched ranking against the ranking of one detection."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from driftlode.operators import chunked, correlate, drift, field

FIELD = "t double, lat double, lon double, u double, v double"


def grid(spark, nt=5, ni=7, nj=9, seed=1, dt=3600.0, lat0=28.0, lon0=-89.5, step=0.1, speed=2.0):
    rng = np.random.default_rng(seed)
    u, v = rng.normal(0, speed, (2, nt, ni, nj))
    rows = [(k * dt, lat0 + i * step, lon0 + j * step, float(u[k, i, j]) if (k + i + j) % 11 else None, float(v[k, i, j])) for k in range(nt) for i in range(ni) for j in range(nj)]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, FIELD)


def drifters(spark, n=60, seed=2):
    rng = random.Random(seed)
    rows = [(k, rng.uniform(27.9, 28.7), rng.uniform(-89.6, -88.6), rng.uniform(-4000, 12000), rng.choice([0.0, 0.03])) for k in range(n)]
    return rows, spark.createDataFrame(rows, "id long, lat double, lon double, t double, alpha double")


@pytest.mark.parametrize(("hold", "backward", "integrator"), [(False, False, "rk4"), (True, True, "rk4"), (False, True, "euler")])
def test_same_tracks_as_the_packed_field(spark, hold, backward, integrator):
    table, wind = grid(spark, speed=0.4), grid(spark, 3, 4, 5, 9, 7200.0, 27.8, -89.8, 0.3, 4.0)
    rows, df = drifters(spark)
    out = chunked.advect(df, table, wind, steps=30, dt=300.0, size=(5000.0, 0.2, 0.17), hold=hold, backward=backward, integrator=integrator, every=15, margin=2, at_once=7).collect()
    assert len(out) == 3 * len(rows)
    current, air = field.pack(table, hold), field.pack(wind, hold)
    got = {(r.id, r.done): (r.lat, r.lon, r.t) for r in out}
    for k, lat, lon, t, alpha in rows:
        for done in (0, 15, 30):
            a, b = drift.integrate([lat], [lon], t, done * 300.0, 300.0, alpha, current, air, backward, integrator)
            assert got[k, done] == pytest.approx((a[0], b[0], t + (-1 if backward else 1) * done * 300.0), abs=1e-9)


def test_boxes_of_any_size_and_plain_fields(spark):
    table = grid(spark, speed=0.5)
    _, df = drifters(spark, 20)
    tracks = [sorted(map(tuple, chunked.advect(df, table, steps=20, size=size).collect())) for size in ((1e9, 90.0, 90.0), (3600.0, 0.1, 0.3))]
    assert np.allclose(*tracks, atol=1e-9)
    gyre = field.Gyre(28.2, -89.1)
    out = {r.id: (r.lat, r.lon) for r in chunked.advect(df, gyre, field.Constant(3.0, 1.0), steps=12).collect()}
    for r in df.collect():
        a, b = drift.integrate([r.lat], [r.lon], r.t, 3600.0, 300.0, r.alpha, gyre, field.Constant(3.0, 1.0))
        assert out[r.id] == pytest.approx((a[0], b[0]), abs=1e-9)


def test_odd_tables_and_particles(spark):
    table = grid(spark, 2, 3, 3)
    with pytest.raises(ValueError, match="no full grid"):
        chunked.axes_of(table.limit(5))
    with pytest.raises(ValueError, match="isn't regular"):
        chunked.axes_of(spark.createDataFrame([(t, a, b, 0.0, 0.0) for t in (0.0, 1.0) for a in (0.0, 1.0, 5.0) for b in (0.0, 1.0)], FIELD))
    nulls = spark.createDataFrame([(1, None, 2.0, 3.0), (2, 28.1, -89.4, 0.0)], "id long, lat double, lon double, t double")
    assert sorted((r.id, r.done) for r in chunked.advect(nulls, table, steps=3).collect()) == [(1, 0), (2, 3)]
    assert chunked.advect(nulls.limit(0), table, steps=3).count() == 0 and chunked.advect(nulls, table, steps=0).count() == 2
    fast = table.selectExpr("t", "lat", "lon", "500D as u", "0D as v")
    with pytest.raises(Exception, match="leaves the margin"):
        chunked.advect(nulls, spark.createDataFrame(grid(spark, 2, 3, 60).selectExpr("t", "lat", "lon", "5000D as u", "0D as v").collect(), FIELD), steps=3, size=(9e9, 9.0, 0.3)).collect()
    one = fast.where("t = 0 and lat = 28.0 and lon = -89.5")  # a field of one place
    assert chunked.advect(nulls, one, steps=1).where("done = 1").count() == 1


def test_every_detection_as_if_alone(spark):
    rng = random.Random(5)
    fixes = [(ship, k, float(rng.randrange(0, 400_000, 50)), rng.uniform(28, 28.6), rng.uniform(-89.5, -88.9)) for ship in range(7) for k in range(1 + 6 * ship)]
    fixes += [(20, 0, 99_000.0, 28.1, -89.1), (20, 1, 101_000.0 + 3600, 28.3, -89.2), (20, 2, 99_000.0, 28.4, -89.2), (21, 0, None, 28.1, -89.0)]
    df = spark.createDataFrame(fixes, "ship_id long, seq long, t double, lat double, lon double")
    cells = [(d, rng.uniform(28, 28.6), rng.uniform(-89.5, -88.9), rng.random()) for d in range(4) for _ in range(5)]
    grids = spark.createDataFrame([*cells, (0, cells[0][1], cells[0][2], 0.25)], "detection long, lat double, lon double, p double")
    windows = [(0, 100_000.0, 103_600.0), (1, 260_000.0, 200_000.0), (2, -9e5, -8e5), (3, 9e5, 9.5e5)]
    table = spark.createDataFrame([*windows, windows[0]], "detection long, start double, end double")
    got = {(r.detection, r.ship_id): tuple(r)[2:] for r in correlate.score_detections(df, grids, table, fallback=True).collect()}
    inside = correlate.score_detections(df, grids, table).collect()
    assert len(got) == 4 * 8 and {(r.detection, r.ship_id): tuple(r)[2:] for r in inside} == {k: v for k, v in got.items() if v[2]} and len(inside) < len(got)
    for d, start, end in windows:
        for r in correlate.score_vessels(df, grids.where(f"detection = {d}"), start, end).collect():
            assert got[d, r.ship_id] == pytest.approx((r.suspicion_score, r.closest_distance_km, r.positions_in_window, r.grid_weighted_proximity), abs=1e-9)


def test_proximity_to_very_many_cells(spark):
    rng = random.Random(9)
    spots = [(28.3, -89.2), (0.0, 179.9), (-0.5, -179.9), (89.6, 10.0), (-89.9, -120.0), (60.0, 0.0)]
    around = lambda n, wide: [(max(-90.0, min(90.0, a + rng.gauss(0, wide))), (o + rng.gauss(0, wide * (20 if abs(a) > 80 else 1)) + 180) % 360 - 180) for a, o in spots for _ in range(n)]
    cells, places = around(400, 0.9), around(25, 1.2)
    grid = spark.createDataFrame([(*c, 1 / len(cells)) for c in cells], "lat double, lon double, p double")
    at = spark.createDataFrame([*places, places[0]], "lat double, lon double")
    got = {(r.lat, r.lon): r.prox for r in correlate.proximity_of_places(at, grid).collect()}
    want = at.distinct().crossJoin(F.broadcast(correlate.packed(grid))).select("lat", "lon", correlate.proximity(F.col("lat"), F.col("lon"), F.col("cells")).alias("prox")).collect()
    assert len(got) == len(want) == len(set(places)) and all(abs(got[r.lat, r.lon] - r.prox) <= 2e-8 for r in want) and max(got.values()) > 1e-3
    fixes = spark.createDataFrame([(k % 7, k, 3600.0 * (k % 50), *p) for k, p in enumerate(places)] + [(1, 900, 10.0, *places[0])] * 2, "ship_id long, seq long, t double, lat double, lon double")
    both = [sorted(map(tuple, correlate.score_vessels(fixes, grid, 0.0, 90_000.0, many_cells=many).collect())) for many in (False, True)]
    assert len(both[0]) == 7 and all(a == pytest.approx(b, abs=2e-6) for a, b in zip(*both, strict=True))


def test_nodes_are_packed_before_they_are_shuffled(spark):
    table = grid(spark, 30, 6, 60, speed=0.4)
    axes, size = chunked.axes_of(table), (8 * 3600.0, 0.2, 1.5)
    got = chunked.boxes(table, axes, size)
    kept = {(r.t, r.lat, r.lon): (r.u or 0.0, r.v) for r in table.collect()}
    places = sorted({p[0] for p in kept}), sorted({p[1] for p in kept}), sorted({p[2] for p in kept})
    rows = got.collect()
    assert len(rows) == len({tuple(r)[:3] for r in rows}) == np.prod([b - a + 1 for a, b in chunked._box_range(axes, size)])
    for r in rows:
        u, v = (np.frombuffer(b).reshape(r.nk, r.ni, r.nj) for b in (r.u, r.v))
        for x, low, n, box, width, step in zip(places, (r.k0, r.i0, r.j0), (r.nk, r.ni, r.nj), tuple(r), size, axes.step, strict=False):
            mine = [k for k, p in enumerate(x) if np.floor((p - 2 * step) / width) <= box <= np.floor((p + 2 * step) / width)]
            assert mine == list(range(low, low + n))
        assert all((u[k, i, j], v[k, i, j]) == kept[places[0][r.k0 + k], places[1][r.i0 + i], places[2][r.j0 + j]] for k in range(r.nk) for i in range(r.ni) for j in range(r.nj))
    found = []

    def walk(node):
        if "Exchange" in node.nodeName():
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    spark.conf.set("spark.sql.adaptive.enabled", "false")  # its stages hide the exchanges
    try:
        plan = got.select("*")._jdf.queryExecution().executedPlan()
        plan.executeCollect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    walk(plan)
    assert 0 < sum(found) < 1000  # 10,800 nodes, most of them in several boxes
