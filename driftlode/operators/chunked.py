"""Drift through tabular fields of any size: the field cut into boxes of space and time, particles sent to their boxes.

A field is a table (t, lat, lon, u, v) of a regular grid. Each box has the nodes in it and a margin around it, packed into one row;
particles move within their box for as many steps as they stay in it, and are then sent on. Such a round is one
co-grouped shuffle of the particles still under way and of the boxes that hold any; a box with very many particles is
several groups. Neither field nor particles pass through the driver, which gets counts and the ends of the axes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlode.functions.geo import METRES_PER_DEGREE
from driftlode.operators.field import Constant, Field, clean
from driftlode.operators.linking import forget, kept

AT_ONCE = 50_000  # particles of a box that one group moves
PART_ROWS = 1 << 17  # nodes that are packed together
BOX = ["box_t", "box_y", "box_x"]
AXES = ("t", "lat", "lon")


@dataclass(frozen=True)
class Axes:
    """First value, step and number of values of each axis: t, lat, lon."""

    first: tuple[float, float, float]
    step: tuple[float, float, float]
    n: tuple[int, int, int]

    def last(self, k: int) -> float:
        return self.first[k] + self.step[k] * (self.n[k] - 1)


def axes_of(table: DataFrame) -> Axes:
    """The axes of a field's table; an error if it is empty, isn't regular, or places lack or come twice."""
    told = table.agg(F.count("*").alias("rows"), *(f(c).alias(f"{c}{i}") for c in AXES for i, f in enumerate((F.min, F.max, F.count_distinct)))).first()
    n = tuple(told[f"{c}2"] for c in AXES)
    if not told["rows"] or told["rows"] != n[0] * n[1] * n[2]:
        raise ValueError("the table is no full grid")
    axes = Axes(tuple(float(told[f"{c}0"]) for c in AXES), tuple((float(told[f"{c}1"]) - float(told[f"{c}0"])) / (k - 1) if k > 1 else 1.0 for c, k in zip(AXES, n, strict=True)), n)
    off = reduce(lambda a, b: a | b, (F.abs(_index(axes, k) - F.rint(_index(axes, k))) > 1e-3 for k in range(3)))
    if not table.where(off).isEmpty():
        raise ValueError("the grid isn't regular")
    return axes


def _index(axes: Axes, k: int) -> Column:
    return (F.col(AXES[k]).cast("double") - axes.first[k]) / axes.step[k]


def _box_range(axes: Axes, size: tuple[float, float, float]) -> list[tuple[int, int]]:
    """The first and last box that a field has nodes for, on each axis."""
    return [(int(np.floor(axes.first[k] / size[k])), int(np.floor(axes.last(k) / size[k]))) for k in range(3)]


PACKED = "box_t long, box_y long, box_x long, k0 int, i0 int, j0 int, nk int, ni int, nj int, u binary, v binary"


PART = "box_t long, box_y long, box_x long, nodes binary"
NODE = np.dtype([("k", "<i4"), ("i", "<i4"), ("j", "<i4"), ("u", "<f8"), ("v", "<f8")])


def _dealt(axes: Axes, size: tuple[float, float, float], margin: int):
    """Nodes by box, packed as bytes: what PART_ROWS rows of a task have for a box is one row of the shuffle."""
    ends = _box_range(axes, size)

    def packed(rows: pa.Table) -> pa.RecordBatch:
        at = [rows.column(c).to_numpy() for c in AXES]
        own = np.empty(rows.num_rows, NODE)
        for k, c in enumerate("kij"):
            own[c] = np.rint((at[k] - axes.first[k]) / axes.step[k])
        own["u"], own["v"] = rows.column("u").to_numpy(), rows.column("v").to_numpy()
        row, boxes = np.arange(len(own)), []
        for x, width, step, (low, high) in zip(at, size, axes.step, ends, strict=True):
            reach = step * (margin + 1)
            first, last = np.maximum(np.floor((x - reach) / width), low).astype(np.int64), np.minimum(np.floor((x + reach) / width), high).astype(np.int64)
            n = (last - first + 1)[row]
            again = np.repeat(np.arange(len(row)), n)
            boxes = [b[again] for b in boxes]
            row = row[again]
            boxes.append(first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
        order = np.lexsort(boxes[::-1])
        own, boxes = own[row[order]], [b[order] for b in boxes]
        cuts = np.flatnonzero(np.any([np.diff(b, prepend=b[:1] - 1) != 0 for b in boxes], axis=0))
        ends_at = np.append(cuts[1:], len(own))
        return pa.RecordBatch.from_arrays([*(pa.array(b[cuts]) for b in boxes), pa.array([own[a:z].tobytes() for a, z in zip(cuts, ends_at, strict=True)], pa.binary())], names=[*BOX, "nodes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PART_ROWS:
                yield packed(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield packed(pa.Table.from_batches(held))

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a box, which come one after another, as one."""
    box, held, out = None, [], []

    def whole() -> tuple:
        nodes = np.frombuffer(b"".join(held), NODE)
        at = np.array([nodes[c] for c in "kij"])
        low = at.min(axis=1)
        n = at.max(axis=1) - low + 1
        u, v = np.full((2, *n), np.nan)
        u[tuple(at - low[:, None])], v[tuple(at - low[:, None])] = nodes["u"], nodes["v"]
        if len(nodes) != u.size or np.isnan(u).any():
            raise ValueError("the table is no full grid")
        return (*box, *low.tolist(), *n.tolist(), u.tobytes(), v.tobytes())

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 3 + [pa.int32()] * 6 + [pa.binary()] * 2, strict=True)], names=[c.split()[0] for c in PACKED.split(", ")])

    for batch in batches:
        for *key, nodes in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if key != box and held:
                out.append(whole())
                held = []
                if len(out) == 64:
                    yield rows()
                    out = []
            box = key
            held.append(nodes)
    if held:
        out.append(whole())
    if out:
        yield rows()


def boxes(table: DataFrame, axes: Axes, size: tuple[float, float, float], margin: int = 1) -> DataFrame:
    """The field by boxes of ``size`` (seconds, degrees, degrees): a row for each, with ``margin`` nodes more on each side."""
    rows = table.select(*(F.col(c).cast("double").alias(c) for c in AXES), *(clean(F.col(c).cast("double")).alias(c) for c in "uv"))
    parts = rows.dropna(subset=list(AXES)).mapInArrow(_dealt(axes, size, margin), PART)
    return parts.repartition(*BOX).sortWithinPartitions(*BOX).mapInArrow(_pack, PACKED)


@dataclass(frozen=True)
class Piece:
    """What a box has of a field, for places and times given as arrays."""

    axes: Axes
    hold: bool
    at: tuple[int, int, int]
    u: np.ndarray
    v: np.ndarray

    def velocity(self, lat: np.ndarray, lon: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, share = [], []
        for k, x in enumerate((t, lat, lon)):
            p, n, here = (x - self.axes.first[k]) / self.axes.step[k], self.axes.n[k], self.u.shape[k]
            if k == 0 or self.hold:
                p = np.clip(p, 0, n - 1)
            i = np.clip(np.floor(p), 0, max(n - 2, 0)).astype(int)
            mine = i - self.at[k]
            if n > 1 and len(mine) and (mine.min() < 0 or mine.max() > here - 2):
                raise ValueError("a step leaves the margin of its box: take larger boxes, a wider margin or shorter steps")
            low.append(np.clip(mine, 0, max(here - 2, 0)))
            share.append(p - i)
        (k, i, j), (w, y, x) = low, share
        k2, i2, j2 = (np.minimum(a + 1, n - 1) for a, n in zip(low, self.u.shape, strict=True))

        def mix(f: np.ndarray) -> np.ndarray:
            plane = lambda k: (1 - y) * ((1 - x) * f[k, i, j] + x * f[k, i, j2]) + y * ((1 - x) * f[k, i2, j] + x * f[k, i2, j2])
            return (1 - w) * plane(k) + w * plane(k2)

        return mix(self.u), mix(self.v)


def _slope(lat, lon, t, alpha, current, wind):
    (uc, vc), (uw, vw) = current.velocity(lat, lon, t), wind.velocity(lat, lon, t)
    c = np.cos(np.radians(lat))
    c = np.where(np.abs(c) < 1e-6, 1e-6, c)
    return (vc + alpha * vw) / METRES_PER_DEGREE, (uc + alpha * uw) / (METRES_PER_DEGREE * c)


def _step(lat, lon, t, dt, alpha, current, wind, integrator):
    """One step of particles that each have a time of their own."""
    if integrator != "rk4":
        a, b = _slope(lat, lon, t, alpha, current, wind)
        return lat + dt * a, lon + dt * b
    k = [_slope(lat, lon, t, alpha, current, wind)]
    for ahead in (0.5, 0.5, 1.0):
        k.append(_slope(lat + ahead * dt * k[-1][0], lon + ahead * dt * k[-1][1], t + ahead * dt, alpha, current, wind))
    return tuple(x + dt / 6 * (k[0][i] + 2 * k[1][i] + 2 * k[2][i] + k[3][i]) for i, x in enumerate((lat, lon)))


MOVED = "id long, lat double, lon double, t double, alpha double, done long, snapshot boolean"


def advect(particles: DataFrame, current: DataFrame | Field, wind: DataFrame | Field | None = None, steps: int = 144, dt: float = 300.0, size: tuple[float, float, float] = (24 * 3600.0, 2.0, 2.0), integrator: str = "rk4", every: int = 0, backward: bool = False, hold: bool = False, margin: int = 1, at_once: int = AT_ONCE) -> DataFrame:
    """(id, lat, lon, t, done): particles (id, lat, lon, t and, if there, alpha, the share of the wind) after ``steps`` steps of ``dt`` seconds.

    With ``every`` also after each so many steps. Currents and wind are tables of regular grids (t, lat, lon, u, v), each with its own
    axes, or fields whose ``velocity`` takes arrays of places and times. Time is held at both ends of a table; space is extrapolated from
    its edge, or held there with ``hold``. ``size`` is that of a box in seconds and degrees. Ids are expected once each; null places or times
    stay as they are.
    """
    if steps < 0 or dt <= 0:
        raise ValueError("steps >= 0 and dt > 0 are asked for")
    sign = -1.0 if backward else 1.0
    given = {"current": current, "wind": Constant() if wind is None else wind}
    tables = {n: f for n, f in given.items() if isinstance(f, DataFrame)}
    plain = {n: f for n, f in given.items() if n not in tables}
    axes = {n: axes_of(f) for n, f in tables.items()}
    packed = {n: kept(boxes(f, axes[n], size, margin), "boxes") for n, f in tables.items()}
    parts = int(particles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    alpha = F.col("alpha").cast("double") if "alpha" in particles.columns else F.lit(0.0)
    now = particles.select(F.col("id").cast("long").alias("id"), *(F.col(c).cast("double").alias(c) for c in ("lat", "lon", "t")), alpha.alias("alpha"), F.lit(0).cast("long").alias("done"), F.lit(True).alias("snapshot"))

    def moved(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        fields, box = dict(plain), [k.as_py() for k in key[:3]]
        for row in right.to_pylist():
            shape = (row["nk"], row["ni"], row["nj"])
            fields[row["which"]] = Piece(axes[row["which"]], hold, (row["k0"], row["i0"], row["j0"]), *(np.frombuffer(row[c]).reshape(shape) for c in "uv"))
        lat, lon, t, share, done = (left.column(c).to_numpy().copy() for c in ("lat", "lon", "t", "alpha", "done"))
        out, on = [], np.arange(len(lat))
        while len(on):
            lat[on], lon[on] = _step(lat[on], lon[on], t[on], sign * dt, share[on], fields["current"], fields["wind"], integrator)
            t[on] += sign * dt
            done[on] += 1
            going = done[on] < steps
            here = np.logical_and.reduce([np.floor(x[on] / w) == k for x, w, k in zip((t, lat, lon), size, box, strict=True)])
            for rows, snapshot in ((on[~going | (done[on] % every == 0)] if every else on[~going], True), (on[going & ~here], False)):
                if len(rows):
                    out.append((rows, lat[rows], lon[rows], t[rows], done[rows], np.full(len(rows), snapshot)))
            on = on[going & here]
        rows, lats, lons, times, n, snapshots = (np.concatenate(c) for c in zip(*out, strict=True)) if out else [np.zeros(0, int)] * 5 + [np.zeros(0, bool)]
        columns = [left.column("id").take(pa.array(rows)), pa.array(lats), pa.array(lons), pa.array(times), pa.array(share[rows]), pa.array(n, pa.int64()), pa.array(snapshots)]
        return pa.table([c.cast(k) for c, k in zip(columns, (pa.int64(), *[pa.float64()] * 4, pa.int64(), pa.bool_()), strict=True)], names=[c.split()[0] for c in MOVED.split(", ")])

    still = F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("t").isNotNull()
    written = [*packed.values(), kept(now if every or not steps else now.where(~still), "moved")]
    told = written[-1:]
    now = now.where(still) if steps else now.where("false")
    while not now.isEmpty():
        at = now.withColumns({b: F.floor(F.col(c) / w) for b, c, w in zip(BOX, AXES, size, strict=True)})
        full = kept(at.groupBy(*BOX).agg(F.ceil(F.count("*") / at_once).alias("groups")), "full")
        # the boxes that hold particles, under each of their groups; beyond a field's ends its last boxes serve
        sent = []
        for name, table in packed.items():
            edge = _box_range(axes[name], size)
            own = [F.least(F.greatest(F.col(b), F.lit(low)), F.lit(high)).alias(f"own_{b}") for b, (low, high) in zip(BOX, edge, strict=True)]
            asked = full.select(*BOX, *own, F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("part"))
            sent.append(asked.join(table.withColumnsRenamed({b: f"own_{b}" for b in BOX}), [f"own_{b}" for b in BOX]).select(*BOX, "part", F.lit(name).alias("which"), "k0", "i0", "j0", "nk", "ni", "nj", "u", "v"))
        if not sent:  # fields that need no table go with the tasks
            sent = [full.selectExpr(*BOX, "groups as part", "'' as which", *(f"0 as {c}" for c in ("k0", "i0", "j0", "nk", "ni", "nj")), *(f"binary('') as {c}" for c in "uv")).where("false")]
        mine = at.join(full, BOX).withColumn("part", F.pmod(F.xxhash64("id"), F.col("groups"))).drop("groups")
        keys = [*BOX, "part"]
        both = mine.repartition(parts, *keys).groupBy(*keys).cogroup(reduce(DataFrame.unionByName, sent).groupBy(*keys))
        after = kept(both.applyInArrow(moved, MOVED), "moved")
        written += [full, after]
        told.append(after.where("snapshot"))
        now = after.where("not snapshot")
    out = kept(reduce(DataFrame.unionByName, told).select("id", "lat", "lon", "t", "done"), "tracks")
    forget(*written)
    return out
