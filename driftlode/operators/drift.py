"""Lagrangian drift: particle integration, the backward ensemble, forward tracks."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, fields, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlode.functions.geo import METRES_PER_DEGREE, convex_hull, geodesic, polygon_area_km2, polygon_areas_km2
from driftlode.functions.polygon import rings
from driftlode.operators import flow
from driftlode.operators.field import Constant


@dataclass(frozen=True)
class Config:
    """Parameters of a backward run, with their defaults."""

    windage: float = 0.03
    windage_jitter: float = 0.30
    windage_count: int = 1
    min_hours: float = 1.0
    max_hours: float = 48.0
    hour_step: float = 2.0
    dt: float = 300.0
    integrator: str = "rk4"
    particles_back: int = 500
    particles_forward: int = 150
    seed_radius_km: float = 0.3
    seed: int = 42
    sigma_km: float = 8.0
    sigma_area: float = 0.6
    sigma_elong: float = 0.5
    mass: float = 0.80
    bin_deg: float | None = 0.05

    def with_overrides(self, given: dict | None) -> Config:
        """Known names with a value replace the defaults; others are ignored."""
        known = {f.name for f in fields(self)}
        return replace(self, **{k: v for k, v in (given or {}).items() if k in known and v is not None})


def release_radius_km(area_km2: Column | float, fraction: float = 1.0):
    """Radius of a disk of the area, within 0.3 and 25 km."""
    if isinstance(area_km2, Column):
        return F.greatest(F.least(F.sqrt(area_km2 / math.pi) * fraction, F.lit(25.0)), F.lit(0.3))
    return max(min(math.sqrt(area_km2 / math.pi) * fraction, 25.0), 0.3)


def hour_grid(low: float, high: float, step: float) -> np.ndarray:
    return np.arange(low, high + 1e-9, step)


def windage_grid(centre: float, jitter: float, count: int) -> np.ndarray:
    return np.array([centre]) if count <= 1 else np.linspace(centre * (1 - jitter), centre * (1 + jitter), count)


def slope(lat, lon, t, alpha, current, wind):
    """Degrees a second of latitude and longitude: current plus a share of the wind."""
    u, v = current.velocity(lat, lon, t)
    if isinstance(wind, Constant):  # the same for all: no arrays of it
        uw, vw = wind.u, wind.v
    else:
        uw, vw = wind.velocity(lat, lon, t)
    if not isinstance(wind, Constant) or uw or vw:
        u, v = u + alpha * uw, v + alpha * vw
    c = np.cos(np.radians(lat))
    if c.size and c.min() < 1e-6:
        c = np.where(np.abs(c) < 1e-6, 1e-6, c)
    c *= METRES_PER_DEGREE
    return v / METRES_PER_DEGREE, u / c


def step_by(lat, lon, t, dt, alpha, current, wind, integrator):
    a1, b1 = slope(lat, lon, t, alpha, current, wind)
    if integrator != "rk4":
        return lat + dt * a1, lon + dt * b1
    half = dt / 2
    a2, b2 = slope(lat + half * a1, lon + half * b1, t + half, alpha, current, wind)
    a3, b3 = slope(lat + half * a2, lon + half * b2, t + half, alpha, current, wind)
    a4, b4 = slope(lat + dt * a3, lon + dt * b3, t + dt, alpha, current, wind)
    for x1, x2, x3, x4 in ((a1, a2, a3, a4), (b1, b2, b3, b4)):  # x1 becomes the step
        x2 += x3
        x2 *= 2
        x1 += x2
        x1 += x4
        x1 *= dt / 6
    return lat + a1, lon + b1


MAPPED = 6  # steps at least


def advance(lat, lon, t, dt, steps, alpha, current, wind, integrator):
    """Positions after so many steps of ``dt``. Where a field says what its phase is, and the wind is the same everywhere, maps of these steps are made and kept (see ``flow``)."""

    def taken(lat, lon, t=t):
        for k in range(steps):
            lat, lon = step_by(lat, lon, t + k * dt, dt, alpha, current, wind, integrator)
        return lat, lon

    if steps < MAPPED or np.ndim(t) or not isinstance(wind, Constant) or not hasattr(current, "phase") or not (np.isfinite(lat).all() and np.isfinite(lon).all()):
        return taken(lat, lon)
    phase = float(current.phase(t))
    there = flow.kept((current, wind, float(alpha), integrator, dt, steps, phase), lambda p, q: taken(p, q, phase))(lat.ravel(), lon.ravel())
    return tuple(x.reshape(lat.shape) for x in there)


def integrate(lat, lon, t, seconds, dt, alpha, current, wind, backward=False, integrator="rk4", snapshots=()):
    """Positions after ``seconds``, or at each of the ``snapshots`` (seconds) on the way.

    The number of steps is rounded half to even; what remains, if over a microsecond, is one
    short step. Snapshots are taken at the nearest step; two at the same step are an error.
    """
    if seconds < 0:
        raise ValueError("the duration is negative")
    lat, lon, sign = np.array(lat, float), np.array(lon, float), -1.0 if backward else 1.0
    wanted = {round(s / dt): s for s in snapshots}
    if len(wanted) < len(snapshots):
        raise ValueError("two snapshots fall on one step")
    out, n, done = {wanted[0]: (lat, lon)} if 0 in wanted else {}, round(seconds / dt), 0
    for k in sorted(k for k in {*wanted, n} if 0 < k <= n):
        lat, lon = advance(lat, lon, t + sign * dt * done, sign * dt, k - done, alpha, current, wind, integrator)
        done = k
        if k in wanted:
            out[wanted[k]] = (lat, lon)
    if snapshots:
        return out
    rest = seconds - n * dt
    return step_by(lat, lon, t + sign * dt * n, sign * rest, alpha, current, wind, integrator) if rest > 1e-6 else (lat, lon)


def together(clouds, hours, t, dt, alpha, current, wind, integrator="rk4"):
    """The clouds released so many ``hours`` before ``t``, as they are at ``t``. A cloud may have several rows of particles, as many as the others.

    If all starts lie whole steps before ``t``, the clouds move as one array that grows at each start.
    """
    if any(h * 3600 % dt for h in hours):
        return [integrate(*c, t - h * 3600, h * 3600, dt, alpha, current, wind, False, integrator) for c, h in zip(clouds, hours, strict=True)]
    steps = [round(h * 3600 / dt) for h in hours]
    lat, lon, order = None, None, sorted(range(len(steps)), key=lambda i: -steps[i])
    for n, left in enumerate(order):
        lat, lon = (c if x is None else np.concatenate([x, c], axis=-1) for x, c in zip((lat, lon), clouds[left], strict=True))
        until = steps[order[n + 1]] if n + 1 < len(order) else 0
        lat, lon = advance(lat, lon, t - steps[left] * dt, dt, steps[left] - until, alpha, current, wind, integrator)
    ends, out = np.cumsum([np.shape(clouds[i][0])[-1] for i in order])[:-1], {}
    for i, p, q in zip(order, np.split(lat, ends, axis=-1), np.split(lon, ends, axis=-1), strict=True):
        out[i] = (p, q)
    return [out[i] for i in range(len(steps))]


def seed_disk(lat: float, lon: float, radius_km: float, n: int, rng: np.random.Generator):
    angle, r = rng.uniform(0, 2 * math.pi, n), radius_km * 1000 * np.sqrt(rng.uniform(0, 1, n))
    return lat + r * np.sin(angle) / METRES_PER_DEGREE, lon + r * np.cos(angle) / (METRES_PER_DEGREE * max(abs(math.cos(math.radians(lat))), 1e-6))


def inside(x: np.ndarray, y: np.ndarray, *rings: np.ndarray) -> np.ndarray:
    """Whether points lie in a polygon of ``rings``, shells and holes alike."""
    hit = np.zeros(len(x), bool)
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, np.roll(ring, -1, axis=0), strict=True):
            if ay != by:
                hit ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return hit


def opened(ring: np.ndarray) -> np.ndarray:
    """The ring without a last vertex that repeats the first."""
    return ring[:-1] if len(ring) > 1 and (ring[0] == ring[-1]).all() else ring


def centroid(shell: np.ndarray, *holes: np.ndarray) -> np.ndarray:
    """Planar centroid (lon, lat) of a ring without its holes; the mean of the shell's vertices if it has no area."""
    total = np.zeros(3)
    for k, ring in enumerate((shell, *holes)):
        p = ring - shell[0]
        q = np.roll(p, -1, axis=0)
        cross = p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]
        total += np.sign(cross.sum()) * (-1 if k else 1) * np.array([cross.sum(), *((p + q) * cross[:, None]).sum(axis=0)])
    return shell[0] + total[1:] / (3 * total[0]) if abs(total[0]) > 1e-18 else shell.mean(axis=0)


def seed_polygon(parts: list[list[np.ndarray]] | np.ndarray, n: int, rng: np.random.Generator):
    """Uniform points in a polygon (parts of a shell and holes, or one lon/lat ring) by rejection; what 200 rounds don't find is jittered about the centroid."""
    parts = parts if isinstance(parts, list) else [[parts]]
    rings, got = [ring for part in parts for ring in part], np.empty((0, 2))
    shells = np.vstack([part[0] for part in parts])
    low, high = shells.min(axis=0), shells.max(axis=0)
    for _ in range(200):
        if len(got) >= n:
            break
        tried = rng.uniform(low, high, (max(4 * (n - len(got)), 64), 2))
        got = np.vstack([got, tried[inside(tried[:, 0], tried[:, 1], *rings)]])[:n]
    if len(got) < n:
        got = np.vstack([got, whole_centroid(parts) + rng.normal(0, 1e-4, (n - len(got), 2))])
    return got[:, 1], got[:, 0]


def whole_centroid(parts: list[list[np.ndarray]]) -> np.ndarray:
    """Centroid of all parts, each weighted by its area without the holes."""
    size = [abs(_area2(part[0])) - sum(abs(_area2(hole)) for hole in part[1:]) for part in parts]
    each = np.array([centroid(*part) for part in parts])
    return (each * np.array(size)[:, None]).sum(axis=0) / sum(size) if sum(size) > 1e-18 else each.mean(axis=0)


def _area2(ring: np.ndarray) -> float:
    x, y = (ring - ring[0]).T
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())


def elongation(lat: np.ndarray, lon: np.ndarray) -> float:
    return 1.0 if len(lat) < 3 else elongations([lat], [lon])[0]


def elongations(lats, lons) -> list[float]:
    """The elongation of each cloud, all of as many points, three at least."""
    lat, lon = np.array(lats, float), np.array(lons, float)
    y, x = lat.mean(axis=1, keepdims=True), lon.mean(axis=1, keepdims=True)
    both = np.stack([(lon - x) * METRES_PER_DEGREE * np.cos(np.radians(y)), (lat - y) * METRES_PER_DEGREE], axis=1)
    both -= both.mean(axis=2, keepdims=True)
    values = np.clip(np.linalg.eigvalsh(both @ both.swapaxes(1, 2) / (lat.shape[1] - 1)), 1e-9, None)
    return np.sqrt(values[:, -1] / values[:, 0]).tolist()


AROUND = (1, 0), (2, 1), (1, 1), (1, 2), (0, 1), (-1, 2), (-1, 1), (-2, 1)


def outer(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Where points may be corners of their hull: those that don't lie well inside the polygon of the outermost ones of 16 directions. Several rows are clouds of their own."""
    along = [a * x + b * y for a, b in AROUND]
    most = np.stack([np.argmax(d, axis=-1) for d in along] + [np.argmin(d, axis=-1) for d in along], axis=-1)
    ax, ay = np.take_along_axis(x, most, -1), np.take_along_axis(y, most, -1)
    ex, ey = np.roll(ax, -1, axis=-1) - ax, np.roll(ay, -1, axis=-1) - ay
    real = (ex != 0) | (ey != 0)
    near, within = 1e-9 * (np.ptp(x, axis=-1) ** 2 + np.ptp(y, axis=-1) ** 2)[..., None], (real.sum(axis=-1) >= 3)[..., None] & np.ones(x.shape, bool)
    for k in range(most.shape[-1]):
        side = slice(k, k + 1)
        within &= (ex[..., side] * (y - ay[..., side]) - ey[..., side] * (x - ax[..., side]) > near) | ~real[..., side]
    return ~within


def hull_area_km2(lat: np.ndarray, lon: np.ndarray) -> float:
    return hull_areas_km2([lat], [lon])[0]


def hull_areas_km2(lats, lons) -> list[float]:
    """The area of the hull of each cloud, all of as many points; distances of all hulls are taken together."""
    lats, lons = np.array(lats, float), np.array(lons, float)
    may = outer(lons, lats) if lats.shape[1] > 16 else np.ones(lats.shape, bool)
    hulls = [convex_hull(lon[m], lat[m]) for lat, lon, m in zip(lats, lons, may, strict=True)]
    areas = iter(polygon_areas_km2([h for h in hulls if h is not None]))
    return [0.0 if h is None else next(areas) for h in hulls]


MEMBER_SCHEMA = "detection long, seq long, hour double, alpha double, lat double, lon double, offset_km double, sim_area_km2 double, sim_elongation double, weight double"
CLOUD = ", lats array<double>, lons array<double>"


@dataclass
class Seen:
    """A detection as backtrack_alike() takes it: parts of closed or open rings, ``centre`` as (lon, lat) or none."""

    detection: int
    parts: list[list[np.ndarray]]
    area_km2: float | None
    seed_radius_km: float
    centre: tuple[float, float] | None = None


def backtrack_one(detection: int, ring: np.ndarray | list[list[np.ndarray]], t: float, area_km2: float | None, current, wind, cfg: Config, centre: tuple[float, float] | None = None, clouds: tuple[float, ...] = ()) -> pd.DataFrame:
    """Members of the backward ensemble of one detection, a ring or parts with holes; rings may be closed or not, an area that isn't positive is an error.

    ``centre``: the detection's own (lon, lat), from which offsets are measured; the ring's centroid unless given.
    ``clouds``: members of these hours have the particles of their cloud too, as lats and lons; the others have null there.
    """
    return backtrack_alike([Seen(detection, ring if isinstance(ring, list) else [[ring]], area_km2, cfg.seed_radius_km, centre)], t, current, wind, cfg, clouds)


def backtrack_alike(seen: list[Seen], t: float, current, wind, cfg: Config, clouds: tuple[float, ...] = ()) -> pd.DataFrame:
    """Members of the backward ensembles of detections of one time, or of one phase of the field; their particles move as one array.

    One backward pass for each windage gives the clouds of all hours. A disk released at each cloud's
    centre and run forward again tells how well its place, size and shape agree with what was seen.
    Random numbers depend on the seed, the detection and the member, not on the order of the work.
    """
    own, starts = [], []
    for s in seen:
        parts = [[opened(r) for r in part] for part in s.parts]
        signed = [(-1 if k else 1) * polygon_area_km2(r[:, 0], r[:, 1]) for part in parts for k, r in enumerate(part)]
        area = sum(signed) if s.area_km2 is None else s.area_km2
        if not area > 0:
            raise ValueError(f"detection {s.detection} has no area")
        shells = np.vstack([np.vstack([part[0], part[0][:1]]) for part in parts])
        name = zlib.crc32(str(s.detection).encode())
        own.append((name, area, elongation(shells[:, 1], shells[:, 0]), *(whole_centroid(parts) if s.centre is None else s.centre)))
        starts.append(seed_polygon(parts, cfg.particles_back, np.random.default_rng([cfg.seed, name])))
    lat0, lon0 = (np.array(x) for x in zip(*starts, strict=True))
    hours, rows = hour_grid(cfg.min_hours, cfg.max_hours, cfg.hour_step), [[] for _ in seen]
    for a, alpha in enumerate(windage_grid(cfg.windage, cfg.windage_jitter, cfg.windage_count)):
        back = integrate(lat0, lon0, t, float(hours.max()) * 3600, cfg.dt, alpha, current, wind, True, cfg.integrator, [h * 3600 for h in hours])
        centres = [[tuple(float(c[n].mean()) for c in back[h * 3600]) for h in hours] for n in range(len(seen))]
        draws = [[np.random.default_rng([cfg.seed, o[0], a, k]) for k in range(len(hours))] for o in own]
        disks = [zip(*[seed_disk(*centres[n][k], s.seed_radius_km, cfg.particles_forward, draws[n][k]) for n, s in enumerate(seen)], strict=True) for k in range(len(hours))]
        moved = together([tuple(np.array(x) for x in d) for d in disks], hours, t, cfg.dt, alpha, current, wind, cfg.integrator)
        flat = [(p[n], q[n]) for n in range(len(seen)) for p, q in moved]
        areas = hull_areas_km2(*zip(*flat, strict=True))
        at_lon, at_lat = (np.repeat([o[k] for o in own], len(hours)) for k in (3, 4))
        offs = geodesic([p.mean() for p, _ in flat], [q.mean() for _, q in flat], at_lat, at_lon)[0] / 1000
        shapes = elongations(*zip(*flat, strict=True)) if cfg.particles_forward > 2 else [1.0] * len(flat)
        for m, (area, off, elong) in enumerate(zip(areas, offs.tolist(), shapes, strict=True)):
            n, k = divmod(m, len(hours))
            h, (_, seen_area, seen_elong, *_) = hours[k], own[n]
            d2 = (off / cfg.sigma_km) ** 2 + (math.log(max(area, 1e-6) / max(seen_area, 1e-6)) / cfg.sigma_area) ** 2 + (math.log(max(elong, 1e-3) / max(seen_elong, 1e-3)) / cfg.sigma_elong) ** 2
            cloud = ([x[n] for x in back[h * 3600]] if h in clouds else [None, None]) if clouds else []
            rows[n].append((seen[n].detection, len(rows[n]), float(h), float(alpha), *centres[n][k], off, area, elong, math.exp(-0.5 * d2), *cloud))
    return pd.DataFrame([r for own in rows for r in own], columns=[c.split()[0] for c in (MEMBER_SCHEMA + CLOUD * bool(clouds)).split(", ")])


def spread(table: DataFrame, key: str) -> DataFrame:
    """Dealt by ``key`` to a fixed number of tasks: the rows are few and small, their work isn't, so they mustn't be coalesced."""
    return table.repartition(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def packed(detections: DataFrame) -> DataFrame:
    """The polygon, if there is one, as flat arrays: pandas takes no nested arrays whose lengths differ."""
    if "polygon" not in detections.columns:
        return detections
    points, sizes = F.flatten(rings(F.col("polygon"))), F.transform(rings(F.col("polygon")), F.size)
    flat = {"_x": F.transform(points, lambda p: p["x"]), "_y": F.transform(points, lambda p: p["y"]), "_rings": sizes, "_parts": F.transform("polygon", F.size)}
    return detections.withColumns(flat).drop("polygon")


def unpacked(r) -> list[list[np.ndarray]]:
    """Parts of rings from a row of packed()."""
    found = np.split(np.column_stack([r._x, r._y]).astype(float), np.cumsum(r._rings)[:-1])
    ends = np.cumsum(r._parts)
    return [found[end - n : end] for n, end in zip(r._parts, ends, strict=True)]


ALIKE = 16  # detections whose particles move as one array


def backtrack(detections: DataFrame, current, wind=None, cfg: Config | None = None, clouds: tuple[float, ...] = ()) -> DataFrame:
    """Members for all detections; rows that repeat a detection count once.

    detection, t, area_km2, ring array<struct<x,y>> or, with parts and holes, polygon (functions.polygon); and, if there, lat and lon.
    Members of the hours ``clouds`` have the particles of their cloud too. Detections are dealt by ranges of their time, or of its phase, if
    the field has one, so that a task has those that move alike.
    """
    cfg, wind = cfg or Config(), wind or Constant()
    phase = getattr(current, "phase", lambda t: t)

    def seen(r) -> Seen:
        parts = unpacked(r) if hasattr(r, "_parts") else [[np.array([(p["x"], p["y"]) for p in r.ring], float)]]
        area = None if pd.isna(r.area_km2) else float(r.area_km2)
        centre = (float(r.lon), float(r.lat)) if hasattr(r, "lat") and not (pd.isna(r.lat) or pd.isna(r.lon)) else None
        return Seen(int(r.detection), parts, area, release_radius_km(area) if area else cfg.seed_radius_km, centre)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, same in pdf.groupby(phase(pdf.t.astype(float))):
                for first in range(0, len(same), ALIKE):
                    yield backtrack_alike([seen(r) for _, r in same.iloc[first : first + ALIKE].iterrows()], float(at), current, wind, cfg, clouds)

    n = int(detections.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = packed(detections).dropDuplicates(["detection"]).withColumn("_at", phase(F.col("t").cast("double")))
    return once.repartitionByRange(n, "_at", "detection").sortWithinPartitions("_at", "detection").drop("_at").mapInPandas(run, MEMBER_SCHEMA + CLOUD * bool(clouds))


TOGETHER = 32  # releases that move as one array
TRACK_SCHEMA = "origin long, hours_elapsed double, t double, lat double, lon double, spread_radius_km double, distance_from_origin_km double, hull_area_km2 double"


def forward(origins: DataFrame, current, wind=None, hours: float = 12.0, step_hours: float = 1.0, cfg: Config | None = None, clouds: tuple[float, ...] = ()) -> DataFrame:
    """Forward tracks of releases (origin, lat, lon, t, radius_km): a row for every snapshot, with its particles where ``clouds`` has its hour."""
    cfg, wind = cfg or Config(), wind or Constant()
    if not 0 < hours <= 120 or step_hours <= 0:
        raise ValueError("0 < hours <= 120 and step_hours > 0 are asked for")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first in range(0, len(pdf), TOGETHER):
                yield tracks(pdf.iloc[first : first + TOGETHER])

    def tracks(r: pd.DataFrame) -> pd.DataFrame:
        own = [np.random.default_rng([cfg.seed, zlib.crc32(str(k).encode())]) for k in r.origin]
        lat, lon = (np.array(x) for x in zip(*[seed_disk(*at, cfg.particles_forward, rng) for *at, rng in zip(r.lat, r.lon, r.radius_km, own, strict=True)], strict=True))
        t, out = r.t.to_numpy(float), []
        for k in range(round(hours / step_hours) + 1):
            if k:
                lat, lon = integrate(lat, lon, t[:, None] + (k - 1) * step_hours * 3600, step_hours * 3600, cfg.dt, cfg.windage, current, wind, False, cfg.integrator)
            y, x = lat.mean(axis=1), lon.mean(axis=1)
            spread = np.sqrt((geodesic(y[:, None], x[:, None], lat, lon)[0] ** 2).mean(axis=1)) / 1000
            far = geodesic(r.lat.to_numpy(float), r.lon.to_numpy(float), y, x)[0] / 1000
            particles = [list(a) if k * step_hours in clouds else None for a in (lat, lon)] if clouds else []
            out.append(pd.DataFrame(dict(zip(names, (r.origin.to_numpy(), k * step_hours, t + k * step_hours * 3600, y, x, spread, far, hull_areas_km2(lat, lon), *particles), strict=True))))
        return pd.concat(out)

    schema = TRACK_SCHEMA + CLOUD * bool(clouds)
    names = [c.split()[0] for c in schema.split(", ")]
    return spread(origins.select("origin", "lat", "lon", "t", "radius_km"), "origin").mapInPandas(run, schema)


def forecast_totals(track: DataFrame) -> DataFrame:
    """By origin: total drift, mean speed and final spread, from the last snapshot."""
    last = F.max(F.struct("hours_elapsed", "distance_from_origin_km", "hull_area_km2", "spread_radius_km")).alias("l")
    each = track.groupBy("origin").agg(last, F.count("*").alias("snapshots"))
    return each.select("origin", "snapshots", F.col("l.distance_from_origin_km").alias("total_drift_km"), (F.col("l.distance_from_origin_km") / F.nullif(F.col("l.hours_elapsed"), F.lit(0.0))).alias("mean_speed_kmh"), F.col("l.hull_area_km2").alias("final_hull_area_km2"))


def euler_track(particles: DataFrame, field, steps: int, dt: float) -> DataFrame:
    """Particles (id, lat, lon, t) after ``steps`` Euler steps through a field of column form, all in the JVM; dealt first, as a small file of rows is one task."""

    def step(a: Column, k: Column) -> Column:
        u, v = field.to_column(a["lat"], a["lon"], F.col("t") + (k - 1) * dt)
        c = F.cos(F.radians(a["lat"]))
        return F.struct((a["lat"] + dt * v / METRES_PER_DEGREE).alias("lat"), (a["lon"] + dt * u / (METRES_PER_DEGREE * c)).alias("lon"))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct("lat", "lon"), step)
    return spread(particles.select("id", "lat", "lon", "t"), "id").withColumn("_e", end).select("id", F.col("_e.lat").alias("lat"), F.col("_e.lon").alias("lon"))
