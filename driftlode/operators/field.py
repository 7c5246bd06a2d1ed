"""Current and wind fields: cleaning, interpolation, analytic fields."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uv(speed_kmh: Column, direction_deg: Column) -> tuple[Column, Column]:
    """Eastward and northward m/s of a speed in km/h and the direction it flows to; nulls are still water."""
    s, d = F.coalesce(speed_kmh, F.lit(0.0)) / 3.6, F.radians(F.coalesce(direction_deg, F.lit(0.0)))
    ok = speed_kmh.isNotNull() & direction_deg.isNotNull()
    return F.when(ok, s * F.sin(d)).otherwise(0.0), F.when(ok, s * F.cos(d)).otherwise(0.0)


def clean(value: Column) -> Column:
    """Masked ocean cells (null or NaN) count as still."""
    return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))


def diagnostics(obs: DataFrame) -> DataFrame:
    """Range and mean of the points' mean speeds, and how many points have no value at all."""
    speed = F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))
    points = obs.groupBy("i", "j").agg(F.avg(speed).alias("s"), F.count("speed_kmh").alias("n"))
    return points.agg((F.max("s") - F.min("s")).alias("speed_range"), F.avg("s").alias("speed_mean"), F.count_if(F.col("n") == 0).alias("empty_points"))


def at_times(obs: DataFrame, asked: DataFrame, step: float = 3600.0) -> DataFrame:
    """u and v of each point (i, j) at the times asked for: linear between the hours, held at both ends.

    obs: i, j, t, u, v at multiples of ``step`` from each point's first time. An equi-join on the hour before and after. All joins are
    sorted: where ``obs`` explodes few rows into many, Spark takes it to be small and would broadcast all of it.
    """
    ends = obs.groupBy("i", "j").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    at = asked.join(ends.hint("merge"), ["i", "j"]).withColumn("x", (F.least(F.greatest("t", "t0"), F.col("t1")) - F.col("t0")) / step)
    at = at.withColumn("k", F.floor("x")).withColumn("w", F.col("x") - F.col("k"))
    hours = obs.join(ends.hint("merge"), ["i", "j"]).select("i", "j", F.floor((F.col("t") - F.col("t0")) / step).alias("k"), "u", "v")
    a = hours.select("i", "j", "k", F.col("u").alias("ua"), F.col("v").alias("va"))
    b = hours.select("i", "j", (F.col("k") - 1).alias("k"), F.col("u").alias("ub"), F.col("v").alias("vb"))
    both = at.join(a.hint("merge"), ["i", "j", "k"]).join(b.hint("merge"), ["i", "j", "k"], "left")
    mix = lambda p, q: F.col(p) + F.col("w") * (F.coalesce(F.col(q), F.col(p)) - F.col(p))
    return both.select("i", "j", "t", mix("ua", "ub").alias("u"), mix("va", "vb").alias("v"), (F.col("t") > F.col("t1")).alias("extrapolated"))


def bilinear(points: DataFrame, nodes: DataFrame, lat0: float, lon0: float, step: float, n: int) -> DataFrame:
    """u and v at points (id, lat, lon) from an n x n grid of nodes (i, j, u, v); the edge is held outside."""
    y = F.least(F.greatest((F.col("lat") - lat0) / step, F.lit(0.0)), F.lit(float(n - 1)))
    x = F.least(F.greatest((F.col("lon") - lon0) / step, F.lit(0.0)), F.lit(float(n - 1)))
    at = points.withColumns({"y": y, "x": x})
    at = at.withColumns({"i0": F.least(F.floor("y"), F.lit(n - 2)), "j0": F.least(F.floor("x"), F.lit(n - 2))})
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    at = at.withColumn("c", corner).withColumns({"i": F.col("i0") + F.col("c.a"), "j": F.col("j0") + F.col("c.b")})
    wy, wx = F.col("y") - F.col("i0"), F.col("x") - F.col("j0")
    w = F.when(F.col("c.a") == 1, wy).otherwise(1 - wy) * F.when(F.col("c.b") == 1, wx).otherwise(1 - wx)
    return at.join(nodes, ["i", "j"]).groupBy("id").agg(F.sum(w * F.col("u")).alias("u"), F.sum(w * F.col("v")).alias("v"))


class Field(Protocol):
    """What moves particles: eastward and northward m/s at places, for arrays, and at one time or at times that broadcast against the places."""

    def velocity(self, lat: np.ndarray, lon: np.ndarray, t: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]: ...


def velocity_column(source: Field, lat: Column, lon: Column, t: Column) -> Column:
    """struct<u,v> of any field, by an Arrow UDF: for those, like Gridded, that no built-in expression gives. Rows of one time are taken together."""

    @F.pandas_udf("u double, v double")
    def run(lats: pd.Series, lons: pd.Series, times: pd.Series) -> pd.DataFrame:
        u, v = np.empty(len(lats)), np.empty(len(lats))
        for at in times.unique():
            on = (times == at).to_numpy()
            u[on], v[on] = source.velocity(lats[on].to_numpy(float), lons[on].to_numpy(float), float(at))
        return pd.DataFrame({"u": u, "v": v})

    return run(lat.cast("double"), lon.cast("double"), t.cast("double"))


@dataclass(frozen=True)
class Constant:
    """The same velocity everywhere, as columns and for arrays."""

    u: float = 0.0
    v: float = 0.0

    def to_column(self, lat: Column, lon: Column, t: Column) -> tuple[Column, Column]:
        return F.lit(self.u), F.lit(self.v)

    def velocity(self, lat: np.ndarray, lon: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
        return np.full_like(lat, self.u), np.full_like(lat, self.v)


@dataclass(frozen=True)
class Gyre:
    """A rotating eddy with a Gaussian envelope, a slow pulse, a background flow and a strain."""

    lat: float
    lon: float
    speed: float = 0.35
    length_km: float = 70.0
    period_s: float = 96 * 3600.0
    background: tuple[float, float] = (-0.08, -0.04)
    strain: float = 1e-5

    def to_column(self, lat: Column, lon: Column, t: Column) -> tuple[Column, Column]:
        dy, dx = (lat - self.lat) * 111.32, (lon - self.lon) * (111.32 * math.cos(math.radians(self.lat)))
        r = F.sqrt(dx * dx + dy * dy)
        safe = F.greatest(r, F.lit(1e-6))
        s = self.speed * F.exp(-(r * r) / (2 * self.length_km**2)) * (0.6 + 0.4 * F.sin(2 * math.pi * t / self.period_s))
        return s * (-dy / safe) + self.background[0] + self.strain * dx * 1000, s * (dx / safe) + self.background[1] - self.strain * dy * 1000

    def phase(self, t):
        """The time in the period: velocities of equal phases are the same, and smooth but at the eddy's middle, so that flow.Map may take the steps."""
        return t % self.period_s

    def velocity(self, lat: np.ndarray, lon: np.ndarray, t: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dy, dx = (lat - self.lat) * 111.32, (lon - self.lon) * (111.32 * math.cos(math.radians(self.lat)))
        r2 = dx * dx
        r2 += dy * dy
        r = np.maximum(np.sqrt(r2), 1e-6)
        r2 *= -1 / (2 * self.length_km**2)
        s = np.exp(r2) * (self.speed * (0.6 + 0.4 * np.sin(2 * math.pi * t / self.period_s)))
        s /= r
        v = s * dx
        s *= dy
        dx *= self.strain * 1000
        dx -= s
        dx += self.background[0]
        dy *= self.strain * 1000
        v -= dy
        v += self.background[1]
        return dx, v


@dataclass(frozen=True)
class Gridded:
    """A packed (time, lat, lon) field with regular axes: linear in time, bilinear in space.

    Time is held at both ends; space is held at the edge, or extrapolated if ``hold`` is false.
    """

    t0: float
    dt: float
    lat0: float
    lon0: float
    step: float
    u: np.ndarray
    v: np.ndarray
    hold: bool = True

    def velocity(self, lat: np.ndarray, lon: np.ndarray, t: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nt, ni, nj = self.u.shape
        x = np.clip((np.asarray(t, float) - self.t0) / self.dt, 0.0, nt - 1.0)
        k = np.clip(x.astype(int), 0, max(nt - 2, 0))
        w, after = x - k, np.minimum(k + 1, nt - 1)
        y, z = (lat - self.lat0) / self.step, (lon - self.lon0) / self.step
        if self.hold:
            y, z = np.clip(y, 0, ni - 1), np.clip(z, 0, nj - 1)
        i, j = np.clip(np.floor(y), 0, max(ni - 2, 0)).astype(int), np.clip(np.floor(z), 0, max(nj - 2, 0)).astype(int)
        wy, wz = y - i, z - j
        down, right = np.minimum(i + 1, ni - 1), np.minimum(j + 1, nj - 1)

        def at(f: np.ndarray) -> np.ndarray:
            g = (lambda a, b: f[k, a, b]) if nt == 1 else (lambda a, b: (1 - w) * f[k, a, b] + w * f[after, a, b])
            return (1 - wy) * ((1 - wz) * g(i, j) + wz * g(i, right)) + wy * ((1 - wz) * g(down, j) + wz * g(down, right))

        return at(self.u), at(self.v)


MAX_VALUES = 5_000_000


def pack(table: DataFrame, hold: bool = True) -> Gridded:
    """A table (t, lat, lon, u, v) of a regular grid as a field; axes may come in any order, null and NaN count as still.

    A field goes to every task, so one of over MAX_VALUES values is an error, as are places that lack and axes that aren't regular.
    """
    slim = table.select(*[F.col(c).cast("double") for c in ("t", "lat", "lon")], clean(F.col("u").cast("double")).alias("u"), clean(F.col("v").cast("double")).alias("v"))
    got = slim.limit(MAX_VALUES + 1).toPandas()
    if len(got) > MAX_VALUES:
        raise ValueError(f"a field of over {MAX_VALUES} values")
    axes = [np.unique(got[c]) for c in ("t", "lat", "lon")]
    if not len(got) or len(got) != np.prod([len(a) for a in axes]):
        raise ValueError("the table is no full grid")
    steps = [np.diff(a) for a in axes]
    if any(len(s) and not np.allclose(s, s[0], rtol=1e-6) for s in steps) or len(steps[1]) and len(steps[2]) and not np.isclose(steps[1][0], steps[2][0], rtol=1e-6):
        raise ValueError("the grid isn't regular")
    got = got.sort_values(["t", "lat", "lon"])
    u, v = (got[c].to_numpy().reshape([len(a) for a in axes]) for c in ("u", "v"))
    step = [float(s[0]) if len(s) else 1.0 for s in steps]
    return Gridded(float(axes[0][0]), step[0], float(axes[1][0]), float(axes[2][0]), step[1] if len(steps[1]) else step[2], u, v, hold)


def grid_points(min_lat: float, min_lon: float, max_lat: float, max_lon: float, side: int) -> list[tuple[float, float]]:
    """side x side points over a box, for one batched request."""
    return [(float(a), float(b)) for a in np.linspace(min_lat, max_lat, side) for b in np.linspace(min_lon, max_lon, side)]


def from_answers(points: list[tuple[float, float]], answers: list[dict]) -> list[tuple[float, float, float, float | None, float | None]]:
    """Rows (t, lat, lon, speed_kmh, direction_deg) of the answers to one batched request, one for each point in order; an error if the counts differ.

    An answer has equally long lists: times (epoch seconds), speeds and directions, where a missing value is None.
    """
    if len(points) != len(answers):
        raise ValueError(f"{len(points)} points were asked for, {len(answers)} came back")
    return [(float(t), lat, lon, s, d) for (lat, lon), a in zip(points, answers, strict=True) for t, s, d in zip(a["time"], a["speed"], a["direction"], strict=True)]
