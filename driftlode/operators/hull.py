"""Convex hulls of groups of any size: hulls of what a task has, and then hulls of those."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlode.functions.geo import convex_hull

FEW = 8
RING = "array<struct<x:double,y:double>>"


def _least(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The points that a hull of them and of any others can need: the hull's vertices, or the ends of a line."""
    hull = convex_hull(x, y)
    if hull is not None:
        return hull
    points = np.unique(np.column_stack([x, y]), axis=0)
    return points[[0, -1]] if len(points) > 1 else points


def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each batch (k, x, y) the points that a group's hull can need, and the number of all on its first row."""
    for frame in frames:
        codes, _ = pd.factorize(frame["k"], use_na_sentinel=False)
        order = np.argsort(codes, kind="stable")
        at = np.column_stack([frame["x"], frame["y"]])[order]
        ends = np.append(np.flatnonzero(np.diff(codes[order])) + 1, len(order))
        firsts = np.append(0, ends[:-1])
        # few points are passed on as they are: a hull would spare less than it costs
        kept = [at[a:b] if b - a <= FEW else _least(*at[a:b].T) for a, b in zip(firsts.tolist(), ends.tolist(), strict=True) if b > a]
        if kept:
            sizes = np.array([len(p) for p in kept])
            n = np.zeros(sizes.sum(), np.int64)
            n[np.cumsum(sizes) - sizes] = ends - firsts
            x, y = np.vstack(kept).T
            yield pd.DataFrame({"k": frame["k"].to_numpy()[np.repeat(order[firsts], sizes)], "x": x, "y": y, "n": n}).astype({"k": frame["k"].dtype})


def hulls(points: DataFrame, key: str, x: str = "x", y: str = "y") -> DataFrame:
    """(key, n, ring): how many points a group has, and its hull, counter-clockwise; null for fewer than three points or points in a line.

    A task keeps for each group only the vertices of the hull of what it has seen in a batch; a group's points never meet in one task, only the
    vertices of its partial hulls do. Points with a null or NaN count for nothing; a null key is a group.
    """
    kind = points.schema[key].dataType.simpleString()

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        hull = convex_hull(frame["x"].to_numpy(), frame["y"].to_numpy())
        ring = None if hull is None else [{"x": float(a), "y": float(b)} for a, b in hull]
        return pd.DataFrame({"k": frame["k"].iloc[:1], "n": [int(frame["n"].sum())], "ring": [ring]})

    slim = points.select(F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    some = slim.mapInPandas(partial, f"k {kind}, x double, y double, n long")
    return some.groupBy("k").applyInPandas(whole, f"k {kind}, n long, ring {RING}").withColumnRenamed("k", key)
