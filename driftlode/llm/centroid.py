"""Subtree totals of a forest by centroid decomposition.

Nodes carry an interval of labels (``start`` to ``stop``, exclusive; those below a node lie within it, siblings are disjoint), a depth, and an
own weight above 0, whose sum over a subtree is ``weight``. A component has as centroid the lowest node with half of its
weight below it: the total of what lies below the centroid within the component is added along the path from the centroid to the
component's top, the centroid goes, and what was below and the rest are components of their own. Where no node has half, the
component is of several light trees and is split at the middle of its labels, the tree that lies across it by itself.
So each round halves the weight or the range of labels of every component, however deep or wide the forest.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlode.llm.common import Scratch

SMALL = 20_000  # nodes of a component that one task finishes
FEW = 64  # nodes whose totals are taken from all ancestors at once
MOST_SENT = 10_000  # components whose centroids are broadcast


def totals(start: np.ndarray, stop: np.ndarray, depth: np.ndarray, own: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Subtree totals of each of the ``values`` (a row for each value), of nodes that are held in memory."""
    out = values.copy()
    weight = np.zeros(len(start), np.int64)
    # the weights within what is given: a node's labels come before those below it, in order of start and depth
    order = np.lexsort((depth, start))
    ahead = np.concatenate([[0], np.cumsum(own[order])])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    weight = ahead[np.searchsorted(start[order], stop, "left")] - ahead[rank]
    todo = [np.arange(len(start))]
    while todo:
        own_ids = todo.pop()
        a, b, d = start[own_ids], stop[own_ids], depth[own_ids]
        if len(own_ids) <= FEW:
            below = (a[:, None] <= a) & (b[:, None] >= b) & (d[:, None] < d)
            out[:, own_ids] += values[:, own_ids] @ below.T
            continue
        half = np.flatnonzero(2 * weight[own_ids] >= own[own_ids].sum())
        if len(half):
            c = half[np.lexsort((-d[half], weight[own_ids][half]))[0]]
            below = (a >= a[c]) & (b <= b[c]) & (d > d[c])
            path = (a <= a[c]) & (b >= b[c]) & (d < d[c])
            under = values[:, own_ids[below]].sum(axis=1)
            out[:, own_ids[c]] += under
            out[:, own_ids[path]] += (under + values[:, own_ids[c]])[:, None]
            weight[own_ids[path]] -= weight[own_ids[c]]
            rest = ~below
            rest[c] = False
            todo += [own_ids[m] for m in (below, rest) if m.any()]
        else:
            middle = (a.min() + b.max()) // 2
            across = np.flatnonzero((a <= middle) & (b > middle))
            cut, end = middle + 1, middle + 1
            if len(across):
                top = across[np.argmin(d[across])]
                cut, end = a[top], b[top]
            left, right = a < cut, a >= end
            todo += [own_ids[m] for m in (left, right, ~left & ~right) if m.any()]
    return out


def _finish(values: list[str]):
    """The totals of a component that fits into a task."""

    def run(table: pa.Table) -> pa.Table:
        col = lambda c: table.column(c).to_numpy()
        got = totals(*(col(c) for c in ("start", "stop", "depth", "own")), np.stack([col(v) for v in values]))
        for i, v in enumerate(values):
            at = table.column_names.index(f"sum_{v}")
            table = table.set_column(at, f"sum_{v}", pa.array(col(f"sum_{v}") + got[i] - col(v)))
        return table.select(["node", *(f"sum_{v}" for v in values)])

    return run


def rollup(nodes: DataFrame, values: list[str], scratch: Scratch, small: int = SMALL) -> DataFrame:
    """(node, sum_<value> ...): the totals of long columns over each node's subtree, itself included.

    ``nodes`` has node (of any type, once each), start, stop, depth, own, weight and the values, all long.
    Every round is grouped sums and one join with a row for each component.
    """
    sums = [f"sum_{v}" for v in values]
    kind = f"node {nodes.schema['node'].dataType.simpleString()}, " + ", ".join(f"{s} long" for s in sums)
    now = nodes.select("node", "start", "stop", "depth", "own", "weight", *values, *(F.col(v).alias(s) for v, s in zip(values, sums, strict=True)), F.lit("0").alias("comp"))
    now = scratch.keep(now, "component")
    done = []
    while True:
        sizes = scratch.keep(now.groupBy("comp").agg(F.count("*").alias("n"), F.sum("own").alias("all"), F.floor((F.min("start") + F.max("stop")) / 2).alias("middle")), "sizes")
        n_comps, n_large = sizes.agg(F.count("*"), F.count_if(F.col("n") > small)).first()
        few = lambda df, n: F.broadcast(df) if n <= MOST_SENT else df
        if n_comps - n_large:
            mine = now.join(few(sizes.where(F.col("n") <= small).select("comp"), n_comps - n_large), "comp")
            done.append(scratch.keep(mine.groupBy("comp").applyInArrow(_finish(values), kind), "done"))
        if not n_large:
            break
        rows = now.join(few(sizes.where(F.col("n") > small), n_large), "comp")
        half = F.col("weight") * 2 >= F.col("all")
        place = F.struct("start", "stop", "depth", "weight", "node")
        across = (F.col("start") <= F.col("middle")) & (F.col("stop") > F.col("middle"))
        cuts = rows.groupBy("comp").agg(
            F.min_by(F.when(half, place), F.when(half, F.struct("weight", -F.col("depth"), "start"))).alias("c"),
            F.min_by(F.when(across, place), F.when(across, F.col("depth"))).alias("t"),
            F.first("middle").alias("middle"),
        )
        below = (F.col("start") >= F.col("c.start")) & (F.col("stop") <= F.col("c.stop")) & (F.col("depth") >= F.col("c.depth"))
        cuts = scratch.keep(cuts, "cuts")
        rows = now.join(few(cuts, n_large), "comp")
        under = rows.where("c is not null").where(below).groupBy("comp").agg(*(F.sum(v).alias(f"under_{v}") for v in values))
        under = scratch.keep(under, "under")
        rows = rows.join(few(under, n_large), "comp", "left")
        path = (F.col("start") <= F.col("c.start")) & (F.col("stop") >= F.col("c.stop")) & (F.col("depth") <= F.col("c.depth"))
        at = below & path  # the centroid itself
        on = F.coalesce(path, F.lit(False))
        told = [F.when(at, F.col(f"under_{v}") + F.col(s) - F.col(v)).when(on, F.col(s) + F.col(f"under_{v}")).otherwise(F.col(s)).alias(s) for v, s in zip(values, sums, strict=True)]
        cut, end = F.coalesce("t.start", F.col("middle") + 1), F.coalesce("t.stop", F.col("middle") + 1)
        piece = F.when(F.col("c").isNotNull(), F.when(at, None).when(below, F.lit("1")).otherwise(F.lit("0"))).when(F.col("start") < cut, F.lit("2")).when(F.col("start") >= end, F.lit("3")).otherwise(F.lit("4"))
        weight = F.when(on & ~at, F.col("weight") - F.col("c.weight")).otherwise(F.col("weight"))
        after = scratch.keep(rows.select("node", "start", "stop", "depth", "own", weight.alias("weight"), *values, *told, F.concat("comp", piece).alias("comp")), "component")
        done.append(after.where("comp is null").select("node", *sums))
        now = after.where("comp is not null")
    empty = now.sparkSession.createDataFrame([], kind)
    return reduce(DataFrame.unionByName, done, empty)
