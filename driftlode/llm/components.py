"""Distributed union-find: connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlode.llm.common import drop_files, materialize


def union_find(pairs) -> dict:
    """node -> smallest node of its component, for an iterable of pairs."""
    parent: dict = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of each batch by stars; never more rows than came in."""
    for batch in batches:
        found = union_find(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        rows = [(n, r) for n, r in found.items() if n != r]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], batch.schema.field(0).type) for i in (0, 1)], names=["u", "v"])


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """Columns (node, component) for every node of ``edges``: the smallest node reachable.

    Alternates a large-star and a small-star step. Each is a grouped minimum and a join, so no
    group is ever gathered: a hub with very many edges is a partial aggregate and a join that
    Spark may split. The edge table is written after each round. Null ends and loops count as no
    edge; an empty table gives an empty result.
    """
    kind = edges.schema[src].dataType.simpleString()
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    e = materialize(e.mapInArrow(_contract, f"u {kind}, v {kind}").distinct(), "cc")
    state = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = materialize(small.select("e.u", "e.v").where("u <> v").distinct(), "cc")
        seen = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        drop_files(e)
        e = now
        if tuple(seen) == state:
            break
        state = tuple(seen)
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
