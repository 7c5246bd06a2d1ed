"""Near-duplicate embeddings by an epsilon grid order join.

Unit vectors with a cosine of c lie sqrt(2 - 2c) = eps apart. They are sorted by the cells of a grid of
half that width on the leading principal axes. The order is cut into parts and these into blocks; blocks
whose boxes on BOX axes are further apart than eps are never joined. Two parts meet in one task, which gets only
the blocks that have a partner there, each once. There the sorted intervals are halved again and again, and
halves that are provably distant are skipped; what is left is compared in double precision.

How much is skipped depends on the vectors: where they lie in clusters most of it, where their spread is the same in
all of many directions little, as no box of such vectors is far from another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlode.llm.common import Scratch, join_hot, materialize, slices
from driftlode.llm.components import connected_components

AXES, BOX, MET, BLOCK, LEAF = 6, 16, 3, 512, 128  # axes of the order, of the boxes, and of the join of boxes
PART_BYTES = 1 << 22  # of the vectors of a part


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, digest and the vector's bytes (doubles); nulls where nothing can be linked."""
    for batch in slices(batches, 4096):
        digests, data = [], []
        for v in batch.column(1).to_pylist():
            x = None if v is None or None in v else np.array(v, "<f8")
            ok = x is not None and len(x) and np.isfinite(x).all() and x.any()
            data.append((x + 0.0).tobytes() if ok else None)
            digests.append(xxhash.xxh3_128_digest(data[-1]) if ok else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(data, pa.binary())], names=["id", "digest", "v"])


def _units(column, dim: int) -> np.ndarray:
    """Unit vectors; shorter ones are padded with zeros."""
    out = np.zeros((len(column), dim))
    for i, b in enumerate(column):
        x = np.frombuffer(b, "<f8")
        x = x / np.abs(x).max()
        out[i, : len(x)] = x / np.sqrt(x @ x)
    return out


def _moments(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim * dim + dim + 1)
        for batch in batches:
            u = _units(batch.column(0).to_pylist(), dim)
            total += np.concatenate([(u.T @ u).ravel(), u.sum(axis=0), [len(u)]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["k", "x"])

    return run


def _located(dim: int, mean: np.ndarray, axes: np.ndarray, eps: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.floor((_units(batch.column(2).to_pylist(), dim) - mean) @ axes[:, :AXES] / (eps / 2)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *(pa.array(np.ascontiguousarray(cells[:, k])) for k in range(AXES))], names=["node", "n", "v", *(f"c{k}" for k in range(AXES))])

    return run


def _blocked(dim: int, mean: np.ndarray, axes: np.ndarray):
    """Rows in order to blocks: their nodes, copies and vectors as bytes, and the box on the axes."""

    def block(rows: list) -> pa.RecordBatch:
        u = _units([r[2] for r in rows], dim)
        y = (u - mean) @ axes
        node, n = np.array([r[0] for r in rows], "<i8"), np.array([r[1] for r in rows], "<i8")
        columns = [pa.array([x.tobytes()], pa.binary()) for x in (node, n, u)] + [pa.array([list(y.min(axis=0))], pa.list_(pa.float64())), pa.array([list(y.max(axis=0))], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, names=["nodes", "copies", "units", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        for batch in batches:
            rows += zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            while len(rows) >= BLOCK:
                yield block(rows[:BLOCK])
                rows = rows[BLOCK:]
        if rows:
            yield block(rows)

    return run


def _distant(a: np.ndarray, b: np.ndarray, eps: float) -> bool:
    gap = np.maximum(np.maximum(a.min(axis=0) - b.max(axis=0), b.min(axis=0) - a.max(axis=0)), 0)
    return float(gap @ gap) > eps * eps


def _joined(dim: int, mean: np.ndarray, axes: np.ndarray, eps: float, cosine: float):
    """The links of two parts: (kind, x, y), where kind is 0 for a node and its links, 1 for an edge, 2 for pairs compared and skipped."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["block", "nodes", "copies", "units", "mates"]).to_pylist(), key=lambda r: r["block"])
        node, copies = (np.concatenate([np.frombuffer(r[c], "<i8") for r in rows]) for c in ("nodes", "copies"))
        u = np.concatenate([np.frombuffer(r["units"], "<f8").reshape(-1, dim) for r in rows])
        y = (u - mean) @ axes
        cuts = np.cumsum([0] + [len(r["nodes"]) // 8 for r in rows])
        span = {r["block"]: (int(a), int(b)) for r, a, b in zip(rows, cuts[:-1], cuts[1:], strict=True)}
        links, group, edges, done = np.zeros(len(node), np.int64), np.arange(len(node)), [], [0, 0]

        def join(a: int, b: int, c: int, d: int) -> None:
            """Intervals [a, b) and [c, d); the same one, or the first before the second."""
            n = (b - a) * (b - a - 1) // 2 if a == c else (b - a) * (d - c)
            if _distant(y[a:b], y[c:d], eps):
                done[1] += n
                return
            if b - a <= LEAF and d - c <= LEAF:
                done[0] += n
                near = u[a:b] @ u[c:d].T >= cosine
                if a == c:
                    near = np.triu(near, 1)
                links[a:b] += near @ copies[c:d]
                links[c:d] += near.T @ copies[a:b]
                for x in np.flatnonzero(near.any(axis=1)):
                    for z in np.flatnonzero(near[x] & (group[c:d] != group[a + x])):
                        if group[a + x] != group[c + z]:
                            edges.append((node[a + x], node[c + z]))
                            group[group == group[c + z]] = group[a + x]
                return
            m, n = (a + b) // 2, (c + d) // 2
            if a == c:
                join(a, m, a, m)
                join(m, b, m, b)
                join(a, m, m, b)
            elif b - a >= d - c:
                join(a, m, c, d)
                join(m, b, c, d)
            else:
                join(a, b, c, n)
                join(a, b, n, d)

        for r in rows:
            for mate in r["mates"] or []:
                join(*span[r["block"]], *span[mate])
        on = np.flatnonzero(links)
        x = np.concatenate([node[on], np.array([e[0] for e in edges], np.int64), done[:1]])
        z = np.concatenate([links[on], np.array([e[1] for e in edges], np.int64), done[1:]])
        return pa.table({"kind": pa.array(np.repeat(np.arange(3, dtype=np.int32), [len(on), len(edges), 1])), "x": pa.array(x), "y": pa.array(z)})

    return run


def _meeting(blocks: DataFrame, eps: float) -> DataFrame:
    """(a, b, part_a, part_b): the pairs of blocks, a <= b, whose boxes are within eps. Boxes meet by the cells of their first MET axes."""
    box = blocks.select("block", "part", "low", "high")
    cell = lambda c, k: F.floor(F.get(c, F.lit(k)) / eps)

    def spread(name: str, margin: int) -> DataFrame:
        out = box.select(F.col("block").alias(name), F.col("part").alias(f"part_{name}"), F.col("low").alias(f"{name}l"), F.col("high").alias(f"{name}h"))
        for k in range(MET):
            out = out.withColumn(f"cell{k}", F.explode(F.sequence(cell(f"{name}l", k) - margin, cell(f"{name}h", k) + margin)))
        return out

    gap = F.aggregate(F.zip_with(F.zip_with("al", "bh", lambda x, y: x - y), F.zip_with("bl", "ah", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0))), F.lit(0.0), lambda s, g: s + g * g)
    met = spread("a", 1).join(spread("b", 0), [f"cell{k}" for k in range(MET)]).where("a <= b").where(gap <= eps * eps)
    return met.select("a", "b", "part_a", "part_b").distinct()


def near_embeddings(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.95, told: dict | None = None) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors of a cosine >= ``cosine`` are linked. Null, empty and zero vectors and those with null or
    non-finite components have no link. Vectors of different lengths are compared as if padded with
    zeros. Equal vectors are joined first and counted with their number of copies. Rows of a null id come
    back with a null component and kept; rows that repeat an id each count as a vector. An empty table
    gives an empty result. ``told`` gets the numbers of distinct vectors and of pairs of them compared.
    """
    scratch = Scratch()
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    usable = scratch.keep(rows.mapInArrow(_usable, "id long, digest binary, v binary"), "vectors")
    good = usable.where("id is not null and digest is not null")
    same = good.groupBy("digest").agg(F.min("id").alias("low"), F.count("*").alias("n"), F.first("v").alias("v"))
    same = scratch.keep(same.withColumn("node", F.monotonically_increasing_id()), "same")
    size = same.agg(F.max(F.octet_length("v")), F.count("*"), F.sum("n")).first()
    if not size[1]:
        return vectors.select(F.col(f"`{id_col}`").cast("long").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col(f"`{id_col}`").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    dim, eps = size[0] // 8, float(np.sqrt(2 - 2 * cosine)) + 1e-7
    own = same.select("node", "n", "v")
    sums = np.zeros(dim * dim + dim + 1)
    for k, x in own.select("v").mapInArrow(_moments(dim), "k long, x double").groupBy("k").agg(F.sum("x")).collect():  # as many as the squared dimension
        sums[k] = x
    mean = sums[dim * dim : -1] / sums[-1]
    axes = np.linalg.eigh(sums[: dim * dim].reshape(dim, dim) / sums[-1] - np.outer(mean, mean))[1][:, ::-1][:, :BOX]
    axes = np.pad(axes, ((0, 0), (0, BOX - axes.shape[1])))
    cells = [f"c{k}" for k in range(AXES)]
    located = own.mapInArrow(_located(dim, mean, axes, eps), "node long, n long, v binary, " + ", ".join(f"{c} int" for c in cells))
    ordered = located.repartitionByRange(max(1, -(-size[1] * dim * 8 // PART_BYTES)), *cells, "node").sortWithinPartitions(*cells, "node")
    blocks = ordered.mapInArrow(_blocked(dim, mean, axes), "nodes binary, copies binary, units binary, low array<double>, high array<double>")
    blocks = scratch.keep(blocks.withColumn("block", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()), "blocks")
    pairs = scratch.keep(_meeting(blocks, eps), "pairs")
    lead = pairs.groupBy("part_a", "part_b", F.col("a").alias("block")).agg(F.collect_list("b").alias("mates"))  # the blocks of one part at most
    other = pairs.select("part_a", "part_b", F.col("b").alias("block"), F.lit(None).cast("array<long>").alias("mates"))
    ends = lead.union(other).groupBy("part_a", "part_b", "block").agg(F.max("mates").alias("mates"))
    met = ends.join(blocks.select("block", "nodes", "copies", "units"), "block").groupBy("part_a", "part_b").applyInArrow(_joined(dim, mean, axes, eps, cosine), "kind int, x long, y long")
    met = scratch.keep(met, "met")
    if told is not None:
        told |= {"vectors": size[1], "compared": met.where("kind = 2").agg(F.sum("x")).first()[0]}
    found = connected_components(met.where("kind = 1").select(F.col("x").alias("a"), F.col("y").alias("b")))
    links = met.where("kind = 0").groupBy(F.col("x").alias("node")).agg(F.sum("y").alias("links"))
    ours = same.join(links, "node", "left").join(found, "node", "left").select("digest", "low", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("c"))
    ours = scratch.keep(ours, "ours")
    labels = ours.groupBy("c").agg(F.min("low").alias("label"), F.count("*").alias("size"))
    ours = scratch.keep(join_hot(ours.drop("low"), labels, ["c"], "size", size[1]).select("digest", "n", "n_links", F.col("label").alias("c")), "labelled")
    linked = join_hot(good.select("id", "digest"), ours, ["digest"], "n", size[2]).select("id", "n_links", "c")
    out = materialize(linked.union(usable.where("id is null or digest is null").select("id", F.lit(0).cast("long"), "id")), "links")
    scratch.drop()
    return out.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), F.col("c").alias("component_id"), F.coalesce(F.col("c") == F.col("id"), F.lit(True)).alias("kept"))
