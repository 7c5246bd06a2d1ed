"""MinHash near-duplicates by an inverted join over signature coordinates.

A signature has MINIMA minima of seeded hash functions over the shingles. Two documents of Jaccard
similarity J agree on each with the probability J; those that agree on LEAST or more are candidates (at
J = 0.8 there are 38 of 48 on average, sd 2.8; fewer than LEAST once in 10**6 pairs). Documents are posted under
coordinate-value pairs. Two that agree on LEAST of MINIMA coordinates also share one of the first
MINIMA - LEAST + 1 of each, in whatever order all pairs are ranked: so only these are posted, and the order
is from the rarest pair to the most frequent, that shared passages don't make long lists. The lists of this prefix are merged;
the longer lists behind it are skipped, and what candidates share in them is counted by looking it up in the
sketches. Every candidate is confirmed on the full shingle sets, so no pair below the threshold is linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlode.llm import collisions
from driftlode.llm.common import Scratch, bit_filter, bits_set, free_name, join_hot, materialize, slices, small_batches
from driftlode.llm.components import connected_components

MINIMA, LEAST = 48, 24
PREFIX = MINIMA - LEAST + 1
CHUNK = 2048
FREQUENT = 1 << 20  # pairs whose frequency is told to the tasks, at most
FEW = 1 << 20  # ids that are broadcast

_rng = np.random.default_rng(20240501)
_MUL = _rng.integers(0, 2**31, (MINIMA, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 2**32, (MINIMA, 1), dtype=np.uint32)
_PLACE = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input bears on every bit of the output."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_COORDINATE = mixed(np.arange(1, MINIMA + 1, dtype=np.uint64))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words of ``text``.

    A-Z is lower-cased; words are split at space and 0x09-0x0D. A text of fewer words is one
    shingle; a text without words has none.
    """
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, (text or "").encode("utf-8", "surrogatepass").lower().split()), np.uint64)
    if not len(hashes):
        return hashes
    k = min(words, len(hashes))
    n = len(hashes) - k + 1
    total = np.full(n, k, np.uint64)
    for i in range(k):
        total += hashes[i : i + n] * _PLACE[i]
        total = mixed(total) if i + 1 < k else total
    return np.unique(mixed(total))


def signature(shingles: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The coordinate-value pairs, hashed, and the sketch (the size, and a byte of each minimum) of a set that isn't empty."""
    low = np.full(MINIMA, 2**32 - 1, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    room = np.empty((MINIMA, min(CHUNK, len(short))), np.uint32)
    for i in range(0, len(short), CHUNK):
        part = short[None, i : i + CHUNK]
        values = np.multiply(part, _MUL, out=room[:, : part.shape[1]])
        values += _ADD
        np.minimum(low, values.min(axis=1), out=low)
    values = mixed(low.astype(np.uint64))
    return mixed(values + _COORDINATE).view(np.int64), collisions.sketch(len(shingles), values.astype(np.uint8))


def digest(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def _signed(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t.as_py(), words) for t in batch.column(1)]
            made = [signature(s) if len(s) else (None, None) for s in sets]
            columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) for s in sets], pa.binary()), pa.array([m[0] for m in made], pa.list_(pa.int64())), pa.array([m[1] for m in made], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_shingles", "digest", "pairs", "sketch"])

    return run


def _prefixed(frequent: np.ndarray, counts: np.ndarray):
    """The PREFIX rarest coordinate-value pairs of each item. Rarity is 0 for all pairs but the ``frequent`` ones; equals go by value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            pairs = batch.column(1).flatten().to_numpy().reshape(-1, MINIMA)
            at = np.minimum(np.searchsorted(frequent, pairs), max(len(frequent) - 1, 0))
            often = np.where(frequent[at] == pairs, counts[at], 0) if len(frequent) else np.zeros(pairs.shape, np.int64)
            order = np.lexsort((pairs, often), axis=1)[:, :PREFIX]
            flat = np.take_along_axis(pairs, order, axis=1).ravel()
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, PREFIX, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), listed, batch.column(2)], names=["node", "coords", "sketch"])

    return run


def _sets(words: int, wanted: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            batch = batch.filter(batch.column(0).is_valid())
            batch = batch.filter(pa.array(bits_set(wanted, batch.column(0).to_numpy())))
            sets = [shingle_set(t.as_py(), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "digest", "full"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of shingles;
    component_id is the smallest id reachable by links, kept says whether it is the own one.
    Null, empty and white-space texts have no shingles and no links. Rows of a null id are
    returned with a null component and kept. Repeated rows each come back. Rows of one id are one
    document for links: it has those of each of its texts, n_shingles is the row's own. An empty table
    gives an empty result; columns besides id and text aren't read.
    """
    scratch = Scratch()
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    signed = rows.mapInArrow(_signed(words), "id long, n_shingles long, digest binary, pairs array<long>, sketch binary")
    signed = scratch.keep(signed.withColumn("uid", F.monotonically_increasing_id()), "signed")
    good = signed.where("id is not null and digest is not null")
    # equal sets are one item, whose node is the smallest id that has the set
    same = scratch.keep(good.groupBy("digest").agg(F.min("id").alias("node"), F.min("uid").alias("uid"), F.count("*").alias("n")), "same")
    items = scratch.keep(signed.select("uid", "pairs", "sketch").join(same.select("uid", "node"), "uid").select("node", "pairs", "sketch"), "items")
    # at most FREQUENT pairs can be in more than this many of the items
    often = max(collisions.SMALL, same.count() * MINIMA // FREQUENT)
    frequent = items.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).where(F.col("n") > often).orderBy("pair").toPandas()
    posts = items.mapInArrow(_prefixed(frequent["pair"].to_numpy(np.int64), frequent["n"].to_numpy(np.int64)), "node long, coords array<long>, sketch binary")
    posts = scratch.keep(posts, "posts")

    def fetch(nodes: DataFrame) -> DataFrame:
        ends = scratch.keep(same.join(nodes, "node").select("node", "digest"), "nodes")
        there = rows.mapInArrow(_sets(words, bit_filter(ends, "node")), "node long, digest binary, full binary")
        return there.join(ends, ["node", "digest"], "left_semi").dropDuplicates(["node", "digest"]).select("node", "full")

    found = collisions.linked(posts, LEAST, percent, fetch, lambda full: [np.frombuffer(x, np.uint64) for x in full], scratch)
    # texts of one id join what each of them is linked with
    of = join_hot(good.select("id", "digest"), same.select("digest", "node", "n"), ["digest"], "n", good.count()).select("id", "node")
    twice = scratch.keep(of.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b"), "twice")
    if not twice.isEmpty():
        more = of.join(twice.select("id", "a"), "id").select("a", F.col("node").alias("b"))
        found = connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    told = same.join(found, "node", "left").select("digest", "n", F.coalesce("component", "node").alias("c"))
    linked = join_hot(good.select("id", "n_shingles", "digest"), scratch.keep(told, "told"), ["digest"], "n", good.count()).select("id", "n_shingles", "c")
    rest = signed.where("id is null or digest is null").select("id", "n_shingles", F.col("id").alias("c"))
    out = materialize(linked.union(_beside(rest, linked)), "components")
    scratch.drop()
    return out.select(F.col("id").alias(id_col), "n_shingles", F.col("c").alias("component_id"), F.coalesce(F.col("c") == F.col("id"), F.lit(True)).alias("kept"))


def _beside(rest: DataFrame, linked: DataFrame) -> DataFrame:
    """Rows without a set of their own have the component of their id's other rows, where there are any."""
    ids = rest.where("id is not null").select("id").distinct()
    other = linked.join(ids, "id", "left_semi").groupBy("id").agg(F.min("c").alias("own"))
    return rest.join(other, "id", "left").select("id", "n_shingles", F.coalesce("own", "c").alias("c"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those linked to a smaller id; all columns stay.

    Rows of a null id stay, as do null and empty texts. Repeated rows of one id stay or go together.
    An empty table stays empty.
    """
    gone = free_name(docs)
    lost = near_duplicates(docs, id_col, text_col, words, percent).where("not kept").select(F.col(id_col).alias(gone)).distinct()
    # few ids go to the documents: Spark guesses their number too high, and would shuffle all texts to meet them
    lost = F.broadcast(lost) if lost.count() <= FEW else lost
    return docs.join(lost, F.col(f"`{id_col}`") == F.col(gone), "left_anti")
