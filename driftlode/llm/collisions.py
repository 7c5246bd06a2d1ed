"""Inverted join over signature coordinates: which items agree on many of them.

Items are posted under the values of some coordinates of their signatures, and have a sketch (the size of
the set, 0 if unknown, in HEAD bytes, and a byte of each of many minima). A list first gives a star around its smallest item, which is that of most lists of a
group of copies. When those links have been confirmed and joined to components, only lists that hold several are
looked at again: up to ``SMALL`` items give all their pairs of different components, and of a longer list the items
outside its largest component are compared with the whole list, in blocks. A candidate pair goes on if
its sketches agree often enough and the sizes allow of the similarity; it is a link if the full sets are similar.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlode.llm.common import Scratch, bit_filter, bits_set, slices
from driftlode.llm.components import connected_components

SMALL, BLOCK = 24, 512
HEAD = 4  # bytes of a set's size, little-endian
PER_BUCKET = 1 << 19  # values that one group looks through
MOST_HELD = 1 << 21  # values of the sets that a task keeps, besides those of its last block


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column as one array of values and the n + 1 places where its lists begin and end."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])


def _dealt(buckets: int):
    """Values by bucket, as bytes; a value that an item or several have comes once from a batch, with a mark if several have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, n = np.unique(_flat(batch.column(0))[0], return_counts=True)
            bucket = ((values.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            values, n, bucket = values[order], n[order], bucket[order]
            cut = np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1, append=-1)) if len(bucket) else np.zeros(1, np.int64)
            parts = list(zip(cut[:-1], cut[1:], strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(bucket[a]) for a, _ in parts], pa.int64()), pa.array([values[a:b].tobytes() for a, b in parts], pa.binary()), pa.array([np.packbits(n[a:b] > 1).tobytes() for a, b in parts], pa.binary())],
                names=["bucket", "values", "several"],
            )

    return run


def _shared(table: pa.Table) -> pa.Table:
    """The values that more than one item has."""
    values, several = [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    for v, s in zip(table.column("values").to_pylist(), table.column("several").to_pylist(), strict=True):
        values.append(np.frombuffer(v, "<i8"))
        several.append(np.unpackbits(np.frombuffer(s, np.uint8), count=len(values[-1])).astype(bool))
    values, several = np.concatenate(values), np.concatenate(several)
    order = np.argsort(values, kind="stable")
    values, several = values[order], several[order]
    again = np.zeros(len(values), bool)
    again[1:] = values[1:] == values[:-1]
    return pa.table({"key": pa.array(np.unique(values[again | several]))})


def _hits(bits: np.ndarray):
    """(key, node) for the values that the bitmap lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, cuts = _flat(batch.column(1))
            on = bits_set(bits, values.copy())
            nodes = np.repeat(batch.column(0).to_numpy(), np.diff(cuts))
            yield pa.RecordBatch.from_arrays([pa.array(values[on]), pa.array(nodes[on])], names=["key", "node"])

    return run


def _posted(items: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, node, n, pivot) for the posting lists of two items or more.

    Most values are one item's alone. Which are not is found from the values packed by bucket, so that a
    row of the shuffle has many of them, and a frequent one once for a batch; only those that others have
    too become rows.
    """
    total = items.agg(F.coalesce(F.sum(F.size("coords")), F.lit(0))).first()[0]
    buckets = max(8, -(-total // PER_BUCKET))
    packed = items.select("coords").mapInArrow(_dealt(buckets), "bucket long, values binary, several binary")
    shared = scratch.keep(packed.groupBy("bucket").applyInArrow(_shared, "key long"), "shared")
    posts = scratch.keep(items.select("node", "coords").mapInArrow(_hits(bit_filter(shared, "key")), "key long, node long"), "posts")
    lists = posts.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where("n > 1")
    return posts.join(lists, "key").select("key", "node", "n", "pivot")


def sketch(size: int, minima: np.ndarray) -> bytes:
    return min(size, 2**32 - 1).to_bytes(HEAD, "little") + minima.tobytes()


def _sketches(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sizes of the sets, and the minima."""
    both = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return np.ascontiguousarray(both[:, :HEAD]).view("<u4").ravel().astype(np.int64), both[:, HEAD:]


def _alike(x: tuple, y: tuple, least: int, percent: int) -> np.ndarray:
    """Whether minima agree ``least`` times or more, and sizes are near enough: of sets of a similarity of j, none is smaller than j times the other."""
    (m, a), (n, b) = x, y
    near = (100 * np.minimum(m, n) >= percent * np.maximum(m, n)) | (np.minimum(m, n) == 0) | (np.maximum(m, n) == 2**32 - 1)
    return ((a == b).sum(axis=1) >= least) & near


def _often(least: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.select([0, 1]).filter(pa.array(_alike(_sketches(batch.column(2)), _sketches(batch.column(3)), least, percent)))

    return run


def _agree(pairs: DataFrame, items: DataFrame, least: int, percent: int) -> DataFrame:
    """Pairs whose sketches allow of a link."""
    left, right = (items.select(F.col("node").alias(c), F.col("sketch").alias(f"{c}_sketch")) for c in ("a", "b"))
    both = pairs.join(left, "a").repartition(F.col("b")).join(right, "b")
    return both.select("a", "b", "a_sketch", "b_sketch").mapInArrow(_often(least, percent), "a long, b long")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted arrays of distinct values share."""
    both = np.concatenate([x, y])
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _similar(percent: int, shingles: Callable[[list], list[np.ndarray]]):
    """Pairs of similar full sets. What several pairs of a batch have is made a set once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            full = batch.column(2).to_pylist() + batch.column(3).to_pylist()
            known: dict = {}
            place = [known.setdefault(x, k) for k, x in enumerate(full)]
            own = sorted(set(place))
            sets = dict(zip(own, shingles([full[k] for k in own]), strict=True))
            keep, n = [], batch.num_rows
            for x, y in zip((sets[k] for k in place[:n]), (sets[k] for k in place[n:]), strict=True):
                common = _common(x, y)
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _confirmed(pairs: DataFrame, full: DataFrame, percent: int, shingles: Callable) -> DataFrame:
    left, right = (full.select(F.col("node").alias(c), F.col("full").alias(f"{c}_full")) for c in ("a", "b"))
    both = pairs.join(left, "a").repartition(F.col("b")).join(right, "b")
    return both.select("a", "b", "a_full", "b_full").mapInArrow(_similar(percent, shingles), "a long, b long")


def _blocks(rows: DataFrame) -> DataFrame:
    """(key, i, j, left, ...): the rows of each list outside its largest component, in blocks, beside each block of the list."""
    sizes = rows.groupBy("key", "c").agg(F.count("*").alias("size"))
    lists = sizes.groupBy("key").agg(F.sum("size").alias("n"), F.max(F.struct("size", F.col("c").alias("major"))).alias("most"))
    lists = lists.where("n > most.size").select("key", F.col("most.major").alias("major"), F.ceil(F.col("n") / BLOCK).cast("int").alias("all"), F.ceil((F.col("n") - F.col("most.size")) / BLOCK).cast("int").alias("odd"))
    both = rows.join(lists, "key")
    column = [c for c in rows.columns if c != "key"]
    own = lambda m, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(m)).cast("int")
    right = both.select("key", F.explode(F.sequence(F.lit(0), F.col("odd") - 1)).alias("i"), own("all", 1).alias("j"), F.lit(False).alias("left"), *column)
    left = both.where("c <> major").select("key", own("odd", 2).alias("i"), F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("j"), F.lit(True).alias("left"), *column)
    return right.union(left)


def _like(least: int, percent: int):
    """The nodes of a pair of blocks that agree often enough with one of another component."""

    def run(table: pa.Table) -> pa.Table:
        node, group, left = (table.column(c).to_numpy() for c in ("node", "c", "left"))
        (size, low), on = _sketches(table.column("sketch").combine_chunks()), np.zeros(len(node), bool)
        a, b = np.flatnonzero(left), np.flatnonzero(~left)
        for x in a:
            own = b[group[b] != group[x]]
            own = own[_alike((size[own], low[own]), (size[x], low[x]), least, percent)]
            on[own] = True
            on[x] |= len(own) > 0
        key = table.column("key")[0].as_py()
        found = np.unique(node[on])
        return pa.table({"key": pa.array(np.full(len(found), key, np.int64)), "node": pa.array(found)})

    return run


def _compared(least: int, percent: int, shingles: Callable[[list], list[np.ndarray]]):
    """Links between the items of two blocks; only those that join what wasn't joined before. What several blocks of a task have is made a set once, while there is room."""
    known: dict = {}
    held = 0

    def sets_of(full: list) -> list[np.ndarray]:
        nonlocal held
        new = list({x for x in full if x not in known})
        made = dict(zip(new, shingles(new), strict=True))
        sets = [known[x] if x in known else made[x] for x in full]
        if held > MOST_HELD:
            known.clear()
            held = 0
        known.update(made)
        held += sum(map(len, made.values()))
        return sets

    def run(table: pa.Table) -> pa.Table:
        node, group, side = (table.column(c).to_numpy().copy() for c in ("node", "c", "left"))
        (size, low), out = _sketches(table.column("sketch").combine_chunks()), []
        sets = sets_of(table.column("full").to_pylist())
        right = np.flatnonzero(~side)
        for x in np.flatnonzero(side):
            own = right[group[right] != group[x]]
            for y in own[_alike((size[own], low[own]), (size[x], low[x]), least, percent)]:
                if group[x] == group[y]:
                    continue
                common = _common(sets[x], sets[y])
                if 100 * common >= percent * (len(sets[x]) + len(sets[y]) - common):
                    out.append((min(int(node[x]), int(node[y])), max(int(node[x]), int(node[y]))))
                    group[group == group[y]] = group[x]
        return pa.table({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})

    return run


def linked(items: DataFrame, least: int, percent: int, fetch: Callable[[DataFrame], DataFrame], shingles: Callable[[list], list[np.ndarray]], scratch: Scratch) -> DataFrame:
    """(node, component) for the ``items`` (node long, coords array<long>, sketch binary) that have links.

    A pair is a candidate if it shares a value of coords and its sketches agree in ``least``
    places. ``fetch`` gives (node, full) for a table of nodes, and ``shingles`` makes of a list of such full
    values sorted arrays of distinct values; a link is a candidate of a Jaccard similarity of ``percent`` or more.
    A node may have several items; it has the links of each of them.
    """
    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("node"))
    posted = scratch.keep(_posted(items, scratch), "posted")
    stars = posted.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    pairs = scratch.keep(_agree(stars, items, least, percent), "pairs")
    full = scratch.keep(fetch(ends(pairs).distinct()), "full")
    links = scratch.keep(_confirmed(pairs, full, percent, shingles), "links")
    scratch.drop(full)
    found = scratch.keep(connected_components(links), "found")
    # lists that hold several components
    rows = scratch.keep(posted.join(found, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("c")), "rows")
    split = rows.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("key")
    rows = scratch.keep(rows.join(split, "key"), "mixed")
    scratch.drop(posted)
    few = rows.where(F.col("n") <= SMALL)
    a, b = (few.select("key", F.col("node").alias(x), F.col("c").alias(f"{x}_c")) for x in ("a", "b"))
    pairs = scratch.keep(_agree(a.join(b, "key").where("a < b and a_c <> b_c").select("a", "b").distinct(), items, least, percent), "pairs")
    # a node meets its sketch, and then its full set, once, not once for each of its lists
    of = lambda posts: posts.groupBy("node").agg(F.collect_set("key").alias("keys"))
    each = lambda nodes: nodes.select(F.explode("keys").alias("key"), *[c for c in nodes.columns if c != "keys"])
    long = rows.where(F.col("n") > SMALL).groupBy("node").agg(F.min("c").alias("c"), F.collect_set("key").alias("keys"))
    long = scratch.keep(long.join(items.select("node", "sketch"), "node"), "long")
    # first the sketches are compared; the full sets are fetched for the items that have a candidate
    like = scratch.keep(_blocks(each(long)).groupBy("key", "i", "j").applyInArrow(_like(least, percent), "key long, node long").distinct(), "like")
    wanted = scratch.keep(ends(pairs).union(like.select("node")).distinct(), "wanted")
    if wanted.isEmpty():
        return found
    full = scratch.keep(fetch(wanted), "full")
    rest = _blocks(each(long.drop("keys").join(of(like), "node").join(full, "node"))).groupBy("key", "i", "j").applyInArrow(_compared(least, percent, shingles), "a long, b long")
    more = scratch.keep(_confirmed(pairs, full, percent, shingles).union(rest), "links")
    return connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
