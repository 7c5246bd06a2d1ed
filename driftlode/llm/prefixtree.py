"""The prefix trie of conversations, with totals of its subtrees by centroid decomposition.

A node is a distinct sequence of first turns. Every turn is a hash of role and text with its place; the exclusive or of those up to a
turn, 128 bits, names the node that the turn leads to, so that nodes are one grouped count. Nodes with the same
members follow each other without a branch, and are one link of a shorter tree, of at most twice as many links as there are distinct
conversations; whatever depth conversations have, only those links are rolled up (``centroid.py``), and a node's totals
follow from its link's and the bytes along the path. Running values within a conversation, among siblings and over labels come from
``scan.py``, so that no conversation, node or group of copies has to fit into a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlode.llm.centroid import SMALL, rollup
from driftlode.llm.common import Scratch, batches_of, materialize
from driftlode.llm.scan import changes, parts_of, running

NODE = ["k1", "k2"]
CHUNK = 4096  # ids of a conversation list that are put into one string
NO_IDS = hashlib.sha256(b"").hexdigest()
PIECE = "k1 long, k2 long, first long, ids binary, whole boolean"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Comma-joined ids of each node, in pieces; ``whole`` where a node's ids are surely all in the one piece.

    Rows come by node and id. Of the first and last node of a partition other partitions may have more.
    """
    held: tuple | None = None  # the node whose ids are being gathered, its first id, the ids, whether all are here
    opened, out = False, []

    def put(whole: bool) -> None:
        out.append((*held[0], held[1], ",".join(map(str, held[2])).encode(), whole))

    for batch in batches:
        k1, k2, conv = (c.to_numpy() for c in batch.columns)
        if not len(conv):
            continue
        at = np.flatnonzero(changes([k1, k2]))
        for a, b in zip(at, [*at[1:], len(conv)], strict=True):
            node, mine = (int(k1[a]), int(k2[a])), conv[a:b].tolist()
            if held is None or held[0] != node:
                if held is not None:
                    put(held[3])
                held = (node, mine[0], [], opened)
                opened = True
            for x in range(0, len(mine), CHUNK):
                if len(held[2]) + CHUNK > 2 * CHUNK:
                    put(False)
                    held = (node, mine[x], [], False)
                held[2].extend(mine[x : x + CHUNK])
        for x in range(0, len(out), 256):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[x : x + 256], strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()), strict=True)], names=["k1", "k2", "first", "ids", "whole"])
        out.clear()
    if held is not None:
        put(False)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()), strict=True)], names=["k1", "k2", "first", "ids", "whole"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, comma-joined, taken as they pass."""
    node, state = None, None
    for batch in batches:
        out = []
        for k1, k2, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
            if node != (k1, k2):
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (k1, k2), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.as_buffer())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=[*NODE, "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], names=[*NODE, "ends_sha256"])


def ends(members: DataFrame, scratch: Scratch) -> DataFrame:
    """(k1, k2, ends_sha256) of the nodes at which conversations end."""
    dealt = members.where("last").select(*NODE, "conv").repartitionByRange(parts_of(members), *NODE, "conv").sortWithinPartitions(*NODE, "conv")
    pieces = scratch.keep(dealt.mapInArrow(_pieces, PIECE), "ids")
    several = pieces.where("not whole").repartition(parts_of(members), *NODE).sortWithinPartitions(*NODE, "first")
    return pieces.where("whole").select(*NODE, F.sha2("ids", 256).alias("ends_sha256")).unionByName(several.mapInArrow(_hashed, "k1 long, k2 long, ends_sha256 string"))


def rebuilt(convs: DataFrame, scratch: Scratch, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(conv, pos, turn, bytes, length) of every turn of the rebuilt conversations, and (conv, length) of all.

    ``turn`` is a hash of role and text. Conversation c begins with the first h turns of conversation c - c % 5 and
    goes on with its own after its first h; h is the CRC-32 of its decimal id, modulo 9.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    role = F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit(""))
    turn = F.md5(F.concat_ws(":", F.octet_length(role), role, text))
    rows = convs.select(F.col(f"`{conv_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("nr"), turn.alias("turn"), F.octet_length(text).cast("long").alias("bytes"))
    rows = rows.where("conv is not null").select("*", F.lit(1).cast("long").alias("one"), F.monotonically_increasing_id().alias("tie"))
    ranked = running(rows, ["conv"], ["nr", "turn", "tie"], {"place": "one"}, {}, scratch).select("conv", "place", "turn", "bytes")
    sizes = ranked.groupBy("conv").agg(F.count("*").alias("n")).withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % 9)
    sizes = scratch.keep(sizes.withColumn("base", F.col("conv") - F.col("conv") % 5), "sizes")
    bases = sizes.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    sizes = sizes.join(bases, "base", "left").withColumn("head", F.least("h", F.coalesce("n_base", F.lit(0))))
    sizes = scratch.keep(sizes.withColumn("length", F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "lengths")
    own = ranked.join(sizes, "conv").where("place > h").select("conv", (F.col("head") + F.col("place") - F.col("h")).alias("pos"), "turn", "bytes", "length")
    lent = ranked.where("place <= 8").withColumnRenamed("conv", "base").join(sizes, "base").where("place <= head").select("conv", F.col("place").alias("pos"), "turn", "bytes", "length")
    return own.unionByName(lent), sizes.select("conv", "length")


def trie(convs: DataFrame, small: int = SMALL, **columns: str) -> DataFrame:
    """A row for each distinct sequence of first turns: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conv_id is the smallest member, ends_sha256 the hash of the members that end there. Null roles and texts are
    empty ones. Turns come by their number, null first; those of one number by the MD5 of role and text, so that their
    order is always the same, and repeated rows are a turn each. Rows of a null conversation id are left out.
    Other columns aren't read, an empty table gives no rows.
    """
    scratch, spark = Scratch(), convs.sparkSession
    with batches_of(spark, 1 << 14):
        turns, all_convs = rebuilt(convs, scratch, **columns)
        turns = turns.select("conv", "pos", "bytes", "length", F.xxhash64("pos", "turn").alias("t1"), F.xxhash64("turn", "pos").alias("t2"))
        turns = running(turns, ["conv"], ["pos"], {"cum": "bytes"}, {"k1": "t1", "k2": "t2"}, scratch)
        none = [F.lit(None).cast("long").alias(c) for c in ("p1", "p2")]
        zero = [F.lit(0).cast("long").alias(c) for c in ("pos", "k1", "k2", "bytes", "cum")]
        members = turns.select("conv", "pos", *NODE, F.col("k1").bitwiseXOR(F.col("t1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("t2")).alias("p2"), "bytes", "cum", (F.col("pos") == F.col("length")).alias("last"))
        members = members.unionByName(all_convs.select("conv", *zero, *none, (F.col("length") == 0).alias("last")))
        # a count for each node; the parent's hash is the same for all members
        nodes = members.groupBy(*NODE, F.col("pos").alias("depth")).agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if("last").alias("n_ends"), *(F.max(c).alias(c) for c in ("bytes", "cum", "p1", "p2")))
        nodes = scratch.keep(nodes, "nodes")
        children = nodes.where("p1 is not null").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
        parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("parent_n"))
        nodes = scratch.keep(nodes.join(children, NODE, "left").join(parents, ["p1", "p2"], "left").fillna(0, ["n_children"]), "named")
        # links: nodes of the same members
        links = nodes.groupBy("conv_id", "n_convs").agg(
            F.min("depth").alias("depth"), F.max("cum").alias("cum"), F.min(F.col("cum") - F.col("bytes")).alias("above"), F.max_by("n_children", "depth").alias("k"),
            F.sum("n_ends").alias("n_ends"), F.min_by("parent_conv_id", "depth").alias("up_conv"), F.min_by("parent_n", "depth").alias("up_n"),
        )
        links = scratch.keep(links, "links")
        placed = labelled(links, scratch)
        long = lambda c, name: c.cast("long").alias(name)
        shaped = placed.select(
            F.struct("conv_id", "n_convs").alias("node"), "start", long(F.col("start") + F.col("n_convs"), "stop"), long(F.col("depth"), "depth"),
            long(2 * F.col("n_ends") + F.col("k") - 1, "own"), long(2 * F.col("n_convs") - 1, "weight"),
            long(F.when(F.col("k") == 0, 1).otherwise(0), "leaves"), long((F.col("n_convs") - 1) * (F.col("cum") - F.col("above")), "saved"),
        )
        summed = rollup(shaped, ["leaves", "saved"], scratch, small).select("node.conv_id", "node.n_convs", "sum_leaves", "sum_saved").join(links.select("conv_id", "n_convs", "above"), ["conv_id", "n_convs"])
        out = nodes.join(summed, ["conv_id", "n_convs"]).join(ends(members, scratch), NODE, "left")
        before = (F.col("n_convs") - 1) * (F.col("cum") - F.col("bytes") - F.col("above"))  # what the link's upper nodes save
        out = materialize(out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("sum_leaves").alias("n_leaves"), (F.col("sum_saved") - before).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256")), "trie")
    scratch.drop()
    return out


def labelled(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``links`` with ``start``: a link has the labels from there on, as many as members; those below it have theirs within.

    A link's place among its siblings is a running sum; the places along its path add up by doubling the distance to the ancestor.
    """
    cols = ["conv_id", "n_convs", "depth", "cum", "above", "k", "n_ends"]
    among = running(links.where("up_conv is not null"), ["up_conv", "up_n"], ["conv_id"], {"run": "n_convs"}, {}, scratch)
    among = among.select(*cols, (F.col("run") - F.col("n_convs")).alias("start"), "up_conv", "up_n")
    now = scratch.keep(among.unionByName(links.where("up_conv is null").select(*cols, F.lit(0).cast("long").alias("start"), "up_conv", "up_n")), "labels")
    while not now.where("up_conv is not null").isEmpty():
        up = now.select(F.col("conv_id").alias("up_conv"), F.col("n_convs").alias("up_n"), F.col("start").alias("more"), F.col("up_conv").alias("next_conv"), F.col("up_n").alias("next_n"))
        moved = now.where("up_conv is not null").join(up, ["up_conv", "up_n"]).select(*cols, (F.col("start") + F.col("more")).alias("start"), F.col("next_conv").alias("up_conv"), F.col("next_n").alias("up_n"))
        now = scratch.keep(moved.unionByName(now.where("up_conv is null")), "labels")
    return now.select(*cols, "start")
