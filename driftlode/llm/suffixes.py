"""Removal of repeated passages by a distributed suffix order.

A passage counts as repeated if its LENGTH bytes start at two places or more. The suffixes that matter are those that begin at some byte
and are cut after LENGTH, and their leading token is content-defined: of the runs of GRAM bytes within, the one of least hash is the anchor, and
WIDTH consecutive starts with one anchor form a block, whose common part (all bytes that each of its suffixes has) is hashed. Equal
suffixes have the same anchor at the same distance, so their token is the same.

1. Blocks whose token occurs once go at once: tokens are looked through packed by bucket, and a bitmap of those that several blocks have is
   sent to the tasks.
2. The other blocks are ordered by token and then by a hash of all their bytes (``neighbours``): sampled splitters range-partition
   them, each bucket sorts by multikey quicksort, first and last row of each are compared across the boundaries. A block that is
   wholly like its neighbour is repeated as a whole.
3. Where only the token agrees, the suffixes of the block are ordered one by one, by token and by the bytes on both sides of the common
   part; those that equal a neighbour are repeated.

Of documents with the same text one is looked at; each of LENGTH bytes or more loses everything.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlode.llm.collisions import PER_BUCKET, _dealt, _shared
from driftlode.llm.common import Scratch, batches_of, bit_filter, bits_set, free_name, materialize, slices
from driftlode.llm.scan import parts_of

LENGTH, GRAM, WIDTH = 400, 32, 64
PIECE = 1 << 18  # bytes that are looked at together
GRAMS = LENGTH - GRAM + 1  # in a suffix
CORE = LENGTH - WIDTH + 1  # bytes that all suffixes of a block have
SIDES = WIDTH - 1  # bytes that a suffix has beside them
PER_BLOCK = 40  # bytes of text for a block, about
ROWS = 1 << 17  # of a bucket
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD)]
NOTHING = hashlib.sha256(b"").hexdigest()


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive values."""
    size = -(-len(values) // n) * n
    padded = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    grid = padded.reshape(-1, n)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: len(values) - n + 1], ahead[n - 1 : len(values)])


def anchors(data: np.ndarray) -> np.ndarray:
    """Where the anchor of each suffix of ``data`` (LENGTH bytes or more, PIECE at most) begins; of equal runs the first."""
    words = np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data).data, strides=(1,))
    n = len(data) - GRAM + 1
    mixed = sum((words[8 * k : 8 * k + n] * MIX[k] for k in range(1, 4)), words[:n] * MIX[0])
    mixed ^= mixed >> np.uint64(32)
    mixed *= MIX[4]
    low = np.uint64(PIECE - 1)
    return (_least((mixed & ~low) | np.arange(n, dtype=np.uint64), GRAMS) & low).astype(np.int64)


def blocks(data: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """For texts that lie one after another: text, first start, number of starts and begin of the common part of each block.

    Places are those in ``data``. Long texts are looked at in overlapping pieces; a block may be cut where a piece ends.
    """
    for at in range(0, max(len(data) - LENGTH + 1, 0), PIECE - LENGTH + 1):
        piece = data[at : at + PIECE]
        if len(piece) < LENGTH:
            break
        first = at + np.arange(len(piece) - LENGTH + 1)
        text = np.searchsorted(cuts, first, "right") - 1
        inside = first + LENGTH <= cuts[text + 1]
        anchor = anchors(piece)[inside] + at
        first, text = first[inside], text[inside]
        if not len(first):
            continue
        column = (anchor - first) // WIDTH
        begins = np.ones(len(first), bool)
        begins[1:] = (anchor[1:] != anchor[:-1]) | (column[1:] != column[:-1]) | (text[1:] != text[:-1])
        b = np.flatnonzero(begins)
        yield text[b], first[b], np.diff(np.append(b, len(first))), anchor[b] - column[b] * WIDTH


def _tokens(data: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Hashes of the common parts."""
    view = memoryview(data)
    return np.fromiter((xxhash.xxh3_64_intdigest(view[c : c + CORE]) for c in core.tolist()), np.uint64, len(core)).view(np.int64)


def _texts(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column one after another, and the n + 1 places where values begin and end."""
    values = batch.column(column).fill_null(b"")
    kind = np.int64 if pa.types.is_large_binary(values.type) else np.int32
    cuts = np.frombuffer(values.buffers()[1], kind)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[cuts[0] : cuts[-1]]
    return data, cuts - cuts[0]


def _first_copies(batch: pa.RecordBatch, reps: np.ndarray) -> pa.RecordBatch:
    """The rows that the bitmap lets through: of equal texts the first, and now and then another."""
    return batch.filter(pa.array(bits_set(reps, batch.column(1).to_numpy().copy())))


def _all_tokens(reps: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, cuts = _texts(_first_copies(batch, reps), 2)
            for *_, core in blocks(data, cuts):
                yield pa.RecordBatch.from_arrays([pa.array([_tokens(data, core)], pa.list_(pa.int64()))], names=["tokens"])

    return run


#: key: token and hash of all bytes. lead: bytes of the sides that stand before the common part.
BLOCK_KIND = "text binary, start int, n short, key binary, lead short, sides binary"
SUFFIX_KIND = "text binary, start int, key binary"


def _repeated_tokens(reps: np.ndarray, bits: np.ndarray):
    """The blocks whose token may occur again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            mine = _first_copies(batch, reps)
            data, cuts = _texts(mine, 2)
            view, digests = memoryview(data), mine.column(0).to_pylist()
            for text, first, count, core in blocks(data, cuts):
                tokens = _tokens(data, core)
                on = np.flatnonzero(bits_set(bits, tokens))
                if not len(on):
                    continue
                text, first, count, core, tokens = text[on], first[on], count[on], core[on], tokens[on].view(np.uint64)
                key, sides = [], []
                for t, f, n, c in zip(tokens.tolist(), first.tolist(), count.tolist(), core.tolist(), strict=True):
                    end = f + n - 1 + LENGTH
                    key.append(t.to_bytes(8, "big") + xxhash.xxh3_64_digest(view[f:end], n * WIDTH + c - f))
                    sides.append(bytes(view[f:c]) + bytes(view[c + CORE : end]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([digests[t] for t in text.tolist()], pa.binary()), pa.array(first - cuts[text], pa.int32()), pa.array(count, pa.int16()), pa.array(key, pa.binary()), pa.array(core - first, pa.int16()), pa.array(sides, pa.binary())],
                    names=["text", "start", "n", "key", "lead", "sides"],
                )

    return run


def multikey_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of words, and how many leading words each has in common with the row before it.

    Multikey quicksort with words as characters: rows are sorted by a word, and only those still equal go on to the next.
    """
    n, words = keys.shape
    order, common = np.arange(n), np.zeros(n, np.int64)
    group, active = np.zeros(n, np.int64), np.arange(n)  # places whose rows aren't yet told apart, by group
    for w in range(words):
        if not len(active):
            break
        word = keys[order[active], w]
        by = np.lexsort((word, group[active]))
        order[active], word = order[active[by]], word[by]
        same = np.zeros(len(active), bool)
        same[1:] = (group[active][1:] == group[active][:-1]) & (word[1:] == word[:-1])
        common[active[same]] = w + 1
        group[active] = active[np.maximum.accumulate(np.where(same, 0, np.arange(len(active))))]
        tied = same.copy()
        tied[:-1] |= same[1:]
        active = active[tied]
    return order, common


def _words(column: pa.Array, words: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, words)


def _sorted(key: int, words: int, names: list[str]):
    """Adds how many leading words a row has in common with those before and after; nulls across the ends of the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        del held
        order, common = multikey_order(_words(table.column(key), words))
        table = table.take(pa.array(order))
        n, bucket = len(order), TaskContext.get().partitionId()
        before = pa.array(common, pa.int32(), mask=np.arange(n) == 0)
        after = pa.array(np.append(common[1:], 0), pa.int32(), mask=np.arange(n) == n - 1)
        for part in table.append_column("before", before).append_column("after", after).append_column("bucket", pa.array(np.full(n, bucket), pa.int32())).combine_chunks().to_batches(4096):
            yield pa.RecordBatch.from_arrays(part.columns, names=names)

    return run


def neighbours(rows: DataFrame, words: int, scratch: Scratch, rows_at_once: int = ROWS) -> DataFrame:
    """``rows`` in the order of ``key`` (binary, ``words`` times 8 bytes) with before, after: leading words common with the neighbours.

    Splitters are sampled; rows of one key may lie in several buckets. Of each bucket the driver gets first and last key.
    """
    parts = max(parts_of(rows), -(-rows.count() // rows_at_once))
    tie = F.xxhash64("text", "start")
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", before int, after int, bucket int"
    names = [*rows.columns, "before", "after", "bucket"]
    found = scratch.keep(rows.repartitionByRange(parts, "key", tie).mapInArrow(_sorted(rows.columns.index("key"), words, names), kind), "order")
    ends = found.where("before is null or after is null").groupBy("bucket").agg(F.min("key").alias("first"), F.max("key").alias("last")).orderBy("bucket").collect()
    across = {}
    for x, y in zip(ends, ends[1:], strict=False):
        a, b = (_words(pa.array([bytes(k)]), words)[0] for k in (x["last"], y["first"]))
        across[x["bucket"], 1] = across[y["bucket"], 0] = int(np.argmin(np.append(a == b, False)))
    told = [(row["bucket"], across.get((row["bucket"], 0), 0), across.get((row["bucket"], 1), 0)) for row in ends]
    table = rows.sparkSession.createDataFrame(told, "bucket int, earlier int, later int")
    both = found.join(F.broadcast(table), "bucket")  # a row a bucket
    return both.select(*rows.columns, F.coalesce("before", "earlier").alias("before"), F.coalesce("after", "later").alias("after"))


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The suffixes of blocks: token, how many bytes stand before the common part, and the bytes on both sides."""
    for batch in slices(batches, 4096):
        text, start, key = [], [], []
        for t, s, n, k, lead, sides in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            token = k[:8]
            text += [t] * n
            start += range(s, s + n)
            key += [token + bytes([lead - i]) + sides[i : i + SIDES] for i in range(n)]
        yield pa.RecordBatch.from_arrays([pa.array(text, pa.binary()), pa.array(start, pa.int32()), pa.array(key, pa.binary())], names=["text", "start", "key"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges that come by text and begin, merged where they overlap or touch, as one row of a text."""
    text, spans = None, []

    def row():
        return pa.RecordBatch.from_arrays([pa.array([text], pa.binary()), pa.array([np.array(spans, "<i4").tobytes()], pa.binary())], names=["text", "spans"])

    for batch in batches:
        for t, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if t != text:
                if spans:
                    yield row()
                text, spans = t, []
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
    if spans:
        yield row()


def repeated(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(text, spans): for the SHA-256 of texts, their repeated byte ranges as pairs of 32-bit numbers, merged.

    ``docs`` has text (the hash), id, rep (a hash of both), n_bytes and body. Of equal texts that with the smallest id is looked at.
    """
    firsts = docs.groupBy("text").agg(F.min_by("rep", "id").alias("rep"), F.first("n_bytes").alias("n_bytes"))
    firsts = scratch.keep(firsts.where(F.col("n_bytes") >= LENGTH), "firsts")
    n, total = firsts.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    reps = bit_filter(firsts, "rep", n)
    bodies = docs.where(F.col("n_bytes") >= LENGTH).select("text", "rep", "body")
    packed = bodies.mapInArrow(_all_tokens(reps), "tokens array<long>").mapInArrow(_dealt(max(8, total // PER_BLOCK // PER_BUCKET)), "bucket long, values binary, several binary")
    shared = scratch.keep(packed.groupBy("bucket").applyInArrow(_shared, "key long"), "shared")
    found = scratch.keep(bodies.mapInArrow(_repeated_tokens(reps, bit_filter(shared, "key")), BLOCK_KIND), "blocks")
    ordered = neighbours(found, 2, scratch)
    whole = ordered.where("before = 2 or after = 2").select("text", "start", F.col("n").cast("int").alias("n"))
    # a block of each kind that shares the token with one of another kind
    mixed = ordered.where("before = 1 or after = 1").select("text", "start", "n", "key", "lead", "sides")
    single = scratch.keep(mixed.mapInArrow(_opened, SUFFIX_KIND), "suffixes")
    alike = neighbours(single, 9, scratch).where("before = 9 or after = 9").select("text", "start", F.lit(1).alias("n"))
    ranges = whole.union(alike).select("text", F.col("start").alias("a"), (F.col("start") + F.col("n") + F.lit(LENGTH - 1)).alias("b"))
    return ranges.repartition(parts_of(docs), "text").sortWithinPartitions("text", "a").mapInArrow(_joined, "text binary, spans binary")


def _hit(bits: np.ndarray):
    """Texts that the bitmap of hashes lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(bits_set(bits, batch.column(1).to_numpy().copy()))).select([0, 2])

    return run


def cut(body: bytes, spans: np.ndarray) -> bytes:
    """What is left of a text without the ranges (begin, end)."""
    edges = np.concatenate([[0], spans.ravel(), [len(body)]]).reshape(-1, 2)
    return b"".join(body[a:b] for a, b in edges.tolist())


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = []
        for text, body, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            spans = np.frombuffer(packed, "<i4").reshape(-1, 2).astype(np.int64)
            rows.append((text, int(np.diff(spans).sum()), len(spans), packed, cut(body, spans)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["text", "n_removed", "n_spans", "spans", "kept"])


def remove_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep_text: bool = True) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans, kept_sha256, and with ``keep_text`` their text without repeated passages.

    Removed is every byte that lies in a passage of LENGTH bytes which also starts elsewhere, in another document or the same.
    Null and empty texts have no bytes; a null text stays null. Rows that repeat a text (and id) are copies like any
    others, a null id is one more id. Columns of the result that ``docs`` has already are replaced, all others pass; an
    empty table stays empty. What is left may not be valid UTF-8 where a passage ends within a character: the hash is that of
    the bytes, and the text has replacement characters there.
    """
    scratch, own = Scratch(), free_name(docs)
    text, body, n = f"{own}_text", f"{own}_body", f"{own}_n"
    plain = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    rows = docs.withColumn(body, plain).withColumn(text, F.unhex(F.sha2(body, 256))).withColumn(n, F.octet_length(body).cast("long"))
    looked = rows.select(F.col(text).alias("text"), F.xxhash64(text, F.col(f"`{id_col}`").cast("string")).alias("rep"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.col(n).alias("n_bytes"), F.col(body).alias("body"))
    with batches_of(docs.sparkSession, 256, 1 << 22):
        spans = scratch.keep(repeated(looked, scratch), "spans")
        copies = scratch.keep(looked.where(F.col("n_bytes") >= LENGTH).groupBy("text").agg(F.count("*").alias("copies"), F.first("n_bytes").alias("n_bytes")).where("copies > 1"), "copies")
        some = scratch.keep(spans.join(copies, "text", "left_anti").withColumn("hash", F.xxhash64("text")), "some")
        hit = looked.where(F.col("n_bytes") >= LENGTH).select("text", F.xxhash64("text").alias("hash"), "body").mapInArrow(_hit(bit_filter(some, "hash")), "text binary, body binary")
        left = hit.join(some.select("text", "spans"), "text").mapInArrow(_left, "text binary, n_removed long, n_spans long, spans binary, kept binary")
        done = left.select("text", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), *([F.make_valid_utf8(F.col("kept").cast("string")).alias("kept")] if keep_text else []))
        gone = copies.select("text", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(NOTHING).alias("kept_sha256"), *([F.lit("").alias("kept")] if keep_text else []))
        done = scratch.keep(done.unionByName(gone).withColumnsRenamed({c: f"{own}_{c}" for c in ("text", "n_removed", "n_spans", "kept_sha256", "kept")}), "cut")
        made = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
        out = rows.join(done, text, "left")
        others = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in made and c != text_col]
        told = [F.col(n).alias("n_bytes"), *(F.coalesce(f"{own}_{c}", F.lit(0)).alias(c) for c in ("n_removed", "n_spans")), F.coalesce(f"{own}_kept_sha256", F.lower(F.hex(text))).alias("kept_sha256")]
        shown = [F.coalesce(f"{own}_kept", F.col(f"`{text_col}`").cast("string")).alias(text_col)] if keep_text else []
        out = materialize(out.select(*others, *shown, *told), "kept")
    scratch.drop()
    return out
