"""Packing documents into sequences of a fixed number of tokens, by large-item matching.

How many pieces there are of each length is all that a packing depends on, and there are at most
``capacity`` lengths. So the plan is made from that histogram, whatever the size of the corpus,
and each piece then looks up its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlode.llm.common import free_name, materialize, slices, small_batches

CAPACITY, END_ID = 4096, 1
CACHED, LONGEST = 150_000, 32
PER_GROUP = 1 << 16

_known: dict[str, _Codes] = {}


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


BYTE_LETTERS = _byte_letters()


class _Codes(dict):
    """The ids of parts of texts, each coded when it is first asked for.

    A part of letters alone, perhaps with one full stop or comma behind, is what the tokenizer's split
    leaves whole (without the stop), so it goes straight to the merges; others take the whole way.
    """

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.model = self.tokenizer.model

    def __missing__(self, part: str) -> bytes:
        base = part[:-1] if part[-1:] in (".", ",") and len(part) > 1 else part
        if base.isalpha():
            letters = base if base.isascii() else "".join([BYTE_LETTERS[b] for b in base.encode()])
            ids = [t.id for t in self.model.tokenize(letters)]
        else:
            base, ids = part, self.tokenizer.encode(part, add_special_tokens=False).ids
        code = struct.pack(f"<{len(ids)}I", *ids)
        if base is not part:
            code += self[part[-1]]
        if len(part) <= LONGEST:
            if len(self) >= CACHED:
                self.clear()
            self[part] = code
        return code


def encoded(path: str, text: str | None) -> bytes:
    """The ids of ``text`` as little-endian unsigned 32-bit numbers, for a tokenizer of whole words.

    The tokenizer composes characters (NFC), lower-cases them one by one, drops white space and
    joins nothing across it, so that the ids of a text are those of its parts between spaces and line
    feeds. Parts seen before aren't encoded again. Texts that this can't be said of (not composed, or
    with the two letters whose lower case differs in Python) are encoded whole.
    """
    text = text or ""
    if not text.isascii() and (not unicodedata.is_normalized("NFC", text) or "\u03a3" in text or "\u0130" in text):
        return np.array(tokenizer(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    if path not in _known:
        _known[path] = _Codes(path)
    return b"".join(map(_known[path].__getitem__, text.lower().replace("\n", " ").split(" ")))


def _pieces(path: str, capacity: int, end_id: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches):
            rows: list[list] = [[], [], [], [], [], []]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoded(path, text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(rows, (key, k, at // 4, len(part) // 4, zlib.crc32(part), part), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ("id", "piece", "start", "length", "ids_crc32", "ids")
            n = 6 if keep_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows[:n], kinds[:n], strict=True)], names=names[:n])

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """Tokenize and cut: id, piece, start, length, ids_crc32 and, if asked for, ids (binary, 4 bytes each).

    A document is its ids and ``end_id`` after them; null and empty texts are the end id alone. Only
    documents over ``capacity`` are cut, into pieces of that many tokens and a shorter last one. Repeated rows
    and those of a null id are documents too, other columns aren't read, an empty table has no pieces.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(_pieces(tokenizer_path, capacity, end_id, keep_ids), "id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def plan(sizes: dict[int, int], capacity: int) -> np.ndarray:
    """Where the pieces of each length go. sizes: pieces by length.

    Rows (length, first rank, first sequence, pieces of that length in a sequence, offset of the
    first of them). Lengths over a third of the capacity are matched greedily, the longest with the
    longest that fits beside it, never more than two in a sequence. Then the smaller ones, longest
    first, go where the gap is smallest; new sequences are opened when no gap is left.
    """
    out: list[tuple[int, int, int, int, int]] = []
    used: dict[int, int] = dict.fromkeys(sizes, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    opened = 0

    def put(length: int, first: int, bins: int, each: int, offset: int) -> None:
        out.append((length, used[length], first, each, offset))
        used[length] += bins * each

    def leave(gap: int, first: int, bins: int) -> None:
        if bins and gap:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, bins))

    left = {n: c for n, c in sizes.items() if c}
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large.pop()
        while left[n]:
            k = bisect_left(large, capacity - n + 1) - 1
            if 2 * n <= capacity and left[n] >= 2:
                bins, mate = left[n] // 2, n
                put(n, opened, bins, 2, 0)
                left[n] -= 2 * bins
            elif k >= 0:
                mate = large[k]
                bins = min(left[n], left[mate])
                put(n, opened, bins, 1, 0)
                put(mate, opened, bins, 1, n)
                left[n] -= bins
                left[mate] -= bins
                if not left[mate]:
                    large.pop(k)
            else:
                bins, mate = left[n], 0
                put(n, opened, bins, 1, 0)
                left[n] = 0
            leave(capacity - n - mate, opened, bins)
            opened += bins
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            k = bisect_left(order, n)
            if k < len(order):
                gap = order[k]
                first, bins = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[k]
            else:
                gap, first, bins = capacity, opened, -(-left[n] // (capacity // n))
                opened += bins
            each = gap // n
            full = min(bins, left[n] // each)
            if full:
                put(n, first, full, each, capacity - gap)
                leave(gap - each * n, first, full)
                left[n] -= full * each
            if full < bins:
                some = left[n]
                if some:
                    put(n, first + full, 1, some, capacity - gap)
                    leave(gap - some * n, first + full, 1)
                    left[n] = 0
                rest = bins - full - bool(some)
                leave(gap, first + full + bool(some), rest)
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def _placed(places: np.ndarray):
    top = int(places[:, 1].max(initial=0)) + 1 if len(places) else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = places[:, 0].astype(np.float64) * 0 if not len(places) else None
        lengths, first_of = (np.unique(places[:, 0], return_index=True)) if len(places) else (starts, starts)
        for batch in batches:
            if not batch.num_rows:
                continue
            n, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.empty(len(n), np.int64)
            for x in np.unique(n):
                mine = n == x
                i = int(np.searchsorted(lengths, x))
                a, b = int(first_of[i]), int(first_of[i + 1]) if i + 1 < len(first_of) else len(places)
                at[mine] = a + np.searchsorted(places[a:b, 1], np.minimum(rank[mine], top), side="right") - 1
            p = places[at]
            by = rank - p[:, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(batch.num_columns - 1)), pa.array(p[:, 2] + by // p[:, 3]), pa.array(p[:, 4] + by % p[:, 3] * n)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (id, piece, length and more) with sequence_id and offset.

    The ranks are counted within groups of a length and a salt, whose number grows with the pieces,
    so that a length that very many pieces have is dealt over many tasks. An empty table stays
    empty; equal rows get places of their own.
    """
    uid, columns = free_name(pieces), pieces.columns
    told = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    pieces = materialize(pieces.withColumn(uid, F.monotonically_increasing_id()), "pieces")
    sizes = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    salts = max(64, -(-sum(sizes.values()) // PER_GROUP))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(uid), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("length", "salt").orderBy(uid)) - 1
    ranked = salted.join(before, ["length", "salt"]).select(*columns, rank.alias("rank"))
    return ranked.mapInArrow(_placed(plan(sizes, capacity)), told + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """Tokenize, cut and pack ``docs``: one row per piece with its place, gapless from offset 0.

    Null and empty texts are an end id; rows that repeat and those of a null id get places of their own; an
    empty table gives an empty result.
    """
    packed = pack(token_pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id, keep_ids), capacity)
    return packed.withColumnRenamed("id", id_col)
