"""Fuzzy line deduplication: MinHash of character shingles, banding, exact check, union-find.

Every line gets a signature of BANDS bands of ROWS minima over its runs of ``width`` characters: by one permutation,
the least hash in each of that many bins, where an empty bin takes that of another one. One changed character touches up to ``width`` runs, so lines want a short width: five, as op9_linededup and the pipeline give. Two
lines that agree on a band are candidates; at a Jaccard similarity of 0.8 a pair is missed with the
probability (1 - 0.8**ROWS)**BANDS = 0.0007, at 0.9 with 10**-8. Six rows to a band keep apart lines that
only share the short runs of their language (mostly under 0.15). Candidates that agree on LEAST of the KEPT minima of
their sketches are checked on the full shingle sets. Of the lines that links join to a component, the first one stays:
that of the smallest document id, and in this document the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlode.llm.collisions import linked, sketch
from driftlode.llm.common import Scratch, bit_filter, bits_set, free_name, join_hot, materialize, slices, small_batches
from driftlode.llm.minhash import mixed

SHINGLE, BANDS, ROWS = 10, 24, 6
BINS = BANDS * ROWS
KEPT, LEAST = 48, 26  # minima of the sketch: 38 agree on average at 0.8 (sd 2.8)
SEEN, CHUNK, PROBES = 100_000, 1 << 16, 12
VALUE = np.uint64(2**40 - 1)
EMPTY = np.uint64(2**63)

_rng = np.random.default_rng(20240502)
_PLACE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BORROW = np.array([_rng.permutation(BINS) for _ in range(PROBES)])


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _rolled(points: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """A hash of each run of ``width`` code points: their sum with a random odd factor for each place, mixed."""
    n = max(len(points) - width + 1, 0)
    total, own = np.zeros(n, np.uint64), np.empty(n, np.uint64)
    for k in range(width if n else 0):
        np.multiply(points[k : k + n], _PLACE[k % 256] + np.uint64(2 * (k // 256)), out=own)
        total += own
    return mixed(total)


def _whole(line: str) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))], np.uint64)


def shingle_set(line: str, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` characters; a shorter line is one shingle."""
    return _whole(line) if len(line) < width else np.unique(_rolled(_points(line), width))


def _bands(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minima (lines x BINS) to a 64-bit value for each line and band, and a byte for each of the KEPT minima."""
    total = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(low), 1))
    for i in range(ROWS):
        total = mixed(total + low[:, i::ROWS] * _PLACE[16 + i])
    return total.view(np.int64), mixed(low[:, :KEPT]).astype(np.uint8)


def _filled(low: np.ndarray) -> np.ndarray:
    """Minima without empty bins: each takes the value of the first bin in its own row of _BORROW that isn't empty, else of the next such bin."""
    out, flat = low.copy(), low.reshape(-1)
    put, at = out.reshape(-1), np.flatnonzero(flat == EMPTY)
    start = at // BINS * BINS
    own = at - start
    for place in _BORROW:
        value = flat[start + place[own]]
        put[at] = value
        bad = np.flatnonzero(value == EMPTY)
        if not len(bad):
            return out
        at, start, own = at[bad], start[bad], own[bad]
    row = start // BINS
    # the next full bin of each bin, for all rows that are left at once; past the last one comes the first
    left = np.unique(row)
    full = low[left] != EMPTY
    later = np.minimum.accumulate(np.where(full, np.arange(BINS), BINS)[:, ::-1], axis=1)[:, ::-1]
    later = np.where(later == BINS, full.argmax(axis=1)[:, None], later)
    put[at] = low[row, later[np.searchsorted(left, row), own]]
    return out


def minima(lines: list[str], width: int = SHINGLE) -> np.ndarray:
    """The minima of ``lines``; a row of BINS for each. CHUNK characters are hashed together, whatever the length of a line; their arrays fit into a cache."""
    low = np.full((len(lines), BINS), EMPTY, np.uint64)
    flat, part, held = low.reshape(-1), [], 0

    def put(rows: np.ndarray, hashes: np.ndarray) -> None:
        at = rows * BINS + ((hashes >> np.uint64(40)) * np.uint64(BINS) >> np.uint64(24)).astype(np.int64)
        np.minimum.at(flat, at, hashes & VALUE)

    def flush() -> None:
        sizes = np.array([len(p) for _, p in part])
        runs, starts = sizes - width + 1, np.concatenate([[0], np.cumsum(sizes[:-1] + 1)])
        at = np.repeat(starts - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(runs.sum())
        put(np.repeat([r for r, _ in part], runs), _rolled(_points("\n".join(p for _, p in part)), width)[at])
        part.clear()

    for row, line in enumerate(lines):
        if len(line) < width:
            put(np.array([row]), _whole(line))
        for at in range(0, len(line) - width + 1, CHUNK):
            piece = line[at : at + CHUNK + width - 1]
            part.append((row, piece))
            held += len(piece)
            if held >= CHUNK:
                flush()
                held = 0
    if part:
        flush()
    return _filled(low)


def shingle_sets(lines: list[str], width: int) -> list[np.ndarray]:
    """shingle_set() of each line; short ones are hashed together."""
    out: list = [None] * len(lines)
    short = [k for k, x in enumerate(lines) if width <= len(x) <= 4096]
    held = np.cumsum([len(lines[k]) for k in short]) // CHUNK
    for part in np.split(np.array(short), np.flatnonzero(np.diff(held)) + 1) if short else ():
        hashes, at = _rolled(_points("\n".join(lines[k] for k in part)), width), 0
        for k in part:
            own = hashes[at : at + len(lines[k]) - width + 1]
            own = np.sort(own)
            out[k] = own[np.concatenate([[True], own[1:] != own[:-1]])]
            at += len(lines[k]) + 1
    return [shingle_set(lines[k], width) if x is None else x for k, x in enumerate(out)]


def _lines(text: str | None) -> tuple[list[str], list[int]]:
    """All lines of a text, and the numbers of those that aren't blank."""
    lines = (text or "").split("\n")
    return lines, [i for i, x in enumerate(lines) if x and not x.isspace()]


def _keys(lines: list[str]) -> np.ndarray:
    """128 bits for each line, as rows of two longs."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in lines]), "<i8").reshape(-1, 2)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, row, line, hi, lo) of every line that isn't blank."""
    for batch in slices(batches):
        counts, numbers, keys = [], [], [np.zeros((0, 2), np.int64)]
        for doc, value in zip(batch.column(0), batch.column(2), strict=True):
            lines, own = _lines(value.as_py() if doc.is_valid else None)
            counts.append(len(own))
            numbers += own
            keys.append(_keys([lines[i] for i in own]))
        both, at = np.concatenate(keys), pa.array(np.repeat(np.arange(batch.num_rows), counts))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(numbers, pa.int32()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["doc", "row", "line", "hi", "lo"])


def _signed(repeated: np.ndarray, width: int):
    """Signatures. ``many`` marks lines that may occur elsewhere too; of these each task gives the first it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in slices(batches):
            at, numbers, wanted, keys, manys = [], [], [], [np.zeros((0, 2), np.int64)], [np.zeros(0, bool)]
            for place, (doc, value) in enumerate(zip(batch.column(0), batch.column(2), strict=True)):
                text = value.as_py() if doc.is_valid else None
                lines, own = _lines(text)
                key = _keys([lines[i] for i in own])
                many = bits_set(repeated, key[:, 1].copy())
                new = []
                for k, m in enumerate(many):
                    if m:
                        name = key[k].tobytes()
                        if name in seen:
                            continue
                        seen.add(name)
                    new.append(k)
                if len(seen) > SEEN:
                    seen.clear()
                if new:
                    at += [place] * len(new)
                    numbers += [own[k] for k in new]
                    keys.append(key[new])
                    manys.append(many[new])
                    wanted += [lines[own[k]] for k in new]
            both, at = np.concatenate(keys), pa.array(at, pa.int64())
            flat, low = _bands(minima(wanted, width))
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, BANDS, dtype=np.int32)), pa.array(flat.ravel()))
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(numbers, pa.int32()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(np.concatenate(manys)), listed, pa.array([sketch(0, x) for x in low], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "row", "line", "hi", "lo", "many", "coords", "sketch"])

    return run


def _texts_at(bits: np.ndarray):
    """The lines whose key the bitmap lets through, each once for a batch: a superset of those asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = list({x for value in batch.column(0) for x in (value.as_py() or "").split("\n") if x and not x.isspace()})
            both = _keys(lines)
            hit = np.flatnonzero(bits_set(bits, both[:, 1].copy()))
            yield pa.RecordBatch.from_arrays([pa.array(both[hit, 0]), pa.array(both[hit, 1]), pa.array([lines[k] for k in hit], pa.string())], names=["hi", "lo", "text"])

    return run


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = SHINGLE) -> DataFrame:
    """(doc, row, removed): for each document that loses lines, their numbers from 0. ``row`` is xxhash64() of the text.

    Rows of one id and different texts are documents of their own, in the order of ``row``; rows that are equal
    in both are one document, that has its lines once.
    """
    scratch = Scratch()
    small_batches(docs.sparkSession)
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.xxhash64(text).alias("row"), text.alias("text"))
    slim = scratch.keep(rows.mapInArrow(_placed, "doc long, row long, line int, hi long, lo long"), "lines")
    place = F.struct("doc", "row", "line")
    repeated = scratch.keep(slim.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1"), "repeated")
    signed = rows.mapInArrow(_signed(bit_filter(repeated, "lo"), width), "doc long, row long, line int, hi long, lo long, many boolean, coords array<long>, sketch binary")
    signed = scratch.keep(signed.withColumn("uid", F.monotonically_increasing_id()), "signed")
    # of the lines that several tasks met, one row
    firsts = signed.where("many").groupBy("hi", "lo").agg(F.min("uid").alias("uid")).select("uid")
    firsts = scratch.keep(firsts, "firsts")
    again = scratch.keep(signed.where("many").join(firsts, "uid").select("uid", "coords", "sketch"), "again")
    items = signed.where("not many").select("uid", "coords", "sketch").union(again).withColumnRenamed("uid", "node")
    keyed = signed.select(F.col("uid").alias("node"), "hi", "lo", place.alias("own"))

    def texts(nodes: DataFrame) -> DataFrame:
        """(node, full), the texts of a table of nodes; few of the other lines get as far as the join."""
        ends = scratch.keep(keyed.join(nodes, "node").select("node", "hi", "lo"), "ends")
        there = rows.select("text").mapInArrow(_texts_at(bit_filter(ends, "lo")), "hi long, lo long, text string")
        return there.join(ends, ["hi", "lo"]).groupBy("hi", "lo", "node").agg(F.first("text").alias("full")).select("node", "full")

    found = linked(items, LEAST, percent, texts, lambda lines: shingle_sets(lines, width), scratch)
    # the lines of a component and where the first of each stands; then where the first of all stands
    ours = keyed.join(found, "node").select("hi", "lo", F.col("component").alias("c"), "own").join(repeated, ["hi", "lo"], "left")
    ours = scratch.keep(ours.select("hi", "lo", "c", F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("first", "own").alias("first")), "ours")
    lines = ours.groupBy("c").agg(F.min("first").alias("stays"), F.count("*").alias("lines"))
    known = join_hot(ours.drop("first"), lines, ["c"], "lines", ours.count()).select("hi", "lo", "n", "stays")
    known = scratch.keep(known.union(repeated.join(ours, ["hi", "lo"], "left_anti").select("hi", "lo", "n", F.col("first").alias("stays"))), "known")
    # a line that occurs once and is its component's first has nothing to remove
    at = join_hot(slim, known, ["hi", "lo"], "n", slim.count()).where(place != F.col("stays"))
    gone = materialize(at.groupBy("doc", "row").agg(F.collect_set("line").alias("removed")), "gone")
    scratch.drop()
    return gone


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = None, percent: int = 80, count_cols: bool = False, width: int = SHINGLE) -> DataFrame:
    """``docs`` without the lines that repeat or nearly repeat a line kept elsewhere.

    Lines end at a line feed and are linked if 100 * |A & B| >= percent * |A | B| for their sets
    of runs of ``width`` characters. Blank lines are never compared and stay, as do documents that lose all their lines (their
    text becomes empty), null texts and rows of a null id. Rows of one id with different texts are documents of their
    own; rows that repeat id and text are one document and come back alike, each with the lines that stay.
    ``chars_col`` gets the new length in code points; ``count_cols`` adds n_lines and n_removed. All
    other columns pass; an empty table stays empty.
    """
    own = free_name(docs)
    doc, row, lost = f"{own}_doc", f"{own}_row", f"{own}_removed"
    gone = removed_lines(docs, id_col, text_col, percent, width).toDF(doc, row, lost)
    text = F.col(f"`{text_col}`")
    parts = F.split(text, "\n", -1)
    # a row of gone has a few numbers: hashing these spares sorting the texts
    both = docs.join(gone.hint("shuffle_hash"), (F.col(f"`{id_col}`").cast("long") == F.col(doc)) & (F.xxhash64(text.cast("string")) == F.col(row)), "left")
    if count_cols:
        both = both.withColumns({"n_lines": F.when(text.isNull(), 0).otherwise(F.size(parts)).cast("long"), "n_removed": F.coalesce(F.size(lost), F.lit(0)).cast("long")})
    # bound once, and the numbers told apart by a set: linear in the lines of a document
    stay = lambda p: F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col(lost)), lambda i: F.get(p, i))
    new = F.array_join(F.element_at(F.transform(F.array(parts), stay), 1), "\n")
    both = both.withColumn(text_col, F.when(F.col(lost).isNotNull(), new).otherwise(text))
    if chars_col:
        both = both.withColumn(chars_col, F.when(F.col(lost).isNotNull(), F.char_length(text).cast("long")).otherwise(F.col(f"`{chars_col}`")))
    return both.drop(doc, row, lost)
