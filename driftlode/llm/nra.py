"""Ranked lexical search by NRA (no random access): impact-sorted lists read in order, score intervals for documents.

N, L and the document frequencies are taken over all documents, so that scores of different shards compare. A shard has
for each term a list of its documents by falling impact. For a query all lists are read downwards together, a level
of impact at a time. What a document has shown so far is its lower bound; its upper bound adds, for each list in which it wasn't
seen, the impact at which that list now stands. Reading goes on until no document outside the k best can reach or
tie with one inside, and every score among them is exact; a document is never looked up in a list.
The k best of a query go on from shard to shard of a task: a shard whose first impacts add up to less is skipped.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlode.llm.common import Scratch, batches_of, materialize, slices

POSTINGS = 1 << 20  # of a shard, on average
QUERY_TERMS = 1 << 20  # terms of the queries that are sent to the tasks at once
#: Bytes that end a term become spaces, A-Z become a-z, digits, letters and all beyond ASCII stay.
TERM_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()
HITS = "item_id long, doc_id long, score long"


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order."""
    return (text or "").encode("utf-8", "surrogatepass").translate(TERM_BYTES).split()


def _hashes(terms) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, terms), np.uint64).view(np.int64)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [_hashes(set(terms_of(t.as_py()))) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["item", "terms"])


def _posted(names: np.ndarray):
    """id, number of terms, and which of the asked terms (by place in ``names``) occur how often, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lengths, terms, counts = [], [], []
            for t in batch.column(1):
                found = terms_of(t.as_py())
                tf = Counter(found)
                keys = _hashes(tf)
                at = np.minimum(np.searchsorted(names, keys), max(len(names) - 1, 0))
                on = names[at] == keys if len(names) else np.zeros(len(keys), bool)
                lengths.append(len(found))
                terms.append(at[on].astype("<i4").tobytes())
                counts.append(np.fromiter(tf.values(), "<u4", len(tf))[on].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], names=["id", "n", "terms", "counts"])

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial document frequencies of a batch."""
    for batch in slices(batches, 4096):
        terms, n = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4"), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(n.astype(np.int64))], names=["term", "df"])


def weight(n_docs: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) of each document frequency."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def shard_of(ids: np.ndarray, n: np.ndarray, terms: list[bytes], counts: list[bytes], n_docs: int, n_terms: int) -> dict[str, np.ndarray]:
    """ids; the terms that occur; where their lists begin; documents and gains of the lists, best gain first.

    A list's order doesn't depend on the term's weight, which is one factor for all of it.
    """
    term, tf = np.frombuffer(b"".join(terms), "<i4"), np.frombuffer(b"".join(counts), "<u4").astype(np.int64)
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), [len(t) // 4 for t in terms])
    m = 10 + (90 * n * n_docs) // max(n_terms, 1)
    gain = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
    order = np.lexsort((doc, -gain, term))
    words, begin = np.unique(term[order], return_index=True)
    return {"ids": ids, "words": words, "begin": np.append(begin, len(term)), "doc": doc[order], "gain": gain[order]}


#: The arrays of a shard and their types.
ARRAYS = {"ids": "<i8", "words": "<i4", "begin": "<i4", "doc": "<i4", "gain": "<i4"}


def _shard(n_docs: int, n_terms: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("uid", "ascending")])
        made = shard_of(table.column("id").to_numpy(), table.column("n").to_numpy(), table.column("terms").to_pylist(), table.column("counts").to_pylist(), n_docs, n_terms)
        return pa.table({c: pa.array([made[c].astype(kind).tobytes()], pa.binary()) for c, kind in ARRAYS.items()})

    return run


def search_shard(shard: dict[str, np.ndarray], terms: np.ndarray, weights: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and exact scores of the k best documents of ``best`` and a shard, and how many postings were read.

    Equal scores go by the smaller id.
    """
    ids, scores = best if best is not None else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    at = np.minimum(np.searchsorted(shard["words"], terms), max(len(shard["words"]) - 1, 0))
    hit = (shard["words"][at] == terms) & (weights > 0) if len(shard["words"]) else np.zeros(len(terms), bool)
    lists = [(shard["doc"][a:b], shard["gain"][a:b].astype(np.int64) * w) for a, b, w in zip(shard["begin"][at[hit]], shard["begin"][at[hit] + 1], weights[hit], strict=True)]
    place, read = [0] * len(lists), 0
    stands = np.array([impact[0] for _, impact in lists], np.int64)  # the impact at which each list stands
    lower, seen = np.zeros(len(shard["ids"]), np.int64), np.zeros((len(lists), len(shard["ids"])), bool)
    open_, docs = True, np.zeros(0, np.int64)  # whether a document not yet seen may get in; those that may be among the best
    while stands.any():
        if open_ and len(scores) >= k and stands.sum() < scores[k - 1] and not lower.any():
            break  # nothing of this shard reaches the best so far
        level = stands.max() * 3 // 4
        for i, (doc, impact) in enumerate(lists):
            if stands[i] > level:
                end = place[i] + int(np.searchsorted(-impact[place[i] :], -level, "left"))
                lower[doc[place[i] : end]] += impact[place[i] : end]
                seen[i, doc[place[i] : end]] = True
                read += end - place[i]
                place[i], stands[i] = end, impact[end] if end < len(impact) else 0
        docs = np.flatnonzero(lower) if open_ else docs
        low = lower[docs]
        up = low + stands.sum() - stands @ seen[:, docs]
        known = np.concatenate([low, scores])
        least = np.partition(known, len(known) - k)[len(known) - k] if len(known) >= k else 0
        if open_ and stands.sum() < least:
            open_ = False
        if not open_:
            docs = docs[up >= least]
            stands[seen[:, docs].all(axis=1)] = 0  # these lists can't change a score any more
    docs = docs[lower[docs] > 0]
    ids, scores = np.concatenate([ids, shard["ids"][docs]]), np.concatenate([scores, lower[docs]])
    top = np.lexsort((ids, -scores))[:k]
    return ids[top], scores[top], read


def _searched(items: list[tuple[int, np.ndarray]], weights: np.ndarray, k: int):
    """The k best of all shards of a task for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list = [None] * len(items)
        for batch in slices(batches, 1):
            shard = {c: np.frombuffer(batch.column(i)[0].as_py(), kind) for i, (c, kind) in enumerate(ARRAYS.items())}
            for q, (_, terms) in enumerate(items):
                *best[q], _ = search_shard(shard, terms, weights[terms], k, best[q])
        some = [(item, *b) for (item, _), b in zip(items, best, strict=True) if b is not None and len(b[0])]
        for at in range(0, len(some), 1024):
            part = some[at : at + 1024]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([q for q, *_ in part], [len(f) for _, f, _ in part])), pa.array(np.concatenate([f for _, f, _ in part])), pa.array(np.concatenate([s for *_, s in part]))], names=["item_id", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 10, query_terms: int = QUERY_TERMS, postings: int = POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest score above 0 for each item.

    Terms are runs of digits, letters and characters beyond ASCII, A-Z lower-cased. A term's weight is
    floor(1000 ln((2 N + 2) / (2 df + 1))), times (10**9 tf) div (1000 tf + 8 m) with m = 10 + (90 n N) div L, summed over an
    item's terms, once each; N counts the documents with a term, L their terms. Equal scores rank by the smaller id.
    Null and empty texts have no terms: as items they give no rows, as documents they aren't counted. Rows of a null id are
    no items and no hits, but count in N, L and df. Rows that repeat an item's id are one item of all their terms; rows that
    repeat a document's id are a document each. Other columns aren't read, an empty table on either side gives no rows.

    Items go through the driver in portions of ``query_terms`` terms, whatever their number; for each the documents are read once.
    """
    spark, scratch, hits = docs.sparkSession, Scratch(), []
    both = lambda df, id_, text: df.select(F.col(f"`{id_}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    with batches_of(spark):
        asked = both(items, item_col, item_text_col).where("id is not null").mapInArrow(_asked, "item long, terms array<long>")
        asked = scratch.keep(asked.select("item", F.explode("terms").alias("term")).distinct(), "asked")
        portions = -(-asked.count() // query_terms)
        for portion in range(portions):
            mine = asked.where(F.pmod(F.xxhash64("item"), F.lit(portions)) == portion).orderBy("item", "term").toPandas()
            names, place = np.unique(mine["term"].to_numpy(np.int64), return_inverse=True)
            cut = np.flatnonzero(np.diff(mine["item"].to_numpy(), prepend=np.nan, append=np.nan))
            sent = [(int(mine["item"].iloc[a]), place[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            rows = both(docs, id_col, text_col).mapInArrow(_posted(names), "id long, n long, terms binary, counts binary")
            rows = scratch.keep(rows.where("n > 0").withColumn("uid", F.monotonically_increasing_id()), "postings")
            n_docs, n_terms, total = rows.agg(F.count("*"), F.sum("n"), F.sum(F.octet_length("counts") / 4)).first()
            if not total:
                continue
            df = rows.select("terms").mapInArrow(_frequencies, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
            weights = np.zeros(len(names), np.int64)
            weights[df["term"].to_numpy()] = weight(n_docs, df["df"].to_numpy())
            shards = -(-int(total) // postings)
            index = rows.where("id is not null").withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards))).groupBy("shard").applyInArrow(_shard(n_docs, n_terms), ", ".join(f"{c} binary" for c in ARRAYS))
            index = scratch.keep(index, "index")
            hits.append(scratch.keep(index.mapInArrow(_searched(sent, weights, k), HITS), "hits"))
            scratch.drop(rows, index)
        found = spark.createDataFrame([], HITS)
        for more in hits:
            found = found.union(more)
        order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        out = materialize(best.select("item_id", "rank", "doc_id", "score"), "best")
    scratch.drop()
    return out
