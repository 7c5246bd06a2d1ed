"""Ranked search by impact-sorted reads against brute force."""

import math
import random
import re

import numpy as np
import pytest

from driftlode.llm import nra

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    """Rows (item, rank, doc, score) of (id, text) pairs, by the definition."""
    bags = [(i, terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df, asked, out = {}, {}, []
    for _, b in bags:
        for t in set(b):
            df[t] = df.get(t, 0) + 1
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    for item, words in asked.items():
        hits = []
        for i, b in bags:
            m = 10 + (90 * len(b) * n_docs) // n_terms if n_terms else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * b.count(w)) // (1000 * b.count(w) + 8 * m)) for w in words if w in df and b.count(w))
            if i is not None and score > 0:
                hits.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(hits)[:k])]
    return sorted(out)


def got(spark, docs, items, **more):
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, nra.search(d, q, **more).select("item_id", "rank", "doc_id", "score").collect()))


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["ÉTÉ", "été", "Maß", "x-y", "a1_b2"]
    text = lambda: " ".join(rng.choice(words[: rng.choice([3, 15, 45])]) for _ in range(rng.choice([1, 5, 20, 80])))
    docs = [(k, text()) for k in range(n)]
    return docs, [(k, text()) for k in range(12)]


@pytest.mark.parametrize(("seed", "more"), [(1, {}), (2, {"postings": 60}), (3, {"query_terms": 7, "k": 3})])
def test_equals_brute_force(spark, seed, more):
    docs, items = corpus(seed)
    assert got(spark, docs, items, **more) == brute(docs, items, more.get("k", 10))


def test_ties_nulls_and_repeated_rows(spark):
    docs = [(k, "same words here") for k in range(30, 0, -1)] + [(None, "same words here"), (5, "same words here"), (7, None), (8, ""), (9, "--- ...")]
    docs += [(100, "WORDS " * 5000), (101, "nothing of it")]
    items = [(1, "Same WORDS"), (1, "here"), (2, None), (3, "unknown"), (None, "same"), (4, "here here here")]
    rows = got(spark, docs, items, postings=10)
    assert rows == brute(docs, items) and [r[2] for r in rows if r[0] == 4] == [1, 2, 3, 4, 5, 5, 6, 7, 8, 9]
    assert got(spark, docs[:0], items) == [] and got(spark, docs, items[:0]) == []
    extra = spark.createDataFrame([(1, "a b", 3, "c")], "doc_id long, text string, item_id int, rank string")
    assert nra.search(extra, extra).count() == 1


def test_lists_are_left_before_their_end_and_bounds_hold():
    """A document far ahead in all lists: what can't reach the best isn't read to the end; all scores are exact."""
    rng = np.random.default_rng(1)
    n, q = 4000, 6
    gains = [np.sort(rng.integers(1, 1000, n))[::-1] for _ in range(q)]
    order = [np.concatenate([rng.permutation(20), 20 + rng.permutation(n - 20)]) for _ in range(q)]
    for g in gains:
        g[:20] += 5000
    shard = {"ids": np.arange(n) * 3, "words": np.arange(q), "begin": np.arange(q + 1) * n, "doc": np.concatenate(order), "gain": np.concatenate(gains)}
    weights = np.arange(1, q + 1)
    ids, scores, read = nra.search_shard(shard, np.arange(q), weights, 10)
    exact = np.zeros(n, np.int64)
    for o, g, w in zip(order, gains, weights, strict=True):
        exact[o] += g * w
    top = np.lexsort((np.arange(n), -exact))[:10]
    assert ids.tolist() == (top * 3).tolist() and scores.tolist() == exact[top].tolist() and read < q * n / 2
    again = nra.search_shard(shard, np.arange(q), weights, 10, (np.array([-1] * 10), np.full(10, 10**9)))
    assert again[2] == 0 and again[0].tolist() == [-1] * 10  # the first impacts can't reach the best so far


def test_terms_are_bytes_of_the_pattern():
    text = "".join(map(chr, range(0x180))) + " Ünïcode ẞ 漢字 \U0001f600 İ a b c"
    assert [t.decode() for t in nra.terms_of(text)] == terms(text) and nra.terms_of(None) == []
