"""Removal of repeated passages against brute force, and its parts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from driftlode.llm import queries, suffixes
from driftlode.llm.common import Scratch


def brute(texts):
    """n_bytes, n_removed, n_spans and kept_sha256 of each text."""
    bodies = [(t or "").encode() for t in texts]
    n = suffixes.LENGTH
    seen = Counter(b[i : i + n] for b in bodies for i in range(len(b) - n + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i + 1 : i + 1 + n] = True
        kept = bytes(x for x, g in zip(b, gone[1:], strict=False) if not g)
        out.append((len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def prose(rng, n):
    return " ".join("".join(rng.choice(["ta", "re", "so", "né", "li", "ku"]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


def corpus(seed):
    rng = random.Random(seed)
    passage, texts = [prose(rng, n) for n in (60, 75, 90, 400)], []
    for k in range(60):
        t = prose(rng, rng.randrange(20, 300))
        if k % 2:
            t += passage[k % 4] + prose(rng, rng.randrange(0, 30))
        if k % 7 == 0 and texts:
            old = list(rng.choice(texts))
            for _ in range(rng.randrange(1, 4)):
                if old:
                    old[rng.randrange(len(old))] = "#"
            t = "".join(old)
        texts.append(t)
    texts += [texts[3], texts[3], texts[5] + "x", "x" + texts[5]]
    texts += [None, "", "short", "short", "z" * 399, "z" * 399, "y" * 400, "y" * 400, "w" * 401, "v" * 1500, "ab" * 700 + "c" + "ab" * 300, passage[0] * 3, "é" * 450]
    return texts


def got(spark, texts, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = suffixes.remove_repeats(docs, keep_text=False, **more).orderBy("doc_id").collect()
    return [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_removal_equals_brute_force(spark, seed):
    texts = corpus(seed)
    assert got(spark, texts) == brute(texts)


def test_long_texts_in_pieces(spark, monkeypatch):
    """Blocks cut at the ends of pieces, and very small buckets; the tasks run in other processes, so the parts are called here."""
    rng = random.Random(5)
    texts = [prose(rng, 2500), prose(rng, 1500)]
    texts.append(texts[0][3000:9000] + prose(rng, 30) + texts[1][100:700])
    want = {(t, f + i, c - f) for t, f, n, c in zip(*(np.concatenate(x).tolist() for x in zip(*whole(texts), strict=True)), strict=True) for i in range(n)}
    monkeypatch.setattr(suffixes, "PIECE", 1 << 12)
    pieces = {(t, f + i, c - f) for t, f, n, c in zip(*(np.concatenate(x).tolist() for x in zip(*whole(texts), strict=True)), strict=True) for i in range(n)}
    assert {x[:2] for x in pieces} == {x[:2] for x in want} and len(pieces) == len({x[:2] for x in pieces})
    assert got(spark, texts) == brute(texts)


def whole(texts):
    bodies = [t.encode() for t in texts]
    return suffixes.blocks(np.frombuffer(b"".join(bodies), np.uint8), np.cumsum([0, *map(len, bodies)]))


def test_order_and_neighbours(spark):
    rng = random.Random(9)
    keys = [bytes(rng.choice([0, 1, 255]) for _ in range(24)) for _ in range(300)] + [b"\1" * 24] * 40
    order, common = suffixes.multikey_order(suffixes._words(suffixes.pa.array(keys, suffixes.pa.binary()), 3))
    assert [keys[i] for i in order] == sorted(keys)
    share = lambda a, b: next((w for w in range(3) if a[8 * w : 8 * w + 8] != b[8 * w : 8 * w + 8]), 3)
    assert common[1:].tolist() == [share(a, b) for a, b in zip(sorted(keys), sorted(keys)[1:], strict=False)]
    rows = spark.createDataFrame([(bytes([k % 256, k // 256]), k, x) for k, x in enumerate(keys)], "text binary, start int, key binary")
    out = suffixes.neighbours(rows, 3, Scratch(), rows_at_once=30).collect()
    most = {k: max(share(x, y) for j, y in enumerate(keys) if j != k) for k, x in enumerate(keys)}
    assert {r.start: max(r.before, r.after) for r in out} == most


def test_texts_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, None, "x", 1), (None, "p" * 500, "y", 2), (4, "p" * 500, "y", 2), (4, "q", None, None), (4, "q", None, None)], "doc_id long, text string, N_bytes string, _own0_text long")
    out = suffixes.remove_repeats(docs)
    assert [c for c in out.columns] == ["doc_id", "_own0_text", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted((r.text is None, r.text or "", r.n_bytes, r.n_removed) for r in out.collect()) == [(False, "", 500, 500), (False, "", 500, 500), (False, "q", 1, 0), (False, "q", 1, 0), (True, "", 0, 0)]
    assert suffixes.remove_repeats(docs.limit(0)).count() == 0
    cut = spark.createDataFrame([(1, "é" + "a" * 450 + "é"), (2, "è" + "a" * 450 + "ù")], "doc_id long, text string")  # the passage begins within a character
    assert {r.doc_id: r.n_removed for r in suffixes.remove_repeats(cut).collect()} == {k: v for k, (_, v, *_) in zip((1, 2), brute([r.text for r in cut.collect()]), strict=True)}


def test_query(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    rows = queries.op13_suffixes(spark, sf_dir).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == brute(texts)
