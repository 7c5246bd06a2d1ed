"""The prefix trie against brute force, the centroid rollup against sums over ancestors, running values over hot keys."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from driftlode.llm import centroid, prefixtree, scan
from driftlode.llm.common import Scratch

CONVS = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Rows of the trie of (conv, turn, role, text) tuples."""
    own = {}
    for c, nr, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append(((nr is not None, nr or 0), hashlib.md5(f"{len(role.encode())}:{role}:{text}".encode()).hexdigest(), (role, text)))
    own = {c: [t for *_, t in sorted(v)] for c, v in own.items()}
    members = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append((c, d == len(path)))
    kids = {p: {q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p} for p in members}
    out = []
    for p, cs in members.items():
        under = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in under if q)
        ends = ",".join(map(str, sorted(c for c, last in cs if last)))
        up = min(c for c, _ in members[p[:-1]]) if p else None
        out.append((min(c for c, _ in cs), len(p), up, len(cs), len(kids[p]), sum(not kids[q] for q in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def convs(seed, n=40, deep=14):
    rng, rows = random.Random(seed), []
    for c in range(n):
        for nr in range(rng.randrange(1, deep)):
            rows.append((c, nr, rng.choice(["user", "assistant"]) if seed % 2 else "user", rng.choice(["a", "b", "é"])))
    return rows


def got(spark, rows, **more):
    table = spark.createDataFrame(rows, CONVS)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in prefixtree.trie(table, **more).select(names).collect()), key=str)


@pytest.mark.parametrize("small", [2, 20_000])
def test_trie_equals_brute_force(spark, small):
    rows = convs(1) + convs(4, 60, 4)[::2]
    rows += [(c, k, "user", "same") for c in range(100, 140) for k in range(9)]  # copies
    rows += [(c, k, "user", f"deep {k}") for c in range(200, 212) for k in range(c - 195)]  # each goes on where another ends
    assert got(spark, rows, small=small) == sorted(brute(rows), key=str)


def test_odd_conversations(spark):
    rows = [(1, None, None, None), (1, 0, "", None), (1, None, None, "x"), (1, 5, "user", "é" * 5000), (2, 1, "user", ""), (2, 1, "user", ""), (2, 1, "assistant", ""), (None, 1, "user", "no id"), (10**15, 3, None, "far")]
    rows += [(7, 0, "user", "word " * 20_000), (8, 9, "user", "tie a"), (8, 9, "user", "tie b")]
    assert got(spark, rows) == sorted(brute(rows), key=str)
    assert got(spark, []) == []
    extra = spark.createDataFrame([(1, 0, "u", "t", 5, "x")], CONVS + ", conv long, K1 string")
    assert prefixtree.trie(extra).count() == len(brute([(1, 0, "u", "t")]))


def test_long_lists_of_members(spark):
    """Conversations without common turns but one, and ids of one node in several pieces over several partitions."""
    n = 3 * prefixtree.CHUNK
    members = spark.range(n).select(prefixtree.F.lit(5).cast("long").alias("k1"), prefixtree.F.lit(6).cast("long").alias("k2"), prefixtree.F.col("id").alias("conv"), prefixtree.F.lit(True).alias("last"))
    other = spark.createDataFrame([(7, 8, 3, True), (7, 8, 12, True), (7, 8, 1, False)], members.schema)
    out = {r.k1: r.ends_sha256 for r in prefixtree.ends(members.union(other), Scratch()).collect()}
    assert out == {5: hashlib.sha256(",".join(map(str, range(n))).encode()).hexdigest(), 7: hashlib.sha256(b"3,12").hexdigest()}


def forest(n, seed, kind):
    """Parents, and start, stop and depth of random trees, a path, a star and a comb."""
    rng = random.Random(seed)
    parent = [None if not v or (kind == "trees" and rng.random() < 0.02) else {"trees": rng.randrange(v), "path": v - 1, "star": 0, "comb": v - 1 if v % 2 else max(v - 2, 0)}[kind] for v in range(n)]
    ends = [rng.randrange(1, 4) for _ in range(n)]
    size, kids = ends[:], [[] for _ in range(n)]
    for v in reversed(range(n)):
        if parent[v] is not None:
            size[parent[v]] += size[v]
            kids[parent[v]].insert(0, v)
    start, depth, at = [0] * n, [0] * n, 0
    for v in range(n):
        if parent[v] is None:
            start[v], at = at, at + size[v]
        place = start[v]
        for k in kids[v]:
            start[k], depth[k], place = place, depth[v] + 1, place + size[k]
    return parent, np.array(start), np.array(start) + size, np.array(depth), np.array(ends), np.array(size)


@pytest.mark.parametrize("kind", ["trees", "path", "star", "comb"])
def test_rollup(spark, kind):
    n = 400
    parent, start, stop, depth, own, weight = forest(n, 3, kind)
    value = np.arange(n) % 7
    want = value.copy()
    for v in reversed(range(n)):
        if parent[v] is not None:
            want[parent[v]] += want[v]
    assert (centroid.totals(start, stop, depth, own, np.stack([value, own]))[0] == want).all()
    rows = [tuple(map(int, r)) for r in zip(range(n), start, stop, depth, own, weight, value, strict=True)]
    nodes = spark.createDataFrame(rows, "node long, start long, stop long, depth long, own long, weight long, v long")
    out = centroid.rollup(nodes, ["v"], Scratch(), small=60).collect()
    assert sorted((r.node, r.sum_v) for r in out) == [(k, int(x)) for k, x in enumerate(want)]


def test_running_over_hot_keys(spark):
    rng = random.Random(2)
    rows = [(k, j, rng.randrange(100), rng.getrandbits(60)) for k, n in ((1, 500), (2, 3), (3, 1), (4, 200)) for j in range(n)]
    out = scan.running(spark.createDataFrame(rows, "k long, j long, v long, x long").repartition(5), ["k"], ["j"], {"s": "v"}, {"o": "x"}, Scratch()).collect()
    want, state = {}, {}
    for k, j, v, x in rows:
        s, o = state.get(k, (0, 0))
        state[k] = want[k, j] = (s + v, o ^ x)
    assert {(r.k, r.j): (r.s, r.o) for r in out} == want
