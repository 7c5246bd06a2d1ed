"""The classifier chain and the site posteriors against plain computations of their own."""

import math
import random

import numpy as np
import pytest

from driftlode.llm import queries, quality, toxicity

SF = "/root/testdata/sf0.001"
CATEGORIES = toxicity.CATEGORIES


def plain_features(text):
    """name -> words that have it."""
    import xxhash

    words = {w for w in "".join(c if ord(c) >= 128 or c.isalnum() else " " for c in (text or "")).lower().split() if w} if (text or "").isascii() else None
    if words is None:
        return None
    out = {}
    for w in words:
        for name in [xxhash.xxh3_64_intdigest(w.encode())] + [xxhash.xxh3_64_intdigest(w[:n].encode(), n) for n in toxicity.PREFIXES if len(w) > n]:
            out[name] = out.get(name, 0) + 1
    return out


def test_chain_equals_a_plain_computation(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    chain, threshold = toxicity.train(docs, labels.select("doc_id", "toxic"), CATEGORIES)
    got = toxicity.classify(docs, labels).collect()
    checked = 0
    for r in got:
        have, before = plain_features(r.text), []
        if have is None:
            continue
        for link in chain:
            z = link.bias + sum(w * p for w, p in zip(link.earlier, before, strict=True))
            z += sum(w * math.log2(1 + have[int(n)]) for n, w in zip(link.chosen, link.weights, strict=True) if int(n) in have)
            before.append(1 / (1 + math.exp(-min(max(z, -30), 30))))
        assert [r.p_toxic_en, r.p_toxic_other, r.p_toxic] == pytest.approx(before, abs=1e-5)
        assert r.toxic == (r.p_toxic >= threshold)
        checked += 1
    assert checked > 20


def test_features_counted_in_spark_are_those_chosen_in_one_place(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    chain, _ = toxicity.train(docs, labels.select("doc_id", "toxic"), CATEGORIES)
    rows = docs.join(labels.select("doc_id", "toxic"), "doc_id").orderBy("doc_id").collect()
    found = toxicity.Found.of([toxicity.features(r.text) for r in rows])
    y = np.array([r.toxic == 1 for r in rows], float)
    assert np.array_equal(chain[2].chosen, toxicity.choose(found, np.arange(len(rows)), y))
    # a slow count of one chosen feature
    name = chain[2].chosen[0]
    have = [name in toxicity.features(r.text)[0] for r in rows]
    assert sum(have) >= toxicity.LEAST_DF


def test_earlier_probabilities_come_from_models_that_have_not_seen_the_document():
    rng, seen = np.random.default_rng(1), []
    docs = [(np.sort(rng.choice(np.arange(60, dtype=np.uint64), 9, False)), np.ones(9)) for _ in range(90)]
    y = np.column_stack([[int(d[0][0] < 3) for d in docs], [int(d[0][0] < 3) for d in docs]])
    fit = toxicity._fit

    def watched(found, rows, before, y, chosen=None):
        seen.append((rows, before.copy()))
        return fit(found, rows, before, y, chosen)

    toxicity._fit = watched
    try:
        toxicity.fit_chain(docs, y)
    finally:
        toxicity._fit = fit
    fold, found = np.arange(90) % toxicity.FOLDS, toxicity.Found.of(docs)
    for f in range(toxicity.FOLDS):
        model = fit(found, np.flatnonzero(fold != f), np.zeros((90, 0)), y[:, 0].astype(float))
        for i in np.flatnonzero(fold == f):
            assert seen[-1][1][i, 0] == pytest.approx(model.score(*docs[i], []))


def plain_posteriors(rows):
    """(host, path) -> (host_p, path_p), by the formulas of the moments."""

    def group(key):
        out = {}
        for r in rows:
            s = out.setdefault(key(r), [0.0, 0, 0.0])
            s[0], s[1], s[2] = s[0] + r[2], s[1] + 1, s[2] + r[2] * (1 - r[2])
        return out

    def strength(sites, prior):
        if len(sites) < 2:
            return 10.0
        n = sum(x[1] for x in sites.values())
        within = max(sum(x[2] for x in sites.values()) / n, 1e-9)
        spread = sum(x[1] * (x[0] / x[1] - prior(k)) ** 2 for k, x in sites.items())
        between = max(spread / len(sites) - within, 1e-9) * len(sites) / n
        return min(max(within / between, 1.0), 1000.0)

    hosts, paths = group(lambda r: r[0]), group(lambda r: (r[0], r[1]))
    mean = min(max(sum(r[2] for r in rows) / len(rows), 1e-3), 1 - 1e-3)
    k = strength(hosts, lambda h: mean)
    host_p = {h: (k * mean + x[0]) / (k + x[1]) for h, x in hosts.items()}
    k = strength(paths, lambda p: host_p[p[0]])
    return {p: (host_p[p[0]], (k * host_p[p[0]] + x[0]) / (k + x[1])) for p, x in paths.items()}


def test_site_posteriors_equal_a_plain_computation(spark):
    rng = random.Random(8)
    rows = [(f"h{min(int(rng.expovariate(0.3)), 30)}", f"p{rng.randrange(3)}", rng.betavariate(2, 3)) for _ in range(700)] + [("alone", "", 0.99)]
    want = plain_posteriors(rows)
    got = {(r.host, r.path): (r.host_p, r.path_p) for r in quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, p_doc double")).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9)


def test_quality_combines_the_odds(spark):
    out = queries.op3_quality(spark, SF).collect()
    assert len(out) == spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = [(r.host, r.path, r.p_doc) for r in out]
    want, mean = plain_posteriors(rows), sum(r[2] for r in rows) / len(rows)
    logit = lambda p: math.log(p / (1 - p))
    for r in out:
        assert (r.host_p, r.path_p) == pytest.approx(want[r.host, r.path], abs=1e-9)
        z = logit(r.p_doc) + quality.SITE_WEIGHT * (logit(r.path_p) - logit(mean))
        assert r.quality == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9) and r.keep == (r.quality >= 0.5)


def test_columns_of_the_same_names_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "5 as toxic", "6 as p_toxic", "7 as _own0", "8 as _y", "9 as _p").limit(40)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {(r.toxic, r.p_toxic, r["_own0"], r["_p"]) for r in kept.collect()} == {(5, 6, 7, 9)}
    assert quality.classify(docs, labels).count() == 40


def test_repeated_labels_and_documents_give_one_model(spark):
    """Labels that repeat an id with other values, and an id that very many rows have: the same model as from one row each."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    lower = labels.selectExpr("doc_id", "0L as quality", "cast(null as bigint) as toxic")
    first = labels.orderBy("doc_id").select("doc_id").first()[0]
    hot = docs.where(f"doc_id = {first}").crossJoin(spark.range(500).select()).union(docs)
    sure, unsure = toxicity.train(docs, labels, CATEGORIES), toxicity.train(hot.repartition(5), lower.unionByName(labels.select(lower.columns)).repartition(3), CATEGORIES)
    assert sure[1] == pytest.approx(unsure[1]) and all(np.array_equal(a.chosen, b.chosen) and np.allclose(a.weights, b.weights) for a, b in zip(sure[0], unsure[0], strict=True))
    a, b = quality.train(docs, labels), quality.train(hot, lower.unionByName(labels.select(lower.columns)))
    assert all(np.allclose(x, y) for x, y in zip(a, b, strict=True))
