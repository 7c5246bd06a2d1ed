"""MinHash near-duplicates: the registered query against brute force on a whole table, and repeated ids."""

from collections import Counter

import pytest

from driftlode.llm import minhash, queries
from driftlode.llm.components import union_find


def shingles(text, k=4):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))) if w else frozenset()


def brute_links(sets):
    """All pairs that share a shingle and are similar enough, by an inverted index."""
    lists, out = {}, []
    for k, s in enumerate(sets):
        seen = Counter(j for x in s for j in lists.get(x, ()))
        out += [(j, k, c / (len(s) + len(sets[j]) - c)) for j, c in seen.items() if 100 * c >= 80 * (len(s) + len(sets[j]) - c)]
        for x in s:
            lists.setdefault(x, []).append(k)
    return out


def test_the_registered_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    sets = [shingles(r.text) for r in docs]
    links = brute_links(sets)
    near = [x for x in links if 0.8 <= x[2] <= 0.85]
    group = union_find([(docs[a].doc_id, docs[b].doc_id) for a, b, _ in links])
    got = {r.doc_id: r for r in queries.op8_minhash(spark, sf_dir).collect()}
    assert len(near) >= 10 and len(got) == len(docs)
    assert all(got[docs[a].doc_id].component_id == got[docs[b].doc_id].component_id for a, b, _ in near)
    for r, s in zip(docs, sets, strict=True):
        assert (got[r.doc_id].n_shingles, got[r.doc_id].component_id) == (len(s), group.get(r.doc_id, r.doc_id))


def test_the_signature_is_that_of_the_set():
    one, two = (minhash.shingle_set(" ".join(f"w{k}" for k in range(a, a + 6000)), 4) for a in (0, 600))
    same = [int((minhash.signature(x)[0] == minhash.signature(y)[0]).sum()) for x, y in ((one, one), (one, two))]
    assert same[0] == minhash.MINIMA and 30 <= same[1] <= 46  # a similarity of 0.82


def test_an_id_has_the_links_of_all_its_texts(spark):
    text = [" ".join(f"{c}{k}" for k in range(30)) for c in "abc"]
    rows = [(5, text[0]), (5, text[1]), (9, text[0]), (2, text[1] + " more"), (7, text[2]), (5, None), (None, text[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as _own0", "2 as _gone", "3 as node")
    got = [(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs, words=4).collect()]
    assert sorted(got, key=str) == sorted([(5, 2, False)] * 3 + [(9, 2, False), (2, 2, True), (7, 7, True), (None, None, True)], key=str)
    kept = minhash.drop_near_duplicates(docs, words=4)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "7", "None"]


@pytest.mark.parametrize(("few", "joined"), [(1 << 20, "BroadcastHashJoin"), (0, "SortMergeJoin")])
def test_few_lost_ids_go_to_the_texts(spark, monkeypatch, few, joined):
    """The texts aren't shuffled to meet the few ids that go, however large Spark takes their table to be."""
    monkeypatch.setattr(minhash, "FEW", few)
    words = [" ".join(f"w{k}x{n}" for n in range(30)) for k in range(6)]
    docs = spark.createDataFrame([*enumerate(words), (6, words[0]), (7, words[3] + " more"), (None, words[0])], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = minhash.drop_near_duplicates(docs)
        assert {r.doc_id for r in left.collect()} == {None, 0, 1, 2, 3, 4, 5}
        plan = left._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert joined in plan
