"""Near-duplicate lines that one small change sets apart."""

from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from driftlode.llm import linededup, queries
from driftlode.llm.components import union_find

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ONE = "the quick brown fox jumps over the lazy dog by the old stone bridge"
TWO = ONE.replace("fox", "fix")
FAR = "a line of its own that has nothing to do with any other line here"


def brute(rows, width, percent=80):
    lines = sorted({x for _, t in rows for x in t.split("\n") if x.strip()})
    sets = [{x[i : i + width] for i in range(max(len(x) - width + 1, 1))} for x in lines]
    pairs = [(i, j) for i in range(len(lines)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    group, seen, gone = union_find(pairs), set(), Counter()
    for doc, t in sorted(rows):
        for x in t.split("\n"):
            if x.strip():
                k = lines.index(x)
                gone[doc] += group.get(k, k) in seen
                seen.add(group.get(k, k))
    return +gone


@pytest.mark.parametrize("width", [5, 7, 10])
def test_any_width_equals_brute_force(spark, width):
    rows = [(k, f"{ONE[: 20 + k]}{chr(97 + k)}{ONE[21 + k :]}\n{FAR[k:]}\n{k}") for k in range(30)]
    want = brute(rows, width)
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), count_cols=True, width=width).collect()
    assert {r.doc_id: r.n_removed for r in got if r.n_removed} == dict(want)


def test_query_and_stage_link_lines_that_differ_in_a_letter(spark, tmp_path):
    docs = spark.createDataFrame([(1, f"{ONE}\nx", "en", "s", 0), (2, f"{TWO}\n{FAR}", "en", "s", 0)], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {1: f"{ONE}\nx", 2: FAR}
    assert {r.doc_id: r.text for r in queries.op9_linededup(spark, str(tmp_path)).collect()} == want
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup_stage(spark, docs, str(tmp_path)).collect()} == want


def test_stage_keeps_texts_that_came_empty(spark):
    docs = spark.createDataFrame([(1, ONE, "en", "s", len(ONE)), (2, ONE, "en", "s", len(ONE)), (3, "", "en", "s", 0), (4, None, "en", "s", 0)], DOCS)
    got = corpus_pipeline.line_dedup_stage(spark, docs, "")
    assert got.columns == docs.columns and {r.doc_id: r.text for r in got.collect()} == {1: ONE, 3: "", 4: None}


def test_rows_that_repeat_an_id_lose_no_line(spark):
    a, b, c = (x * 3 for x in (ONE, FAR, "c line of the second row, under the same id as the first "))
    rows = [(7, f"{a}\n{b}"), (7, f"{b}\n{c}"), (7, f"{b}\n{c}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "5 as _own0_doc", "6 as _removed", "7 as row")
    got = linededup.dedup_lines(docs, width=5)
    assert got.columns == docs.columns
    texts = sorted(r.text for r in got.collect())
    assert len(texts) == 3 and len(set(texts)) == 2 and {x for t in texts for x in t.split("\n")} == {a, b, c}
    assert {(r["_own0_doc"], r["_removed"], r.row) for r in got.collect()} == {(5, 6, 7)}


def test_a_document_of_very_many_lines(spark):
    """Half of 60,000 lines go, in linear time."""
    import time

    lines = [f"{k % 30_000:06d} stands here and {k % 30_000 * 7919} follows" for k in range(60_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    gone = spark.createDataFrame([(1, list(range(30_000, 60_000)))], "doc long, removed array<int>").join(docs.selectExpr("doc_id as doc", "xxhash64(text) as row"), "doc").select("doc", "row", "removed")
    began = time.time()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(linededup, "removed_lines", lambda *_: gone)
        (row,) = linededup.dedup_lines(docs, count_cols=True).collect()
    assert time.time() - began < 30 and row.text == "\n".join(lines[:30_000]) and (row.n_lines, row.n_removed) == (60_000, 30_000)


def test_sets_are_made_once_for_several_blocks():
    from driftlode.llm import collisions

    rng = np.random.default_rng(5)
    lines = ["".join(rng.choice(list("abcdefgh"), 60)) for _ in range(8)]
    lines[7] = lines[0][:-1] + "z"
    asked = []

    def shingles(full):
        asked.extend(full)
        return linededup.shingle_sets(full, 5)

    run = collisions._compared(0, 80, shingles)
    table = pa.table({"node": np.arange(8), "c": np.arange(8), "left": np.arange(8) < 4, "sketch": [collisions.sketch(0, np.zeros(48, np.uint8))] * 8, "full": lines})
    assert [run(table).to_pydict() for _ in range(3)] == [{"a": [0], "b": [7]}] * 3
    assert sorted(asked) == sorted(lines)


def test_chunks_and_empty_bins_give_the_same_minima():
    rng = np.random.default_rng(6)
    lines = ["".join(rng.choice(list("abcdefghij"), n)) for n in (3, 5, 6, 9, 14, 40, 150, 700, 5000)] * 3
    lines += ["".join(rng.choice(list("abcdefghij"), 3000)) for _ in range(60)]
    for line, row in zip(lines, linededup.minima(lines, 5), strict=True):
        low = {}
        for h in linededup.shingle_set(line, 5).tolist():
            at = (h >> 40) * linededup.BINS >> 24
            low[at] = min(low.get(at, 2**64), h & (2**40 - 1))
        full = sorted(low)
        for at in range(linededup.BINS):
            took = [p for p in [at, *linededup._BORROW[:, at].tolist()] if p in low]
            took = took[0] if took else next((f for f in full if f > at), full[0])
            assert row[at] == low[took]
    for line, got in zip(lines, linededup.shingle_sets(lines, 5), strict=True):
        assert got.tolist() == linededup.shingle_set(line, 5).tolist()
