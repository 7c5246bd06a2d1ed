"""The registered corpus queries by name: those with SQL against it, the packing against the tokenizer."""

import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest

from driftlode.llm import queries, toxicity


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def sorted_rows(df):
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    a, b = sorted_rows(queries.QUERIES[name](spark, sf_dir).toPandas()), sorted_rows(duck.execute(queries.ORACLE_SQL[name]).df())
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        assert same.all(), (c, a[~same].head(), b[~same].head())


def test_packing_query(spark, sf_dir):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op5_packing(spark, sf_dir).orderBy("doc_id", "piece").collect()
    ids, filled = {k: np.array(coder.encode(t, add_special_tokens=False).ids + [1], "<u4") for k, t in docs.items()}, {}
    seen = dict.fromkeys(docs, 0)
    for r in rows:
        assert r.start == seen[r.doc_id] and r.length == min(4096, len(ids[r.doc_id]) - r.start)
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        seen[r.doc_id] += r.length
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(seen[k] == len(ids[k]) for k in docs)
    for places in filled.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [a for a, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 4096


def test_toxicity_query(spark, sf_dir):
    out = queries.op1_toxicity(spark, sf_dir).collect()
    assert len(out) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(0 <= p <= 1 for r in out for p in (r.p_toxic_en, r.p_toxic_other, r.p_toxic)) and list(toxicity.CATEGORIES) == ["toxic_en", "toxic_other", "toxic"]
