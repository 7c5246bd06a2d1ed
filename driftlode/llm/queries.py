"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlode.llm import bm25, epsjoin, linededup, minhash, nra, oracles, packing, prefixtree, quality, secrets, spm, suffixes, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return toxicity.classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "p_toxic_en", "p_toxic_other", "p_toxic", "toxic")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = secrets.base_spans(F.col("secrets"))
    counts = [secrets.count_of("secrets", kind).alias(f"n_{kind}") for kind, _, _ in secrets.BASE]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("secrets")).alias("spans"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return quality.classify(docs, table(spark, sf_dir, "labels"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep_ids=False)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epsjoin.near_embeddings(table(spark, sf_dir, "embeddings"))


def op7_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bm25.top_k(docs, docs.where("doc_id % 100 = 0")).withColumn("score", F.round("score", 6))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), count_cols=True, width=5)
    return kept.select("doc_id", "n_lines", "n_removed", "text")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.convert_pages(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "url", "date", "mime")


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nra.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtree.trie(table(spark, sf_dir, "conversations"))


def op13_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_secrets": op2_secrets,
    "op3_quality": op3_quality,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_packing": op5_packing,
    "op6_embeddings": op6_embeddings,
    "op7_bm25": op7_bm25,
    "op8_minhash": op8_minhash,
    "op9_linededup": op9_linededup,
    "op10_warc": op10_warc,
    "op11_ranked": op11_ranked,
    "op12_trie": op12_trie,
    "op13_suffixes": op13_suffixes,
}

#: The others have none: models, tokenizers, a packing that isn't the only one, entropies of sliding windows, hashes of bytes that are no text.
ORACLE_SQL: dict[str, str] = {
    "op6_embeddings": oracles.EMBEDDINGS,
    "op7_bm25": oracles.BM25,
    "op8_minhash": oracles.MINHASH,
    "op9_linededup": oracles.LINES,
    "op10_warc": oracles.WARC.format(namespace=warc.NAMESPACE.hex),
    "op11_ranked": oracles.RANKED,
    "op12_trie": oracles.TRIE,
}
