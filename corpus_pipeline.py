"""The corpus pipeline: five stages, each applying one operator to what the stage before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from driftlode.llm import linededup, minhash, packing, secrets, toxicity
from driftlode.llm.common import materialize


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go, with all their rows; the others stay as they are.

    Null and empty texts and rows of a null id are classified like any other; extra columns pass, an empty
    table stays empty.
    """
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that nearly repeat, one stays; documents that lose all their text by that go.

    Null texts, texts that came empty and rows of a null id stay as they are. Rows that repeat id and text lose the
    same lines. Extra columns pass (n_lines and n_removed are the stage's own and go), an empty table stays empty.
    """
    kept = linededup.dedup_lines(docs, chars_col="n_chars", count_cols=True, width=5)
    return kept.where("text is null or text <> '' or n_removed = 0").drop("n_lines", "n_removed")


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate documents, that of the smallest id stays, with all its rows.

    Null and empty texts and rows of a null id stay; extra columns pass, an empty table stays empty.
    """
    return minhash.drop_near_duplicates(docs, words=5, percent=80)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every row stays, and n_chars is the length of the new text.

    Null texts stay null, as their n_chars. Only the columns of documents are returned; an empty table stays empty.
    """
    masked = secrets.mask_secrets(docs)
    return masked.selectExpr("doc_id", "text", "lang", "source", "cast(char_length(text) as bigint) as n_chars")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens, packed into sequences: a row for each piece of a document.

    Null and empty texts are an end id; repeated rows and those of a null id are documents too; extra columns
    aren't read, an empty table gives an empty result.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("minhash", minhash_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: The classifier, MinHash links and tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the documents of ``sf_dir``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
