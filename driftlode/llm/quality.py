"""Quality by hierarchical empirical Bayes: a document's own evidence and that of its host and path.

A logistic model over simple statistics of the text gives each document a probability. Its mean over
a host is shrunk toward the global mean, and that over a path toward its host, the more the
fewer documents there are; how much follows from the spread between sites. The odds of the document
and of its site against the global odds are combined.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlode.llm.common import materialize, small_batches

SAMPLE, STEPS, L2 = 8000, 25, 1e-2
SITE_WEIGHT = 0.25
_ODD = re.compile(r"[^\w\s.,;:'\"()-]+")


def statistics(text: str | None) -> list[float]:
    """Shares of letters, capitals, digits, odd signs, repeated and distinct words, line and word lengths."""
    t = text or ""
    n, words = max(len(t), 1), t.split()
    m = max(len(words), 1)
    lines = [x for x in t.split("\n") if x.strip()]
    odd = _ODD.findall(t)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / m
    letters = sum(map(str.isalpha, t))
    upper = sum(map(str.isupper, t))
    return [
        math.log1p(len(words)), letters / n, upper / max(letters, 1), sum(map(str.isdigit, t)) / n, sum(map(len, odd)) / n, len(odd) / m, again,
        len(set(words)) / m, len(set(words)) / math.sqrt(m), len(set(lines)) / max(len(lines), 1), math.log1p(n / m), math.log1p(n / max(len(lines), 1)),
        (t.count(".") + t.count("!") + t.count("?")) / m, t.count("!") / m, t.count("<") / n + t.count("{") / n, float(not words),
    ]


def _squares(x: np.ndarray) -> np.ndarray:
    return np.column_stack([x, x * x, np.ones(len(x))])


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights of a ridge logistic model, by Newton's steps; classes count alike."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = _squares(np.clip((x - mean) / scale, -6, 6))
    share = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    w = np.zeros(z.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (share * np.maximum(p * (1 - p), 1e-5))[:, None]).T @ z / len(y) + L2 * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (share * (p - y)) / len(y) + L2 * w)
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    return mean, scale, w


def _told(texts: pd.Series) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(len(texts), 16)


def _listed(texts: pd.Series) -> pd.Series:
    return pd.Series(list(_told(texts)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fit on at most ``sample`` labelled documents, those of the smallest id hashes.

    Of labels that repeat an id the largest counts, of documents that do the row whose text has the smallest hash.
    With no label, or labels of one kind, every document scores even odds.
    """
    some = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max("quality").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    told = F.pandas_udf(_listed, "array<double>")
    texts = docs.select(F.col(id_col).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).join(F.broadcast(some), "id")
    got = texts.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("y").alias("y")).select("id", told("text").alias("x"), "y").collect()  # `sample` short rows at most
    got.sort(key=lambda r: r[0])
    y = np.array([r[2] for r in got], float)
    if not len(y) or y.min() == y.max():
        return np.zeros(16), np.ones(16), np.zeros(33)
    return fit(np.array([r[1] for r in got], float), y)


def evidence(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray], text_col: str = "text", out: str = "p_doc") -> DataFrame:
    mean, scale, w = model

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        z = _squares(np.clip((_told(texts) - mean) / scale, -6, 6))
        return pd.Series(1 / (1 + np.exp(-np.clip(z @ w, -9, 9))))

    return docs.withColumn(out, run(F.col(f"`{text_col}`").cast("string")))


def _strength(sites: DataFrame, prior: str) -> float:
    """Pseudo-documents of the prior, by moments: the less sites differ beyond chance, the more. Within 1 and 1000."""
    p, n = F.col("s") / F.col("n"), F.col("n")
    a = sites.agg(F.sum(n * F.pow(p - F.col(prior), 2)), F.count("*"), F.sum(n), F.sum("q")).first()
    if a[1] < 2:
        return 10.0
    within = max(a[3] / a[2], 1e-9)
    between = max(a[0] / a[1] - within, 1e-9) * a[1] / a[2]
    return float(min(max(within / between, 1.0), 1000.0))


def site_posteriors(scored: DataFrame) -> DataFrame:
    """(host, path) with n, host_p, path_p and the global mean, from rows of host, path and p_doc.

    Sums are made by path first, then by host, with partial aggregates; a host of very many
    documents is a few partial sums.
    """
    paths = scored.groupBy("host", "path").agg(F.sum("p_doc").alias("s"), F.count("*").alias("n"), F.sum(F.col("p_doc") * (1 - F.col("p_doc"))).alias("q"))
    paths = materialize(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("q").alias("q"))
    total = hosts.agg(F.sum("s"), F.sum("n")).first()
    mean = min(max(total[0] / total[1], 1e-3), 1 - 1e-3) if total[1] else 0.5
    k = _strength(hosts.withColumn("prior", F.lit(mean)), "prior")
    hosts = hosts.select("host", ((k * mean + F.col("s")) / (k + F.col("n"))).alias("host_p"))
    both = materialize(paths.join(hosts, "host"), "sites")
    k = _strength(both, "host_p")
    return both.select("host", "path", "n", "host_p", ((k * F.col("host_p") + F.col("s")) / (k + F.col("n"))).alias("path_p"), F.lit(mean).alias("global_p"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """One row per document: id, host, path, p_doc, host_p, path_p, quality and keep (quality >= 0.5).

    quality is the combined probability; the site's odds against the global ones count with SITE_WEIGHT
    as exponent. Null hosts and paths are a site each; null and empty texts are scored like any other;
    repeated rows and null ids come back. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    model = train(docs, labels.select(F.col("doc_id").alias(id_col), "quality"), id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"))
    scored = materialize(evidence(rows, model).select("id", "host", "path", "p_doc"), "scored")
    joined = scored.join(site_posteriors(scored), ["host", "path"])
    logit = lambda p: F.ln(F.col(p) / (1 - F.col(p)))
    odds = logit("p_doc") + SITE_WEIGHT * (logit("path_p") - logit("global_p"))
    q = 1 / (1 + F.exp(-odds))
    return joined.select(F.col("id").alias(id_col), "host", "path", "p_doc", "host_p", "path_p", q.alias("quality"), (q >= 0.5).alias("keep"))
