"""Toxicity by a classifier chain of linear models.

The categories are predicted one after the other. Each model sees the words of a document and the
probabilities of the categories before it. In training these probabilities come from models that
haven't seen the document (out-of-fold), as they will when new documents are scored. Features are counted by
fold and category in Spark; the driver gets, of at most SAMPLE documents, those few features that a model may use.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlode.llm.common import Scratch, free_name, slices, small_batches

SAMPLE = 5000  # labelled documents that the models are fitted on, at most
FEATURES, LEAST_DF, FOLDS, STEPS, L2 = 400, 4, 3, 10, 0.3
PREFIXES = (4, 5, 7)
_SPACES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct words of a text and of their first bytes, each with log2(1 + words that have it)."""
    words = set((text or "").encode("utf-8", "surrogatepass").lower().translate(_SPACES).split())
    names = [xxhash.xxh3_64_intdigest(w) for w in words]
    for n in PREFIXES:
        names += [xxhash.xxh3_64_intdigest(w[:n], n) for w in words if len(w) > n]
    found, count = np.unique(np.array(names, np.uint64), return_counts=True)
    return found, np.log2(1.0 + count)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Link:
    """One model of the chain: chosen features, their weights, weights of earlier categories, bias."""

    chosen: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def score(self, found: np.ndarray, value: np.ndarray, before: list[float]) -> float:
        total = self.bias + float(self.earlier @ np.array(before))
        if len(self.chosen):
            at = np.searchsorted(self.chosen, found)
            at[at == len(self.chosen)] = 0
            hit = self.chosen[at] == found
            total += float(self.weights[at[hit]] @ value[hit])
        return float(_sigmoid(np.array(total)))


@dataclass
class Found:
    """The features of all sampled documents, as three arrays in the order of documents."""

    names: np.ndarray
    owner: np.ndarray
    code: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, docs: list[tuple[np.ndarray, np.ndarray]]) -> Found:
        names, code = np.unique(np.concatenate([d[0] for d in docs]) if docs else np.zeros(0, np.uint64), return_inverse=True)
        return cls(names, np.repeat(np.arange(len(docs), dtype=np.int32), [len(d[0]) for d in docs]), code.astype(np.int32), np.concatenate([d[1] for d in docs]) if docs else np.zeros(0))


def tell(n, pos, rate: float, by=np):
    """How many standard deviations the documents of a category among those with a feature are away from their share; arrays, or columns with ``by`` as F."""
    return by.abs(pos - n * rate) / by.sqrt(n * rate * (1 - rate) + 1e-9)


def choose(found: Found, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The names of the FEATURES features that tell most about ``y`` of ``rows``; equal ones by name."""
    mine = np.isin(found.owner, rows)
    n, pos = (np.bincount(found.code[mine], weights=w, minlength=len(found.names)) for w in (None, y[found.owner[mine]]))
    told = np.where(n >= LEAST_DF, tell(n, pos, y[rows].mean()), 0)
    top = np.lexsort((found.names.view(np.int64), -told))[:FEATURES]
    return np.sort(found.names[top[told[top] > 0]])


def _fit(found: Found, rows: np.ndarray, before: np.ndarray, y: np.ndarray, chosen: np.ndarray | None = None) -> Link:
    """Fit a ridge logistic model of the chosen features to ``rows`` by Newton's steps."""
    if not len(rows) or y[rows].min() == y[rows].max():
        return Link(np.zeros(0, np.uint64), np.zeros(0), np.zeros(before.shape[1]), -5.0 if not len(rows) or not y[rows].max() else 5.0)
    chosen = choose(found, rows, y) if chosen is None else np.intersect1d(chosen, found.names)
    at = np.full(len(found.names), -1, np.int32)
    at[np.searchsorted(found.names, chosen)] = np.arange(len(chosen), dtype=np.int32)
    place = np.full(len(y), -1, np.int32)
    place[rows] = np.arange(len(rows), dtype=np.int32)
    own = (place[found.owner] >= 0) & (at[found.code] >= 0)
    k, y = before.shape[1], y[rows]
    x = np.zeros((len(rows), len(chosen) + k + 1))
    x[place[found.owner[own]], at[found.code[own]]] = found.value[own]
    x[:, len(chosen) : len(chosen) + k] = before[rows]
    x[:, -1] = 1
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], L2)
    ridge[-1] = 1e-6
    for _ in range(STEPS):
        p = _sigmoid(x @ w)
        slope = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ x + np.diag(ridge), slope)
        w = w - step
        if np.abs(step).max() < 1e-3:
            break
    return Link(chosen, w[: len(chosen)], w[len(chosen) : -1], float(w[-1]))


def fit_chain(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, fold: np.ndarray | None = None, chosen: dict | None = None) -> tuple[list[Link], float]:
    """The chain for ``labels`` (documents x categories), and the threshold for the last category that
    makes the F1 of its out-of-fold probabilities largest (between 0.2 and 0.8).

    ``chosen``: names of features by category and fold left out (-1: none); chosen here unless given."""
    fold, found = np.arange(len(docs)) % FOLDS if fold is None else fold, Found.of(docs)
    before, chain = np.zeros((len(docs), 0)), []
    for c in range(labels.shape[1]):
        y, p = labels[:, c].astype(float), np.zeros(len(docs))
        for f in range(FOLDS):
            model = _fit(found, np.flatnonzero(fold != f), before, y, chosen and chosen[c, f])
            for i in np.flatnonzero(fold == f):
                p[i] = model.score(*docs[i], list(before[i]))
        chain.append(_fit(found, np.arange(len(docs)), before, y, chosen and chosen[c, -1]))
        before = np.column_stack([before, p])
    grid = np.arange(0.2, 0.81, 0.05)
    f1 = [2 * (y[p >= t]).sum() / max(y.sum() + (p >= t).sum(), 1) for t in grid] if len(docs) else [0.0]
    return chain, round(float(grid[int(np.argmax(f1))]) if max(f1) > 0 else 0.5, 2)


def predict(chain: list[Link], found: np.ndarray, value: np.ndarray) -> list[float]:
    out: list[float] = []
    for link in chain:
        out.append(link.score(found, value, out))
    return out


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [features(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0].tobytes() for r in rows], pa.binary()), pa.array([r[1].astype("<f4").tobytes() for r in rows], pa.binary()), batch.column(2), batch.column(3)], names=["id", "found", "value", "fold", "y"])


def _counted(categories: int):
    """Of a batch: documents with each feature by fold, and those of each category among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            found = [np.frombuffer(x, "<i8") for x in batch.column(1).to_pylist()]
            names, code = np.unique(np.concatenate(found), return_inverse=True)
            owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
            fold, y = batch.column(3).to_numpy(), np.array(batch.column(4).to_pylist()).reshape(-1, categories)
            both = [np.bincount(code, weights=((fold == f) * w)[owner], minlength=len(names)).astype(np.int64) for f in range(FOLDS) for w in (np.ones(len(fold)), *y.T)]
            yield pa.RecordBatch.from_arrays([pa.array(names), *map(pa.array, both)], names=["name", *_counts(categories)])

    return run


def _counts(categories: int) -> list[str]:
    """Names of the counts: n of a fold, then those of its categories."""
    return [f"n{f}" + f"_{c}" * (c >= 0) for f in range(FOLDS) for c in range(-1, categories)]


def _thinned(chosen: np.ndarray):
    """Documents with their chosen features only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[], []]
            for found, value in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                on = np.isin(np.frombuffer(found, "<i8"), chosen)
                out[0].append(np.frombuffer(found, "<i8")[on].tobytes())
                out[1].append(np.frombuffer(value, "<f4")[on].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.binary()) for x in out), batch.column(3), batch.column(4)], names=["id", "found", "value", "fold", "y"])

    return run


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[list[Link], float]:
    """Fit the chain on at most ``sample`` labelled documents, those of the smallest id hashes.

    ``categories``: name -> SQL condition over the columns of documents and labels; null counts as false. Of labels that repeat an
    id the largest value of each column counts, of documents that do the one row whose text has the smallest hash.
    The threshold comes with it. Without labelled documents nothing is rejected.
    """
    scratch, m = Scratch(), len(categories)
    once = labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(*(F.max(f"`{c}`").alias(c) for c in labels.columns if c != id_col))
    told = docs.join(F.broadcast(once.orderBy(F.xxhash64(id_col), id_col).limit(sample)), id_col)  # `sample` ids at most
    fold = F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.lit("fold")), F.lit(FOLDS)).cast("int")
    each = told.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), fold.alias("fold"), F.array(*[F.coalesce(F.expr(c).cast("int"), F.lit(0)) for c in categories.values()]).alias("y"))
    rows = each.groupBy("id").agg(F.min_by(F.struct("text", "fold", "y"), F.xxhash64("text", "y")).alias("r")).select("id", "r.text", "r.fold", "r.y")
    shape = "id long, found binary, value binary, fold int, y array<int>"
    known = scratch.keep(rows.mapInArrow(_extract, shape), "features")
    classes = known.groupBy("fold").agg(F.count("*"), *[F.sum(F.get("y", F.lit(c))) for c in range(m)]).collect()  # FOLDS rows
    of = {r[0]: np.array(r[1:], float) for r in classes}
    counts = known.mapInArrow(_counted(m), ", ".join(["name long", *(f"{c} long" for c in _counts(m))]))
    counts = scratch.keep(counts.groupBy("name").agg(*[F.sum(c).alias(c) for c in _counts(m)]).where(" + ".join(f"n{f}" for f in range(FOLDS)) + f" >= {LEAST_DF}"), "counts")
    best = None
    for c in range(m):
        for out in (*range(FOLDS), -1):
            kept = [f for f in range(FOLDS) if f != out]
            size, pos = (sum((of[f][i] for f in kept if f in of), 0.0) for i in (0, c + 1))
            n, p = (sum((F.col(f"n{f}{mark}") for f in kept), F.lit(0)) for mark in ("", f"_{c}"))
            rank = counts.where(n >= LEAST_DF).select(F.lit(c).alias("c"), F.lit(out).alias("out"), "name", tell(n, p, pos / size if size else 0.0, F).alias("tell"))
            rank = rank.where("tell > 0").orderBy(F.desc("tell"), "name").limit(FEATURES)
            best = rank if best is None else best.union(rank)
    names = best.toPandas()  # FEATURES rows for each category and fold
    chosen = {(c, out): np.sort(names.name[(names.c == c) & (names.out == out)].to_numpy(np.int64).view(np.uint64)) for c in range(m) for out in (*range(FOLDS), -1)}
    got = known.mapInArrow(_thinned(np.unique(names.name.to_numpy(np.int64))), shape).collect()
    got.sort(key=lambda r: (r[0], r[1], r[2]))
    y, fold = np.array([r[4] for r in got], np.float32).reshape(-1, m), np.array([r[3] for r in got], np.int64)
    scratch.drop()
    return fit_chain([(np.frombuffer(r[1], np.uint64), np.frombuffer(r[2], "<f4")) for r in got], y, fold, chosen)


def score(docs: DataFrame, chain: list[Link], names: list[str], out: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``out``, a struct of p_<name> of each category. Null and empty texts get what the bias alone gives."""

    @F.pandas_udf(", ".join(f"p_{n} double" for n in names))
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [predict(chain, *features(t)) for t in texts]
        return pd.DataFrame(np.array(rows, float).reshape(-1, len(names)), columns=[f"p_{n}" for n in names])

    return docs.withColumn(out, run(F.col(f"`{text_col}`").cast("string")))


# The categories that the labels give: toxic documents of the main language, of the others, and all.
CATEGORIES = {"toxic_en": "toxic = 1 and lang = 'en'", "toxic_other": "toxic = 1 and lang <> 'en'", "toxic": "toxic = 1"}


def _classified(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str, float]:
    """``docs`` with a struct of the probabilities under a name of its own, that name, and the threshold."""
    small_batches(docs.sparkSession)
    chain, threshold = train(docs.drop("toxic", "quality"), labels.select(F.col("doc_id").alias(id_col), "toxic"), CATEGORIES, id_col, text_col)
    own = free_name(docs)
    return score(docs, chain, list(CATEGORIES), own, text_col), own, threshold


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with p_toxic_en, p_toxic_other, p_toxic and toxic, true from the fitted threshold on.

    Every row comes back, repeated ones and those of null ids too; null and empty texts are scored by the bias.
    Columns of these four names are replaced, all others stay. An empty table stays empty.
    """
    out, own, threshold = _classified(docs, labels, id_col, text_col)
    return out.withColumns({f"p_{n}": F.col(f"{own}.p_{n}") for n in CATEGORIES} | {"toxic": F.col(f"{own}.p_toxic") >= threshold}).drop(own)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't classified as toxic, with all their columns as they are.

    Rows of a null id and null or empty texts are classified like any other; an empty table stays empty.
    """
    out, own, threshold = _classified(docs, labels, id_col, text_col)
    return out.where(F.col(f"{own}.p_toxic") < threshold).drop(own)
