"""Toxicity by a classifier chain.

The categories are predicted one after the other: each linear model sees the words
of a text, as hashed presence features, and the probabilities of the categories
before it. In training those probabilities are out of fold, made by models that
did not see the row. Words enter a model only if their link to the category is
significant, so that a long harmless text gathers no score. The categories are
columns of the labels; the last is the one that decides.

Defined results: a null or empty text has the probabilities of a text without any
telling word and isn't toxic; texts of any length are read whole; repeated rows are
scored each; of labels or texts that share an id the largest label and the least
text count; a row without the label of a category isn't shown to its model; a
category with fewer than ``MIN_POSITIVE`` labelled texts gets its share of the
labelled rows as its probability; without any labels nothing is toxic. Other columns
are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship
from .linear import fit_logistic, sigmoid
from .minhash import signatures_of
from .textfeat import words

#: labelled rows that the chain is fitted on, at most
LABELLED_ROWS = 4000
THRESHOLD, FOLDS, MIN_POSITIVE, MIN_TEXTS, MIN_Z = 0.5, 5, 5, 4, 5.0
BITS = 20
#: columns of the labels, in the order of the chain
CATEGORIES = ("quality", "toxic")


@dataclass
class Link:
    """One model of the chain: hashed words with weights, weights of the categories before it, and an intercept."""

    buckets: np.ndarray
    weights: np.ndarray
    chain: np.ndarray
    intercept: float


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and hashed bucket of each different word of each text."""
    rows, buckets = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, _, row, h in words(column):
        key = np.unique((row << BITS) | (h >> np.uint64(64 - BITS)).astype(np.int64))
        rows.append((key >> BITS) + i)
        buckets.append(key & ((1 << BITS) - 1))
    return np.concatenate(rows), np.concatenate(buckets)


def _select(rows: np.ndarray, buckets: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Buckets whose share among positive and other texts differs significantly."""
    size = 1 << BITS
    seen = np.bincount(buckets, minlength=size)
    with_pos = np.bincount(buckets, weights=y[rows], minlength=size)
    at = np.flatnonzero(seen >= MIN_TEXTS)
    pos, n = max(y.sum(), 1), len(y)
    share = seen[at] / n
    spread = np.sqrt(share * (1 - share) * (1 / pos + 1 / max(n - pos, 1)))
    z = (with_pos[at] / pos - (seen[at] - with_pos[at]) / max(n - pos, 1)) / np.maximum(spread, 1e-9)
    return at[np.abs(z) >= MIN_Z]


def _matrix(rows: np.ndarray, buckets: np.ndarray, chosen: np.ndarray, n: int) -> np.ndarray:
    x = np.zeros((n, len(chosen)), np.float32)
    if len(chosen):
        k = np.minimum(np.searchsorted(chosen, buckets), len(chosen) - 1)
        hit = chosen[k] == buckets
        x[rows[hit], k[hit]] = 1
    return x


def _fit(rows: np.ndarray, buckets: np.ndarray, y: np.ndarray, before: np.ndarray) -> Link:
    if y.sum() < MIN_POSITIVE:
        p = min(max(float(y.mean()) if len(y) else 0.0, 1e-4), 1 - 1e-4)
        return Link(np.zeros(0, np.int64), np.zeros(0), np.zeros(before.shape[1]), float(np.log(p / (1 - p))))
    chosen = _select(rows, buckets, y)
    x = np.hstack([_matrix(rows, buckets, chosen, len(y)), before.astype(np.float32)])
    w, b = fit_logistic(x, y, penalty=0.1)
    return Link(chosen, w[: len(chosen)], w[len(chosen) :], b)


def _apply(link: Link, rows: np.ndarray, buckets: np.ndarray, before: np.ndarray) -> np.ndarray:
    score = np.full(len(before), link.intercept) + before @ link.chain
    if len(link.buckets):
        k = np.minimum(np.searchsorted(link.buckets, buckets), len(link.buckets) - 1)
        hit = link.buckets[k] == buckets
        score += np.bincount(rows[hit], weights=link.weights[k[hit]], minlength=len(before))
    return sigmoid(score)


def out_of_fold(rows: np.ndarray, buckets: np.ndarray, y: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The probability of each text by a model fitted without its fold; NaN in ``y`` is no label."""
    n = len(y)
    fold, held = np.arange(n) % FOLDS, np.zeros(n)
    for f in range(FOLDS):
        train = (fold != f) & ~np.isnan(y)
        held[fold == f] = _apply(_fit_rows(rows, buckets, y, before, train), rows, buckets, before)[fold == f]
    return held


def _fit_rows(rows: np.ndarray, buckets: np.ndarray, y: np.ndarray, before: np.ndarray, train: np.ndarray) -> Link:
    """A model of the texts in ``train`` alone."""
    where, inside = np.cumsum(train) - 1, train[rows]
    return _fit(where[rows[inside]], buckets[inside], y[train], before[train])


def fit_chain(texts: list[str | None], labels: np.ndarray) -> list[Link]:
    """Models for each column of ``labels`` (1, 0 or NaN), in order; copies among the texts count once."""
    texts, labels = _once(texts, labels)
    rows, buckets = features(pa.array(texts, pa.string()))
    before = np.zeros((len(texts), 0))
    chain = []
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(np.float64)
        chain.append(_fit_rows(rows, buckets, y, before, ~np.isnan(y)))
        if c + 1 < labels.shape[1]:
            before = np.column_stack([before, out_of_fold(rows, buckets, y, before)])
    return chain


def _once(texts: list[str | None], labels: np.ndarray) -> tuple[list[str | None], np.ndarray]:
    """One text of each group of near copies, lest a copied label count many times."""
    sig, has = signatures_of(pa.array(texts, pa.string()), 24)
    seen: set[bytes] = set()
    keep = []
    for i in range(len(texts)):
        bands = [bytes([b // 3]) + sig[i, b : b + 3].tobytes() for b in range(0, 24, 3)] if has[i] else []
        if not any(b in seen for b in bands):
            keep.append(i)
        seen.update(bands)
    return [texts[i] for i in keep], labels[keep]


def labelled_chain(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", categories: tuple[str, ...] = CATEGORIES, rows: int = LABELLED_ROWS) -> list[Link]:
    """Fit the chain on at most ``rows`` labelled texts, those with the least hash of their id, whose last label is known."""
    names = [f"y{c}" for c in range(len(categories))]
    known = labels.where(F.col(categories[-1]).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*[F.max(F.col(c).cast("int")).alias(n) for c, n in zip(categories, names)])
    chosen = F.broadcast(known.orderBy(F.xxhash64("id"), "id").limit(rows))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("t IS NOT NULL").join(chosen, "id", "left_semi")
    found = texts.groupBy("id").agg(F.min("t").alias("t")).join(chosen, "id").collect()
    found.sort(key=lambda r: r["id"])
    y = np.array([[np.nan if r[n] is None else float(r[n] > 0) for n in names] for r in found]).reshape(len(found), len(names))
    return fit_chain([r["t"] for r in found], y)


def probabilities(spark: SparkSession, text: Column, chain: list[Link], names: tuple[str, ...] = CATEGORIES) -> Column:
    """A struct with the probability of each category; the models' size is bounded by the labelled rows."""
    model = ship(spark, chain)

    def run(column: pa.Array) -> pa.Array:
        rows, buckets = features(column)
        told = np.unique(np.concatenate([link.buckets for link in model()] or [np.zeros(0, np.int64)]))
        if len(told):
            hit = told[np.minimum(np.searchsorted(told, buckets), len(told) - 1)] == buckets
            rows, buckets = rows[hit], buckets[hit]
        else:
            rows, buckets = rows[:0], buckets[:0]
        before = np.zeros((len(column), 0))
        for link in model():
            before = np.column_stack([before, _apply(link, rows, buckets, before)])
        return pa.StructArray.from_arrays([pa.array(before[:, c].astype(np.float64)) for c in range(len(names))], names=list(names))

    return F.arrow_udf(run, T.StructType([T.StructField(n, T.DoubleType()) for n in names]))(text)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Every document's id, its probabilities (``p_`` and the category) and whether it is toxic."""
    chain = labelled_chain(docs, labels, id_col, text_col)
    scored = docs.select(F.col(id_col), probabilities(docs.sparkSession, F.col(text_col), chain).alias("_p"))
    return scored.select(id_col, *[F.col(f"_p.{n}").alias(f"p_{n}") for n in CATEGORIES], (F.col("_p.toxic") >= threshold).alias("is_toxic"))


def without_toxic(docs: DataFrame, corpus: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that the chain, fitted on the labelled rows of ``corpus``, calls toxic."""
    chain = labelled_chain(corpus, labels, id_col, text_col)
    return docs.where(probabilities(docs.sparkSession, F.col(text_col), chain).getField("toxic") < threshold)
