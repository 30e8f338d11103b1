"""Labelled training rows, and logistic regression in NumPy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels of rows whose crc32(doc_id as text) leaves this remainder modulo 4 are never learnt from.
HELD_OUT = 2
#: Features that fit_sparse() works on at once.
_PIECE = 1 << 20


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row's label is held out; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(label, text) of a sample of labelled documents, `most` of each class at most, in one partition.

    The sample is the rows with the least hashes of their doc_id.  Null labels and
    ids are left out; a doc_id with several labels counts with the greatest.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    order = [F.xxhash64("id"), F.col("id")]
    chosen = known.where("y = 0").orderBy(*order).limit(most).unionByName(known.where("y = 1").orderBy(*order).limit(most))
    # bounded by `most` of each class
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # all tasks look for them; only what was chosen goes on to the one that fits
    return texts.join(F.broadcast(chosen), "id").select("y", "text").repartition(1)


def base_rate(labels: DataFrame, label: str) -> float:
    """Share of label 1 among the labels that may be learnt from; 0.5 if there is none."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    rate = known.agg(F.avg(F.col(label).cast("double"))).first()[0]
    return 0.5 if rate is None else float(rate)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def fit_dense(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression, the intercept last, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ w)
        grad = x.T @ (p - y) + penalty * w
        hess = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-7:
            break
    return w


def fit_sparse(first: np.ndarray, col: np.ndarray, scale: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression by accelerated gradient steps.

    Row i has the features col[first[i] : first[i + 1]], each with its value in `scale`.
    Rows are worked on in pieces, so that temporary arrays stay small.
    """
    n, n_cols = len(y), len(scale)
    cuts = [0]
    while cuts[-1] < n:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(first, first[cuts[-1]] + _PIECE, "right")) - 1))
    pieces = [(a, min(b, n)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    sizes = np.diff(first)

    def forward(v: np.ndarray, c: float) -> np.ndarray:
        u = v * scale
        out = np.full(n, c)
        for a, b in pieces:
            doc = np.repeat(np.arange(b - a), sizes[a:b])
            out[a:b] += np.bincount(doc, u[col[first[a] : first[b]]], b - a)
        return out

    def back(e: np.ndarray) -> np.ndarray:
        out = np.zeros(n_cols)
        for a, b in pieces:
            out += np.bincount(col[first[a] : first[b]], np.repeat(e[a:b], sizes[a:b]), n_cols)
        return out * scale

    # the largest curvature, by power iteration from a vector of ones
    v, c, top = np.ones(n_cols), 1.0, 1.0
    for _ in range(8):
        e = forward(v, c)
        v, c = back(e), e.sum()
        top = max(np.sqrt(v @ v + c * c), 1e-12)
        v, c = v / top, c / top
    rate = 1 / (0.25 * 1.1 * top / n + ridge / n)
    w, b = np.zeros(n_cols), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    v, c = w, b
    for t in range(rounds):
        e = (sigmoid(forward(v, c)) - y) / n
        new_w, new_b = v - rate * (back(e) + ridge / n * v), c - rate * e.sum()
        m = t / (t + 3)
        v, c = new_w + m * (new_w - w), new_b + m * (new_b - b)
        w, b = new_w, new_b
    return w, b
