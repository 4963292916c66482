"""Documents with a label of the `labels` table, and a small logistic fit that several operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import bounded_sample, fold

#: Labels of up to so many documents (16 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def one_label(labels: DataFrame, label: str, id_col: str = "doc_id", out: str = "_label") -> DataFrame:
    """(id, label as int): of several labels of a document the largest; without null ids and labels."""
    return labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).cast("int").alias(out))


def with_label(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", out: str = "_label") -> DataFrame:
    """The documents that have a label, with it as column `out`."""
    own = one_label(labels, label, id_col, out)
    return docs.join(F.broadcast(own) if labels.count() <= BROADCAST_ROWS else own, id_col)


def sample_with_label(docs: DataFrame, labels: DataFrame, label: str, per_label: int, seed: int, folds: tuple[int, ...], id_col: str = "doc_id") -> DataFrame:
    """The documents of a bounded sample of the labels of some folds of five, with column `_label`.

    The sample is drawn from the label table, about `per_label` rows a label, so what is broadcast never
    grows with the corpus and no text is shuffled.
    """
    own = one_label(labels, label, id_col)
    return docs.join(F.broadcast(bounded_sample(own.where(fold(id_col, 5).isin(*folds)), id_col, "_label", per_label, seed)), id_col)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights and bias (last) of a ridge-regularised logistic regression by Newton's method."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        pen = np.full(len(w), ridge)
        pen[-1] = 1e-6
        g = x.T @ (p - y) + pen * w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(pen)
        w -= (step := np.linalg.solve(h, g))
        if np.abs(step).max() < 1e-8:
            break
    return w
