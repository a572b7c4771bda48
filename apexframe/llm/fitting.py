"""Bounded samples of labelled rows for fitting a classifier on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sampled_ids(ids: DataFrame, rows: int, id_col: str = "doc_id") -> DataFrame:
    """``rows`` ids at most, in the order of a hash, from a narrow table of ids.

    This is the documented bound of a fit: it never limits what is scored.
    """
    order = F.xxhash64(F.col(id_col))
    return ids.where(F.col(id_col).isNotNull()).select(id_col).distinct().orderBy(order, id_col).limit(rows)


def sampled_rows(df: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``df`` with one of the sampled ids; the bounded ids are broadcast."""
    return df.join(F.broadcast(ids), id_col, "left_semi")


def platt(raw: np.ndarray, label: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and offset of the logistic curve that maps raw scores to labels.

    Targets are smoothed, so that separable scores keep a finite slope.
    """
    n1, n0 = float(label.sum()), float(len(label) - label.sum())
    if not len(raw):
        return 1.0, 0.0
    target = np.where(label > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = float(np.std(raw)) or 1.0
    x = np.stack([raw / scale, np.ones(len(raw))], 1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        gradient = x.T @ (p - target) + 1e-6 * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])
