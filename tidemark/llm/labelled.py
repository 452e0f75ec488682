"""Bounded labelled samples and calibration for the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(of: int) -> Column:
    """True where crc32 of the id's text leaves 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == 0, F.lit(False))


def drawn(documents: DataFrame, labels: DataFrame, label: str, most: int, among: Column) -> DataFrame:
    """About `most` rows (doc_id, text, y) at most, chosen by a hash of the id; ids are filtered before the join."""
    lab = labels.where(among & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    n = lab.count()
    if n > most:
        take = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 60)) < (most << 60) // n
        documents, lab = documents.where(take), lab.where(take)
    return documents.where(among).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(lab, "doc_id").select("doc_id", "text", "y")


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a * margin + b))) by Newton's method, with Platt's targets; a is 0 at least."""
    pos, neg = y.sum(), len(y) - y.sum()
    if not len(y):
        return 1.0, 0.0
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    w = np.array([0.0, np.log((pos + 1) / (neg + 1))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - t) + 1e-6 * w)
        step *= min(1.0, 5 / max(1e-12, np.abs(step).max()))
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(w[0])), float(w[1])


def chance(margin: np.ndarray | float, ab: tuple[float, float]) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(ab[0] * np.asarray(margin) + ab[1], -35, 35)))
