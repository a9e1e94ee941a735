"""The bounded sample of labelled rows that the classifiers are fitted on, and the held-out fold."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on, at most; small enough to broadcast (16 bytes a row).
FIT_ROWS = 20_000


def held_out(doc_id: Column) -> Column:
    """The fold that no classifier learns from: crc32 of the id as text divisible by 5. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and label (double) of at most limit labelled rows outside of the held-out fold.

    The rows with the least hash of their id are taken, one label each; null labels are left out, null texts are empty.
    """
    chosen = (
        labels.select(F.col(id_col).alias("__id"), F.col(label).cast("double").alias("label"))
        .where(F.col("label").isNotNull() & ~held_out(F.col("__id")))
        .groupBy("__id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("__id"), "__id").limit(limit)
    )
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "label")


def logistic(x: np.ndarray, y: np.ndarray, lasso: float = 0.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression with lasso penalty, by accelerated proximal gradient steps."""
    n, k = x.shape
    w, b = np.zeros(k), 0.0
    if not n:
        return w, b
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = (x - mean) / scale
    rate = 4.0 / (np.linalg.norm(z, 2) ** 2 / n + 1.0)
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-np.clip(z @ v + c, -30, 30))) - y
        new = v - rate * (z.T @ error) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * lasso, 0)
        new_b = c - rate * error.mean()
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t_next * (new - w), new_b + (t - 1) / t_next * (new_b - b)
        w, b, t = new, new_b, t_next
    return w / scale, float(b - (w / scale) @ mean)
