"""Bounded samples of labelled rows, and a logistic fit, for the trained operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondeo.llm.words import column, text_or_empty


def held_out(key: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the key as text leaves remainder ``part``; a null key is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == part, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, excluded, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """At most ``rows`` labelled documents that are not ``excluded``: label 0 or 1, fold (0 to 9) and t, the text's bytes.

    The labels with the smallest hashes of their ids are taken, so the sample does not depend on the order of rows; the
    chosen ids, at most ``rows`` of them, are broadcast. Null ids and labels, and ids that are not in ``docs``, give none.
    """
    ids = labels.select(column(labels, id_column).alias("_id"), column(labels, label).cast("int").alias("label"))
    ids = ids.filter(F.col("_id").isNotNull() & F.col("label").isin(0, 1) & ~excluded(F.col("_id")))
    chosen = ids.withColumn("_h", F.xxhash64("_id")).orderBy("_h", "_id", "label").limit(rows)
    texts = docs.select(column(docs, id_column).alias("_key"), text_or_empty(column(docs, text_column)).cast("binary").alias("t"))
    fold = F.pmod(F.xxhash64(F.lit("fold"), "_id"), F.lit(10)).cast("int")
    return texts.join(F.broadcast(chosen), F.col("_key") == F.col("_id")).select("label", fold.alias("fold"), "t")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic model with a constant last column, by damped Newton steps on smoothed targets."""
    x = np.column_stack([x, np.ones(len(x))])
    pos, neg = float((y == 1).sum()), float((y == 0).sum())
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - target) + ridge * w
        hessian = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(x: float | np.ndarray):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
