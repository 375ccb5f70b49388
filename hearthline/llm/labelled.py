"""Labelled rows to learn from: a bounded sample that leaves out the held-out fold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, by_class: bool) -> DataFrame:
    """(doc_id, text, label) of at most rows labelled documents (of each class, if by_class), smallest hash of the id first.

    The fold whose crc32(doc_id) mod 4 is 2 never enters. Rows without id or label are passed over; of repeated labels the
    largest counts, of several texts of an id the smallest. The labelled side is bounded by rows, so broadcasting it is safe at any size of docs.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    order = F.xxhash64("doc_id")
    if by_class:
        chosen = known.where("label = 0").orderBy(order, "doc_id").limit(rows).unionByName(known.where("label = 1").orderBy(order, "doc_id").limit(rows))
    else:
        chosen = known.orderBy(order, "doc_id").limit(rows)
    return whole_text(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def logistic(x, y, rounds: int = 60):
    """Weights (last one: bias) of a ridge logistic regression by Newton steps, on standardised columns of x."""
    import numpy as np

    x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
    if not len(y):
        return np.zeros(x.shape[1] + 1)
    mean, std = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / std, np.ones(len(y))]
    w = np.zeros(z.shape[1])
    ridge = np.r_[np.full(x.shape[1], 0.1), 1e-6]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w += step
        if abs(step).max() < 1e-8:
            break
    return np.r_[w[:-1] / std, w[-1] - (w[:-1] * mean / std).sum()]
