"""Labelled rows for the classifiers: a bounded, documented sample that never holds out-of-fold rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on, about: the bound on what the driver sees.
MAX_LABELLED = 20_000
#: Fixed value: rows whose crc32(doc_id as text) is divisible by it are held out.
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Never learnt from; a null doc_id has no label and counts as not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, column: str, bound: int = MAX_LABELLED) -> DataFrame:
    """(text, label) of about `bound` labelled rows at most, by a hash of doc_id; equal texts count once, labelled by their largest label.

    Labels are thinned by the hash first: about `bound` rows are left, which are broadcast and
    meet the texts in the scan, so that no other text is shuffled.
    """
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    share = min(1.0, bound / max(1, known.count()))
    thin = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))
    texts = docs.where(thin).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(known.where(thin)), "doc_id").groupBy("text").agg(F.max("label").alias("label"))


def platt(margins: np.ndarray, labels: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """a, b of P(1) = 1 / (1 + exp(-(a * margin + b))), by Newton steps with smoothed targets."""
    pos, neg = int(labels.sum()), int(len(labels) - labels.sum())
    goal = np.where(labels > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margins, np.ones(len(margins))], 1)
    w = np.array([0.0, np.log((pos + 1) / (neg + 1))])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - goal) + 1e-3 * w * [1, 0])
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
