"""Bounded samples of labelled rows, and a logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UNIT = 1 << 30


def thinned(rows: DataFrame, by: str, each: int) -> DataFrame:
    """About `each` rows of every value of `by`, chosen by a hash of doc_id, so that reruns agree.

    Without ranking: a value's rows pass if their hash is below each / count.  by has few values.
    """
    counts = {r[0]: r[1] for r in rows.where(F.col(by).isNotNull()).groupBy(by).count().collect()}
    passes = F.lit(False)
    for value, n in counts.items():
        passes = F.when(F.col(by) == F.lit(value), F.pmod(F.xxhash64("doc_id"), F.lit(_UNIT)) < min(_UNIT, int(_UNIT * each / n) + 1)).otherwise(passes)
    return rows.where(F.col(by).isNotNull() & passes)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, each: dict | int) -> list[tuple[str, int]]:
    """(text, label) of about `each` training rows of either class, in the order of their ids.

    The chosen ids are few by construction, so they are broadcast and no text is shuffled.
    """
    known = labels.where(learn & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = thinned(known, "y", each)
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return [(r["text"], r["y"]) for r in rows]


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights by Newton's method; the last one is the intercept, which isn't shrunk."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    pull = np.full(x.shape[1], l2)
    pull[-1] = 1e-3
    for _ in range(steps):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull + 1e-9), x.T @ (y - p) - pull * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w
