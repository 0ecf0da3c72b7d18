"""Bounded labelled samples, calibration and the rows that two classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import crc_remainder


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_remainder: int, counts: dict[int, int], max_bytes: int, key: str = "doc_id", text: str = "text") -> list[tuple[str, int]]:
    """At most ``counts[v]`` texts of each label v, of at most ``max_bytes`` bytes, none held out, in a fixed order.

    Labels of rows that say both 0 and 1 are left out. An id has one text, the least if its rows differ, so an id that
    repeats brings no more. The chosen labels are few, so they are broadcast.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & (crc_remainder(F.col(key), modulus) != held_remainder))
    single = known.groupBy(F.col(key).alias("__k")).agg(F.min(label).alias("__v"), F.max(label).alias("__w")).where("__v = __w").select("__k", "__v")
    chosen = [single.where(F.col("__v") == v).orderBy(F.xxhash64("__k"), "__k").limit(n) for v, n in counts.items()]
    picked = chosen[0]
    for c in chosen[1:]:
        picked = picked.union(c)
    texts = docs.where(F.octet_length(F.col(text)) <= max_bytes).select(F.col(key).alias("__id"), F.col(text).cast("string").alias("__t"))
    rows = texts.join(F.broadcast(picked), F.col("__id") == F.col("__k")).groupBy("__k", "__v").agg(F.min("__t").alias("__t")).collect()
    return [(t, v) for _, _, t, v in sorted((hash_order(r["__k"]), str(r["__k"]), r["__t"], int(r["__v"])) for r in rows)]


def hash_order(key) -> int:
    """A fixed shuffle of keys."""
    import zlib

    return zlib.crc32(f"order {key}".encode())


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50, zeros: float = 1.0) -> np.ndarray:
    """Weights and, last, a bias, by Newton's method; the rows of label 0 weigh ``zeros`` times those of label 1."""
    z = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 * zeros / max(1, (y == 0).sum())) * len(y)
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (weight * (p - y)) + penalty * w
        step = np.linalg.solve((z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
