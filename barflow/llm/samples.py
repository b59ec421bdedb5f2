"""Bounded samples of labelled documents, and the logistic fit that turns counts into a score between 0 and 1."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.operators.stage import materialize

C = F.col


def held_out(key):
    """Whether a document is kept out of fitting: one in five, by the CRC-32 of its key as text."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int, key: str = "doc_id", text: str = "text") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, labels and weights (which give the classes their shares of all fitting labels) of at most ``per_class`` fitting documents of each class, none longer than ``max_chars``.

    They are taken in the order of a hash of their keys, from all labelled documents; what is broadcast and collected is bounded by
    ``2 * per_class`` rows of ``max_chars``.
    """
    known = labels.where(C(label).isin(0, 1) & C(key).isNotNull() & ~held_out(C(key))).groupBy(C(key)).agg(F.max(label).alias("_label"))
    short = docs.where(F.length(text) <= max_chars).select(key, C(text).alias("_text"))
    order = F.xxhash64(C(key), F.lit(17))
    wanted = [known.where(C("_label") == v).orderBy(order, key).limit(2 * per_class) for v in (0, 1)]
    found = materialize(short.join(F.broadcast(wanted[0].unionByName(wanted[1])), key))
    rows = [r for v in (0, 1) for r in found.where(C("_label") == v).orderBy(order, key).limit(per_class).select("_text", "_label").collect()]
    y = np.array([r["_label"] for r in rows], np.int64)
    return [r["_text"] for r in rows], y, class_weights(y, {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()})


def class_weights(y: np.ndarray, counts: dict[int, int]) -> np.ndarray:
    """Weight of each sampled row, so that both classes weigh as much as ``counts`` says; 1 on average."""
    taken = np.maximum(np.bincount(y, minlength=2), 1)
    weight = np.array([counts.get(v, 0) / taken[v] for v in (0, 1)])[y]
    return weight / weight.mean() if len(y) else weight


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights (intercept first) by Newton steps on the penalised log-likelihood; class shares as they are unless ``weight`` is given."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    r = np.ones(len(x)) if weight is None else weight
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(steps):
        p = sigmoid(x @ w)
        change = np.linalg.solve((x * (r * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (r * (y - p)) - penalty @ w)
        w += np.clip(change, -5, 5)
        if np.abs(change).max() < 1e-6:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sigmoid(w[0] + x @ w[1:])
