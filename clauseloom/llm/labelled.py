"""Bounded samples of labelled documents and calibration, shared by the two classifiers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> F.Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def held_out(id_col: str, folds: int, out: int) -> F.Column:
    return F.coalesce(fold(id_col, folds) == out, F.lit(False))


def highest(labels: DataFrame, label: str, id_col: str, folds: int, out: int) -> DataFrame:
    """_id and _y, the larger label, of ids outside the held-out fold; null labels don't count."""
    usable = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, folds, out))
    return usable.groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("_y"))


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, out: int, rows: int, id_col: str, text_col: str, also: list[str]) -> list:
    """At most `rows` labelled documents outside the held-out fold, the first by a hash of the id: (label, text, *also, id, id as text).

    A document labelled more than once has the larger label; null labels don't count.
    """
    chosen = highest(labels, label, id_col, folds, out).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), *[F.col(c).alias(f"_{c}") for c in also])
    met = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))  # `rows` rows at most
    got = met.select("_y", "_text", *[f"_{c}" for c in also], "_id", F.col("_id").cast("string").alias("_name"))
    return got.orderBy(F.xxhash64("_id"), F.xxhash64("_text")).limit(rows).collect()


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def platt(z: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(a, b) of sigmoid(a z + b) by Newton steps on smoothed labels; z's own sign and scale where a class is absent."""
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 1) / (len(y) + 2)
        return 0.0, float(np.log(rate / (1 - rate)))
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([z, np.ones_like(z)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - t) + 1e-3 * (w - [1.0, 0.0]))
        w = w - np.clip(step, -2, 2)
    return float(w[0]), float(w[1])


def best_bin(counts: pd.DataFrame, per_unit: int) -> float:
    """The score between neighbouring bins (rows n, of them hits; per_unit bins for each unit of log-odds) with the highest F1."""
    c = counts.groupby("bin")[["n", "hits"]].sum().sort_index(ascending=False)
    hit = c["hits"].to_numpy().cumsum()
    k = int((2 * hit / (c["n"].to_numpy().cumsum() + hit[-1])).argmax())
    low = sigmoid(c.index[k] / per_unit)
    return float((low + (sigmoid((c.index[k + 1] + 1) / per_unit) if k + 1 < len(c) else 0)) / 2)
