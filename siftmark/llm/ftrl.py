"""FTRL-proximal logistic regression on hashed features, and the samples it learns from."""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Ftrl:
    """Per-coordinate rates; weights whose sums stay within ``l1`` are exactly 0."""

    def __init__(self, size: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros(size)
        self.n = np.zeros(size)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(0.0, np.abs(z) - self.l1)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, label: float, weight: float = 1.0) -> None:
        """One row: ``at`` are its distinct features, each of value 1."""
        w = self.weights(at)
        gradient = weight * (sigmoid(w.sum()) - label)
        more = self.n[at] + gradient * gradient
        self.z[at] += gradient - (np.sqrt(more) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] = more


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def fixed_order(key: Column, seed: int) -> Column:
    """A pseudo-random order of rows that is the same on every run."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def bounded_sample(rows: DataFrame, key: str, most: int, seed: int) -> DataFrame:
    """At most ``most`` rows of a narrow table, the same on every run."""
    return rows.orderBy(fixed_order(F.col(key), seed), key).limit(most)


def sparse(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(weights)
    return at.astype(np.int32), weights[at].astype(np.float32)
