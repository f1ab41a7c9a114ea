"""What the classifiers share: bounded samples of labelled rows, and logistic weights fitted on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: Labelled rows that a model is fitted on, at most in expectation; the classes share this number evenly.
SAMPLE_ROWS = 4000


def unit_hash(seed: int, *columns: Column | str) -> Column:
    """A value from 0 to 1 that depends on the columns and the seed alone."""
    return F.xxhash64(F.lit(seed), *columns).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))


def class_counts(rows: DataFrame, label: str) -> dict:
    """How many rows each class has. Classes are few: their number is that of a configuration."""
    return {r[0]: r[1] for r in rows.filter(F.col(label).isNotNull()).groupBy(label).count().collect()}


def bounded_sample(rows: DataFrame, label: str, counts: dict, key: str = "doc_id", most: int = SAMPLE_ROWS, seed: int = 3) -> DataFrame:
    """Rows drawn by a hash of their key, so that each class has about `most` / number of classes at most.

    A class with no more rows than its part is taken whole. The sample has that size whatever the number of rows, and is the
    same on every run.
    """
    share = F.lit(0.0)
    for value, n in sorted(counts.items(), key=str):
        share = F.when(F.col(label) == F.lit(value), F.lit(most / len(counts) / n)).otherwise(share)
    return rows.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & (unit_hash(seed, F.col(key)) < share))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def adam(gradient, shape: tuple[int, ...], rounds: int, rate: float) -> np.ndarray:
    """Weights after so many full-gradient steps from zero."""
    weights, first, second = np.zeros(shape, np.float32), np.zeros(shape, np.float32), np.zeros(shape, np.float32)
    for step in range(1, rounds + 1):
        g = gradient(weights)
        first = 0.9 * first + 0.1 * g
        second = 0.99 * second + 0.01 * g * g
        weights -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return weights
