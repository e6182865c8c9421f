"""What the trained operators share: a bounded sample of labelled rows and a gradient step."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_column: str, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % folds, F.lit(0)).cast("int")


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_column: str, text: str) -> DataFrame:
    """At most ``rows`` documents with their label as rows (id, text, label): those of the least hash of the id.

    Null labels are left out; an id with several labels has the more frequent one (1 if equal); a repeated document is
    taken once. The chosen ids are at most ``rows`` numbers, so they are broadcast.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull())
    known = known.groupBy(F.col(id_column).alias("id")).agg((F.avg(label) >= 0.5).cast("double").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    return texts.join(F.broadcast(chosen), "id").dropDuplicates(["id"])


class Adam:
    """Gradient steps with momentum for a dictionary of arrays."""

    def __init__(self, parameters: dict[str, np.ndarray], rate: float):
        self.parameters, self.rate, self.turn = parameters, rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in parameters.items()}
        self.square = {k: np.zeros_like(v) for k, v in parameters.items()}

    def step(self, gradients: dict[str, np.ndarray]) -> None:
        self.turn += 1
        for name, gradient in gradients.items():
            self.mean[name] += 0.1 * (gradient - self.mean[name])
            self.square[name] += 0.001 * (gradient * gradient - self.square[name])
            mean = self.mean[name] / (1 - 0.9**self.turn)
            square = self.square[name] / (1 - 0.999**self.turn)
            self.parameters[name] -= self.rate * mean / (np.sqrt(square) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
