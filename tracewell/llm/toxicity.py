"""Toxicity: cumulative-link ordinal regression on sparse word features.

Labels say only toxic or not, so severity grades are made from the training rows themselves: words that occur
mostly in toxic rows are marked by their log odds, and toxic rows fall into ``GRADES - 1`` grades by their number of
marked words (grade 0 is not toxic). The model has one weight per hashed word, shared by ordered thresholds:
P(grade > k) = sigmoid(w . x - t_k) with t_0 < t_1 < ...; the expected severity is the sum of these probabilities.

The model is fitted on a sample of at most ``TRAINING_ROWS`` labelled documents, whole texts, of which only word hashes
travel to the driver. Scoring is one pass over all documents without an exchange.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import words
from tracewell.llm.learning import Adam, labelled, sigmoid

BUCKETS = 1 << 18
GRADES = 4
TRAINING_ROWS = 8000
LEAST_ROWS = 5
BEGINNINGS = (5, 7)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def counted(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word buckets of consecutive documents, their counts, and where each document begins.

    Words are lower-cased (A-Z) and lose what is neither letter nor digit at both ends. The beginnings of ``BEGINNINGS``
    bytes of longer words have buckets as well, so that forms of one stem are known together.
    """
    w = words.split(data, offsets, lower=True)
    if not len(w.starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    letter = _LETTER[w.data]
    place = np.arange(len(w.data))
    first = np.minimum.reduceat(np.where(letter, place, len(w.data)), w.starts)
    last = np.maximum.reduceat(np.where(letter & ~words.spaces(w.data), place, -1), w.starts) + 1
    solid = np.flatnonzero((first < w.ends) & (last > first))
    document = w.document()[solid]
    values, begins, ends = words.byte_values(w.data), first[solid], last[solid]
    parts = [(document, words.range_hashes(values, begins, ends, 0))]
    for size in BEGINNINGS:
        longer = np.flatnonzero(ends - begins > size)
        parts.append((document[longer], words.range_hashes(values, begins[longer], begins[longer] + size, 1)))
    hashes = np.concatenate([h for _, h in parts])
    key = np.concatenate([d for d, _ in parts]) * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64)
    key, count = np.unique(key, return_counts=True)
    return key % BUCKETS, count, np.searchsorted(key // BUCKETS, np.arange(len(offsets)))


def _features(count: np.ndarray) -> np.ndarray:
    return np.log2(1 + count)


@dataclass
class Ordinal:
    """Weights shared by ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def exceeds(self, bucket: np.ndarray, count: np.ndarray, first: np.ndarray) -> np.ndarray:
        """P(grade > k) for each document (rows) and threshold (columns)."""
        sums = np.concatenate([[0.0], np.cumsum(self.weights[bucket] * _features(count))])
        value = sums[first[1:]] - sums[first[:-1]]
        return sigmoid(value[:, None] - self.thresholds[None, :])


def grades(bucket: np.ndarray, count: np.ndarray, first: np.ndarray, toxic: np.ndarray, number: int) -> np.ndarray:
    """A grade from 0 to number - 1 for each training row."""
    row = np.repeat(np.arange(len(toxic)), np.diff(first))
    rows_with = np.bincount(bucket, minlength=BUCKETS)
    toxic_with = np.bincount(bucket, weights=toxic[row], minlength=BUCKETS)
    share = max(toxic.mean(), 1e-9)
    odds = np.log((toxic_with + share) / (rows_with - toxic_with + 1 - share)) - np.log(share / max(1 - share, 1e-9))
    marked = (odds > 1.5) & (rows_with >= LEAST_ROWS)
    weight = np.bincount(row, weights=marked[bucket] * count, minlength=len(toxic))
    grade = np.zeros(len(toxic), np.int64)
    of_toxic = weight[toxic > 0]
    if len(of_toxic):
        borders = np.quantile(of_toxic, np.arange(1, number - 1) / (number - 1))
        grade[toxic > 0] = 1 + np.searchsorted(borders, of_toxic, "left")
    return grade


def train(bucket, count, first, grade, number: int = GRADES, turns: int = 200, rate: float = 0.05, decay: float = 1e-3):
    """Maximum likelihood with a small quadratic penalty; buckets of few rows keep weight 0."""
    known = (np.bincount(bucket, minlength=BUCKETS) >= LEAST_ROWS).astype(float)
    kept = np.flatnonzero(known[bucket])
    first = np.searchsorted(kept, first)
    bucket, count = bucket[kept], count[kept]
    row = np.repeat(np.arange(len(grade)), np.diff(first))
    x = _features(count)
    share = np.clip([(grade > k).mean() for k in range(number - 1)], 1e-4, 1 - 1e-4)
    start = -np.log(share / (1 - share))
    parameters = {"w": np.zeros(BUCKETS), "t": start[:1].copy(), "d": np.log(np.maximum(np.diff(start), 0.05))}
    adam = Adam(parameters, rate)
    for _ in range(turns):
        steps = np.exp(parameters["d"])
        model = Ordinal(parameters["w"], np.concatenate([parameters["t"], parameters["t"] + np.cumsum(steps)]))
        above = model.exceeds(bucket, count, first)
        edged = np.concatenate([np.ones((len(grade), 1)), above, np.zeros((len(grade), 1))], axis=1)
        at = np.arange(len(grade))
        over, under = edged[at, grade], edged[at, grade + 1]
        slope = 1 - over - under
        likely = np.maximum(over - under, 1e-12)
        to_t = np.zeros(number - 1)
        np.add.at(to_t, grade[grade < number - 1], (under * (1 - under) / likely)[grade < number - 1])
        np.add.at(to_t, grade[grade > 0] - 1, -(over * (1 - over) / likely)[grade > 0])
        to_w = -np.bincount(bucket, weights=slope[row] * x, minlength=BUCKETS) / len(grade)
        to_t = -to_t / len(grade)
        adam.step(
            {
                "w": known * (to_w + decay * parameters["w"]),
                "t": to_t.sum(keepdims=True),
                "d": np.cumsum(to_t[::-1])[::-1][1:] * steps,
            }
        )
        # A word is evidence or none: clean words do not excuse others, however long the text.
        np.maximum(parameters["w"], 0, out=parameters["w"])
    steps = np.exp(parameters["d"])
    thresholds = np.concatenate([parameters["t"], parameters["t"] + np.cumsum(steps)])
    return Ordinal(parameters["w"].astype(np.float32).astype(np.float64), thresholds)


def _collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, end, data, offsets in words.chunks(batch.column("text")):
            bucket, count, first = counted(data, offsets)
            borders = pa.array(first.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").slice(begin, end - begin),
                    batch.column("label").slice(begin, end - begin),
                    pa.ListArray.from_arrays(borders, pa.array(bucket.astype(np.int32))),
                    pa.ListArray.from_arrays(borders, pa.array(count.astype(np.int32))),
                ],
                names=["id", "label", "buckets", "counts"],
            )


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    id_column: str = "doc_id",
    text: str = "text",
    rows: int = TRAINING_ROWS,
    number: int = GRADES,
) -> Ordinal:
    """The model of at most ``rows`` labelled documents; without toxic ones it calls nothing toxic."""
    sample = labelled(docs, labels, label, rows, id_column, text).select(F.col("id").cast("string").alias("id"), "label", "text")
    table = sample.mapInArrow(_collected, "id string, label double, buckets array<int>, counts array<int>").toArrow()
    toxic = table.column("label").to_numpy() if table.num_rows else np.zeros(0)
    if not toxic.any():
        return Ordinal(np.zeros(BUCKETS), np.full(number - 1, 40.0) + np.arange(number - 1))
    table = table.sort_by("id").combine_chunks()
    buckets, counts = table.column("buckets").combine_chunks(), table.column("counts").combine_chunks()
    first = np.concatenate([[0], np.cumsum(buckets.value_lengths().to_numpy())])
    bucket, count = buckets.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy().astype(np.int64)
    toxic = table.column("label").to_numpy()
    return train(bucket, count, first, grades(bucket, count, first, toxic, number), number)


def score(docs: DataFrame, model: Ordinal, text: str = "text") -> DataFrame:
    """``docs`` with expected_severity, severity (the thresholds passed with even odds) and toxic (severity > 0).

    Null and empty texts have no words and get the severity of none. Columns of these names are replaced.
    """
    made = ["expected_severity", "severity", "toxic"]
    fields = [f for f in docs.schema.fields if f.name not in made]
    names = [f.name for f in fields]
    fitted = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fitted.value.exceeds(*counted(data, offsets)) for _, _, data, offsets in words.chunks(batch.column(text))]
            above = np.concatenate(found) if found else np.zeros((0, 1))
            passed = (above >= 0.5).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names]
                + [pa.array(above.sum(axis=1)), pa.array(passed.astype(np.int32)), pa.array((passed > 0).astype(np.int32))],
                names=[*names, *made],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    schema = f"{kinds}, expected_severity double, severity int, toxic int"
    return docs.select(*[f"`{n}`" for n in names]).mapInArrow(run, schema)
