"""Quality classifier: attention over the passages of a document (multiple-instance learning).

A document is a bag of passages of ``PASSAGE`` words; only the document has a label. Each passage is encoded: the mean of
learned embeddings of its words (hashes of the word, of its ending and of its shape) and a few measures (length, distinct
and repeated words, symbols) go through a tanh layer to h. Gated attention w . (tanh(V h) * sigmoid(U h)) says how much a passage
counts; the softmax-weighted mean of the h is scored by a logistic unit.

The model is fitted on a sample of at most ``TRAINING_ROWS`` labelled documents, whole texts, of which only numbers of
features travel to the driver. Scoring is one pass over all documents without an exchange.
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

PASSAGE = 64
TRAINING_ROWS = 6000
THRESHOLD = 0.3
DECAY = 1e-4
_WORDS, _ENDINGS, _SHAPES = 4096, 2048, 512
_EMBEDDING, _MEASURES, _HIDDEN, _GATE = 8, 7, 16, 8

_KIND = np.full(256, 32, np.uint8)  # other ASCII symbols
_KIND[97:123] = 1
_KIND[65:91] = 2
_KIND[48:58] = 4
_KIND[128:] = 8
_KIND[[ord(c) for c in ".,;:!?'\"-()"]] = 16


@dataclass
class Passages:
    """Features of the passages of consecutive documents; every document has one passage at least."""

    features: np.ndarray  # (words, 3)
    sizes: np.ndarray  # words of each passage
    measures: np.ndarray  # (passages, _MEASURES)
    bags: np.ndarray  # passages of each document

    def take(self, documents: np.ndarray) -> Passages:
        passage = np.concatenate([[0], np.cumsum(self.bags)])
        word = np.concatenate([[0], np.cumsum(self.sizes)])
        rows = np.concatenate([np.arange(passage[d], passage[d + 1]) for d in documents])
        at = np.concatenate([np.arange(word[passage[d]], word[passage[d + 1]]) for d in documents])
        return Passages(self.features[at], self.sizes[rows], self.measures[rows], self.bags[documents])


def _distinct(group: np.ndarray, values: np.ndarray, groups: int) -> np.ndarray:
    order = np.lexsort((values, group))
    group, values = group[order], values[order]
    fresh = np.ones(len(group), bool)
    fresh[1:] = (group[1:] != group[:-1]) | (values[1:] != values[:-1])
    return np.bincount(group[fresh], minlength=groups)


def describe(data: np.ndarray, offsets: np.ndarray) -> Passages:
    w = words.split(data, offsets)
    count = np.diff(w.first)
    bags = np.maximum(1, -(-count // PASSAGE))
    begins = np.concatenate([[0], np.cumsum(bags)])[:-1]
    document = w.document()
    place = np.arange(len(document)) - w.first[document]
    passage = begins[document] + place // PASSAGE
    total = int(bags.sum())
    sizes = np.bincount(passage, minlength=total)
    length = w.ends - w.starts
    kinds = _KIND[data]
    if len(w.starts):
        shape = np.bitwise_or.reduceat(np.where(words.spaces(data), 0, kinds).astype(np.uint8), w.starts).astype(np.int64)
        symbols = np.concatenate([[0], np.cumsum(kinds == 32)])
        symbols = symbols[w.ends] - symbols[w.starts]
        endings = words.range_hashes(words.byte_values(data), np.maximum(w.starts, w.ends - 3), w.ends, 1)
    else:
        shape = symbols = np.zeros(0, np.int64)
        endings = np.zeros(0, np.uint64)
    shape = (shape & 63) * 8 + np.minimum(length, 15) // 2
    features = np.stack(
        [
            (w.hashes % np.uint64(_WORDS)).astype(np.int32),
            _WORDS + (endings % np.uint64(_ENDINGS)).astype(np.int32),
            _WORDS + _ENDINGS + shape.astype(np.int32),
        ],
        axis=1,
    )
    per = np.maximum(sizes, 1)
    bag = np.repeat(np.arange(len(bags)), bags)
    again = np.zeros(len(document))
    again[1:] = (w.hashes[1:] == w.hashes[:-1]) & (passage[1:] == passage[:-1])
    measures = np.stack(
        [
            np.bincount(passage, weights=again, minlength=total) / per,
            np.log1p(sizes) / 4,
            _distinct(passage, w.hashes, total) / per,
            (_distinct(document, w.hashes, len(bags)) / np.maximum(count, 1))[bag],
            np.bincount(passage, weights=length, minlength=total) / per / 10,
            np.bincount(passage, weights=symbols, minlength=total) / per,
            np.log1p(count)[bag] / 8,
        ],
        axis=1,
    )
    return Passages(features, sizes, measures.astype(np.float32), bags)


class Model:
    """Weights of the network; `scores` gives a probability for each document."""

    def __init__(self, seed: int = 9):
        r = np.random.Generator(np.random.PCG64(seed))
        wide = _EMBEDDING + _MEASURES

        def normal(*shape):
            return (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.weights = {
            "embedding": (r.standard_normal((_WORDS + _ENDINGS + _SHAPES, _EMBEDDING)) * 0.1).astype(np.float32),
            "encode": normal(wide, _HIDDEN),
            "shift": np.zeros(_HIDDEN, np.float32),
            "attend": normal(_HIDDEN, _GATE),
            "gate": normal(_HIDDEN, _GATE),
            "weigh": normal(_GATE),
            "score": normal(_HIDDEN),
            "bias": np.zeros(1, np.float32),
        }

    def forward(self, p: Passages) -> dict[str, np.ndarray]:
        m = self.weights
        full = np.flatnonzero(p.sizes > 0)
        mean = np.zeros((len(p.sizes), _EMBEDDING), np.float32)
        if len(full):
            summed = m["embedding"][p.features[:, 0]]
            summed += m["embedding"][p.features[:, 1]]
            summed += m["embedding"][p.features[:, 2]]
            starts = (np.cumsum(p.sizes) - p.sizes)[full]
            mean[full] = np.add.reduceat(summed, starts, axis=0) / p.sizes[full, None]
        x = np.concatenate([mean, p.measures], axis=1)
        h = np.tanh(x @ m["encode"] + m["shift"])
        v, u = np.tanh(h @ m["attend"]), sigmoid(h @ m["gate"])
        s = (v * u) @ m["weigh"]
        first = np.cumsum(p.bags) - p.bags
        bag = np.repeat(np.arange(len(p.bags)), p.bags)
        e = np.exp(s - np.maximum.reduceat(s, first)[bag])
        a = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        y = sigmoid(z @ m["score"] + m["bias"])
        return {"x": x, "h": h, "v": v, "u": u, "a": a, "z": z, "y": y, "bag": bag, "first": first}

    def gradients(self, p: Passages, label: np.ndarray) -> dict[str, np.ndarray]:
        m, f = self.weights, self.forward(p)
        x, h, v, u, a, bag = (f[k] for k in ("x", "h", "v", "u", "a", "bag"))
        error = ((f["y"] - label) / len(label)).astype(np.float32)
        back = (error[:, None] * m["score"])[bag]
        weight = (h * back).sum(axis=1)
        s = a * (weight - np.add.reduceat(a * weight, f["first"])[bag])
        to_v = s[:, None] * m["weigh"] * u * (1 - v * v)
        to_u = s[:, None] * m["weigh"] * v * u * (1 - u)
        to_h = (a[:, None] * back + to_v @ m["attend"].T + to_u @ m["gate"].T) * (1 - h * h)
        to_x = to_h @ m["encode"].T
        each = (to_x[:, :_EMBEDDING] / np.maximum(p.sizes, 1)[:, None])[np.repeat(np.arange(len(p.sizes)), p.sizes)]
        embedding = np.zeros_like(m["embedding"])
        flat = p.features.T.ravel()
        for k in range(_EMBEDDING):
            embedding[:, k] = np.bincount(flat, np.tile(each[:, k], 3), minlength=len(embedding))
        return {
            "embedding": embedding + DECAY * m["embedding"],
            "encode": x.T @ to_h,
            "shift": to_h.sum(axis=0),
            "attend": h.T @ to_v,
            "gate": h.T @ to_u,
            "weigh": (v * u).T @ s,
            "score": f["z"].T @ error,
            "bias": error.sum(keepdims=True),
        }

    def scores(self, p: Passages) -> np.ndarray:
        return self.forward(p)["y"].astype(np.float64)


def _collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, end, data, offsets in words.chunks(batch.column("text")):
            p = describe(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").slice(begin, end - begin),
                    batch.column("label").slice(begin, end - begin),
                    pa.array(p.bags),
                    *(_nested(values, borders) for values, borders in _split(p)),
                ],
                names=["id", "label", "bags", "features", "sizes", "measures"],
            )


def _split(p: Passages):
    passage = np.concatenate([[0], np.cumsum(p.bags)])
    word = np.concatenate([[0], np.cumsum(p.sizes)])[passage]
    yield p.features.ravel(), word * 3
    yield p.sizes.astype(np.int32), passage
    yield p.measures.ravel(), passage * _MEASURES


def _nested(values: np.ndarray, borders: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), pa.array(values))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    id_column: str = "doc_id",
    text: str = "text",
    rows: int = TRAINING_ROWS,
    epochs: int = 8,
    batch: int = 64,
    rate: float = 0.01,
    seed: int = 9,
) -> Model:
    """The model of at most ``rows`` labelled documents; without any, one that gives every document about 0.5."""
    sample = labelled(docs, labels, label, rows, id_column, text).select(F.col("id").cast("string").alias("id"), "label", "text")
    schema = "id string, label double, bags long, features array<int>, sizes array<int>, measures array<float>"
    table = sample.mapInArrow(_collected, schema).toArrow()
    model = Model(seed)
    if not table.num_rows:
        return model
    order = np.argsort(np.array(table.column("id").to_pylist()), kind="stable")
    flat = {name: table.column(name).combine_chunks().flatten().to_numpy() for name in ("features", "sizes", "measures")}
    everything = Passages(
        flat["features"].reshape(-1, 3), flat["sizes"], flat["measures"].reshape(-1, _MEASURES), table.column("bags").to_numpy()
    )
    target = table.column("label").to_numpy()
    adam, r = Adam(model.weights, rate), np.random.Generator(np.random.PCG64(seed))
    for epoch in range(epochs):
        adam.rate = rate * (1 - epoch / epochs)
        mixed = order[r.permutation(len(order))]
        for begin in range(0, len(mixed), batch):
            chosen = mixed[begin : begin + batch]
            adam.step(model.gradients(everything.take(chosen), target[chosen]))
    return model


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 in ``column`` (replaced if present). Null and empty texts have a score."""
    fields = [f for f in docs.schema.fields if f.name != column]
    names = [f.name for f in fields]
    weights = docs.sparkSession.sparkContext.broadcast(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Model()
        fitted.weights = weights.value
        for batch in batches:
            found = [fitted.scores(describe(data, offsets)) for _, _, data, offsets in words.chunks(batch.column(text))]
            values = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(values)], names=[*names, column])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return docs.select(*[f"`{n}`" for n in names]).mapInArrow(run, f"{kinds}, `{column}` double")
