"""Approximate nearest neighbours by inner product with randomly rotated one-bit codes.

Method: a shard of the candidates is rotated by a random orthogonal matrix, and each vector is kept as the signs of its
coordinates (packed bits), its length and the cosine between it and its code. A rotated query of unit length is rounded
to ``PLANES`` bits a coordinate, so that the product with a code is a sum of counts of common bits, plane by plane.
Divided by that cosine, it estimates the inner product; the estimate errs by at most
``length * |query| * sqrt((1 - cos^2) / cos^2) * epsilon / sqrt(d - 1)`` but with a probability that falls with
exp(-epsilon^2 / 2); the bound has room for the rounding, too. Lengths are taken out first and kept in double precision,
so very long and very short vectors are treated alike. The best estimates are measured first; the k-th best of them is a threshold, and every candidate
whose upper bound reaches it is measured on the original vectors.

All queries meet all shards: queries are copied to the shards (a shard has ``SHARD_ROWS`` candidates, so a query is
copied rows / SHARD_ROWS times), and each task streams the queries past one indexed shard after the other. Memory is
one shard and one batch of queries; a shard returns k rows for a query, and a window merges them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 16384
EPSILON = 3.5
SEED = 20
PLANES = 8
_BLOCK = 64


def rotation(dimension: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


def _unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one, and the lengths; squares of any finite components neither overflow nor vanish."""
    largest = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / largest
    length = np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
    return scaled / length, (largest * length)[:, 0]


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    packed = np.packbits(bits, axis=-1)
    room = -packed.shape[-1] % 8
    return np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, room)]).view(np.uint64)


class Codes:
    """One-bit codes of a shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int, epsilon: float):
        self.ids, self.vectors = ids, vectors
        self.dimension = vectors.shape[1]
        self.rotation = rotation(self.dimension, seed)
        units, self.length = _unit(vectors)
        rotated = units @ self.rotation
        self.bits = _packed(rotated > 0)
        self.ones = np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)
        cosine = np.abs(rotated).sum(axis=1) / np.sqrt(self.dimension)
        self.scale = self.length / (cosine * np.sqrt(self.dimension))
        spread = np.sqrt(np.maximum(0, 1 - cosine**2)) / cosine
        self.error = self.length * spread * epsilon / np.sqrt(max(1, self.dimension - 1))

    def exact(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Inner products in double precision, added from the first component to the last."""
        return np.add.accumulate(self.vectors[rows] * query, axis=1)[:, -1]

    def estimates(self, rotated: np.ndarray) -> tuple[np.ndarray, float]:
        """Estimated products with a rotated query of unit length, and how far rounding can move a sum of signs."""
        low = rotated.min()
        step = (rotated.max() - low) / (2**PLANES - 1) or 1.0
        levels = np.rint((rotated - low) / step).astype(np.uint16)
        planes = _packed((levels >> np.arange(PLANES, dtype=np.uint16)[:, None]) & 1 > 0)
        common = np.zeros(len(self.ids), np.int64)
        for place, plane in enumerate(planes):
            common += np.bitwise_count(self.bits & plane).sum(axis=1, dtype=np.int64) << place
        sums = 2 * (low * self.ones + step * common) - rotated.sum()
        return sums * self.scale, self.dimension * step / 2 + 1e-12

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query its place, and the rows and scores of its best candidates of this shard."""
        for begin in range(0, len(queries), _BLOCK):
            units, norms = _unit(queries[begin : begin + _BLOCK])
            rotated = units @ self.rotation
            for at, unit in enumerate(units):
                query = queries[begin + at]
                estimate, rounding = self.estimates(rotated[at])
                others = self.ids != ids[begin + at]
                estimate[~others] = -np.inf
                first = np.argpartition(-estimate, k - 1)[:k] if len(estimate) > k else np.arange(len(estimate))
                first = first[others[first]]
                threshold = self.exact(first, query).min() / norms[at] if len(first) >= k else -np.inf
                # A bound that is not a number proves nothing, so such a row stays.
                rows = np.flatnonzero(~(estimate + self.error + self.scale * rounding < threshold) & others)
                # Products of unit vectors first, with room for their error; what is left is measured exactly.
                margin = 1e-14 * self.dimension * self.length[rows]
                rows = rows[~(self.vectors[rows] @ unit + margin < threshold)]
                scores = self.exact(rows, query)
                best = np.lexsort((self.ids[rows], -scores))[:k]
                yield begin + at, rows[best], scores[best]


def _searcher(k: int, seed: int, epsilon: float):
    """Rows (query_id, query_key, vec_id, score); rows come by shard, candidates before queries."""

    def matrix(batch: pa.RecordBatch, dimension: int) -> np.ndarray:
        return batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, dimension)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, parts, codes = None, [], [], None
        for batch in batches:
            group = np.stack([batch.column(c).to_numpy() for c in ("dimension", "shard", "kind")], axis=1)
            borders = [0, *(np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1).tolist(), len(group)]
            for begin, end in zip(borders, borders[1:]):
                if begin == end:
                    continue
                dimension, shard, kind = group[begin].tolist()
                part = batch.slice(begin, end - begin)
                if current != (dimension, shard):
                    current, ids, parts, codes = (dimension, shard), [], [], None
                if kind == 0:
                    ids.append(part.column("id").to_numpy())
                    parts.append(matrix(part, dimension))
                    continue
                if not ids:
                    continue
                if codes is None:
                    codes = Codes(np.concatenate(ids), np.concatenate(parts), seed, epsilon)
                    parts = [codes.vectors]
                query_ids, query_keys = part.column("id").to_numpy(), part.column("key").to_numpy()
                found = list(codes.search(query_ids, matrix(part, dimension), k))
                sizes = [len(rows) for _, rows, _ in found]
                at = np.repeat([place for place, _, _ in found], sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(query_ids[at]),
                        pa.array(query_keys[at]),
                        pa.array(codes.ids[np.concatenate([rows for _, rows, _ in found])]),
                        pa.array(np.concatenate([scores for _, _, scores in found])),
                    ],
                    names=["query_id", "query_key", "vec_id", "score"],
                )

    return run


def usable(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """Rows (id, vector of doubles) without those that take no part."""
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    broken = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & ~broken & F.exists("vector", lambda x: x != 0))


def nearest(
    candidates: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_column: str = "vec_id",
    vector: str = "embedding",
    epsilon: float = EPSILON,
    seed: int = SEED,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` candidates of largest inner product, ties to the smaller id.

    Null and empty vectors, zero vectors, those with null or non-finite components and rows without an id take no part,
    neither as query nor as candidate. A query meets the vectors of its own length, but no row of its own id; with
    fewer than ``k`` of them it gets all. Repeated queries are answered once, repeated candidates are listed each.
    Scores are sums in double precision over the original vectors. Other columns play no part.
    """
    rows = usable(candidates, id_column, vector)
    shards = max(1, -(-rows.count() // shard_rows))
    indexed = rows.select("id", "vector", F.lit(0).alias("kind"), F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"))
    asked = usable(queries, id_column, vector).distinct()
    asked = asked.select("id", "vector", F.lit(1).alias("kind"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    both = indexed.withColumn("shard", F.col("shard").cast("long")).unionByName(
        asked.withColumn("shard", F.col("shard").cast("long"))
    )
    both = both.select(
        F.col("id").cast("long").alias("id"),
        F.xxhash64("vector").alias("key"),
        F.size("vector").cast("long").alias("dimension"),
        "shard",
        F.col("kind").cast("long").alias("kind"),
        "vector",
    )
    both = both.repartition("dimension", "shard").sortWithinPartitions("dimension", "shard", "kind")
    found = both.mapInArrow(_searcher(k, seed, epsilon), "query_id long, query_key long, vec_id long, score double")
    best = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
