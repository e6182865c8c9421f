"""Ranked lexical search: for each item the documents of the highest term score, exactly.

Method (sparse ball-tree inner-product search):

1. A document's score for an item is an inner product of whole numbers: weights of the item's terms, and what a term is
   worth in the document (by its occurrences and the document's length).
2. One scan counts, for every document, all its terms and the occurrences of those that some item asks for. Only these few
   pairs of term and count are kept; the corpus statistics are aggregated from them and from the counts of terms.
3. Each task streams its documents in shards. For a group of items that are alike, a shard becomes a ball tree over the
   terms of the group, each scaled by its weight: a node has the mean of its documents and the radius around it, so no
   document below it scores more than ``mean . item + radius * |item|``. Radii and bounds are rounded up by more than the
   arithmetic can err. Small groups have few terms, which keeps the radii short.
4. An item takes nodes from the best bound on and stops when the next bound is below its k-th score so far, which is
   carried from shard to shard. Leaves are scored in 64-bit whole numbers. A task returns at most k rows for an item.
5. A window merges the tasks.

Items are taken in passes of bounded size, so that neither the driver nor a task holds more than one pass of them.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm import words
from tracewell.llm.tables import Staging

RANKS = 50
LEAF = 32
SHARD_ROWS = 4096
CELLS = 4_000_000
GROUP_ITEMS = 8
GROUP_TERMS = 512
PASS_TERMS = 500_000
_SLACK = 1e-3


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, terms) of items: the hashes of their distinct terms."""
    for batch in batches:
        for begin, end, data, offsets in words.chunks(batch.column("text")):
            w = words.split(data, offsets, lower=True, separators=words.TERM_SEPARATORS)
            terms = [np.unique(w.hashes[a:b]).view(np.int64) for a, b in zip(w.first[:-1], w.first[1:])]
            keys = batch.column("key").slice(begin, end - begin)
            yield pa.RecordBatch.from_arrays([keys, pa.array(terms, pa.list_(pa.int64()))], names=["key", "terms"])


def _counted(vocabulary: np.ndarray):
    """Rows (doc, n, terms, counts) of documents: the places in the vocabulary of the terms they hold, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(1, len(vocabulary))
        for batch in batches:
            for begin, end, data, offsets in words.chunks(batch.column("text")):
                w = words.split(data, offsets, lower=True, separators=words.TERM_SEPARATORS)
                at = np.minimum(np.searchsorted(vocabulary, w.hashes), size - 1)
                hit = np.flatnonzero(vocabulary[at] == w.hashes) if len(vocabulary) else np.zeros(0, np.int64)
                document = np.searchsorted(w.first, hit, "right") - 1
                cell, count = np.unique(document * size + at[hit], return_counts=True)
                borders = pa.array(np.searchsorted(cell, np.arange(end - begin + 1) * size).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc").slice(begin, end - begin),
                        pa.array(np.diff(w.first).astype(np.int64)),
                        pa.ListArray.from_arrays(borders, pa.array((cell % size).astype(np.int32))),
                        pa.ListArray.from_arrays(borders, pa.array(count.astype(np.int64))),
                    ],
                    names=["doc", "n", "terms", "counts"],
                )

    return run


class BallTree:
    """Rows of a matrix, in nested balls: first by length, then along the line between two distant rows."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        length = np.sqrt(np.square(points).sum(axis=1))
        self.order = np.arange(len(points))
        self.spans, self.children, centres, radii = [], [], [], []
        waiting = [(0, len(points), None)]
        while waiting:
            begin, end, parent = waiting.pop()
            node = len(self.spans)
            if parent is not None:
                self.children[parent].append(node)
            at = self.order[begin:end]
            rows = points[at]
            centre = rows.mean(axis=0)
            distance = np.square(rows - centre).sum(axis=1)
            self.spans.append((begin, end))
            self.children.append([])
            centres.append(centre)
            # Single precision errs by less than this, relative to the distance and to the rows.
            radii.append(math.sqrt(float(distance.max())) * (1 + _SLACK) + _SLACK * float(length[at].max()) / 100)
            if end - begin > leaf and distance.max() > 0:
                if length[at].max() > 2 * length[at].min():
                    along = length[at]
                else:
                    one = rows[distance.argmax()]
                    other = rows[np.square(rows - one).sum(axis=1).argmax()]
                    along = rows @ (other - one)
                half = (end - begin) // 2
                self.order[begin:end] = at[np.argpartition(along, half)]
                waiting += [(begin, begin + half, node), (begin + half, end, node)]
        self.centres, self.radii = np.array(centres, np.float64), np.array(radii)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each node and query a number that no inner product below the node exceeds."""
        length = np.sqrt(np.square(queries).sum(axis=1))
        exact = self.centres @ queries.T + self.radii[:, None] * length
        return exact * (1 + 1e-9) + 1

    def best_first(self, bounds: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """Bounds and rows of the leaves, best node first."""
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(heap, (max(bound, -bounds[child]), child))
            else:
                begin, end = self.spans[node]
                yield -bound, self.order[begin:end]


class Best:
    """The ``k`` highest (score, smaller id) of an item so far."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def threshold(self) -> int:
        """No lower score can enter."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        enter = scores >= self.threshold
        if enter.any():
            scores, ids = np.append(self.scores, scores[enter]), np.append(self.ids, ids[enter])
            first = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[first], ids[first]


def grouped(items: list[np.ndarray], frequency: np.ndarray) -> list[list[int]]:
    """Items that share their most frequent terms together, up to ``GROUP_ITEMS`` and about ``GROUP_TERMS`` a group."""
    common = [tuple(terms[np.argsort(-frequency[terms], kind="stable")[:4]].tolist()) for terms in items]
    groups, held = [], set()
    for at in sorted(range(len(items)), key=lambda i: common[i]):
        terms = set(items[at].tolist())
        if not groups or len(groups[-1]) == GROUP_ITEMS or len(held | terms) > GROUP_TERMS:
            groups.append([])
            held = set()
        groups[-1].append(at)
        held |= terms
    return groups


def _searcher(keys: np.ndarray, items: list[np.ndarray], weights: np.ndarray, groups: list[list[int]], documents: int, length: int, k: int):
    """Rows (key, doc, score): at most ``k`` for each item and task."""

    def shard(rows: pa.Table, best: list[Best]) -> None:
        ids, n = rows.column("doc").to_numpy(), rows.column("n").to_numpy()
        terms, counts = rows.column("terms").combine_chunks(), rows.column("counts").combine_chunks()
        owner = np.repeat(np.arange(len(ids)), np.diff(terms.offsets.to_numpy()))
        terms, counts = terms.flatten().to_numpy(), counts.flatten().to_numpy()
        # Products of the length stay whole, however long the corpus.
        size = np.array([50 + 50 * int(x) * documents // length for x in n], np.int64)
        value = 1_000_000_000 * counts // (1000 * counts + 20 * size[owner])
        for group in groups:
            own = np.unique(np.concatenate([items[i] for i in group]))
            column = np.full(len(weights), -1, np.int64)
            column[own] = np.arange(len(own))
            queries = np.zeros((len(group), len(own)), np.int64)
            for row, item in enumerate(group):
                queries[row, column[items[item]]] = weights[items[item]]
            held = column[terms] >= 0
            step = max(LEAF, CELLS // len(own))
            for begin in range(0, len(ids), step):
                taken = held & (owner >= begin) & (owner < begin + step)
                places = np.unique(owner[taken])
                if not len(places):
                    continue
                points = np.zeros((len(places), len(own)), np.float32)
                points[np.searchsorted(places, owner[taken]), column[terms[taken]]] = value[taken]
                tree = BallTree(points * weights[own].astype(np.float32))
                bounds = tree.bounds((queries > 0).astype(np.float64))
                for row, item in enumerate(group):
                    wanted = column[items[item]]
                    weight = queries[row, wanted]
                    for bound, leaf in tree.best_first(bounds[:, row]):
                        if bound < best[item].threshold:
                            break
                        best[item].add(points[leaf][:, wanted].astype(np.int64) @ weight, ids[places[leaf]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held, rows = [Best(k) for _ in items], [], 0
        for batch in batches:
            for begin in range(0, batch.num_rows, SHARD_ROWS):
                part = batch.slice(begin, SHARD_ROWS)
                if rows + part.num_rows > SHARD_ROWS:
                    shard(pa.Table.from_batches(held), best)
                    held, rows = [], 0
                held.append(part)
                rows += part.num_rows
        if held:
            shard(pa.Table.from_batches(held), best)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(keys, [len(b.ids) for b in best])),
                pa.array(np.concatenate([b.ids for b in best])),
                pa.array(np.concatenate([b.scores for b in best])),
            ],
            names=["key", "doc", "score"],
        )

    return run


def _pass(narrow: DataFrame, asked: DataFrame, k: int, staging: Staging, name: str) -> DataFrame:
    """Rows (key, doc, score) for a bounded number of items."""
    rows = asked.orderBy("key").collect()
    keys = np.array([r.key for r in rows], np.int64)
    hashes = [np.array(r.terms, np.int64).view(np.uint64) for r in rows]
    vocabulary = np.unique(np.concatenate(hashes))
    items = [np.searchsorted(vocabulary, h) for h in hashes]
    schema = "doc long, n long, terms array<int>, counts array<long>"
    counted = staging.write(narrow.mapInArrow(_counted(vocabulary), schema), f"counted-{name}")
    total = counted.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("length")).first()
    frequency = np.zeros(len(vocabulary), np.int64)
    for term, count in counted.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        frequency[term] = count
    documents, length = total.documents, max(1, total.length or 0)
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in frequency], np.int64)
    groups = grouped(items, frequency)
    held = counted.where(F.col("doc").isNotNull() & (F.size("terms") > 0))
    search = _searcher(keys, items, weights, groups, documents, length, k)
    found = held.mapInArrow(search, "key long, doc long, score long")
    best = Window.partitionBy("key").orderBy(F.col("score").desc(), "doc")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    ranked = staging.write(ranked, f"ranked-{name}")
    staging.drop(f"counted-{name}")
    return ranked


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = RANKS,
    id_column: str = "doc_id",
    text: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    pass_terms: int = PASS_TERMS,
) -> DataFrame:
    """Rows (item, rank, doc, score): the ``k`` documents of the highest score above 0 for each item, ties to the smaller id.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII; A-Z are lower-cased. N counts the
    documents with a term, L all terms; a term weighs floor(1000 * ln((2 N + 2) / (2 df + 1))) and counts for
    1000000000 tf div (1000 tf + 20 m) with m = 50 + 50 n N div L. A term of the item counts once. Null and empty texts
    have no terms: such documents are not in N and never found, such items have no rows. Repeated documents are listed
    each; documents without an id count in N, L and df, but cannot be named and are left out. Equal items are answered
    once; items of one id and different texts are answered each. Ids of documents are whole numbers. Other columns play
    no part. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    staging = Staging(spark, "ranking")
    narrow = docs.select(F.col(id_column).cast("long").alias("doc"), F.col(text).alias("text"))
    wanted = items.select(F.col(item_column).alias("item"), F.col(item_text).alias("text")).where("text IS NOT NULL").distinct()
    wanted = wanted.select("item", "text", F.xxhash64("item", F.col("item").isNull(), "text").alias("key"))
    asked = wanted.select("key", "text").mapInArrow(_asked, "key long, terms array<long>").where(F.size("terms") > 0)
    asked = staging.write(asked, "asked")
    held = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    passes = max(1, -(-held // pass_terms))
    ranked = None
    for turn in range(passes):
        block = asked.where(F.pmod("key", F.lit(passes)) == turn)
        if not block.isEmpty():
            part = _pass(narrow, block, k, staging, str(turn))
            ranked = part if ranked is None else ranked.unionByName(part)
    if ranked is None:
        ranked = spark.createDataFrame([], "key long, doc long, score long, rank int")
    named = ranked.join(wanted.select("item", "key"), "key")
    return named.select(F.col("item").alias(item_column), "rank", F.col("doc").alias(id_column), "score")
