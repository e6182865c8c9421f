"""N-gram Jaccard join: groups of documents whose sets of word shingles are alike.

Method (count-vector R-tree):

1. Documents with equal sets form a class (the class number is a 64-bit hash of the set); from here on only classes
   count, so copies cost nothing.
2. *Cells.* The shingles of a set are dealt by hash into more ranges than two linked sets can differ in. So linked sets
   agree on some ranges, and a class signs with the content of each of its ranges. Sets of other sizes are dealt by
   levels of size; a class that can have a partner in the next level signs there too. The ranges of under two shingles
   say little; so many spare ranges are added that a class may leave out a sixteenth of them. More spare ranges (a
   quarter) mean that linked sets agree on a number of signed ranges, not only one: a class that shares fewer of its
   cells with others is out, and so in turns, until only cells of classes with likely partners are left.
3. *Stars.* In each cell all classes are compared with the least one, by their full sets. This joins groups of near
   copies, however large, with a number of comparisons in proportion to their members. Where classes of different
   components still meet, ``AGAIN`` turns compare those of a cell with one that the cell draws by hash, so members of a
   group meet many others of it.
4. *R-tree.* What remains are cells that hold classes of different components. Classes with too few of these are out, and
   each of the others leaves out its most crowded ones, as many as linked sets share beyond one. The classes of a cell
   become points, the numbers of their shingles in ``GROUPS`` hash groups. An R-tree of them, whose nodes know the
   largest coordinates, the sizes and the component, yields the pairs of different components for which the sum of
   coordinate minima allows the required overlap; minima over ``FINE_GROUPS`` groups settle most of these. A cell of more
   than ``BLOCK`` classes is cut into pairs of blocks. A place returns the classes that have such a partner there.
5. Only these meet again, with their full sets: once with all their neighbours, the classes that common places join,
   unless their places take fewer rows (with very many neighbours). Pairs are verified unless links of the same place have joined their
   components already, so a place returns fewer links than it has members. Links of both steps give the components.

All links between different sets are found or lie within one component; nothing is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm import words
from tracewell.llm.graphs import components
from tracewell.llm.streams import groups
from tracewell.llm.tables import Staging, row_key

SHINGLE = 3
PERCENT = 90
GROUPS = 128
FINE_GROUPS = 1024
BLOCK = 1024
LEAF = 48
TURNS = 1
NARROWING = 2
AGAIN = 2
CARRIED = 2
_RATIO = 1.5


def _levels(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By level: least size, number of ranges, how many may be left out, and how many signed ones linked sets share."""
    start = -(-percent // (100 - percent))
    starts = [start]
    while starts[-1] < 2**31:
        starts.append(max(starts[-1] + 1, int(starts[-1] * max(_RATIO, 100 / percent + 0.01))))
    differ = np.array([(following - 1) * (100 - percent) // percent for following in starts[1:]])
    return np.array(starts[:-1]), differ + 1 + differ // 16 + differ // 4, differ // 16, differ // 4 + 1


def _sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, one after the other, and where each document begins."""
    w = words.split(data, offsets, lower=True)
    hashes, whole = w.grams(shingle)
    document = w.document()[: len(hashes)][whole]
    size = np.diff(w.first)
    short = np.flatnonzero((size > 0) & (size < shingle))
    document = np.concatenate([document, short])
    hashes = np.concatenate([hashes[whole], words.range_hashes(w.hashes, w.first[short], w.first[short + 1], 0)])
    order = np.lexsort((hashes, document))
    document, hashes = document[order], hashes[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (document[1:] != document[:-1])
    return hashes[fresh], np.searchsorted(document[fresh], np.arange(len(offsets)))


def _class(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.append(np.zeros(1, np.uint64), np.cumsum(words.mix(hashes)))
    return words.mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64)


def _cells(hashes: np.ndarray, first: np.ndarray, which: np.ndarray, level: np.ndarray, ranges, spare):
    """Owner and cell of the ranges with which the documents ``which`` sign at their ``level``."""
    size = first[which + 1] - first[which]
    number = ranges[level]
    base = np.concatenate([np.zeros(1, np.int64), np.cumsum(number)])
    owner = np.repeat(np.arange(len(which)), size)
    at = np.repeat(first[which], size) + np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    taken = hashes[at]
    slot = base[owner] + ((taken >> np.uint64(32)) * number[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    begins = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])) if len(slot) else np.zeros(0, np.int64)
    sums = np.append(np.zeros(1, np.uint64), np.cumsum(words.mix(taken)))
    content = np.zeros(base[-1], np.uint64)
    content[slot[begins]] = sums[np.append(begins[1:], len(slot))] - sums[begins]
    count = np.zeros(base[-1], np.int64)
    count[slot[begins]] = np.diff(np.append(begins, len(slot)))
    of = np.repeat(np.arange(len(which)), number)
    weak = count < 2
    many = np.bincount(of, weights=weak, minlength=len(which)) > spare[level]
    keep = np.flatnonzero(~weak | many[of])
    place = (keep - base[of[keep]]).astype(np.uint64)
    step = words.mix(place * np.uint64(64) + level[of[keep]].astype(np.uint64))
    # Cells that collide only bring more classes together; 48 bits take less room where cells are exchanged.
    return which[of[keep]], words.mix(content[keep] ^ step) >> np.uint64(16)


def _describe(shingle: int, percent: int):
    """Rows (row_key, n, class, cells, own, need, need_above) of documents: the first ``own`` cells are those of the own level."""
    starts, ranges, spare, shared = _levels(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, offsets in words.chunks(batch.column("text")):
                hashes, first = _sets(data, offsets, shingle)
                n = np.diff(first)
                level = np.searchsorted(starts, n, "right") - 1
                signs = np.flatnonzero(level >= 0)
                upper = signs[100 * n[signs] >= percent * starts[level[signs] + 1]]
                owner, cell = _cells(hashes, first, signs, level[signs], ranges, spare)
                more, above = _cells(hashes, first, upper, level[upper] + 1, ranges, spare)
                owner, cell = np.concatenate([owner, more]), np.concatenate([cell, above])
                order = np.argsort(owner, kind="stable")
                borders = np.searchsorted(owner[order], np.arange(end - begin + 1)).astype(np.int32)
                at_least = np.append(shared, shared[-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row_key").slice(begin, end - begin),
                        pa.array(n.astype(np.int64)),
                        pa.array(_class(hashes, first)),
                        pa.ListArray.from_arrays(pa.array(borders), pa.array(cell[order].view(np.int64))),
                        pa.array(np.bincount(owner[: len(owner) - len(more)], minlength=end - begin).astype(np.int32)),
                        pa.array(at_least[np.maximum(level, 0)].astype(np.int32)),
                        pa.array(at_least[np.maximum(level, 0) + 1].astype(np.int32)),
                    ],
                    names=["row_key", "n", "class", "cells", "own", "need", "need_above"],
                )

    return run


def _packed(counts: np.ndarray) -> list[bytes]:
    """Each row of counts as bytes, or as larger numbers where a count does not fit into a byte."""
    return [row.astype(np.uint8 if row.max() < 256 else np.uint32).tobytes() for row in counts]


def _unpacked(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    rows = [np.frombuffer(text, np.uint8 if len(text) == width else np.uint32) for text in column.to_pylist()]
    return np.stack(rows) if rows else np.zeros((0, width), np.uint8)


def _vectors(shingle: int):
    """Rows (class, n, shingles, counts, fine) of documents: the set, and its numbers of shingles in few and in many hash groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, offsets in words.chunks(batch.column("text")):
                hashes, first = _sets(data, offsets, shingle)
                rows = end - begin
                owner = np.repeat(np.arange(rows), np.diff(first))
                slot = owner * FINE_GROUPS + (hashes % np.uint64(FINE_GROUPS)).astype(np.int64)
                fine = np.bincount(slot, minlength=rows * FINE_GROUPS).reshape(rows, FINE_GROUPS)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(_class(hashes, first)),
                        pa.array(np.diff(first).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(hashes.view(np.int64))),
                        pa.array(_packed(_folded(fine)), pa.binary()),
                        pa.array(_packed(fine), pa.binary()),
                    ],
                    names=["class", "n", "shingles", "counts", "fine"],
                )

    return run


def _folded(fine: np.ndarray) -> np.ndarray:
    """Numbers of shingles in ``GROUPS`` groups from those in ``FINE_GROUPS``, a multiple of it."""
    return fine.reshape(len(fine), FINE_GROUPS // GROUPS, GROUPS).sum(axis=1, dtype=np.int64)


def _bounded(column: str, width: int, percent: int):
    """The pairs (a, b) whose group counts allow the overlap that a link needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = (_unpacked(batch.column(f"{column}_{side}"), width) for side in "ab")
            size = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            passed = (100 + percent) * np.minimum(one, other).sum(axis=1, dtype=np.int64) >= percent * size
            yield batch.select(["a", "b"]).filter(pa.array(passed))

    return run


class RTree:
    """Points of group counts; finds those of other components that may overlap enough with queries."""

    def __init__(self, points: np.ndarray, size: np.ndarray, component: np.ndarray, percent: int):
        self.points, self.size, self.component, self.percent = points, size, component, percent
        self.root = self._node(np.argsort(size, kind="stable"))

    def _node(self, rows: np.ndarray):
        points, size, component = self.points[rows], self.size[rows], self.component[rows]
        alone = component[0] if (component == component[0]).all() else None
        children = None
        if len(rows) > LEAF:
            # Split where the sizes differ, or else along the coordinate of the widest spread.
            if size.min() * 100 < size.max() * self.percent:
                order = rows
            else:
                order = rows[np.argsort(points[:, points.var(axis=0).argmax()], kind="stable")]
            half = len(order) // 2
            children = [self._node(np.sort(part)) if part is order else self._node(part) for part in (order[:half], order[half:])]
        return points.max(axis=0), size.min(), size.max(), alone, rows, children

    def search(self, points: np.ndarray, size: np.ndarray, component: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of queries and rows of points that pass the bound, leaf by leaf of a tree of the queries."""
        queries = self if points is self.points else RTree(points, size, component, self.percent)
        waiting = [(queries.root, self.root)]
        while waiting:
            one, other = waiting.pop()
            highest, least, largest, alone, places, parts = one
            top, low, high, same, rows, children = other
            if alone is not None and same is not None and alone == same:
                continue
            if 100 * largest < self.percent * low or 100 * high < self.percent * least:
                continue
            if (100 + self.percent) * np.minimum(highest, top).sum() < self.percent * (least + low):
                continue
            if children is not None:
                waiting += [(one, child) for child in children]
            elif parts is not None:
                waiting += [(part, other) for part in parts]
            else:
                overlap = np.minimum(points[places, None, :], self.points[None, rows, :]).sum(axis=2)
                passed = (100 + self.percent) * overlap >= self.percent * (size[places, None] + self.size[None, rows])
                i, j = np.nonzero(passed & (component[places, None] != self.component[None, rows]))
                yield places[i], rows[j]


class _Joined:
    """Union-find over the components that meet in one place."""

    def __init__(self, component: np.ndarray):
        self.known, self.of = np.unique(component, return_inverse=True)
        self.parent = np.arange(len(self.known))

    def root(self, row: int) -> int:
        at = self.of[row]
        while self.parent[at] != at:
            self.parent[at] = at = self.parent[self.parent[at]]
        return at

    def roots(self, rows: np.ndarray) -> np.ndarray:
        at = self.of[rows]
        while (self.parent[at] != at).any():
            at = self.parent[at]
        return at


def _passing(rows: pa.Table, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of rows of a block pair that belong to different components and pass the bounds of the tree and of the fine counts."""
    size, component, side = (rows.column(c).to_numpy() for c in ("n", "component", "side"))
    fine = _unpacked(rows.column("fine"), FINE_GROUPS)
    points = _folded(fine)
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if (side == 1).any() else left
    if not len(left) or not len(right):
        return
    tree = RTree(points[right], size[right], component[right], percent)
    asked = tree.points if right is left else points[left]
    for i, j in tree.search(asked, size[left], component[left]):
        i, j = left[i], right[j]
        overlap = np.minimum(fine[i], fine[j]).sum(axis=1, dtype=np.int64)
        passed = (100 + percent) * overlap >= percent * (size[i] + size[j])
        yield i[passed], j[passed]


def _alive(percent: int):
    """Rows (meet, side, class, component) that have a partner within the bounds where they meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, "meet"):
            alive = np.zeros(rows.num_rows, bool)
            for i, j in _passing(rows, percent):
                alive[i] = alive[j] = True
            if alive.any():
                yield from rows.select(["meet", "side", "class", "component"]).filter(pa.array(alive)).to_batches()

    return run


def _linked(percent: int):
    """Links (a, b) per block pair between components that no earlier link of the block pair joins."""

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        number, size, component = (rows.column(c).to_numpy() for c in ("class", "n", "component"))
        sets = rows.column("shingles").combine_chunks()
        first, hashes = sets.offsets.to_numpy(), sets.values.to_numpy()
        joined, a, b = _Joined(component), [], []
        for i, j in _passing(rows, percent):
            apart = joined.roots(i) != joined.roots(j)
            for x, y in zip(i[apart].tolist(), j[apart].tolist()):
                one, other = joined.root(x), joined.root(y)
                if one == other:
                    continue
                shared = len(np.intersect1d(hashes[first[x] : first[x + 1]], hashes[first[y] : first[y + 1]], assume_unique=True))
                if (100 + percent) * shared >= percent * (size[x] + size[y]):
                    joined.parent[one] = other
                    a.append(number[x])
                    b.append(number[y])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, "meet"):
            yield pairs(rows)

    return run


def _narrowed(labelled: DataFrame, staging: Staging) -> DataFrame:
    """Rows (cell, class, component) in which linked classes of different components still meet.

    Linked classes share ``need`` cells of a level or more, and a cell that two components share is mixed. So a class
    with fewer mixed cells is out; and each of the others may leave out its ``need - 1`` most crowded ones: of the cells
    that two linked classes share, the least crowded one stays with both.
    """

    def mixed(rows: DataFrame) -> DataFrame:
        cells = rows.groupBy("cell").agg(
            F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size")
        )
        return cells.where("low <> high").select("cell", "size")

    for turn in range(1, NARROWING + 1):
        cells = staging.write(mixed(labelled), f"mixed-{turn}")
        met = labelled.join(cells.select("cell"), "cell", "left_semi")
        enough = met.groupBy("class", "above", "need").count().where("count >= need").select("class", "above")
        labelled = staging.write(met.join(enough, ["class", "above"], "left_semi"), f"labelled-{turn}")
        staging.drop(f"labelled-{turn - 1}", f"mixed-{turn}")
    cells = staging.write(mixed(labelled), "mixed-cells")
    order = Window.partitionBy("class", "above").orderBy(F.col("size").desc(), "cell")
    ranked = labelled.join(cells, "cell").withColumn("place", F.row_number().over(order))
    kept = staging.write(ranked.where("place >= need").select("cell", "class", "component").distinct(), "kept")
    labelled = staging.write(kept.join(staging.write(mixed(kept), "mixed-kept"), "cell", "left_semi"), "labelled")
    staging.drop(f"labelled-{NARROWING}", "mixed-cells", "kept", "mixed-kept")
    return labelled


def _joined_again(labelled: DataFrame, sets: DataFrame, percent: int, staging: Staging, turn: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of the classes of a mixed cell with one of them, and the rows of ``labelled`` that are mixed after these links.

    Each cell and turn draws another one by hash, so a class meets many others of a group, with one comparison a cell.
    """
    drawn = F.struct(F.xxhash64(F.lit(turn), "cell", "class").alias("draw"), "class", "component")
    heads = labelled.groupBy("cell").agg(F.min(drawn).alias("head")).select("cell", "head.*")
    heads = heads.select("cell", F.col("class").alias("head"), F.col("component").alias("other"))
    pairs = labelled.join(heads, "cell").where("component <> other")
    pairs = pairs.select(F.least("class", "head").alias("a"), F.greatest("class", "head").alias("b")).distinct()
    name = f"again-{turn}"
    links = staging.write(_verified(pairs, sets, percent, staging, name), name)
    if links.isEmpty():
        return links, labelled
    of = staging.write(labelled.select("class", "component").distinct(), f"{name}-of")
    ends = links.join(_side(of, "a", "component"), "a").join(_side(of, "b", "component"), "b")
    ends = ends.select(F.col("component_a").alias("a"), F.col("component_b").alias("b")).distinct()
    roots = components(ends, staging, f"{name}-roots").withColumnRenamed("node", "component")
    now = labelled.join(roots, "component", "left").select("cell", "class", F.coalesce("root", "component").alias("component"))
    now = staging.write(now, f"{name}-all")
    mixed = now.groupBy("cell").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    kept = staging.write(now.join(mixed.select("cell"), "cell", "left_semi"), f"{name}-labelled")
    staging.drop(f"{name}-counts", f"{name}-fine", f"{name}-of", f"{name}-all", f"again-{turn - 1}-labelled")
    return links, kept


def _side(rows: DataFrame, side: str, *columns: str) -> DataFrame:
    return rows.select(F.col("class").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])


def _alike(shared, percent: int):
    return (100 + percent) * shared >= percent * (F.col("n_a") + F.col("n_b"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, staging: Staging, name: str) -> DataFrame:
    """The pairs (a, b) whose sets are alike enough; narrow bounds by size and group counts come before the sets."""
    sized = pairs.join(_side(sets, "a", "n"), "a").join(_side(sets, "b", "n"), "b")
    sized = sized.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").select("a", "b")
    near = sized
    for column, width in (("counts", GROUPS), ("fine", FINE_GROUPS)):
        both = near.join(_side(sets, "a", "n", column), "a").join(_side(sets, "b", "n", column), "b")
        near = staging.write(both.mapInArrow(_bounded(column, width, percent), "a long, b long"), f"{name}-{column}")
    joined = near.join(_side(sets, "a", "n", "shingles"), "a").join(_side(sets, "b", "n", "shingles"), "b")
    return joined.where(_alike(F.size(F.array_intersect("shingles_a", "shingles_b")).cast("long"), percent)).select("a", "b")


def _blocks(rows: DataFrame, key: str) -> DataFrame:
    """Rows (meet, side, class, component) of classes of a ``key`` that is cut into ``blocks``: each pair of blocks meets once."""
    cut = rows.withColumn("own", F.pmod(F.xxhash64("class"), "blocks"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return cut.select(
        F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other")).alias("meet"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
        "class",
        "component",
    )


def _gathered(alive: DataFrame, staging: Staging) -> DataFrame:
    """Places (meet, side, class, component) where all classes that meet in ``alive`` meet again, with fewer rows.

    Classes with a partner are few, but the same ones meet in place after place. Those that are joined by common places
    are neighbours; they meet in one place, or in pairs of blocks of it, unless their places have fewer rows.
    """
    heads = alive.groupBy("meet").agg(F.min("class").alias("head"))
    edges = alive.join(heads, "meet").where("class <> head").select(F.col("head").alias("a"), F.col("class").alias("b"))
    near = components(edges.distinct(), staging, "near").select(F.col("node").alias("class"), F.col("root").alias("near"))
    near = staging.write(near, "near")
    rows = alive.join(near, "class")
    members = rows.select("near", "class", "component").distinct()
    blocks = F.ceil(F.count(F.lit(1)) / BLOCK).cast("long")
    cut = members.groupBy("near").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("size"))
    fewer = rows.groupBy("near").agg(F.count(F.lit(1)).alias("rows")).join(cut, "near").where("size * blocks <= rows")
    fewer = staging.write(fewer.select("near", "blocks"), "neighbours")
    once = _blocks(members.join(fewer, "near"), "near")
    return rows.join(fewer, "near", "left_anti").select(once.columns).unionByName(once)


def _turns(places: DataFrame, sets: DataFrame) -> int:
    """In how many turns the sets go to their places if one turn may carry ``CARRIED`` times the room of all sets."""
    room = F.sum(F.col("n") + FINE_GROUPS // 8).alias("room")
    carried = places.join(sets.select("class", "n"), "class").agg(room).first().room or 0
    held = sets.agg(room).first().room or 1
    return max(1, math.ceil(carried / (CARRIED * held)))


def _found(places: DataFrame, sets: DataFrame, percent: int, staging: Staging) -> DataFrame:
    """Links (a, b) of all places. A class has many places, so its set goes to some of them at a time: the exchange of a turn
    is deleted before the next one begins, and what is on disk at once grows with the sets, not with the places."""
    turns = _turns(places, sets)
    turn_of = F.pmod(F.xxhash64(F.lit("turn"), "meet"), F.lit(turns))
    whole = sets.select("class", "n", "fine", "shingles")
    links = []
    for turn in range(turns):
        rows = places.where(turn_of == turn).join(whole, "class").repartition("meet").sortWithinPartitions("meet")
        links.append(staging.write(rows.mapInArrow(_linked(percent), "a long, b long").distinct(), f"found-{turn}"))
    staging.drop("places")
    return reduce(DataFrame.unionByName, links).distinct()


def _heads(cells: DataFrame) -> DataFrame:
    """The least class of each cell that has several."""
    found = cells.groupBy("cell").agg(F.min("class").alias("head"), F.max("class").alias("last"))
    return found.where("head <> last").select("cell", "head")


def _grouped(docs: DataFrame, text: str, shingle: int, percent: int, staging: Staging) -> DataFrame:
    """Rows (row_key, n, group), one per distinct row; equal groups are one component, documents without words have none."""
    keyed = docs.select(row_key(*docs.columns).alias("row_key"), F.col(text).alias("text"))
    schema = "row_key long, n long, class long, cells array<long>, own int, need int, need_above int"
    described = staging.write(keyed.mapInArrow(_describe(shingle, percent), schema), "described", compression="zstd")
    cells = described.select("class", F.explode("cells").alias("cell"))
    heads = staging.write(_heads(cells), "heads")
    signed = described.select("class", "own", "need", "need_above", F.posexplode("cells").alias("at", "cell"))
    above = F.col("at") >= F.col("own")
    signed = signed.select("class", "cell", above.alias("above"), F.when(above, F.col("need_above")).otherwise(F.col("need")).alias("need"))
    entries = staging.write(signed.join(heads.select("cell"), "cell", "left_semi").distinct(), "entries-0")
    classes = staging.write(described.select("row_key", "n", "class").distinct(), "classes")
    staging.drop("described", "heads")
    for turn in range(1, TURNS + 1):
        enough = entries.groupBy("class", "above", "need").count().where("count >= need").select("class", "above")
        entries = entries.join(enough, ["class", "above"], "left_semi")
        entries = staging.write(entries, f"enough-{turn}")
        entries = staging.write(entries.join(_heads(entries).select("cell"), "cell", "left_semi"), f"entries-{turn}")
        staging.drop(f"entries-{turn - 1}", f"enough-{turn}")
    entries = staging.write(entries.join(_heads(entries), "cell"), "entries")
    staging.drop(f"entries-{TURNS}")

    wanted = classes.join(entries.select("class").distinct(), "class", "left_semi").groupBy("class")
    wanted = wanted.agg(F.min("row_key").alias("row_key")).select("row_key")
    chosen = keyed.join(wanted.hint("shuffle_hash"), "row_key", "left_semi")
    sets = chosen.mapInArrow(_vectors(shingle), "class long, n long, shingles array<long>, counts binary, fine binary")
    sets = staging.write(sets, "sets")
    # Repeated rows share a key and give their set twice.
    if not sets.groupBy("class").count().where("count > 1").isEmpty():
        sets = staging.write(sets.dropDuplicates(["class"]), "sets-once")

    star = entries.where("class <> head").select(F.col("head").alias("a"), F.col("class").alias("b")).distinct()
    star = staging.write(_verified(star, sets, percent, staging, "star"), "star")
    first = components(star, staging, "first")

    labelled = entries.join(first.withColumnRenamed("node", "class"), "class", "left")
    labelled = labelled.select("cell", "class", "above", "need", F.coalesce("root", "class").alias("component"))
    labelled = _narrowed(staging.write(labelled, "labelled-0"), staging)
    for turn in range(1, AGAIN + 1):
        links, labelled = _joined_again(labelled, sets, percent, staging, turn)
        if links.isEmpty():
            break
        star = star.unionByName(links)
    # Cells of the same classes need one search only; what they hold is known by count and two hashes.
    mixed = labelled.groupBy("cell").agg(
        F.count(F.lit(1)).alias("size"),
        F.bit_xor(F.xxhash64("class")).alias("one"),
        F.bit_xor(F.xxhash64(F.lit(1), "class")).alias("two"),
    )
    mixed = mixed.groupBy("size", "one", "two").agg(F.min("cell").alias("cell"))
    mixed = staging.write(mixed.select("cell", F.ceil(F.col("size") / BLOCK).cast("long").alias("blocks")), "mixed")
    spread = _blocks(labelled.join(mixed, "cell"), "cell")
    points = spread.join(sets.select("class", "n", "fine"), "class").repartition("meet").sortWithinPartitions("meet")
    alive = points.mapInArrow(_alive(percent), "meet long, side int, class long, component long")
    alive = staging.write(alive, "alive")
    # Again places of the same classes need one search only.
    shape = alive.groupBy("meet").agg(
        F.count(F.lit(1)).alias("size"),
        F.bit_xor(F.xxhash64("class", "side")).alias("one"),
        F.bit_xor(F.xxhash64(F.lit(1), "class", "side")).alias("two"),
    )
    once = staging.write(shape.groupBy("size", "one", "two").agg(F.min("meet").alias("meet")).select("meet"), "once")
    # Written, as the next step reads these rows several times.
    distinct = staging.write(alive.join(once, "meet", "left_semi"), "alive-once")
    places = staging.write(_gathered(distinct, staging), "places")
    staging.drop("mixed", "labelled", *[f"again-{turn}-labelled" for turn in range(1, AGAIN + 1)], "alive", "once", "alive-once", "near")
    found = _found(places, sets, percent, staging)
    last = components(star.unionByName(found), staging, "last")

    grouped = classes.join(last.withColumnRenamed("node", "class"), "class", "left")
    group = F.when(F.col("n") > 0, F.coalesce("root", "class"))
    grouped = staging.write(grouped.select("row_key", "n", group.alias("group")), "grouped")
    staging.drop("entries", "classes", "sets", "sets-once", "star-counts", "star-fine")
    return grouped


def join_components(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """Rows (id, n_shingles, component_id), one for each row of ``docs``.

    Words are lower-cased (A-Z only); the set of a document holds its distinct ``shingle``-word sequences, or all its
    words as one if it has fewer. Two documents link if 100 * intersection >= percent * union, and component_id is the
    least id that can be reached. Documents without words, null texts included, are linked with nothing and keep their
    own id. Repeated rows and copies share a component; a null id takes the component of its links, or null. Other
    columns play no part. ``percent`` is from 50 to 99. An empty table gives an empty result.
    """
    staging = Staging(docs.sparkSession, "jaccard")
    narrow = docs.select(id_column, text)
    grouped = _grouped(narrow, text, shingle, percent, staging)
    ids = narrow.select(F.col(id_column), row_key(id_column, text).alias("row_key"))
    rows = staging.write(ids.join(grouped, "row_key").select(id_column, "n", "group"), "rows")
    least = rows.where("group IS NOT NULL").groupBy("group").agg(F.min(id_column).alias("component_id"))
    joined = rows.join(least, "group", "left")
    component = F.when(F.col("group").isNull(), F.col(id_column)).otherwise(F.col("component_id"))
    return joined.select(id_column, F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80
) -> DataFrame:
    """``docs`` without near duplicates: of each component the row of the least id stays (null ids come last).

    Of rows that are equal in id and text one stays. Documents without words all stay. See `join_components` for what
    links.
    """
    staging = Staging(docs.sparkSession, "one-of-each")
    narrow = docs.select(id_column, text)
    grouped = _grouped(narrow, text, shingle, percent, staging)
    ids = narrow.select(F.col(id_column).alias("id"), row_key(id_column, text).alias("row_key"))
    rows = staging.write(ids.join(grouped, "row_key").select("row_key", "group", "id"), "rows")
    with_words = rows.where("group IS NOT NULL")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row_key")
    least = with_words.groupBy("group").agg(F.min(order).alias("least")).select("least.row_key")
    stays = staging.write(rows.where("group IS NULL").select("row_key").distinct().unionByName(least), "stays")
    repeated = with_words.groupBy("row_key").count().where("count > 1").select("row_key")
    repeated = staging.write(repeated.join(stays, "row_key", "left_semi"), "repeated")
    # The document travels as one column, so no name of it meets a name of ours.
    whole = F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("document")
    kept = docs.select(whole, row_key(id_column, text).alias("_row_key")).join(_keys(stays), "_row_key", "left_semi")
    if not repeated.isEmpty():
        once = kept.join(_keys(repeated), "_row_key", "left_semi").dropDuplicates(["_row_key"])
        kept = kept.join(_keys(repeated), "_row_key", "left_anti").unionByName(once)
    return kept.select("document.*")


def _keys(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("row_key").alias("_row_key")).hint("shuffle_hash")
