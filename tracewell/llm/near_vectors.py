"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosines, connected components.

Method:

1. Equal vectors of one label form a class; from here on only classes count, so copies cost nothing.
2. *Signs.* In each of ``TABLES`` tables a class is known by the signs of ``BITS`` projections. Classes of a label with the
   same signs share a bucket. Two vectors at the threshold share one of the tables with a probability of 0.97, closer
   ones with a higher one; buckets of one class are dropped before vectors travel.
3. *Balls.* In a bucket of over ``CROWD`` classes a centre is made of eight members. Classes within half the threshold's
   angle of the centre are joined, and what is joined gets one common centre, whose ball again has half that angle: all
   in a ball are linked with one another, by the triangle inequality, without being compared. A large group of near
   copies costs one step a member; buckets that hold one ball only are done.
4. *Cosines.* The classes of the other buckets meet and are compared in double precision, those of one ball excepted. A
   bucket of over ``BLOCK`` classes is cut into blocks: the classes outside its largest ball meet all, those inside
   meet only them. A pair that shares several tables counts in the first. A task returns one row per class, its links
   and the least class it is connected with, so that rows grow with members and not with pairs.
5. Components of the classes are found by distributed joins.

No bucket or group is capped. Pairs that share no table are not found; the parameters set how few those are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import words
from tracewell.llm.graphs import components
from tracewell.llm.streams import groups, lists, matrix
from tracewell.llm.tables import Staging

COSINE = 0.93
TABLES = 20
BITS = 14
CROWD = 64
BLOCK = 512
SEED = 11
_CENTRE = 8


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; very large and very small components neither overflow nor vanish."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _sign(tables: int, bits: int, seed: int):
    """Rows (class, copies, vector, keys) of classes: the bucket of each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("dimension").to_numpy()
            for dimension in np.unique(size).tolist():
                part = batch.filter(pa.array(size == dimension))
                planes = np.random.Generator(np.random.PCG64([seed, dimension])).standard_normal((dimension, tables * bits))
                signs = (unit(matrix(part.column("vector"))) @ planes > 0).reshape(-1, tables, bits)
                code = signs.astype(np.uint64) @ (np.uint64(1) << np.arange(bits, dtype=np.uint64))
                place = words.mix(np.arange(tables, dtype=np.uint64) * np.uint64(1 << 20) + np.uint64(dimension))
                label = words.mix(part.column("label_key").to_numpy().view(np.uint64))
                keys = words.mix(words.mix(code ^ place[None, :]) ^ label[:, None])
                yield pa.RecordBatch.from_arrays(
                    [part.column("class"), part.column("copies"), part.column("vector"), lists(keys.view(np.int64))],
                    names=["class", "copies", "vector", "keys"],
                )

    return run


def _inside(cosine: float):
    """Rows (class, centre) of those (class, centre, vector, chosen) that lie within half the angle of the threshold."""
    least = np.cos(np.arccos(cosine) / 2) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            keep = np.zeros(rows, bool)
            size = np.array([len(v) for v in batch.column("vector")])
            for dimension in np.unique(size).tolist():
                at = np.flatnonzero(size == dimension)
                part = batch.take(pa.array(at))
                chosen = matrix(part.column("chosen").flatten()).reshape(len(at) * _CENTRE, dimension)
                middle = unit(chosen).reshape(len(at), _CENTRE, dimension).mean(axis=1)
                turned = np.abs(middle).max(axis=1) > 0
                at, middle = at[turned], middle[turned]
                vectors = unit(matrix(part.column("vector"))[turned])
                keep[at] = (vectors * unit(middle)).sum(axis=1) >= least if len(at) else False
            yield batch.select(["class", "centre"]).filter(pa.array(keep))

    return run


def _links(cosine: float):
    """Rows (class, links, root) of the classes that are linked where they meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, "meet"):
            number, copies, side, table = (rows.column(c).to_numpy() for c in ("class", "copies", "side", "table"))
            ball, loose = rows.column("ball").fill_null(0).to_numpy(), rows.column("ball").is_null().to_numpy()
            vectors, keys = unit(matrix(rows.column("vector"))), matrix(rows.column("keys"), np.int64)
            left = np.flatnonzero(side == 0)
            right = np.flatnonzero(side == 1) if (side == 1).any() else left
            links, root = np.zeros(len(number), np.int64), np.arange(len(number))
            edges = []
            for begin in range(0, len(left), 256):
                part = left[begin : begin + 256]
                near = vectors[part] @ vectors[right].T >= cosine
                near &= loose[part, None] | loose[None, right] | (ball[part, None] != ball[None, right])
                if right is left:
                    near &= np.arange(begin, begin + len(part))[:, None] < np.arange(len(right))[None, :]
                i, j = np.nonzero(near)
                i, j = part[i], right[j]
                once = (keys[i, : table[0]] != keys[j, : table[0]]).all(axis=1)
                i, j = i[once], j[once]
                links += np.bincount(i, weights=copies[j], minlength=len(number)).astype(np.int64)
                links += np.bincount(j, weights=copies[i], minlength=len(number)).astype(np.int64)
                edges.append((i, j))
            i, j = (np.concatenate([e[k] for e in edges]) if edges else np.zeros(0, np.int64) for k in (0, 1))
            while True:
                lower = root.copy()
                np.minimum.at(lower, i, root[j])
                np.minimum.at(lower, j, root[i])
                lower = lower[lower]
                if (lower == root).all():
                    break
                root = lower
            linked = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array(number[linked]), pa.array(links[linked]), pa.array(number[root[linked]])], names=["class", "links", "root"]
            )

    return run


def _centred(members: DataFrame, cosine: float) -> DataFrame:
    """The members (class, centre, vector) within half the angle of what a few members of the centre's group mark."""
    few = [F.max_by("vector", F.xxhash64("class", F.lit(i))).alias(f"v{i}") for i in range(_CENTRE)]
    chosen = members.groupBy("centre").agg(*few)
    chosen = chosen.select("centre", F.array(*[f"v{i}" for i in range(_CENTRE)]).alias("chosen"))
    return members.join(chosen, "centre").mapInArrow(_inside(cosine), "class long, centre long")


def _balls(bucketed: DataFrame, sizes: DataFrame, signed: DataFrame, cosine: float, crowd: int, staging: Staging) -> DataFrame:
    """Rows (class, ball): groups of which any two are linked."""
    crowded = staging.write(sizes.where(F.col("size") > crowd).select("bucket"), "crowded")
    if crowded.isEmpty():
        return signed.select("class", F.lit(0).cast("long").alias("ball")).limit(0)
    members = staging.write(bucketed.select("class", "bucket").join(crowded, "bucket"), "crowd")
    members = members.join(signed.select("class", "vector"), "class").withColumnRenamed("bucket", "centre")
    members = staging.write(members, "crowd-vectors")
    near = staging.write(_centred(members, cosine), "near")
    joined = components(near.select(F.col("class").alias("a"), F.col("centre").alias("b")), staging, "crowds")
    joined = near.select("class").distinct().join(joined.withColumnRenamed("node", "class"), "class")
    joined = joined.join(signed.select("class", "vector"), "class").withColumnRenamed("root", "centre")
    joined = staging.write(joined, "joined")
    balls = staging.write(_centred(joined, cosine).withColumnRenamed("centre", "ball"), "balls")
    staging.drop("crowded", "crowd", "crowd-vectors", "near", "joined")
    return balls


def _meetings(members: DataFrame, block: int, staging: Staging) -> DataFrame:
    """Rows (meet, side, table, class): which classes of which buckets are compared in one place."""
    balls = members.groupBy("bucket", "ball").count()
    within = F.col("ball").isNotNull()
    shape = balls.groupBy("bucket").agg(
        F.sum("count").alias("size"),
        F.max(F.when(within, F.struct("count", "ball"))).alias("most"),
    )
    small = F.col("size") <= block
    major = F.coalesce(F.col("most.count"), F.lit(0))
    shape = shape.where(F.col("size") > major).select(
        "bucket",
        F.when(~small, F.col("most.ball")).alias("largest"),
        F.when(small, 1).otherwise(F.ceil((F.col("size") - major) / block)).cast("long").alias("minors"),
        F.when(small, 0).otherwise(F.ceil(major / block)).cast("long").alias("majors"),
    )
    shape = staging.write(shape, "shape")
    met = members.join(shape, "bucket").withColumn("inside", F.coalesce(F.col("ball") == F.col("largest"), F.lit(False)))
    own = F.pmod(F.xxhash64("class"), F.when(F.col("inside"), F.col("majors")).otherwise(F.col("minors")))
    met = met.withColumn("own", own)

    def place(kind: int, one, other, side):
        return F.struct(F.xxhash64("bucket", F.lit(kind), one, other).alias("meet"), F.lit(side).cast("int").alias("side"))

    zero = F.lit(0).cast("long")
    across = F.transform(F.sequence(zero, F.col("minors") - 1), lambda i: place(1, i, F.col("own"), 1))
    among = F.transform(
        F.sequence(zero, F.col("minors") - 1),
        lambda i: place(0, F.least(i, "own"), F.greatest(i, "own"), (F.col("own") > i)),
    )
    outward = F.transform(F.sequence(zero, F.col("majors") - 1), lambda i: place(1, F.col("own"), i, 0))
    places = F.when(F.col("inside"), across).otherwise(F.when(F.col("majors") > 0, F.concat(among, outward)).otherwise(among))
    return met.select("table", "class", F.explode(places).alias("at")).select("at.meet", "at.side", "table", "class")


def link(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    cosine: float = COSINE,
    tables: int = TABLES,
    bits: int = BITS,
    crowd: int = CROWD,
    block: int = BLOCK,
    seed: int = SEED,
) -> DataFrame:
    """Rows (id, n_links, component_id, kept), one for each row of ``vectors``.

    Vectors are compared with those of the same label and number of components; a link is a cosine of ``cosine`` or more.
    Rows link with nothing and keep their own id if the label is null, or if the vector is null, empty, zero or holds
    null or non-finite components. Repeated rows count as vectors of their own and are linked. ``component_id`` is the
    least id that can be reached; a null id takes that of its links, or null, and is never ``kept``. Other columns play
    no part. An empty table gives an empty result.
    """
    staging = Staging(vectors.sparkSession, "near-vectors")
    rows = vectors.select(F.col(id_column).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    broken = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("label").isNotNull() & F.col("vector").isNotNull() & ~broken & F.exists("vector", lambda x: x != 0)
    # Adding zero makes -0.0 and 0.0 one value for the hash, as they are for grouping.
    plain = F.transform("vector", lambda x: x + F.lit(0).cast("float"))
    rows = rows.select("id", "label", plain.alias("vector"), F.when(usable, F.xxhash64("label", plain)).alias("class"))
    classes = rows.where("class IS NOT NULL").groupBy("class", "label", "vector").agg(F.count(F.lit(1)).alias("copies"))
    classes = classes.select(
        "class", "copies", "vector", F.size("vector").alias("dimension"), F.xxhash64("label").alias("label_key")
    )
    kind = vectors.schema[vector].dataType.simpleString()
    schema = f"class long, copies long, vector {kind}, keys array<long>"
    signed = staging.write(classes.mapInArrow(_sign(tables, bits, seed), schema), "signed")
    bucketed = signed.select("class", F.posexplode("keys").alias("table", "bucket"))
    sizes = staging.write(bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    balls = _balls(bucketed, sizes, signed, cosine, crowd, staging)
    members = bucketed.join(sizes.select("bucket"), "bucket").join(balls, "class", "left")
    members = staging.write(members, "members")
    met = _meetings(members, block, staging).join(signed, "class").join(balls, "class", "left")
    met = met.repartition("meet").sortWithinPartitions("meet", "side")
    found = staging.write(met.mapInArrow(_links(cosine), "class long, links long, root long"), "found")
    staging.drop("sizes", "members", "shape")

    inside = balls.join(signed.select("class", "copies"), "class")
    totals = inside.groupBy("ball").agg(F.sum("copies").alias("total"), F.min("class").alias("head"))
    totals = staging.write(totals, "totals")
    inside = staging.write(inside.join(totals, "ball").select("class", "total", "head"), "inside")
    edges = found.select(F.col("class").alias("a"), F.col("root").alias("b"))
    edges = edges.unionByName(inside.select(F.col("class").alias("a"), F.col("head").alias("b")))
    roots = components(edges, staging, "components").withColumnRenamed("node", "class")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    known = signed.select("class", "copies").join(links, "class", "left").join(inside, "class", "left").join(roots, "class", "left")
    near = F.coalesce("links", F.lit(0)) + F.coalesce("total", "copies") - 1
    known = staging.write(known.select("class", near.alias("n_links"), F.coalesce("root", "class").alias("root")), "known")
    staging.drop("signed", "balls", "found", "totals", "inside")

    ids = staging.write(rows.select("id", "class").join(known, "class", "left").select("id", "n_links", "root"), "ids")
    least = staging.write(ids.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("component_id")), "least")
    result = ids.join(least, "root", "left")
    component = F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return result.select(
        F.col("id").alias(id_column),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
