"""Connected components by alternating stars, as joins and aggregations over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.tables import Staging


def components(links: DataFrame, staging: Staging, name: str) -> DataFrame:
    """Rows (node, root) for every node of ``links`` (a, b); the root is the least node that can be reached.

    Each round points nodes at the least neighbour of a neighbour; a logarithmic number of rounds is enough, and a node
    with very many links is never gathered: its neighbours are only aggregated and joined.
    """
    v, u = F.col("v"), F.col("u")
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    edges = staging.write(pairs, f"{name}-0")
    state, turn = None, 0
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == state:
            break
        state, turn = now, turn + 1
        both = edges.unionByName(edges.select(u.alias("v"), v.alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), v).alias("m"))
        large = both.join(least, "v").where("u > v").select(u.alias("v"), F.col("m").alias("u")).distinct()
        large = staging.write(large, f"{name}-{turn}-large")
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        met = large.join(least, "v")
        small = met.select("v", F.col("m").alias("u")).unionByName(
            met.where("u <> m").select(u.alias("v"), F.col("m").alias("u"))
        )
        edges = staging.write(small.distinct(), f"{name}-{turn}")
        staging.drop(f"{name}-{turn}-large", f"{name}-{turn - 1}")
    nodes = edges.select(v.alias("node"), u.alias("root"))
    return nodes.unionByName(nodes.select("root").distinct().select(F.col("root").alias("node"), "root"))
