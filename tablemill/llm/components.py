"""Connected components of a graph of ids, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import staged


def _star(edges: DataFrame, inner: bool) -> DataFrame:
    """One step over edges (u, v) with u > v: hang neighbours of a node on the least of them.

    ``inner`` takes each node's smaller neighbours and itself, otherwise its larger ones move. Minima are combined before
    the shuffle. The join brings one row per node to its edges; the minima have a key of their own, so that Spark
    shuffles them by themselves and can split the edges of a node that has very many.
    """
    both = edges if inner else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("_m")).withColumn("_m", F.least("u", "_m"))
    keyed = least.select(F.bitwise_not("u").alias("_u"), "_m")
    joined = both.join(keyed, F.bitwise_not("u") == F.col("_u")).select("u", "v", "_m")
    if inner:
        own = least.select("u", F.col("_m").alias("v"))
        return joined.where("v > _m").select(F.col("v").alias("u"), F.col("_m").alias("v")).unionByName(own).distinct()
    return joined.where("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v): the component is its smallest node.

    Loops and nulls are left out, repeated edges and either direction are fine; no edges give no rows. Each round is
    staged; the number of rounds grows with the logarithm of the longest path.
    """
    now = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        # order-free fingerprint of the edges
        said = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if said == seen or not said[0]:
            break
        seen = said
        now = staged(_star(_star(now, inner=False), inner=True), "edges")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
