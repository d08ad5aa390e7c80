"""Connected components by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierlake.llm import common


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from every node of ``edges`` (u, v): node, label.

    Every round ties the larger neighbours of a node to its smallest one, then the smaller ones. The
    number of edges never grows beyond that of the first round; rounds grow with the logarithm of the
    longest chain. Minima are aggregated before the shuffle, so a hub costs no task more than its
    edges. Each round's edges are written to the checkpoint folder. Nodes that only have an edge to
    themselves, and nulls, are left out.
    """
    pair = F.array_sort(F.array("u", "v"))
    now = edges.where((F.col("u") != F.col("v"))).select(F.get(pair, F.lit(1)).alias("u"), F.get(pair, F.lit(0)).alias("v")).distinct()
    now, before = common.checkpoint(now), None
    while (state := _state(now)) != before:
        before = state
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = common.checkpoint(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _state(edges: DataFrame) -> tuple:
    """A fingerprint of the set of edges."""
    h = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h)).first())
