"""Connected components of a graph that does not fit anywhere: alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loftline.llm.common import settled


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node with a link to another; root is the smallest node reachable.

    Every round points the larger neighbours of a node at the node's smallest neighbour, then its smaller ones;
    the forest of links flattens into stars in about log2(longest path) rounds.  Minima are combined map-side and
    joined back; they are not kept first, so a node with very many links is dealt to one task of a join.  Each round is
    kept in the checkpoint folder.  Links from a node to itself and nulls are ignored; no links, no rows.
    """
    e = settled(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        far = (both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = far.groupBy("u").agg(F.min("v").alias("m"))
        near = (far.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                                          F.col("m").alias("v")).distinct())
        e = settled(near)
        was, mark = mark, _mark(e)
        if was == mark:
            break
    return (e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
