"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

FEW = 50_000  # links that one task takes without a shuffle; more are dealt out


def components(links: DataFrame, scratch: Scratch, most: int | None = None) -> DataFrame:
    """``links(a, b)`` to ``(node, root)``: each linked node and the smallest
    node it is connected with (roots themselves are not listed).

    Every step writes its edges to the shared folder. Nothing reaches the
    driver but a count and a checksum, and a node with very many links is only
    ever aggregated or joined. Up to ``FEW`` links are read by one task, so that
    a small round costs no shuffles of mostly empty partitions; ``most`` bounds
    their number where that is known before they are counted.
    """
    one = lambda df, n: df.coalesce(1) if n is not None and n <= FEW else df
    turned = one(links, most).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v")
    edges = scratch.keep(turned.distinct())
    mark, n = None, edges.count()
    while True:
        both = one(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), n)
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        large = scratch.keep(large)
        read = one(large, n)
        low = read.groupBy("u").agg(F.min("v").alias("m"))
        small = read.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").unionByName(low.select("u", F.col("m").alias("v")))
        small = scratch.keep(one(small, n).distinct())
        scratch.drop(edges, large)
        now = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        edges, n = small, now[0]
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
