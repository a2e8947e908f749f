"""Connected components by alternating stars, without any component in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of links (a, b: long), component being its smallest node.

    Each round hangs every node's larger neighbours on its smallest neighbour (large star), then its
    smaller neighbours (small star); the links end as stars around the smallest nodes. No links give
    no rows; nulls and loops are left out.
    """
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links, before = c.cut(links), None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select("v", "v")).distinct()
        before = now
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = c.join_unique(both, least, "u", "n").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = c.join_unique(large, least, "u", "n").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = c.cut(small.union(least.select("u", "m")).distinct())
