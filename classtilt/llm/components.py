"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classtilt.session import cut


def _star(edges: DataFrame) -> DataFrame:
    """(u, v) with the smallest neighbour of u (u itself included) beside each."""

    least = edges.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
    return edges.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) of longs to rows (node, root): root is the smallest node that is reachable.

    Every round is written to the checkpoint folder; it ends when a round changes nothing. Only two numbers per round
    reach the driver. No links give an empty table; loops and repeated links change nothing.
    """

    edges = cut(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )

    def mark(rows: DataFrame) -> tuple:
        return tuple(
            rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        )

    seen = mark(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _star(large)
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v"))
        )
        edges = cut(small.distinct())
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
