"""Connected components of links between numbered nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.common import dropped, saved


def _mark(edges: DataFrame) -> tuple[int, ...]:
    """Number of edges and two sums of their hashes: differs, but for an unlikely accident, when the edges differ."""
    code = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(code, 32)), F.sum(code.bitwiseAND(0xFFFFFFFF))).first())


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node that it reaches) for every node of ``links`` (columns a, b).

    Alternates large and small stars: each node hands its larger, then its smaller neighbours to the smallest one, so
    the number of rounds grows with the logarithm of the longest path. Only sums and minima leave a group, no lists.
    """
    edges = saved(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    now = _mark(edges)
    while now[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        near = large.join(least, "a")
        small = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            near.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        last, edges = edges, saved(small, "links")
        dropped(last)
        before, now = now, _mark(edges)
        if now == before:  # the same edges again: every component is a star
            break
    roots = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    named = saved(roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "roots")
    dropped(edges)
    return named
