"""Connected components of a link table by alternating star contractions.

Each round re-points every node at the smallest neighbour it has seen
(Kiveris et al., "Connected Components in MapReduce and Beyond").  All work
is joins and partially aggregated minima; the table never grows beyond its
links, nothing is collected, and a hub is never one task's problem: its
minimum is pre-aggregated and its join partition can be split by AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetflow.llm.common import materialise


def _minima(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("k", "m").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = _minima(both)
    return (both.join(low, both["a"] == low["k"]).filter(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())


def _small_star(links: DataFrame) -> DataFrame:
    low = _minima(links)
    moved = links.join(low, links["a"] == low["k"])
    return (moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select(F.col("k").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct())


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links (a, b)``; root is the smallest node reachable.

    Nodes without links do not appear.  Rounds run until nothing changes.
    """
    work = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                       .filter("a <> b").distinct(), "links")
    before = None
    while True:
        mark = work.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        work = materialise(_small_star(materialise(_large_star(work), "large")), "small")
    roots = work.groupBy("a").agg(F.min("b").alias("b"))
    return (roots.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .union(work.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
