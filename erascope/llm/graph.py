"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erascope.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b``); the root is the smallest node reachable.

    Alternates two steps until the links stop changing. Large star: every neighbour above a node is linked to
    the smallest node of its neighbourhood. Small star: a node and its smaller neighbours are linked to the
    smallest of them. Only minima are aggregated, so a node with very many links is one row after map-side
    combining; the join back is an equi-join that AQE splits. Each round is written to the shared folder.
    Rows with a null end are no links. No links: an empty result.
    """
    pair = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = staged(pair.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lows = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(lows, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        lows = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lows, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        now = staged(lows.select("a", F.col("low").alias("b")).unionByName(small).distinct(), "links")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(links: DataFrame) -> tuple[int, int | None]:
    row = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]
