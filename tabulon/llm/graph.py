"""Connected components of a link table by alternating star contraction.

A round aggregates and joins; links are never collected.  Hub nodes may own
any share of the edges: minima are combined before the shuffle and joined back
by broadcast while the counted edges allow, else as a written table, so that
AQE can split a hot key.  The loop ends when the edges form stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.scratch import BROADCAST_ROWS, broadcast_if, written


def _state(edges: DataFrame) -> tuple[int, bool]:
    """Number of edges, and whether some node points at two others or stands in the middle."""
    ends = edges.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("lo").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    n, unfinished = nodes.agg(F.coalesce(F.sum("up"), F.lit(0)),
                              F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()
    return n, bool(unfinished)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): component is the smallest id reachable; ids without a link are absent."""
    edges = written(links.where(F.col(a) != F.col(b))
                    .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    n, unfinished = _state(edges)
    while unfinished:
        def joinable(df: DataFrame, rows: int = 2 * n) -> DataFrame:
            return broadcast_if(df if rows <= BROADCAST_ROWS else written(df), rows)

        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour points at the smallest neighbour
        large = written(both.where("v > u").join(joinable(least), "u")
                        .select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi != lo").distinct())
        # small star: smaller neighbours are joined among themselves
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        edges = written(
            large.join(joinable(low), "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi != lo")
            .unionByName(low.select("hi", F.col("m").alias("lo"))).distinct())
        n, unfinished = _state(edges)
    return edges.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
