"""Connected components by alternating large and small stars, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.runtime import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (``u`` > ``v``): link neighbours to the least one around.

    Minima are combined on the map side; the join that hands them out is one that
    Spark can split where a hub is hot.
    """
    both = edges.select("u", "v")
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.join(least, "u")
    if large:
        linked = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = out.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return linked.where("u != v").distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """``u`` and ``root`` (the least node it is linked to) for every node of ``edges`` (columns ``u``, ``v``) but the roots.

    Every step is written to the shared folder, so lineage stays short. It ends
    when a step changes nothing; stars halve paths, so steps grow with the
    logarithm of the longest one.
    """
    edges = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialize(edges, "edges")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())

    before = state(edges)
    for _ in range(most):
        edges = materialize(_star(_star(edges, True), False), "edges")
        after = state(edges)
        if after == before:
            return edges.select("u", F.col("v").alias("root"))
        before = after
    raise RuntimeError("components did not settle")
