"""Connected components of a large graph by alternating star contraction.

Every round hangs neighbours on the smallest node around them, first the larger ones of
every node, then the smaller ones, until each component is a star on its smallest node.
Rounds grow with the logarithm of the graph. Edges of a hub with very many neighbours are
only ever aggregated by minimum (combined before the shuffle) and joined (which adaptive
execution splits).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotscope.llm.common import cut_lineage


def _hang(edges: DataFrame) -> DataFrame:
    """Give every (u, v) the smallest of u and its neighbours, as ``m``."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    return edges.join(least, "u").select("u", "v", F.least("u", "least").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _hang(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    hung = _hang(down)
    moved = hung.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(hung.select("u", F.col("m").alias("v"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether distinct edges from larger to smaller nodes hang every node on one other
    that hangs on none: then each star is a component."""
    ends = edges.selectExpr("u AS node", "1 AS up", "0 AS down").union(edges.selectExpr("v", "0", "1"))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").isEmpty()


def component_labels(edges: DataFrame) -> DataFrame:
    """From links (u, v) of two longs: node and ``label``, the smallest node of its
    component, for every node but those smallest ones. Loops and repeated links do no
    harm; null ends are dropped. No links give no rows."""
    edges = edges.filter("u <> v").select("u", "v")
    while True:
        edges = cut_lineage(_small_star(_large_star(edges)))
        if _are_stars(edges):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))


def joined_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after more links (u, v): the stars found so far stand for the links before."""
    return component_labels(labels.select(F.col("node").alias("u"), F.col("label").alias("v")).union(links))
