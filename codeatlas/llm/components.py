"""Connected components of an edge table, by alternating large and small stars.

Each round rewires every node to the least node it knows of; the number of rounds grows with the
logarithm of the longest path. Edges stay in tables in the shared folder; nothing of their size
reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeatlas.llm.common import cut, drop


def _is_forest_of_stars(e: DataFrame) -> bool:
    """Each node has one edge to a lesser one, and that one has none."""
    return e.groupBy("u").count().where("count > 1").isEmpty() and e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def _large(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each node's greater neighbours go to the least node it knows of. Also the table that must
    be kept until the edges are written."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")  # written, so that the join may split a hub's edges
    moved = e.join(least.select(F.col("u").alias("v"), "m"), "v").select("u", F.col("m").alias("v"))
    return moved.distinct(), least


def _small(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of the nodes that have edges, but for the roots themselves: root is the least
    node of the component. ``edges`` has columns a and b (long); loops, repeats and nulls are
    dropped; no edges give no rows."""
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = cut(e, "edges")
    for _ in range(rounds):
        if _is_forest_of_stars(e):
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        large, least = _large(e)
        after = cut(_small(large), "edges")
        drop(e, least)
        e = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")
