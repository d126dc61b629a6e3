"""Connected components of an edge table: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silolens.llm.common import stored


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One step. Each node's smallest neighbour is a partial aggregate, written before it
    meets the edges: both join sides then come from plain exchanges, which adaptive
    execution can split where a hub holds a large part of all edges."""
    if small:
        around = edges.selectExpr("greatest(a, b) AS u", "least(a, b) AS v")
    else:
        around = edges.selectExpr("a AS u", "b AS v").union(edges.selectExpr("b AS u", "a AS v"))
    low = stored(around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "lowest")
    met = around.join(low, "u")
    if small:
        out = met.selectExpr("v AS a", "m AS b").union(low.selectExpr("u AS a", "m AS b"))
    else:
        out = met.where("v > u").selectExpr("v AS a", "m AS b")
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges (a, b)``; root is the smallest node reachable.

    Self links, repeated links and either direction are allowed; rows with a
    null end are ignored. An empty edge table gives an empty result. Nodes are
    any ordered type. The number of steps grows with the logarithm of the
    longest path; every step is written to the shared folder.
    """
    edges = edges.selectExpr("greatest(a, b) AS a", "least(a, b) AS b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = stored(edges.distinct(), "edges")
    mark = None
    while True:
        now = stored(_star(_star(now, small=False), small=True), "edges")
        seen = tuple(now.selectExpr("count(*)", "bit_xor(xxhash64(a, b))", "sum(cast(xxhash64(b, a) AS decimal(38, 0)))").first())
        if seen == mark or seen[0] == 0:
            break
        mark = seen
    # at the fixed point every node but the roots has exactly one edge, to its root
    return now.selectExpr("a AS node", "b AS root").union(now.selectExpr("b AS node", "b AS root").distinct())
