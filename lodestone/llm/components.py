"""Connected components of a graph given by its edges, by alternating large-star and small-star steps.

Each step is a minimum per node, pre-aggregated before its shuffle, and a join of the edges with the minima; hot nodes
are split by Spark's skew join. The edges of each round are a written table; the driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import dropped, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges(u, v), u > v, one way each. large: each node's larger neighbours to its smallest; else its smaller ones."""
    ways = edges.union(edges.select("v", "u").toDF("u", "v")) if large else edges
    least = ways.groupBy("u").agg(F.min("v").alias("least"))
    # Under a name that Spark does not know to be dealt by u, the join deals both sides anew, so it can split a hot node.
    least = least.select(F.bitwise_not(F.bitwise_not("u")).alias("c"), F.least("u", "least").alias("least"))
    met = ways.join(least, F.col("u") == F.col("c"))
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("least").alias("v")).union(
            least.select(F.col("c").alias("u"), F.col("least").alias("v"))
        )
    return out.where("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """edges(u, v) of longs, any way round, repeats and loops allowed -> node, root: the component's smallest node.

    Nodes without an edge to another node are not returned.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before = written(now, "edges"), None
    for _ in range(most_rounds):
        got = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if got["n"] == 0 or (got["n"], got["h"]) == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = (got["n"], got["h"])
        old, now = now, written(_star(_star(now, large=True), large=False), "edges")
        dropped(old)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
