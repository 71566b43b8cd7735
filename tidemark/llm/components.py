"""Connected components of a link table, with joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.stage import stored


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) of every node with a link; ``links`` has longs ``a`` and ``b``.

    Every round each node's larger neighbours move to its smallest neighbour, then every node and its
    smaller neighbours move to the smallest of them (large star, small star), until only stars are
    left. A node with very many neighbours is a hot join key, which adaptive execution splits.
    Links from a node to itself and repeated links change nothing; no links give an empty result.
    """
    edges = stored(links.where("a <> b").selectExpr("greatest(a, b) as u", "least(a, b) as v").distinct(), "links")
    for _ in range(most_rounds):
        both = edges.unionByName(edges.selectExpr("v as u", "u as v"))
        lowest = stored(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("v", "u").alias("m")), "lowest")
        # edges (u, v) with v < u: v's larger neighbour u goes to the lowest neighbour of v
        large = edges.join(lowest.withColumnRenamed("u", "v"), "v").selectExpr("u", "m as v").where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").selectExpr("v as u", "m as v")
        found = stored(moved.unionByName(least.selectExpr("u", "m as v")).distinct(), "links")
        state = [x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (edges, found)]
        edges = found
        if state[0] == state[1]:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.selectExpr("v as node", "v as component")
    return edges.selectExpr("u as node", "v as component").unionByName(roots).distinct()
