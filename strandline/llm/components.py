"""Connected components as joins and minimum aggregates: hooking plus pointer jumping, one written table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import written


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for the undirected `edges` (a long, b long); component is the smallest node reachable.

    Every step is an equi-join against one row a node or a `min` aggregate with map-side combine, so a node with
    very many links splits over tasks. Rounds grow with the logarithm of the longest chain. No edges: no rows.
    """
    links = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = written(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-links")
    parents = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("p")), "cc-parents")
    for _ in range(max_rounds):
        up = parents.select(F.col("v").alias("p"), F.col("p").alias("gp"))
        grand = parents.join(up, "p").select("v", "p", "gp")
        near = both.join(grand.select(F.col("v").alias("b"), "gp"), "b").groupBy(F.col("a").alias("v")).agg(F.min("gp").alias("m"))
        seen = grand.join(near, "v")
        offers = seen.select(
            F.explode(
                F.array(
                    F.struct("v", F.least("gp", "m").alias("offer"), F.col("p").alias("old")),
                    F.struct(F.col("p").alias("v"), F.least("gp", "m").alias("offer"), F.lit(None).cast("long").alias("old")),
                )
            ).alias("o")
        ).select("o.*")
        moved = written(offers.groupBy("v").agg(F.min("offer").alias("p"), F.max("old").alias("old")), "cc-parents")
        parents = moved.select("v", "p")
        if moved.where("p <> old").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return parents.select(F.col("v").alias("node"), F.col("p").alias("component"))
