"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgraph.llm.shared import cut

MAX_ROUNDS = 60


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Only stars and edges move between tasks: every round shuffles at most the current edge list,
    hot nodes are pre-aggregated (min) and their join side is splittable.  Self loops are kept as
    components of one.  Raises if it does not settle in MAX_ROUNDS (log-many are expected).
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    loops = pairs.where("u = v").select(F.col("u").alias("node"))
    now = cut(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(MAX_ROUNDS):
        now = cut(_stars(_stars(now, True), False))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == mark:
            break
        mark = state
    else:
        raise RuntimeError("components did not settle")
    label = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = label.select(F.col("component").alias("node"), "component")
    alone = loops.select("node", F.col("node").alias("component"))
    return label.union(roots).union(alone).groupBy("node").agg(F.min("component").alias("component"))
