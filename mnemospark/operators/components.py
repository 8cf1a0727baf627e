"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

MAX_ROUNDS = 60


def _min_neighbour(arcs: DataFrame) -> DataFrame:
    """Each arc (u, v) with m, the least of u and its neighbours; the minimum combines map-side, so hubs are cheap."""
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("lu"), F.least("u", "m").alias("m"))
    return arcs.join(least, arcs.u == least.lu).select("u", "v", "m")


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, component) of every node of an undirected edge list; component is its least node.

    Edges with a null end and self-loops link nothing and are dropped; repeated
    edges count once; no edges give no rows. Nodes may be of any orderable
    type. Large-star hangs every larger neighbour of a node on its least
    neighbour, small-star every smaller one, until the edges are stars; the
    rounds grow with the logarithm of the longest path. Each round is cut into
    the shared checkpoint folder, so a lost executor costs one round.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).dropna().where("x <> y")
    current = cut(pairs.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    state = None
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _min_neighbour(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _min_neighbour(large)
        hung = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        current = cut(hung.where("u <> v").distinct())
        seen = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(members.select(F.col("component").alias("node"), "component")).distinct()
