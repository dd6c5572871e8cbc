"""Connected components of a graph given by its edges, without gathering any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogmill.llm.common import settled


def _with_least(pairs: DataFrame) -> DataFrame:
    """Rows (u, v) with m, the least of u and its neighbours v; minima are combined before the shuffle."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    starred = _with_least(down)
    joined = starred.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
        starred.select("u", F.col("m").alias("v"))
    )
    return joined.where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """Rows (node, root) of the nodes in ``edges`` (long columns u and v).

    ``root`` is the least node of the component. Alternating large and small
    stars (Kiveris and others, 2014) halve paths in each round; every round is
    written to the shared folder. Loops and repeated edges are allowed; without
    edges the result is empty. Nodes without an edge do not occur in it.
    """
    now = settled(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state[0] == 0 or tuple(state) == seen:
            break
        seen = tuple(state)
        now = settled(_small_star(_large_star(now)), "stars")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
