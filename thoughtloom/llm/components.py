"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Each step is a grouped minimum, computed partially before its shuffle, and a join back. The state
is a set of edges no larger than the first one; it is checkpointed after every round, so a lost
executor costs a round at most. The driver sees only a count and a checksum. A hub, which has more
than one in HUBS of all edges, is joined with its minimum by broadcast, so its edges stay where they
are; their number is bounded by a small multiple of HUBS.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


#: A node is a hub from one edge in HUBS on, and from LEAST_HUB edges on.
HUBS, LEAST_HUB = 512, 256


def _with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """``edges`` (a, b) with the minimum ``m`` of a; ``least`` has a, m and the number n of its edges."""
    is_hub = F.col("n") > max(LEAST_HUB, total // HUBS)
    hubs = F.broadcast(least.where(is_hub).select("a", "m"))
    others = edges.join(hubs.select("a"), "a", "left_anti")
    return others.join(least.where(~is_hub).select("a", "m"), "a").unionByName(edges.join(hubs, "a"))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return _with_least(both, least, total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = _with_least(down, least, total).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (columns a, b); root is the smallest node reachable.

    Edges with a null end and self loops are left out. Nodes without any edge have no row.
    """
    state = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        now = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).head()
        if now["n"] == 0 or now == seen:
            break
        seen = now
        state = checkpointed(_small_star(checkpointed(_large_star(state, now["n"]).distinct()), now["n"]).distinct())
    nodes = state.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
