"""The concept graph: nodes and edges as DataFrames, with traversal by joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The weights of seeds, first and second hops.
HOPS = (1.0, 0.5, 0.2)
#: Edges that a task brings to a forest at once, and edges of a forest that it keeps.
EDGES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; on a local master without it, one of this machine."""
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or f"{tempfile.gettempdir()}/graph-{uuid.uuid4().hex}")
    return (spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir().get()).rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df``, computed once in the checkpoint folder that the cluster shares."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def build(concepts: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of concepts that are not deleted, and the edges between them, one per pair and type."""
    nodes = concepts.where(F.col("status") != "deleted") if "status" in concepts.columns else concepts
    names = nodes.select("slug").distinct()
    edges = links.join(names.withColumnRenamed("slug", "source"), "source", "left_semi").join(names.withColumnRenamed("slug", "target"), "target", "left_semi")
    return nodes, edges.groupBy("source", "target", "type").agg(F.max("confidence").alias("confidence"))


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b): every edge in both directions, once."""
    return edges.select(F.col("source").alias("a"), F.col("target").alias("b")).unionByName(edges.select(F.col("target").alias("a"), F.col("source").alias("b"))).distinct()


def neighbors(edges: DataFrame, slugs: DataFrame) -> DataFrame:
    """(slug, neighbor) in either direction for each of ``slugs``; none for an unknown one."""
    return both_ways(edges).join(slugs.select(F.col("slug").alias("a")), "a", "left_semi").select(F.col("a").alias("slug"), F.col("b").alias("neighbor"))


def outgoing(edges: DataFrame) -> DataFrame:
    """(source, target, confidence): one edge per pair, the surest."""
    return edges.groupBy("source", "target").agg(F.max("confidence").alias("confidence"))


def outgoing_types(edges: DataFrame) -> DataFrame:
    """(source, target, type, confidence): one edge per pair, the surest with its type."""
    best = edges.groupBy("source", "target").agg(F.max(F.struct("confidence", "type")).alias("e"))
    return best.select("source", "target", "e.type", "e.confidence")


def within(edges: DataFrame, seeds: DataFrame, radius: int) -> DataFrame:
    """(slug, distance) of all nodes within ``radius`` of a seed, in either direction."""
    step, front = both_ways(edges), seeds.select("slug").distinct().withColumn("distance", F.lit(0))
    seen = front
    for hop in range(1, radius + 1):
        front = front.join(step, front.slug == step.a).select(F.col("b").alias("slug")).distinct().join(seen.select("slug"), "slug", "left_anti").withColumn("distance", F.lit(hop))
        front = stored(front) if hop < radius else front  # each further hop would build it anew twice
        seen = seen.unionByName(front)
    return seen


def subgraph(edges: DataFrame, seeds: DataFrame, radius: int = 2, types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes within the radius, and the edges among them, of the given types only."""
    nodes = within(edges, seeds, radius)
    names = nodes.select("slug")
    inner = edges.join(names.withColumnRenamed("slug", "source"), "source", "left_semi").join(names.withColumnRenamed("slug", "target"), "target", "left_semi")
    return nodes, inner.where(F.col("type").isin(*types)) if types else inner


def shortest_paths(edges: DataFrame, pairs: DataFrame, most: int = 4, keep: int = 3) -> DataFrame:
    """(a, b, rank, path): up to ``keep`` of the shortest paths of at most ``most`` edges, in name order.

    Paths grow from all starts at once. A path that comes to a node later than another of the same
    pair has done is not shortest and stops there; of those that come at the same time the first
    ``keep`` go on, since their continuations keep their order. So the front has at most ``keep`` paths
    for each start and node. Each round is stored, so the plan does not grow with the rounds.
    """
    from pyspark.sql import Window

    step = stored(both_ways(edges).select(F.col("a").alias("from"), F.col("b").alias("to")))
    starts = stored(pairs.select("a", "b").where("a <> b").distinct())
    front = starts.select("a", F.col("a").alias("at"), F.array("a").alias("path")).distinct()
    reached, found = front.select("a", "at"), None
    for hop in range(1, most + 1):
        grown = front.join(step, front["at"] == step["from"]).where(~F.array_contains("path", F.col("to"))).select("a", F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path"))
        order = F.row_number().over(Window.partitionBy("a", "at").orderBy(F.array_join("path", "\u0001")))
        front = stored(grown.join(reached, ["a", "at"], "left_anti").withColumn("order", order).where(F.col("order") <= keep).drop("order"))
        reached = stored(reached.unionByName(front.select("a", "at").distinct()))
        hits = front.join(starts.withColumnRenamed("b", "at"), ["a", "at"]).select("a", F.col("at").alias("b"), "path")
        found = hits if found is None else found.unionByName(hits)
    rank = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.array_join("path", "\u0001")))
    return found.withColumn("rank", rank).where(F.col("rank") <= keep).select("a", "b", "rank", "path")


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(slug, degree, centrality): in plus out degree, over the other nodes; 1.0 for a lone node."""
    pairs = edges.select("source", "target").distinct()
    ends = pairs.select(F.explode(F.array("source", "target")).alias("slug")).groupBy("slug").agg(F.count("*").alias("degree"))
    total = nodes.agg(F.count("*").alias("n"))
    rows = nodes.select("slug").join(ends, "slug", "left").join(F.broadcast(total))  # one row
    degree = F.coalesce("degree", F.lit(0))
    return rows.select("slug", degree.alias("degree"), F.when(F.col("n") > 1, degree / (F.col("n") - 1)).otherwise(1.0).alias("centrality"))


def clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(slug, cluster): the smallest slug that is connected to it, whatever the direction.

    Each round takes the least label among the neighbours and then the label's own label, so the
    rounds grow with the logarithm of a cluster's length. Labels are written to the checkpoint
    folder every round; the driver sees a count of changes.
    """
    step = stored(both_ways(edges))
    label = stored(nodes.select("slug", F.col("slug").alias("cluster")))
    while True:
        near = step.join(label.select(F.col("slug").alias("b"), "cluster"), "b").groupBy(F.col("a").alias("slug")).agg(F.min("cluster").alias("near"))
        least = label.join(near, "slug", "left").select("slug", F.col("cluster").alias("old"), F.least("cluster", F.coalesce("near", "cluster")).alias("up"))
        jump = label.select(F.col("slug").alias("up"), F.col("cluster").alias("further"))
        new = stored(least.join(jump, "up", "left").select("slug", "old", F.least("up", F.coalesce("further", "up")).alias("cluster")))
        changed = new.where("old <> cluster").limit(1).count()
        label = new.select("slug", "cluster")
        if not changed:
            return label


def _heads(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of the numbers under ``n`` that hangs together with each by the edges a to b."""
    label = np.arange(n)
    while len(a):
        np.minimum.at(label, label[a], label[b])
        np.minimum.at(label, label[b], label[a])
        while not np.array_equal(label, up := label[label]):
            label = up
        differ = label[a] != label[b]
        a, b = a[differ], b[differ]
    return label


def _stars(edges: pa.Table) -> pa.Table:
    """(source, target): each slug with the smallest that hangs together with it by ``edges``."""
    ends = pa.chunked_array([*edges.column("source").chunks, *edges.column("target").chunks], pa.string()).combine_chunks().dictionary_encode()
    order = pc.sort_indices(ends.dictionary).to_numpy()
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    codes = place[ends.indices.to_numpy(zero_copy_only=False)]
    label = _heads(len(order), codes[: len(edges)], codes[len(edges) :])
    moved = np.flatnonzero(label != np.arange(len(order)))
    return pa.table([ends.dictionary.take(pa.array(order[label[moved]])), ends.dictionary.take(pa.array(order[moved]))], names=["source", "target"])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[bool, list[pa.Table]] = {True: [], False: []}

    def shrunk(kept: bool) -> pa.Table:
        return _stars(pa.concat_tables(held[kept]))

    def rows(table: pa.Table, kept: bool) -> Iterator[pa.RecordBatch]:
        yield from table.append_column("kept", pa.array(np.full(len(table), kept))).combine_chunks().to_batches(1 << 16)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        for kept in held:
            own = table.filter(pc.equal(table.column("kept"), kept)).select(["source", "target"])
            held[kept].append(own)
            if sum(map(len, held[kept])) >= EDGES:
                held[kept] = [shrunk(kept)]
                if len(held[kept][0]) >= EDGES // 2:  # as many nodes as a task should know
                    yield from rows(held[kept][0], kept)
                    held[kept] = []
    for kept in held:
        if held[kept]:
            yield from rows(shrunk(kept), kept)


def forest(edges: DataFrame) -> DataFrame:
    """(source, target, kept): fewer edges that join the same nodes, found by each task among its own edges, which are not moved.

    Edges with another ``kept`` (boolean; false without such a column) are joined apart.
    """
    kept = F.col("kept") if "kept" in edges.columns else F.lit(False)
    rows = edges.where("source is not null and target is not null").select("source", "target", kept.alias("kept"))
    return rows.mapInArrow(_forest, "source string, target string, kept boolean")


def reclustered(labels: DataFrame, nodes: DataFrame, edges: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """(slug, cluster) after a change, from the ``labels`` before it.

    ``nodes`` and ``edges`` are those after the change; ``added`` and ``removed`` the edges (source, target) that make
    the difference, ``removed`` with those of nodes that went. Only clusters that lost an edge or a node are
    searched anew, among their own nodes. Added edges join clusters as wholes: their ends are replaced by labels, and
    the graph of labels, which has as many edges as were added, is clustered. Others keep their label.
    """
    ends = removed.select(F.explode(F.array("source", "target")).alias("slug")).distinct()
    return reclustered_around(labels, nodes, edges, added, ends)


def reclustered_around(labels: DataFrame, nodes: DataFrame, edges: DataFrame, added: DataFrame, ends: DataFrame) -> DataFrame:
    """``reclustered`` where instead of the removed edges their ``ends`` (slug) are known, or all nodes that changed.

    Of ``edges`` those that were there before are enough, and so is a ``forest`` of them and of ``added``.
    """
    here = nodes.select("slug").distinct()
    went = labels.join(here, "slug", "left_anti")
    torn = stored(labels.join(ends, "slug", "left_semi").unionByName(went).select("cluster").distinct())
    open_ = stored(labels.join(torn, "cluster", "left_semi").join(here, "slug", "left_semi").select("slug"))
    inner = edges.join(open_.withColumnRenamed("slug", "source"), "source", "left_semi").join(open_.withColumnRenamed("slug", "target"), "target", "left_semi")
    kept = labels.join(torn, "cluster", "left_anti").select("slug", "cluster")
    new = here.join(labels.select("slug"), "slug", "left_anti").select("slug", F.col("slug").alias("cluster"))
    now = stored(kept.unionByName(clusters(open_, inner)).unionByName(new))
    label = lambda end: now.select(F.col("slug").alias(end), F.col("cluster").alias(f"{end}_cluster"))
    joins = added.join(label("source"), "source").join(label("target"), "target").where("source_cluster <> target_cluster")
    joins = stored(joins.select(F.col("source_cluster").alias("source"), F.col("target_cluster").alias("target")).distinct())
    wholes = joins.select(F.explode(F.array("source", "target")).alias("slug")).distinct()
    merged = clusters(wholes, joins).select(F.col("slug").alias("cluster"), F.col("cluster").alias("least"))
    return now.join(merged, "cluster", "left").select("slug", F.coalesce("least", "cluster").alias("cluster"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, distinct pairs, clusters, density (0 for fewer than two nodes)."""
    n = nodes.agg(F.count("*").alias("nodes"))
    e = edges.agg(F.count("*").alias("edges"), F.count_distinct("source", "target").alias("pairs"))
    k = clusters(nodes, forest(edges)).agg(F.count_distinct("cluster").alias("clusters"))
    row = n.join(F.broadcast(e)).join(F.broadcast(k))  # one row each
    density = F.when(F.col("nodes") > 1, F.col("pairs") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0)
    return row.select("nodes", "edges", "pairs", "clusters", F.round(density, 4).alias("density"))


def walk_scores(seeds: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(slug, score) spread from seeds (slug, score) over at most two outgoing hops, largest is 1.

    Along a path only the last edge's confidence counts, and no node is met twice.
    """
    known = seeds.join(nodes.select("slug"), "slug", "left_semi").select(F.col("slug").alias("seed"), F.col("score").alias("sigma"))
    out = outgoing(edges)
    one = known.join(out, F.col("seed") == F.col("source")).where("target <> seed").select("seed", "sigma", F.col("target").alias("mid"), "confidence")
    two = one.select("seed", "sigma", "mid").join(out, F.col("mid") == F.col("source")).where("target <> seed and target <> mid")
    parts = (
        known.select(F.col("seed").alias("slug"), (F.col("sigma") * HOPS[0]).alias("s"))
        .unionByName(one.select(F.col("mid").alias("slug"), (F.col("sigma") * F.col("confidence") * HOPS[1]).alias("s")))
        .unionByName(two.select(F.col("target").alias("slug"), (F.col("sigma") * F.col("confidence") * HOPS[2]).alias("s")))
    )
    return share_of_best(parts.groupBy("slug").agg(F.sum("s").alias("raw")), "raw").select("slug", "score")


def share_of_best(rows: DataFrame, raw: str) -> DataFrame:
    """``rows`` with ``score``: ``raw`` over its largest value, 0 if that is not positive."""
    best = rows.agg(F.max(raw).alias("_best"))
    return rows.join(F.broadcast(best)).withColumn("score", F.when(F.col("_best") > 0, F.col(raw) / F.col("_best")).otherwise(0.0)).drop("_best")  # one row
