"""Scores of extraction and retrieval against what is expected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import stored
from .hygiene import ratio_candidates


def _first_similar(threshold: float):
    """(e, a) of each e the first a whose ratio is at the threshold; rows (e, a, x, y) are sorted, and an e may go on in the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from difflib import SequenceMatcher

        done = None
        for batch in batches:
            hits = []
            for k, (e, x, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("e", "x", "y")))):
                if e != done and SequenceMatcher(None, x, y).ratio() >= threshold:
                    done = e
                    hits.append(k)
            yield batch.select(["e", "a"]).take(pa.array(hits, pa.int64()))

    return run


def match_concepts(expected: DataFrame, actual: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(e, a): of each expected slug the same slug, else the first slug of a name with a ratio at the threshold.

    The ratio, which is computed in Python, is taken of pairs only whose characters can give it, in the order of
    their slugs until the first that reaches the threshold; pairs are dealt to many tasks, as they are small but slow to compare.
    """
    spark = expected.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    same = expected.select("slug").join(actual.select("slug"), "slug").select(F.col("slug").alias("e"), F.col("slug").alias("a"))
    left = expected.join(same, expected.slug == same.e, "left_anti").select(F.col("slug").alias("e"), F.col("name").alias("x"))
    near = ratio_candidates(left, actual.select(F.col("slug").alias("a"), F.col("name").alias("y")), threshold)
    near = near.select("e", "a", F.lower("x").alias("x"), F.lower("y").alias("y")).repartition(tasks, "e").sortWithinPartitions("e", "a")
    best = near.mapInArrow(_first_similar(threshold), near.select("e", "a").schema)
    return same.unionByName(best)


def concept_scores(expected: DataFrame, actual: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: recall, precision and the share of key phrases found in the matched concepts."""
    phrases = expected.select(F.col("slug").alias("e"), F.explode("key_phrases").alias("phrase")).join(matches, "e")
    text = actual.select(F.col("slug").alias("a"), F.lower(F.concat_ws(" ", "definition", *([F.array_join("insights", " ")] if "insights" in actual.columns else []))).alias("t"))
    grounded = phrases.join(text, "a").agg(F.count("*").alias("phrases"), F.count_if(F.contains("t", F.lower("phrase"))).alias("found"))
    sizes = expected.agg(F.count("*").alias("expected")).join(actual.agg(F.count("*").alias("extracted"))).join(matches.agg(F.count("*").alias("matched"))).join(grounded)  # one row each
    share = lambda a, b, empty: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(empty), 3)
    precision = F.when(F.col("expected") == 0, F.when(F.col("extracted") == 0, 1.0).otherwise(0.0)).otherwise(F.col("matched") / F.greatest("extracted", F.lit(1)))
    return sizes.select(share("matched", "expected", 1.0).alias("recall"), F.round(precision, 3).alias("precision"), share("found", "phrases", 1.0).alias("phrase_grounding"), "matched", "expected", "extracted")


def relationship_scores(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row: recall of edges and accuracy of their types; 1 where nothing is expected."""
    first = actual.groupBy("source", "target").agg(F.min("type").alias("found"))
    rows = expected.join(first, ["source", "target"], "left").agg(F.count("*").alias("expected"), F.count("found").alias("matched"), F.count_if(F.col("found") == F.col("type")).alias("right"))
    share = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(1.0), 3)
    return rows.select(share("matched", "expected").alias("recall"), share("right", "matched").alias("type_accuracy"), "matched", "expected")


def _own_tags(concepts: DataFrame, key: str = "slug", tags: str = "tags") -> DataFrame:
    return concepts.groupBy(F.col(key).alias("key")).agg(F.array_distinct(F.flatten(F.collect_list(tags))).alias("own"))


def judgments(concepts: DataFrame, key: str = "slug", tags: str = "tags") -> DataFrame:
    """(query, relevant): concepts that share a tag.

    A pair stands under the least tag that both have, so pairs need not be made distinct, and are not moved.
    """
    own = _own_tags(concepts, key, tags).select(F.col("key").alias("query"), "own", F.explode("own").alias("tag"))
    other = own.select(F.col("query").alias("relevant"), F.col("own").alias("others"), "tag")
    return own.join(other, "tag").where((F.col("query") != F.col("relevant")) & (F.array_min(F.array_intersect("own", "others")) == F.col("tag"))).select("query", "relevant")


def recall_at_k(relevant: DataFrame, retrieved: DataFrame, k: int) -> DataFrame:
    """(query, recall) of ranked (query, item, rank); 0 for a query with nothing relevant."""
    hits = retrieved.where(F.col("rank") <= k).join(relevant.select("query", F.col("relevant").alias("item")), ["query", "item"])
    sizes = relevant.groupBy("query").agg(F.count("*").alias("n"))
    return _recall(retrieved.select("query").unionByName(relevant.select("query")), hits, sizes)


def _recall(queries: DataFrame, hits: DataFrame, sizes: DataFrame) -> DataFrame:
    found = queries.distinct().join(sizes, "query", "left").join(hits.groupBy("query").agg(F.count("*").alias("hits")), "query", "left")
    return found.select("query", F.coalesce(F.coalesce("hits", F.lit(0)) / F.col("n"), F.lit(0.0)).alias("recall"))


def judged(pairs: DataFrame, concepts: DataFrame) -> DataFrame:
    """The ``pairs`` (query, item, ...) that are among the ``judgments`` of ``concepts``, which are not made for it."""
    tags = stored(_own_tags(concepts))  # a plain side of both joins, so an item of very many queries can be split
    for end in ("query", "item"):
        pairs = pairs.join(tags.select(F.col("key").alias(end), F.col("own").alias(f"_{end}")), end)
    return pairs.where((F.col("query") != F.col("item")) & F.arrays_overlap("_query", "_item")).drop("_query", "_item")


def judged_sizes(concepts: DataFrame) -> DataFrame:
    """(query, n): how many are relevant for each query that has any, counted where they meet."""
    return judgments(concepts).groupBy("query").agg(F.count("*").alias("n"))


def recall_by_tags(concepts: DataFrame, retrieved: DataFrame, k: int) -> DataFrame:
    """``recall_at_k`` by the ``judgments`` of ``concepts``: of those only numbers are moved, and tags decide on what is retrieved."""
    best, sizes = stored(retrieved.where(F.col("rank") <= k)), stored(judged_sizes(concepts))
    return _recall(best.select("query").unionByName(sizes.select("query")), judged(best.select("query", "item"), concepts), sizes)


def weight_grid(spark: SparkSession, step: float = 0.1) -> DataFrame:
    """All (keyword, semantic, graph) weights of a step that sum to 1."""
    n = round(1 / step)
    rows = [(a / n, b / n, (n - a - b) / n) for a in range(n + 1) for b in range(n + 1 - a)]
    return spark.createDataFrame(rows, "w_keyword double, w_semantic double, w_graph double")


def ranked(scores: DataFrame, weights: tuple[float, float, float]) -> DataFrame:
    """(query, item, rank) with the given weights, each query's own concept left out."""
    w = dict(zip(("keyword", "semantic", "graph"), weights))
    total = F.round(sum((F.col(c) * x for c, x in w.items()), F.lit(0.0)), 9)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("total"), "item"))
    return scores.withColumn("total", total).where("total > 0 and item <> query").select("query", "item", rank.alias("rank"))


def evaluate_weights(scores: DataFrame, relevant: DataFrame, weights: tuple[float, float, float], k: int) -> DataFrame:
    """(query, recall) of each query with the given weights, its own concept left out."""
    return recall_at_k(relevant, ranked(scores, weights), k)


def _contenders(scores: DataFrame, k: int) -> DataFrame:
    """The scores that can be among the k best of their query for some weights.

    With weights w the k-th best total is at least w[c] * T[c] for each component c, T[c] being its k-th
    best value; so a total reaches it for some w only if the shares x[c] / T[c] add up to 1.
    """
    rows, shares = scores.where("item <> query"), F.lit(0.0)
    for c in ("keyword", "semantic", "graph"):
        rows = rows.withColumn(f"r_{c}", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(c))))
        rows = rows.withColumn(f"t_{c}", F.max(F.when(F.col(f"r_{c}") == k, F.col(c))).over(Window.partitionBy("query")))
        shares = shares + F.when(F.col(f"t_{c}") > 0, F.col(c) / F.col(f"t_{c}")).otherwise((F.col(c) > 0).cast("double"))
    return rows.where(shares >= 1 - 1e-6).select(*scores.columns)


def _winners(grid: list[tuple[float, float, float]], k: int):
    """(query, item, at): the items that are among a query's k best, with the places of the weights for which they are."""
    w = np.array(grid).reshape(-1, 3).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: tuple[list, list, list] = ([], [], [])
            rows = batch.column("rows")
            for i, q in enumerate(batch.column("query").to_pylist()):
                own = rows[i].values  # in the order of the items, which decides between equals
                keyword, semantic, graph = (own.field(c).to_numpy()[:, None] for c in ("keyword", "semantic", "graph"))
                totals = np.floor((keyword * w[0] + semantic * w[1] + graph * w[2]) * 1e9 + 0.5)
                best = np.argsort(-totals, axis=0, kind="stable")[:k]
                rank, at = np.nonzero(np.take_along_axis(totals, best, 0) > 0)
                won: dict[int, list[int]] = {}
                for item, place in zip(best[rank, at].tolist(), at.tolist()):
                    won.setdefault(item, []).append(place)
                found[0].extend([q] * len(won))
                found[1].extend(own.field("item").take(pa.array(list(won), pa.int64())).to_pylist())
                found[2].extend(won.values())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(found, (pa.string(), pa.string(), pa.list_(pa.int32())))], names=["query", "item", "at"])

    return run


def _sweep(scores: DataFrame, grid: DataFrame, k: int, hits, sizes: DataFrame) -> DataFrame:
    """The means over all queries; each query's scores are ranked for all weights in one place, and only its winners are moved."""
    spark, weights = grid.sparkSession, ["w_keyword", "w_semantic", "w_graph"]
    points = [tuple(map(float, r)) for r in grid.select(*weights).collect()]  # of fixed size
    row = F.struct("item", *(F.col(c).cast("double").alias(c) for c in ("keyword", "semantic", "graph")))
    rows = scores.where("item <> query").groupBy("query").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    won = hits(rows.mapInArrow(_winners(points, k), "query string, item string, at array<int>")).join(sizes, "query")
    mean = won.select("query", "n", F.explode("at").alias("at")).groupBy("at", "query", "n").agg(F.count("*").alias("hits")).groupBy("at").agg(F.sum(F.col("hits") / F.col("n")).alias("s"))
    queries = scores.select("query").distinct().agg(F.count("*").alias("queries"))
    numbers = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "at int, w_keyword double, w_semantic double, w_graph double")
    return numbers.join(mean, "at", "left").join(F.broadcast(queries)).select(*weights, F.round(F.coalesce("s", F.lit(0.0)) / F.greatest("queries", F.lit(1)), 6).alias("recall"))  # one row


def sweep_weights(scores: DataFrame, relevant: DataFrame, grid: DataFrame, k: int) -> DataFrame:
    """(weights, mean recall at k) of component scores (query, item, keyword, semantic, graph).

    The components are computed once; the grid, of fixed size, is sent to every task and meets only
    those scores that can be among the k best for some weights.
    """
    hits = lambda won: won.join(relevant.select("query", F.col("relevant").alias("item")), ["query", "item"])
    queries = scores.select("query", F.col("query").alias("item"), *(F.lit(0.0).alias(c) for c in ("keyword", "semantic", "graph"))).distinct()
    return _sweep(_contenders(scores, k).unionByName(queries), grid, k, hits, relevant.groupBy("query").agg(F.count("*").alias("n")))


def sweep_by_tags(scores: DataFrame, concepts: DataFrame, grid: DataFrame, k: int) -> DataFrame:
    """``sweep_weights`` of ``best_scores`` by the ``judgments`` of ``concepts``: of those only numbers are moved, and tags decide on the winners."""
    return _sweep(stored(scores), grid, k, lambda won: judged(stored(won), concepts), judged_sizes(concepts))


def report(scores: DataFrame) -> Column:
    return F.to_json(F.struct(*scores.columns))


def _table(head: list[str], rows: list[list]) -> list[str]:
    cell = lambda x: f"{x:.3f}" if isinstance(x, float) else str(x)
    return ["| " + " | ".join(head) + " |", "|" + " --- |" * len(head), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]


def markdown_report(results: list[dict]) -> str:
    """Scores by fixture, and over all of them, as Markdown; one row for each of ``cli.evaluate``'s results."""
    names = ["recall", "precision", "phrase_grounding", "matched", "expected", "extracted"]
    rows = [[r["fixture"], *(r[n] for n in names), r["relationships"]["recall"], r["relationships"]["type_accuracy"]] for r in results]
    matched, expected, extracted = (sum(r[n] for r in results) for n in ("matched", "expected", "extracted"))
    share = lambda a, b: a / b if b else 1.0
    lines = ["# Evaluation", "", f"Fixtures: {len(results)}", f"Concept recall: {share(matched, expected):.3f} ({matched} of {expected})", f"Concept precision: {share(matched, extracted):.3f} ({matched} of {extracted})", ""]
    return "\n".join([*lines, *_table(["fixture", *names, "relation recall", "type accuracy"], rows), ""])


def sweep_report(scores: DataFrame, top: int = 10) -> str:
    """The best weights of a sweep (keyword, semantic, graph and a score each) as Markdown."""
    names = scores.columns
    best = scores.orderBy(F.desc(names[-1]), *names[:-1]).limit(top).collect()
    return "\n".join(["# Weights", "", *_table(names, [list(r) for r in best]), ""])
