"""Keyword, vector and graph scores, their fusion, and what is handed to an agent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import share_of_best, walk_scores

#: Weights of keyword, vector and graph scores; the size of the seed pool.
WEIGHTS = {"hybrid": (0.4, 0.4, 0.2), "no_vectors": (0.6, 0.0, 0.4), "keyword": (1.0, 0.0, 0.0), "semantic": (0.0, 1.0, 0.0)}
SEEDS = 10


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def concept_text(df: DataFrame) -> Column:
    more = [F.array_join("insights", " ")] if "insights" in df.columns else []
    return F.concat_ws(" ", "name", "definition", *more)


def keyword_scores(docs: DataFrame, key: str, text: Column, query: str) -> DataFrame:
    """(key, score): sum over the query's tokens of tf times idf, over the best; positive ones only.

    Only the query's tokens leave the scan, counted per text, so nothing of the other words is moved.
    """
    import re

    asked = re.findall("[a-z0-9]+", query.lower())
    times = {t: asked.count(t) for t in asked}
    rows = docs.select(key, tokens(text).alias("_t"))
    total = rows.agg(F.count("*").alias("n"))
    hits = rows.select(key, F.size("_t").alias("len"), F.explode(F.filter("_t", lambda t: t.isin(*times) if times else F.lit(False))).alias("t"))
    tf = hits.groupBy(key, "len", "t").agg(F.count("*").alias("tf"))
    idf = tf.groupBy("t").agg(F.count_distinct(key).alias("df")).join(F.broadcast(total))  # one row
    idf = idf.select("t", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
    weight = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in (times or {"": 0}).items() for x in kv)), F.col("t")), F.lit(0))
    raw = tf.join(F.broadcast(idf), "t").groupBy(key).agg(F.sum(F.col("tf") / F.col("len") * F.col("idf") * weight).alias("raw"))  # as many rows as the query has words
    return share_of_best(raw, "raw").where("score > 0").select(key, "score")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    size = F.sqrt(dot(v, v))
    return F.when(size > 0, F.transform(v, lambda x: x.cast("double") / size)).otherwise(F.transform(v, lambda x: x.cast("double")))


def vector_scores(vectors: DataFrame, key: str, vector: str, query: Column, top: int = 50, digits: int = 12) -> DataFrame:
    """(key, cosine, score): the best by cosine to ``digits`` places, which scan and heap deliver without a full sort."""
    cosine = F.round(dot(unit(F.col(vector)), unit(query)), digits)
    best = vectors.select(key, cosine.alias("cosine")).orderBy(F.desc("cosine"), key).limit(top)
    return share_of_best(best, "cosine").select(key, "cosine", "score")


def seed_pool(keyword: DataFrame, semantic: DataFrame, key: str = "slug", size: int = SEEDS) -> DataFrame:
    best = lambda df: df.select(key, "score").orderBy(F.desc("score"), key).limit(size)
    return best(keyword).unionByName(best(semantic)).where("score > 0").groupBy(key).agg(F.max("score").alias("score"))


def fuse(keyword: DataFrame, semantic: DataFrame, graph: DataFrame, weights: tuple[float, float, float], key: str = "slug") -> DataFrame:
    """(key, total, keyword, semantic, graph, matched_via): the positive weighted sums."""
    named = [(df.select(key, F.col("score").alias(n)), n) for df, n in ((keyword, "keyword"), (semantic, "semantic"), (graph, "graph"))]
    all_ = named[0][0].join(named[1][0], key, "full").join(named[2][0], key, "full").na.fill(0.0, ["keyword", "semantic", "graph"])
    total = sum((F.col(n) * w for (_, n), w in zip(named, weights)), F.lit(0.0))
    via = F.filter(F.array(*(F.when((F.col(n) > 0) & (F.lit(w) > 0), n) for (_, n), w in zip(named, weights))), lambda x: x.isNotNull())
    return all_.select(key, F.round(total, 9).alias("total"), "keyword", "semantic", "graph", via.alias("matched_via")).where("total > 0")


def top(rows: DataFrame, score: str, key: str, k: int) -> DataFrame:
    return rows.orderBy(F.desc(score), key).limit(k)


def filter_concepts(concepts: DataFrame, tag: str | None = None, min_confidence: float | None = None, since: str | None = None, include_deleted: bool = False) -> DataFrame:
    out = concepts if include_deleted or "status" not in concepts.columns else concepts.where("status <> 'deleted'")
    if tag:
        out = out.where(F.array_contains("tags", tag))
    if min_confidence is not None:
        out = out.where(F.col("confidence") >= min_confidence)
    if since:
        out = out.where(F.col("last_reinforced_at") >= F.lit(since).cast("timestamp"))
    return out


def hybrid(concepts: DataFrame, edges: DataFrame, query: str, semantic: DataFrame | None = None, mode: str | None = None, weights: tuple[float, float, float] | None = None) -> DataFrame:
    """Fused scores; explicit weights win over the mode, branches of no weight are not built."""
    empty = concepts.select("slug", F.lit(0.0).alias("score")).limit(0)
    mode = mode or "hybrid"
    w = weights or WEIGHTS["no_vectors" if mode == "hybrid" and semantic is None else mode]
    kw = keyword_scores(concepts, "slug", concept_text(concepts), query) if w[0] or w[2] else empty
    sem = semantic.select("slug", "score") if semantic is not None and (w[1] or w[2]) else empty
    walked = walk_scores(seed_pool(kw, sem), concepts, edges) if w[2] else empty
    return fuse(kw, sem, walked, w)


def context_pack(results: DataFrame, edges: DataFrame, score: str = "total") -> DataFrame:
    """One row: the hits in order, their relations, the targets that are no hits, the mean score."""
    hits = results.agg(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), "slug"))).alias("h"), F.coalesce(F.avg(score), F.lit(0.0)).alias("confidence"))
    own = edges.join(results.select(F.col("slug").alias("source")), "source", "left_semi")
    near = own.select(F.col("target").alias("slug")).distinct().join(results.select("slug"), "slug", "left_anti")
    relations = own.agg(F.array_sort(F.collect_list(F.concat_ws(" ", "source", "type", "target"))).alias("relationships"))
    sides = near.agg(F.array_sort(F.collect_list("slug")).alias("neighbor_slugs"))
    row = hits.join(F.broadcast(relations)).join(F.broadcast(sides))  # one row each, sized by the hits
    return row.select(F.transform("h", lambda x: x["slug"]).alias("concepts"), "relationships", "neighbor_slugs", F.round("confidence", 9).alias("confidence"))


def per_group(rows: DataFrame, group: str, score: str, key: str, k: int, overall: int = 20) -> DataFrame:
    """The k best of each group, and of these the best overall."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), key))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).orderBy(F.desc(score), group, key).limit(overall)


def embedding_text(concepts: DataFrame) -> Column:
    """Name, definition, explanation if it says more, and the first three insights."""
    parts = ["name", "definition"]
    if "explanation" in concepts.columns:
        parts.append(F.when((F.col("explanation") != "") & (F.col("explanation") != F.col("definition")), F.col("explanation")))
    if "insights" in concepts.columns:
        parts.append(F.nullif(F.array_join(F.slice("insights", 1, 3), " "), F.lit("")))
    return F.concat_ws(". ", *parts)
