import math

import pytest
from pyspark.sql import functions as F

from thoughtloom.operators import evaluation as E
from thoughtloom.operators import retrieval as R

DOCS = [("rag", "Retrieval", "retrieval finds vector text"), ("vec", "Vector Embedding", "a vector of numbers"), ("k8s", "Kubernetes", "runs containers")]


@pytest.fixture
def concepts(spark):
    return spark.createDataFrame([(*d, ["t"] if d[0] != "k8s" else [], 0.5, "active") for d in DOCS], "slug string, name string, definition string, tags array<string>, confidence double, status string")


@pytest.fixture
def edges(spark):
    return spark.createDataFrame([("rag", "vec", "uses", 0.9)], "source string, target string, type string, confidence double")


def test_keyword_scores_equal_the_formula(concepts):
    got = {r.slug: r.score for r in R.keyword_scores(concepts, "slug", R.concept_text(concepts), "Vector vector text").collect()}
    idf = {w: math.log((3 - df + 0.5) / (df + 0.5) + 1) for w, df in (("vector", 2), ("text", 1))}
    raw = {"rag": (2 * idf["vector"] + idf["text"]) / 5, "vec": 2 * 2 / 6 * idf["vector"]}
    assert got == pytest.approx({k: v / max(raw.values()) for k, v in raw.items()})
    assert R.keyword_scores(concepts, "slug", R.concept_text(concepts), "?!").count() == 0


def test_hybrid(spark, concepts, edges):
    semantic = spark.createDataFrame([("vec", 1.0), ("k8s", 0.1)], "slug string, score double")
    got = {r.slug: r for r in R.hybrid(concepts, edges, "retrieval", semantic).collect()}
    assert max(got.values(), key=lambda r: r.total).slug in ("rag", "vec")
    for r in got.values():
        assert r.total == pytest.approx(0.4 * r.keyword + 0.4 * r.semantic + 0.2 * r.graph)
        assert 0 <= min(r.keyword, r.semantic, r.graph) and max(r.keyword, r.semantic, r.graph) <= 1
    assert got["rag"].matched_via == ["keyword", "graph"]
    only = R.hybrid(concepts, edges, "retrieval", semantic, mode="keyword").collect()
    assert [r.slug for r in only] == ["rag"]


def test_pack_and_filters(concepts, edges, spark):
    hits = spark.createDataFrame([("rag", 0.8)], "slug string, total double")
    row = R.context_pack(hits, edges).head()
    assert (row.concepts, row.relationships, row.neighbor_slugs, row.confidence) == (["rag"], ["rag uses vec"], ["vec"], 0.8)
    assert R.filter_concepts(concepts, tag="t", min_confidence=0.5).count() == 2
    assert R.filter_concepts(concepts, min_confidence=0.6).count() == 0


def test_vectors(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [0.0, 0.0])], "slug string, v array<float>")
    got = [(r.slug, round(r.cosine, 4)) for r in R.vector_scores(df, "slug", "v", F.array(F.lit(2.0), F.lit(0.0)), 2).orderBy(F.desc("cosine")).collect()]
    assert got == [("a", 1.0), ("b", 0.7071)]


def test_evaluation(spark):
    expected = spark.createDataFrame([("kv-cache", "KV Cache", ["keys"]), ("embeddings", "Embeddings", ["numbers", "absent"]), ("none", "Qqq", [])], "slug string, name string, key_phrases array<string>")
    actual = spark.createDataFrame([("kv-cache", "KV Cache", "stores Keys"), ("embedding", "Embedding", "numbers"), ("z", "Zebra", "")], "slug string, name string, definition string")
    matches = E.match_concepts(expected, actual)
    assert sorted(tuple(r) for r in matches.collect()) == [("embeddings", "embedding"), ("kv-cache", "kv-cache")]
    assert E.concept_scores(expected, actual, matches).head().asDict() == {"recall": 0.667, "precision": 0.667, "phrase_grounding": 0.667, "matched": 2, "expected": 3, "extracted": 3}
    edge = lambda rows: spark.createDataFrame(rows, "source string, target string, type string")
    got = E.relationship_scores(edge([("a", "b", "uses"), ("a", "c", "uses")]), edge([("a", "b", "enables")])).head()
    assert (got.recall, got.type_accuracy) == (0.5, 0.0)
    assert E.relationship_scores(edge([]), edge([("a", "b", "uses")])).head().recall == 1.0


def test_judgments_recall_and_sweep(spark, concepts):
    relevant = E.judgments(concepts)
    assert sorted(tuple(r) for r in relevant.collect()) == [("rag", "vec"), ("vec", "rag")]
    ranked = spark.createDataFrame([("rag", "k8s", 1), ("rag", "vec", 2), ("k8s", "rag", 1)], "query string, item string, rank int")
    assert {r["query"]: r.recall for r in E.recall_at_k(relevant, ranked, 1).collect()} == {"rag": 0.0, "vec": 0.0, "k8s": 0.0}
    assert {r["query"]: r.recall for r in E.recall_at_k(relevant, ranked, 2).collect()}["rag"] == 1.0
    scores = spark.createDataFrame([("rag", "vec", 1.0, 0.0, 0.0), ("vec", "k8s", 0.5, 0.0, 0.0), ("vec", "rag", 0.1, 0.0, 1.0)], "query string, item string, keyword double, semantic double, graph double")
    got = {(r.w_keyword, r.w_graph): r.recall for r in E.sweep_weights(scores, relevant, E.weight_grid(spark), 1).collect()}
    assert len(E.weight_grid(spark).collect()) == 66
    assert got[1.0, 0.0] == 0.5 and got[0.5, 0.5] == 1.0


def test_pairs_that_share_tags_are_not_made_distinct(spark):
    rows = spark.createDataFrame([("a", ["x", "y", "x"]), ("b", ["y", "x"]), ("c", ["y"]), ("d", []), ("e", None)], "slug string, tags array<string>")
    pairs = E.judgments(rows)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2 and plan.lstrip().startswith("Project")  # one on each side of the join, none over pairs
    assert sorted(map(tuple, pairs.collect())) == [(a, b) for a in "abc" for b in "abc" if a != b]
