import random
from itertools import product

import pyarrow as pa
import pytest

from thoughtloom.operators import graph as G
from thoughtloom.operators import linking as K

EDGES = [("a", "b", "uses", 0.9), ("a", "c", "related_to", 0.5), ("b", "d", "uses", 0.8), ("d", "a", "uses", 0.4), ("x", "y", "uses", 1.0)]


@pytest.fixture
def graph(spark):
    nodes = spark.createDataFrame([(s, "active") for s in "abcdxyz"] + [("gone", "deleted")], "slug string, status string")
    edges = spark.createDataFrame([*EDGES, ("a", "gone", "uses", 1.0), ("a", "b", "uses", 0.2)], "source string, target string, type string, confidence double")
    return G.build(nodes, edges)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_build(graph):
    nodes, edges = graph
    assert nodes.count() == 7
    assert rows(edges.select("source", "target", "type", "confidence")) == sorted(EDGES)


def test_neighbors(spark, graph):
    asked = spark.createDataFrame([("a",), ("nobody",)], "slug string")
    assert rows(G.neighbors(graph[1], asked)) == [("a", "b"), ("a", "c"), ("a", "d")]


def test_subgraph(spark, graph):
    seeds = spark.createDataFrame([("c",)], "slug string")
    nodes, edges = G.subgraph(graph[1], seeds, 1)
    assert rows(nodes) == [("a", 1), ("c", 0)]
    nodes, edges = G.subgraph(graph[1], seeds, 2, ["uses"])
    assert {r.slug for r in nodes.collect()} == set("abcd")
    assert {(r.source, r.target) for r in edges.collect()} == {("a", "b"), ("b", "d"), ("d", "a")}


def test_paths(spark, graph):
    pairs = spark.createDataFrame([("c", "d"), ("b", "c"), ("a", "x"), ("a", "a")], "a string, b string")
    got = sorted((r.a, r.b, r["rank"], "".join(r.path)) for r in G.shortest_paths(graph[1], pairs).collect())
    assert got == [("b", "c", 1, "bac"), ("c", "d", 1, "cad")]


def test_all_shortest_paths_equal_brute_force(spark):
    rng = random.Random(1)
    names = [f"n{i}" for i in range(7)]
    pairs = {(a, b) for a, b in product(names, names) if a < b and rng.random() < 0.3}
    edges = spark.createDataFrame([(a, b, "uses", 1.0) for a, b in pairs], "source string, target string, type string, confidence double")
    near = {n: {b for a, b in pairs if a == n} | {a for a, b in pairs if b == n} for n in names}

    def brute(a, b):
        front = [(a,)]
        for _ in range(4):
            front = [(*p, n) for p in front for n in near[p[-1]] if n not in p]
            if hits := sorted(p for p in front if p[-1] == b):
                return hits[:3]
        return []

    asked = [(a, b) for a in names for b in names if a != b]
    got = {}
    for r in G.shortest_paths(edges, spark.createDataFrame(asked, "a string, b string")).collect():
        got.setdefault((r.a, r.b), {})[r["rank"]] = tuple(r.path)
    assert {k: [v[i] for i in sorted(v)] for k, v in got.items()} == {(a, b): p for a, b in asked if (p := brute(a, b))}


def test_centrality_and_stats(spark, graph):
    got = {r.slug: r.centrality for r in G.degree_centrality(*graph).collect()}
    assert got["a"] == 0.5 and got["z"] == 0.0
    assert G.stats(*graph).head().asDict() == {"nodes": 7, "edges": 5, "pairs": 5, "clusters": 3, "density": 0.119}
    lone = spark.createDataFrame([("a",)], "slug string")
    none = graph[1].limit(0)
    assert G.degree_centrality(lone, none).head().centrality == 1.0
    assert G.stats(lone, none).head().density == 0.0


def test_clusters_of_a_long_chain(spark):
    names = [f"n{i:03}" for i in range(16)]
    order = names[:]
    random.Random(3).shuffle(order)
    edges = spark.createDataFrame([(a, b, "uses", 1.0) for a, b in zip(order, order[1:])], "source string, target string, type string, confidence double")
    nodes = spark.createDataFrame([(n,) for n in [*names, "other"]], "slug string")
    assert {r.slug: r.cluster for r in G.clusters(nodes, edges).collect()} == {**dict.fromkeys(names, "n000"), "other": "other"}


def test_walk(spark, graph):
    seeds = spark.createDataFrame([("a", 1.0), ("nobody", 5.0)], "slug string, score double")
    got = {r.slug: round(r.score, 6) for r in G.walk_scores(seeds, *graph).collect()}
    assert got == {"a": 1.0, "b": 0.45, "c": 0.25, "d": 0.16}


def brute_links(concepts):
    import re

    words = lambda t: set(re.findall(r"\w+", t[:200].lower()))
    out = {}
    for s, n, d, t in concepts:
        for s2, n2, d2, t2 in concepts:
            if s == s2:
                continue
            m = (d + " ").lower().count(n2.lower())
            a, b = words(d), words(d2)
            jac = len(a & b) / len(a | b) if a and b else 0
            score = round(min(m * 0.3, 1) + len(set(t) & set(t2)) / max(len(t), 1) * 0.5 + jac * 0.4, 9)
            if score >= 0.3:
                out[s, s2] = score
    return out


def test_links_equal_all_pairs(spark):
    rng = random.Random(5)
    vocabulary = "cache store vector query graph node edge score rank text".split()
    concepts = [(f"c{i}", rng.choice(vocabulary) + str(i % 7), " ".join(rng.choices(vocabulary, k=rng.randint(2, 9))) + (f" {vocabulary[i % 10]}{i % 7}." if i % 3 else ""), rng.sample("pqrstuvw", rng.randint(0, 3))) for i in range(40)]
    concepts += [("twin1", "One", "alpha beta gamma delta", []), ("twin2", "Two", "alpha beta gamma delta", [])]
    df = spark.createDataFrame(concepts, "slug string, name string, definition string, tags array<string>")
    assert {(r.source, r.target): r.score for r in K.score_links(df).collect()} == brute_links(concepts)


def test_relation_types(spark):
    from pyspark.sql import functions as F

    rows = [("It is fast. RAG uses a Vector Store! More", "vector store", "uses"), ("Unlike Trees, it grows", "trees", "contrasts_with"), ("It enables x. Nothing on Y", "Y", "related_to"), ("part of the Index; an example of Index", "index", "part_of")]
    df = spark.createDataFrame(rows, "t string, n string, k string")
    assert all(r.got == r.k for r in df.select("k", K.relation_type(K.telling_sentences(F.lower("t")), F.col("n")).alias("got")).collect())


def test_wiki_links(spark):
    df = spark.createDataFrame([("The KV cache and a kv cache, [[RAG]] too", ["KV Cache", "RAG", "cache"]), (None, ["x"])], "text string, names array<string>")
    assert [r.text for r in K.wiki_links(df).collect()] == ["The [[KV cache]] and a kv [[cache]], [[RAG]] too", None]


def test_a_forest_joins_what_the_edges_join_with_fewer_edges(spark):
    rng = random.Random(5)
    pairs = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}", bool(rng.randrange(3))) for _ in range(4000)] + [("lone", "lone", False), ("x", "y", True), ("y", "z", False)]
    edges = spark.createDataFrame(pairs, "source string, target string, kept boolean")
    found = G.forest(edges.coalesce(2)).collect()
    assert len(found) < 4 * 303
    nodes = edges.selectExpr("explode(array(source, target)) slug").distinct()
    for kept in (True, False):
        want = G.clusters(nodes, edges.where(edges.kept == kept)).collect()
        got = G.clusters(nodes, spark.createDataFrame([r for r in found if r.kept == kept], "source string, target string, kept boolean"))
        assert sorted(got.collect()) == sorted(want)
    bare = [G._stars(t).to_pylist() for t in (pa.table({"source": ["b", "c"], "target": ["a", "b"]}), pa.table({"source": pa.array([], pa.string()), "target": pa.array([], pa.string())}))]
    assert bare == [[{"source": "a", "target": "b"}, {"source": "a", "target": "c"}], []]


def test_marks_go_with_the_links_and_change_none(spark):
    rows = [(f"c{i}", f"Name{i}", ["t1", f"t{i % 3}"], f"Name{(i + 1) % 8} uses Name{(i + 3) % 8} and more words of name{i % 4}") for i in range(8)]
    concepts = spark.createDataFrame(rows, "slug string, name string, tags array<string>, definition string")
    changed = spark.createDataFrame([("c2",), ("c5",), ("nobody",)], "slug string")
    got = K.marked_ends(K.score_links(K.marked(concepts, changed))).collect()
    assert sorted((r.source, r.target) for r in got) == sorted((r.source, r.target) for r in K.score_links(concepts).collect()) and got
    assert all(r.kept == (not {r.source, r.target} & {"c2", "c5"}) for r in got)
