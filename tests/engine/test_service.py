"""A knowledge base from transcripts to answers: runs, versions, tools, registry, command line."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from thoughtloom.operators import extraction as X
from thoughtloom.operators import parsing as P
from thoughtloom.service import cli, tools
from thoughtloom.service.knowledge import KnowledgeBase, ingest, pruned
from thoughtloom.service.registry import Registry
from thoughtloom.service.settings import load, merged
from thoughtloom.sources import buckets, storage

ONE = "Human: what is it?\nAssistant: Vector Search is quick for most. Rank Fusion joins the lists of Vector Search.\n"
TWO = "Human: and?\nAssistant: Prompt Cache requires Vector Search at times.\n"
TIME = datetime(2025, 1, 1)


def write(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / f"{name}.md").write_text(text)


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("kb")
    write(root / "in", one=ONE, two=TWO)
    kb = KnowledgeBase(spark, str(root / "kb"))
    told = ingest(kb, str(root / "in"), now=TIME)
    return kb, told, root


def test_a_first_run(filled):
    kb, told, _ = filled
    assert told["files"] == {"new": 2, "modified": 0, "unchanged": 0, "deleted": 0}
    assert {r.slug for r in kb.live().collect()} == {"vector-search", "rank-fusion", "prompt-cache"}
    assert told["concepts"]["added"] == 3 and told["extraction"]["calls"] == 2 and told["extraction"]["rejected_by_grounding"] == 0
    assert {(e.source, e.target) for e in kb.edges().collect()} >= {("rank-fusion", "vector-search"), ("prompt-cache", "vector-search")}
    assert storage.Storage(kb.spark, kb.folder()).exists("markdown")


def test_runs_follow_the_files(spark, tmp_path):
    source, kb = tmp_path / "in", KnowledgeBase(spark, str(tmp_path / "kb"))
    write(source, one=ONE, two=TWO)
    assert ingest(kb, str(source), now=TIME, dry_run=True)["concepts"]["added"] == 3 and kb.version() == 0
    ingest(kb, str(source), now=TIME)
    assert ingest(kb, str(source), now=TIME) == {"skipped": True, "files": {"new": 0, "modified": 0, "unchanged": 2, "deleted": 0}}
    (source / "two.md").unlink()
    write(source, one=ONE + "Human: more\nAssistant: Late Binding waits for Vector Search.\n")
    told = ingest(kb, str(source), now=datetime(2025, 2, 1))
    assert told["files"] == {"new": 0, "modified": 1, "unchanged": 0, "deleted": 1}
    status = {r.slug: r.status for r in kb.concepts().collect()}
    assert {r.slug: r.status for r in kb.concepts(1).collect()} == dict.fromkeys(["vector-search", "rank-fusion", "prompt-cache"], "active")
    assert status["prompt-cache"] == "deleted" and status["late-binding"] == "active" == status["vector-search"]
    assert [(r.slug, r.change) for r in buckets.changed_between(kb.changes(), *map(F.lit, buckets.times_compared(kb.history()))).collect() if r.slug == "late-binding"] == [("late-binding", "added")]
    with pytest.raises(ValueError):
        ingest(kb, str(source), provider="real", now=TIME)
    assert pruned(kb, 9999, datetime(2025, 3, 1)) == 0 and pruned(kb, None, datetime(2025, 3, 1)) == 1
    assert "prompt-cache" not in {r.slug for r in kb.concepts().collect()}


def test_answers(filled):
    kb, _, _ = filled
    hits = tools.search(kb, "vector search", 2)
    assert hits[0]["slug"] == "vector-search" and hits[0]["rank"] == 1 and "rank-fusion" in hits[0]["related"]
    assert tools.get_concept(kb, "VECTOR SEARCH")["slug"] == "vector-search"
    assert tools.get_concept(kb, "nothing")["error"] == "concept_not_found"
    assert "Prompt Cache" in {n["name"] for n in tools.get_neighbors(kb, "vector-search")["neighbors"]}
    told = tools.get_stats(kb)
    assert told["concepts"] == 3 and told["graph_nodes"] == 3 and told["most_central"]
    around = tools.get_subgraph(kb, "Prompt Cache", 1)
    assert {n["slug"] for n in around["nodes"]} >= {"prompt-cache", "vector-search"} and "## Nodes" in around["markdown"]
    assert {n["slug"] for n in tools.get_subgraph(kb, "Prompt Cache", 1, ["no such type"])["nodes"]} == {n["slug"] for n in around["nodes"]}
    way = tools.path_between(kb, "Prompt Cache", "Rank Fusion")
    assert way["found"] and way["path"][0] == "prompt-cache" and way["path"][-1] == "rank-fusion" and len(way["edge_types"]) == len(way["path"]) - 1
    assert not tools.path_between(kb, "Prompt Cache", "nothing")["found"]
    assert len(tools.explain_concept(kb, "Vector Search", "brief")["explanation"]) <= 400
    assert tools.explain_concept(kb, "Vector Search") == tools.UNAVAILABLE == tools.summarize_query(kb, "vector")
    model = X.CannedModel(lambda prompt: " prose ")
    assert tools.explain_concept(kb, "Vector Search", model=model)["explanation"] == "prose"
    both = tools.compare_concepts(kb, ["Vector Search", "rank-fusion", "none"], "speed", model)
    assert both["comparison"] == "prose" and both["concepts_consulted"] == ["vector-search", "rank-fusion"] and both["relationship_types"]
    assert tools.compare_concepts(kb, ["Vector Search"], model=model)["error"] == "insufficient_concepts"
    said = tools.summarize_query(kb, "vector search", 2, model)
    assert said["answer"] == "prose" and said["concepts_consulted"][0] == "vector-search"
    assert tools.summarize_query(kb, "zzz", 2, model)["concepts_consulted"] == []
    assert tools.wrapped({"a": "b"}).startswith("<retrieved-content>\n{")
    assert tools.review_queue(kb, F.lit("2025-01-02")) == []


def test_registry(spark, tmp_path):
    r = Registry(spark, str(tmp_path))
    assert r.create("  A  KB_one! ")["id"] == "a-kb-one" and r.delete("a-kb-one")["success"]
    assert r.create("My KB", "d")["id"] == "my-kb" and not r.create("my kb")["success"] and not r.create("!")["success"]
    assert r.create("Other")["success"] and r.current() is None and not r.select("none")["success"]
    assert r.select("my-kb") == {"success": True, "id": "my-kb", "name": "My KB", "concept_count": 0}
    write(tmp_path / "in", one=ONE)
    ingest(r.open("my-kb"), str(tmp_path / "in"), now=TIME)
    assert r.current()["concepts"] == 2 and [k["is_active"] for k in r.list()] == [True, False]
    write(tmp_path / "in2", two=TWO)
    ingest(r.open("other"), str(tmp_path / "in2"), now=TIME)
    found = tools.search_many(r.concepts(), "vector search").collect()
    assert {f.kb_id for f in found} == {"my-kb", "other"} and found[0].score == 1.0
    assert {f.kb_id for f in tools.search_many(r.concepts(["other"]), "vector search").collect()} == {"other"}
    assert r.rename("my-kb", "New Name")["new_id"] == "new-name" and Registry(spark, str(tmp_path)).current()["id"] == "new-name" and not r.rename("new-name", "other")["success"]
    assert r.open("new-name").live().count() == 2
    gone = r.delete("new-name", TIME)
    assert gone["success"] and storage.Storage(spark, str(tmp_path)).exists(gone["kept"])
    assert r.current() is None and [k["id"] for k in r.list()] == ["other"] and not r.delete("new-name")["success"]
    assert r.create("New Name")["success"] and r.open("new-name").live().count() == 0  # not the old one's folder
    with pytest.raises(KeyError):
        r.open("my-kb")
    with pytest.raises(Exception, match="exist|Exist"):
        r.files.write_text(f"registry/{r.state().number:09d}", "{}", replace=False)


def test_models(spark):
    turns = spark.createDataFrame([("f", 0, "assistant", "Vector Search is quick."), ("g", 0, "assistant", "Rank Fusion is not."), ("h", 0, "assistant", "bad")], "source_file string, idx int, role string, content string")
    chunks = P.chunk_turns(turns)
    reply = json.dumps({"concepts": [{"name": "Vector Search", "definition": "d", "tags": ["t"]}, {"name": "Made Up", "definition": "x"}]})

    def answer(prompt):
        if "bad" in prompt:
            raise OSError("down")
        return reply if "Vector" in prompt else "no json"

    raw, told = X.extract_concepts(P.batch_chunks(chunks), chunks, X.CannedModel(answer))
    rows = raw.collect()
    assert [(r.name, r.source_chunks) for r in rows] == [("Vector Search", ["f:t0:c0"])]
    assert told.head().asDict() == {"chunks_processed": 3, "calls": 3, "concepts_extracted": 1, "parse_failures": 2, "rejected_by_grounding": 1}
    seen = []

    def post(url, body, headers, timeout):
        seen.append((url, headers))
        if len(seen) == 1:
            raise OSError("once")
        return {"message": {"content": "a"}, "choices": [{"message": {"content": "b"}}]}

    assert X.HttpModel("http://x/", "m", post=post, retries=1).generate("p") == "a"
    assert X.HttpModel("http://x", "m", "openai", "k", post=post).generate("p", "s") == "b"
    assert seen[1][0] == "http://x/api/chat" and seen[2] == ("http://x/v1/chat/completions", {"Authorization": "Bearer k"})
    assert not X.HttpModel("http://127.0.0.1:9", "m").available()


def test_distilling_by_method(spark):
    raw = spark.createDataFrame([("A", "plain [[tags:x]]", "llm"), ("B", "B is said. Other.", "heuristic")], "name string, raw_content string, extraction_method string")
    got = {r.name: r.definition for r in X.distill(raw, lambda rows: rows.withColumn("definition", F.lit("by rule"))).collect()}
    assert got == {"A": "plain", "B": "by rule"}


def test_command_line(spark, tmp_path, capsys):
    write(tmp_path / "in", one=ONE, two=TWO)
    (tmp_path / "c.json").write_text(json.dumps({"root": str(tmp_path / "root"), "top_k": 3, "other": 1}))

    def said(*argv):
        args = cli.parser().parse_args(["--config", str(tmp_path / "c.json"), *argv])
        return json.loads(json.dumps(cli.run(spark, args), default=str))

    assert said("config")["top_k"] == 3 and said("--kb", "k", "config")["kb"] == "k"
    assert said("ingest", str(tmp_path / "in"))["files"]["new"] == 2
    assert said("query", "prompt cache", "--top-k", "1")[0]["slug"] == "prompt-cache"
    assert said("stats")["concepts"] == 3
    assert "source_files" in said("show", "Rank Fusion", "--sources") and "source_files" not in said("show", "Rank Fusion")
    assert len(said("list", "--limit", "2")) == 2 and said("diff") == [] and said("prune") == {"pruned": 0}
    assert said("review", "--decide", "rank-fusion=delete") == {"decided": 1} and said("stats")["concepts"] == 2
    assert said("prune") == {"pruned": 1} and said("kb", "list")[0]["id"] == "default"
    assert said("tool", "get_neighbors", '{"name": "Vector Search"}')["concept"] == "Vector Search"
    truth = tmp_path / "eval"
    write(truth, good=ONE, bare=TWO)
    (truth / "good.gt.yaml").write_text("expected_concepts:\n- {name: Vector Search, slug: vector-search, key_phrases: [quick]}\n- {name: None, slug: none}\nexpected_relationships: []\n")
    pytest.importorskip("yaml")
    told = said("eval", str(truth))
    assert [t["fixture"] for t in told] == ["good"] and told[0]["recall"] == 0.5 and told[0]["phrase_grounding"] == 1.0 and told[0]["relationships"]["recall"] == 1.0
    assert load(str(tmp_path / "none")) == {} and merged({"top_k": None}, {}).top_k == 5


def test_stores(spark, tmp_path):
    assert storage.load_hashes(spark, str(tmp_path)).count() == 0
    (tmp_path / "hashes").mkdir()
    (tmp_path / "hashes" / "part-0.parquet").write_text("damaged")
    assert storage.load_hashes(spark, str(tmp_path)).count() == 0
    storage.save_hashes(spark.createDataFrame([("a", "1")], "path string, hash string"), str(tmp_path))
    assert storage.load_hashes(spark, str(tmp_path)).collect() == [("a", "1")]
    assert storage.load_vectors(spark, str(tmp_path)) is None
    storage.save_vectors(spark.createDataFrame([("a", [1.0, 2.0])], "slug string, vector array<float>"), str(tmp_path), "m")
    assert storage.load_vectors(spark, str(tmp_path)).head().width == 2
    nodes = spark.createDataFrame([("a", "A"), ("b", "B")], "slug string, name string")
    edges = spark.createDataFrame([("a", "b", "uses", 0.5)], "source string, target string, type string, confidence double")
    told = {(r.kind, r.json) for r in storage.graph_json(nodes, edges).collect()}
    assert ("stats", '{"nodes":2,"edges":1}') in told and len(told) == 4
    rows = spark.createDataFrame([(1, "A", 0.5, "d")], "rank int, name string, total double, definition string")
    assert rows.select(storage.format_results(rows)).head()[0] == "1. A (0.500)\n   d"
