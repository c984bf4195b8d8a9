"""What a store must not lose: sources, relations, replies, conflicts, places, vectors, versions."""

import json
import sys
from datetime import datetime

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from thoughtloom.operators import extraction as X
from thoughtloom.operators.embedding import CannedEmbedder, HttpEmbedder
from thoughtloom.service import cli, tools
from thoughtloom.service.knowledge import KnowledgeBase, ingest
from thoughtloom.service.registry import Registry
from thoughtloom.sources import storage

TIME = datetime(2025, 1, 1)
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import a test


class Counting:
    """A model that counts how often each prompt is asked, in a file, since tasks are other processes."""

    model = "counting"

    def __init__(self, path, answer, fails=()):
        self.path, self.answer, self.fails = str(path), answer, fails

    def available(self):
        return True

    def generate(self, prompt, system=""):
        import hashlib

        with open(self.path, "a") as f:
            f.write(hashlib.sha256(prompt.encode()).hexdigest() + "\n")
        text = prompt.removeprefix(X.TASK)
        if any(w in text for w in self.fails):
            raise OSError("down")
        return json.dumps({"concepts": self.answer(text)})


def asked(path):
    return path.read_text().splitlines() if path.exists() else []


def concept(name, **more):
    return {"name": name, "definition": f"{name} is a thing that is told of here.", **more}


def by_line(text):
    found = []
    if "Vector Store" in text:
        found.append(concept("Vector Store", insights=["It is always built from tokens.", "It is sometimes kept for long."], tags=["store"]))
    if "Rank Fusion" in text:
        found.append(concept("Rank Fusion", relationships=[{"target": "Vector Store", "type": "depends_on"}, {"target": "Unknown", "type": "uses"}]))
    return found


@pytest.fixture(scope="module")
def told(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("truth")
    source = root / "in"
    source.mkdir()
    (source / "a.md").write_text("Human: q\nAssistant: The Vector Store holds them.\n")
    (source / "b.md").write_text("Human: q\nAssistant: A Vector Store again.\n---\nmore?\n---\nThe Vector Store has turns.\n")
    (source / "c.md").write_text("Human: q\nAssistant: Rank Fusion joins.\n")
    kb = KnowledgeBase(spark, str(root / "kb"))
    model = Counting(root / "asked", by_line)
    embedder = CannedEmbedder(lambda t: [1.0, 0.0] if "Vector" in t.split(".")[0] else [0.1, 1.0])
    result = ingest(kb, str(source), "real", model, TIME, embedder=embedder)
    return kb, root, source, model, embedder, result


def test_a_model_is_asked_once_for_each_prompt(told):
    kb, root, _, _, _, result = told
    lines = asked(root / "asked")
    assert result["extraction"]["calls"] == 3 == len(lines) == len(set(lines))


def test_relations_that_a_model_names_are_edges(told):
    edges = {(e.source, e.target, e.type): e.confidence for e in told[0].edges().collect()}
    assert edges["rank-fusion", "vector-store", "depends_on"] == 0.85
    assert not any("unknown" in e for e in edges)


def test_conflicts_are_stored_with_their_variants(told):
    kb = told[0]
    row = kb.live().where("slug = 'vector-store'").head()
    assert row.status == "conflicted" and [(c.a, c.b) for c in row.conflicts] == [("It is always built from tokens.", "It is sometimes kept for long.")]
    assert [(r["slug"], r["reason"]) for r in tools.review_queue(kb, F.lit("2025-01-02"))] == [("vector-store", "conflicted")]
    assert kb.live().where("slug = 'rank-fusion'").head().status == "active"


def test_places_are_in_the_store_and_in_its_json(told):
    kb = told[0]
    sources = {s.transcript_path.rsplit("/")[-1]: s for s in kb.live().where("slug = 'vector-store'").head().sources}
    assert set(sources) == {"a.md", "b.md"} and sources["b.md"].turn_indices == [1, 3] and sources["a.md"].turn_indices == [1]
    assert sources["b.md"].chunk_id.endswith("b.md:t1:c0") and sources["b.md"].snippet == "A Vector Store again." and sources["a.md"].transcript_hash
    lines = [json.loads(r.value) for r in kb.spark.read.text(f"{kb.folder()}/provenance").collect()]
    assert {x["slug"]: len(x["sources"]) for x in lines} == {"vector-store": 2, "rank-fusion": 1}
    assert tools.get_concept(kb, "Vector Store")["sources"][0]["transcript_path"].endswith("a.md")


def test_questions_meet_vectors(told):
    kb, _, _, _, embedder, _ = told
    hits = tools.search(kb, "Vector what", mode="semantic", embedder=embedder)
    assert [h["slug"] for h in hits] == ["vector-store", "rank-fusion"] and hits[0]["total"] == 1.0
    assert tools.search(kb, "zzz", mode="hybrid") == [] and tools.search(kb, "Vector zzz", embedder=embedder)[0]["slug"] == "vector-store"
    assert [h["slug"] for h in tools.search(kb, "Vector what", mode="semantic", embedder=embedder, tag="store")] == ["vector-store"]


def test_a_source_that_goes_leaves_the_others_and_vectors_go_along(told):
    kb, root, source, model, embedder, _ = told
    before = len(asked(root / "asked"))
    (source / "a.md").unlink()
    (source / "d.md").write_text("Human: q\nAssistant: Rank Fusion joins.\n")  # a prompt that is answered already
    ingest(kb, str(source), "real", model, datetime(2025, 2, 1))
    row = kb.live().where("slug = 'vector-store'").head()
    assert [f.rsplit("/")[-1] for f in row.source_files] == ["b.md"] == [s.transcript_path.rsplit("/")[-1] for s in row.sources]
    assert len(asked(root / "asked")) == before
    assert {f.rsplit("/")[-1] for f in kb.live().where("slug = 'rank-fusion'").head().source_files} == {"c.md", "d.md"}
    assert kb.vectors().where("slug = 'vector-store'").head().vector == [1.0, 0.0] and kb.cells() is not None
    assert kb.version() == 2 and kb.links() is not None


def test_failed_prompts_are_asked_again(spark, tmp_path):
    batches = spark.createDataFrame([(i, t) for i, t in enumerate(("good one", "bad one", "good one"))], "i int, content string")
    down = Counting(tmp_path / "asked", lambda t: [], fails=("bad",))
    rows = X.ask_once(batches, down, str(tmp_path / "replies")).orderBy("i").collect()
    assert [r.error for r in rows] == [None, "down", None] and rows[0].reply == rows[2].reply and len(asked(tmp_path / "asked")) == 2
    up = Counting(tmp_path / "asked", lambda t: [])
    rows = X.ask_once(batches, up, str(tmp_path / "replies")).collect()
    assert all(r.error is None and r.reply for r in rows) and len(asked(tmp_path / "asked")) == 3


def test_a_stop_before_the_end_leaves_the_last_version(spark, told, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    kb.save(told[0].concepts())
    (tmp_path / "kb" / "v2").mkdir()  # a run that stopped
    (tmp_path / "kb" / "finished" / "000000002.0a.new").write_text("")
    assert kb.version() == 1 and kb.live().count() == 2


def test_embedding_servers_of_both_forms():
    seen = []

    def post(url, body, headers, timeout):
        seen.append((url, body, headers))
        return {"embedding": [1, 2], "data": [{"embedding": [3]}, {"embedding": [4]}]}

    assert HttpEmbedder("http://x/", "m", post=post).embed(["a", "b"]) == [[1, 2], [1, 2]]
    assert HttpEmbedder("http://x/v1", "m", "openai", "k", post=post).embed(["a", "b"]) == [[3], [4]]
    assert [s[0] for s in seen] == ["http://x/api/embeddings"] * 2 + ["http://x/v1/embeddings"]
    assert seen[2][1:] == ({"model": "m", "input": ["a", "b"]}, {"Authorization": "Bearer k"})


def test_commands_over_bases_filters_and_reports(spark, tmp_path, capsys):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.md").write_text("Human: q\nAssistant: Vector Search is quick for most. Rank Fusion joins the lists.\n")
    (tmp_path / "c.json").write_text(json.dumps({"root": str(tmp_path / "root"), "mode": "keyword"}))

    def said(*argv):
        return json.loads(json.dumps(cli.run(spark, cli.parser().parse_args(["--config", str(tmp_path / "c.json"), *argv])), default=str))

    said("ingest", str(source))
    assert said("tool", "search_selected", '{"question": "vector"}')["error"] == "no_kb_selected"
    assert said("tool", "kb_select", '{"kb_id": "default"}')["success"] and Registry(spark, str(tmp_path / "root")).current()["id"] == "default"
    assert said("tool", "kb_get_current")["concepts"] == 2 and said("kb", "current")["id"] == "default"
    assert said("tool", "search_selected", '{"question": "vector"}')["results"][0]["slug"] == "vector-search"
    assert said("tool", "search_all", '{"question": "vector"}')[0]["kb_id"] == "default"
    tag = said("show", "Vector Search")["tags"][0]
    assert all(tag in h["tags"] for h in said("query", "vector rank", "--tag", tag)) and said("query", "vector", "--tag", tag)
    assert said("query", "vector", "--tag", "no such") == [] == said("query", "vector", "--min-confidence", "0.99") == said("query", "vector", "--since", "2999-01-01")
    said("review", "--decide", "rank-fusion=delete")
    assert "rank-fusion" not in str(said("query", "rank")) and "rank-fusion" in str(said("query", "rank", "--include-deleted"))
    (source / "a.gt.yaml").write_text("expected_concepts:\n- {name: Vector Search, slug: vector-search, key_phrases: [quick]}\nexpected_relationships: []\n")
    pytest.importorskip("yaml")
    said("eval", str(source), "--report", str(tmp_path / "report"))
    assert json.loads((tmp_path / "report" / "report.json").read_text())[0]["recall"] == 1.0
    text = (tmp_path / "report" / "report.md").read_text()
    assert "Concept recall: 1.000 (1 of 1)" in text and "| a | 1.000 |" in text
    assert tools.for_client("enveloped", "query", {"a": "b"}).startswith("<retrieved-content>") and tools.for_client("none such", "x", [1]) == "[\n  1\n]"
    tools.register_client("short", lambda command, payload: command)
    assert tools.for_client("short", "stats", {}) == "stats"


def test_text_is_replaced_whole(spark, tmp_path):
    files = storage.Storage(spark, str(tmp_path))
    files.write_text("a.json", "1")
    files.write_text("a.json", "2")
    assert files.read_text("a.json") == "2" and files.names("") == ["a.json"] or ".a.json.crc" in files.names("")
    assert files.names("none") == []
