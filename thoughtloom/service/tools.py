"""What agents may ask of a knowledge base; answers are dictionaries of a size set by the question.

Every tool is a short plan over concepts and edges; only its few result rows come to the driver.
Tools that write prose ask a model; without one they say so, and the plain ones still answer.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import slugify
from ..operators import graph as G
from ..operators import hygiene, lifecycle
from ..operators import retrieval as R
from ..operators.embedding import Embedder
from ..operators.extraction import Model
from .knowledge import KnowledgeBase
from .registry import Registry

#: Lengths of texts in answers, and how many neighbours a hit shows.
BRIEF_CHARS, LISTED_CHARS, NEIGHBOR_CHARS, RELATED = 400, 200, 150, 5
UNAVAILABLE = {"error": "synthesis_backend_unavailable", "message": "no model can be reached"}


def resolve(concepts: DataFrame, names: DataFrame) -> DataFrame:
    """(name, slug) for each of ``names``: the concept of that slug, else of that name in any case; others have no row."""
    asked = names.select("name", slugify(F.col("name")).alias("s"), F.lower("name").alias("low")).distinct()
    own = concepts.select("slug", F.lower("name").alias("c"))
    by_slug = asked.join(own, asked.s == own.slug).select("name", "slug", F.lit(0).alias("k"))
    by_name = asked.join(own, asked.low == own.c).select("name", "slug", F.lit(1).alias("k"))
    return by_slug.unionByName(by_name).groupBy("name").agg(F.min(F.struct("k", "slug")).alias("m")).select("name", F.col("m.slug").alias("slug"))


def _slugs(kb: KnowledgeBase, *names: str) -> list[str | None]:
    found = {r["name"]: r["slug"] for r in resolve(kb.live(), kb.spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    return [found.get(n) for n in names]


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def search_rows(concepts: DataFrame, edges: DataFrame, question: str, k: int = 5, semantic: DataFrame | None = None, mode: str | None = None) -> DataFrame:
    """(rank, slug, name, total, definition, tags, related): the k best hits, each with its first neighbours."""
    hits = G.stored(R.top(R.hybrid(concepts, edges, question, semantic, mode), "total", "slug", k))
    near = G.neighbors(edges, hits).groupBy("slug").agg(F.slice(F.array_sort(F.collect_list("neighbor")), 1, RELATED).alias("related"))
    rank = F.row_number().over(R.Window.orderBy(F.desc("total"), "slug"))  # at most k rows
    rows = hits.withColumn("rank", rank).join(concepts.select("slug", "name", "definition", "tags"), "slug").join(near, "slug", "left")
    return rows.select("rank", "slug", "name", F.round("total", 3).alias("total"), "definition", "tags", F.coalesce("related", F.array().cast("array<string>")).alias("related")).orderBy("rank")


def nearest(kb: KnowledgeBase, question: str, embedder: Embedder | None, top: int = 50) -> DataFrame | None:
    """(slug, cosine, score) of the concepts whose vectors are nearest to the question's; None where one of them is missing."""
    cells = kb.cells() if embedder is not None else None
    if cells is None:
        return None
    return cells.nearest(embedder.embed([question])[0], top).withColumnRenamed("key", "slug")


def search(kb: KnowledgeBase, question: str, top_k: int = 5, mode: str | None = None, embedder: Embedder | None = None, **filters) -> list[dict]:
    """The best hits; ``filters`` (tag, min_confidence, since, include_deleted) say which concepts can be among them.

    A filter holds before scores are taken, so that the best of the filtered concepts are found.
    """
    rows = R.filter_concepts(kb.concepts(), **filters)
    semantic = nearest(kb, question, embedder)
    if semantic is not None:
        semantic = semantic.join(rows.select("slug"), "slug", "left_semi")
    return _rows(search_rows(rows, kb.edges(), question, top_k, semantic, mode))


def search_all(registry: Registry, question: str, top_k: int = 5, max_total: int = 20, kb_ids: list[str] | None = None) -> list[dict]:
    """The best of each knowledge base (or of the named ones), and of these the best of all."""
    concepts = registry.concepts(kb_ids)
    return [] if concepts is None else _rows(search_many(concepts, question, top_k, max_total))


def search_selected(registry: Registry, question: str, top_k: int = 5, embedder: Embedder | None = None) -> dict:
    """The hits of the selected knowledge base."""
    selected = registry.state().selected
    if selected is None:
        return {"error": "no_kb_selected", "message": "select a knowledge base first"}
    return {"kb_id": selected, "results": search(registry.open(selected), question, top_k, embedder=embedder)}


def search_many(concepts: DataFrame, question: str, top_k: int = 5, most: int = 20) -> DataFrame:
    """(kb_id, kb_name, slug, name, score, definition): the best of each knowledge base, then the best of all.

    Keywords are scored within each knowledge base, as it would score them alone.
    """
    key = F.concat_ws("\u0001", "kb_id", "slug")
    rows = concepts.withColumn("key", key)
    scores = None
    for kb_id in [r[0] for r in concepts.select("kb_id").distinct().collect()]:  # knowledge bases are few and named
        own = R.keyword_scores(rows.where(F.col("kb_id") == kb_id), "key", R.concept_text(rows), question)
        scores = own if scores is None else scores.unionByName(own)
    if scores is None:
        return rows.select("kb_id", "kb_name", "slug", "name", F.lit(0.0).alias("score"), "definition").limit(0)
    best = R.per_group(scores.join(rows, "key").withColumn("score", F.round("score", 3)), "kb_id", "score", "slug", top_k, most)
    return best.select("kb_id", "kb_name", "slug", "name", "score", _cut(F.col("definition"), LISTED_CHARS, "...").alias("definition"))


def _cut(text: Column, n: int, sign: str = "") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(sign))).otherwise(text)


def get_concept(kb: KnowledgeBase, name: str) -> dict:
    slug = _slugs(kb, name)[0]
    if slug is None:
        return {"error": "concept_not_found", "message": f"Concept not found: {name}"}
    row = kb.live().where(F.col("slug") == slug).head().asDict(recursive=True)
    fields = ("name", "slug", "definition", "explanation", "insights", "examples", "tags", "confidence", "links", "source_files", "status", "conflicts", "sources")
    edges = kb.edges().where(F.col("source") == slug).select("target", "type").orderBy("target", "type")
    return {**{f: row.get(f) for f in fields}, "relationships": _rows(edges)}


def list_concepts(concepts: DataFrame, tag: str = "", limit: int | None = None) -> DataFrame:
    """(name, slug, confidence, tags), the surest first; a tag is compared in any case."""
    rows = concepts.where(F.exists("tags", lambda t: F.lower(t) == tag.lower())) if tag else concepts
    out = rows.select("name", "slug", "confidence", "tags").orderBy(F.desc("confidence"), "slug")
    return out.limit(limit) if limit is not None else out


def get_neighbors(kb: KnowledgeBase, name: str) -> dict:
    slug = _slugs(kb, name)[0]
    if slug is None:
        return {"error": "concept_not_found", "message": f"Concept not found: {name}"}
    live, own = kb.live(), kb.live().where(F.col("slug") == slug)
    near = G.neighbors(kb.edges(), own).select(F.col("neighbor").alias("slug")).join(live, "slug")
    out = G.outgoing_types(kb.edges()).where(F.col("source") == slug)
    return {"concept": own.head()["name"], "neighbors": _rows(near.select("name", "slug", F.substring("definition", 1, NEIGHBOR_CHARS).alias("definition")).orderBy("slug")), "relationships": _rows(out.select("target", "type", "confidence").orderBy("target"))}


def get_stats(kb: KnowledgeBase) -> dict:
    live, edges = kb.live(), kb.edges()
    central = G.degree_centrality(live, edges).join(live.select("slug", "name"), "slug").orderBy(F.desc("centrality"), "slug").limit(5)
    return {**lifecycle.kb_stats(live).head().asDict(), **{f"graph_{k}": v for k, v in G.stats(live, edges).head().asDict().items()}, "most_central": _rows(central.select("name", F.round("centrality", 3).alias("centrality")))}


def review_queue(kb: KnowledgeBase, now: Column) -> list[dict]:
    return _rows(hygiene.review_queue(kb.live(), now).orderBy("slug"))


def get_subgraph(kb: KnowledgeBase, center: str, depth: int = 1, types: list[str] | None = None) -> dict:
    """Nodes and edges around a concept, as lists and as Markdown; nodes stay where their edges are left out."""
    slug = _slugs(kb, center)[0]
    if slug is None:
        return {"nodes": [], "edges": [], "markdown": ""}
    near, inner = G.subgraph(kb.edges(), kb.spark.createDataFrame([(slug,)], "slug string"), depth, types)
    nodes = _rows(near.select("slug").distinct().join(kb.live().select("slug", "name"), "slug").orderBy("slug"))
    edges = _rows(inner.select("source", "target", "type", "confidence").orderBy("source", "target", "type"))
    lines = [f"# Around {slug} ({depth} hops)", "", "## Nodes", *(f"- {n['slug']}: {n['name']}" for n in nodes), "", "## Edges", *(f"- {e['source']} {e['type']} {e['target']}" for e in edges)]
    return {"nodes": nodes, "edges": edges, "markdown": "\n".join(lines if edges else [*lines, "(none)"])}


def typed_paths(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """``paths`` (a, b, rank, path) with ``edge_types``: of each step the type of its edge, or else of the one back."""
    steps = paths.select("a", "b", "rank", "path", F.posexplode(F.expr("transform(sequence(1, size(path) - 1), i -> struct(path[i - 1] as x, path[i] as y))")).alias("i", "step"))
    kind = edges.groupBy("source", "target").agg(F.min("type").alias("type"))
    there = kind.select(F.col("source").alias("x"), F.col("target").alias("y"), F.col("type").alias("there"))
    back = kind.select(F.col("target").alias("x"), F.col("source").alias("y"), F.col("type").alias("back"))
    rows = steps.select("a", "b", "rank", "path", "i", "step.*").join(there, ["x", "y"], "left").join(back, ["x", "y"], "left")
    types = F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("there", "back").alias("t")))), lambda s: s["t"])
    return rows.groupBy("a", "b", "rank", "path").agg(types.alias("edge_types"))


def path_between(kb: KnowledgeBase, one: str, other: str, max_hops: int = 4, model: Model | None = None) -> dict:
    none = {"found": False, "path": [], "narrative": "", "edge_types": []}
    a, b = _slugs(kb, one, other)
    if a is None or b is None:
        return none
    edges = kb.edges()
    paths = G.shortest_paths(edges, kb.spark.createDataFrame([(a, b)], "a string, b string"), max_hops, 1)
    row = typed_paths(paths, edges).head()
    if row is None:
        return none
    narrative = model.generate("Tell in one sentence how these are connected: " + " -> ".join(row["path"])) if model is not None and model.available() else ""
    return {"found": True, "path": row["path"], "narrative": narrative, "edge_types": row["edge_types"]}


def explain_concept(kb: KnowledgeBase, name: str, depth: str = "standard", model: Model | None = None) -> dict:
    """``brief`` needs no model: the definition and the first insight."""
    slug = _slugs(kb, name)[0]
    if slug is None:
        return {"error": "concept_not_found", "message": f"No concept matching '{name}'."}
    c = kb.live().where(F.col("slug") == slug).head()
    related = sorted(r["neighbor"] for r in G.neighbors(kb.edges(), kb.spark.createDataFrame([(slug,)], "slug string")).orderBy("neighbor").limit(RELATED).collect())
    if depth == "brief":
        said = " ".join([c["definition"] or "", *(c["insights"] or [])[:1]]).strip()[:BRIEF_CHARS]
    elif model is None or not model.available():
        return UNAVAILABLE
    else:
        words = 80 if depth == "standard" else 200
        said = model.generate(f"Explain in about {words} words, from this alone: {c['name']}: {c['definition']} {c['explanation'] or ''} {'; '.join(c['insights'] or [])}").strip()
    return {"slug": slug, "explanation": said, "related_slugs": related}


def compare_concepts(kb: KnowledgeBase, names: list[str], aspect: str = "", model: Model | None = None) -> dict:
    if model is None or not model.available():
        return UNAVAILABLE
    slugs = [s for s in dict.fromkeys(_slugs(kb, *names)) if s] if names else []
    if len(slugs) < 2:
        return {"error": "insufficient_concepts", "message": f"Need at least 2 known concepts; got {len(slugs)}."}
    rows = {r["slug"]: r for r in kb.live().where(F.col("slug").isin(*slugs)).collect()}
    among = kb.edges().where(F.col("source").isin(*slugs) & F.col("target").isin(*slugs)).orderBy("source", "target", "type").collect()
    text = "\n".join([*(f"{rows[s]['name']}: {rows[s]['definition']}" for s in slugs), *(f"{e['source']} {e['type']} {e['target']}" for e in among)])
    told = model.generate(f"Compare in a few sentences{' with regard to ' + aspect if aspect else ''}, from this alone:\n{text}").strip()
    return {"comparison": told, "relationship_types": sorted({e["type"] for e in among}), "concepts_consulted": slugs}


def summarize_query(kb: KnowledgeBase, question: str, top_k: int = 5, model: Model | None = None) -> dict:
    """An answer in prose from the concepts that match best and their relations."""
    if model is None or not model.available():
        return UNAVAILABLE
    live, edges = kb.live(), kb.edges()
    hits = G.stored(R.top(R.hybrid(live, edges, question), "total", "slug", top_k))
    pack = R.context_pack(hits, edges).head()
    if not pack["concepts"]:
        return {"answer": "", "concepts_consulted": [], "confidence": 0.0, "suggested_followup": []}
    rows = {r["slug"]: r for r in live.join(hits.select("slug"), "slug", "left_semi").collect()}
    text = "\n".join([*(f"{rows[s]['name']}: {rows[s]['definition']}" for s in pack["concepts"]), *pack["relationships"]])
    answer = model.generate(f"Answer in 2 to 5 sentences, from this alone. QUESTION: {question}\n{text}").strip()
    return {"answer": answer, "concepts_consulted": pack["concepts"], "confidence": pack["confidence"], "suggested_followup": pack["neighbor_slugs"][:3]}


def wrapped(payload: object, tag: str = "retrieved-content") -> str:
    """A payload as JSON in the envelope that marks retrieved content, without hidden characters."""
    text = json.dumps(payload, default=str)
    hidden = {*range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xFEFF, *range(0xE0000, 0xE0080)}
    return f"<{tag}>\n{text.translate(dict.fromkeys(hidden))}\n</{tag}>"


#: How answers are written for a client, by its name; others are added by ``register_client``.
_CLIENTS = {"plain": lambda command, payload: json.dumps(payload, indent=2, default=str), "enveloped": lambda command, payload: wrapped(payload)}


def register_client(name: str, write) -> None:
    """``write`` gets the command and its answer, and gives the text for that client."""
    _CLIENTS[name] = write


def for_client(name: str, command: str, payload: object) -> str:
    """An answer as text; an unknown client gets it plain. What a tool retrieved is enveloped for all but plain clients."""
    return _CLIENTS.get(name, _CLIENTS["plain"])(command, payload)
