"""The command line: ``python -m thoughtloom.service.cli COMMAND``. Answers are printed as JSON."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, graph, hygiene
from ..operators.embedding import Embedder, HttpEmbedder
from ..operators.extraction import HttpModel, Model
from ..sources import buckets, storage
from . import knowledge, tools
from .registry import Registry
from .settings import Settings, load, merged


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="thoughtloom")
    for flag in ("root", "kb", "provider", "url", "model", "form", "embed-url", "embed-model", "embed-form", "client"):
        out.add_argument(f"--{flag}")
    out.add_argument("--config")
    commands = out.add_subparsers(dest="command", required=True)
    add = lambda name, *rest: [c := commands.add_parser(name), *(c.add_argument(a, **k) for a, k in rest)][0]
    add("ingest", ("source", {}), ("--dry-run", {"action": "store_true"}))
    add("query", ("question", {}), ("--top-k", {"type": int}), ("--mode", {"choices": ["hybrid", "no_vectors", "keyword", "semantic"]}), ("--tag", {}), ("--min-confidence", {"type": float}), ("--since", {}), ("--include-deleted", {"action": "store_true"}))
    add("stats")
    add("show", ("name", {}), ("--sources", {"action": "store_true"}))
    add("list", ("--tag", {"default": ""}), ("--limit", {"type": int}))
    add("diff", ("--since", {}))
    add("prune", ("--older-than-days", {"type": float}))
    add("review", ("--decide", {"action": "append", "default": [], "metavar": "SLUG=ACTION"}))
    add("eval", ("folder", {}), ("--report", {}))
    add("kb", ("action", {"choices": ["list", "create", "delete", "rename", "select", "current"]}), ("names", {"nargs": "*"}))
    add("tool", ("name", {"choices": sorted({**TOOLS, **REGISTRY_TOOLS})}), ("arguments", {"nargs": "?", "default": "{}"}))
    add("config")
    return out


def _model(settings: Settings) -> Model | None:
    return HttpModel(settings.url, settings.model, settings.form) if settings.provider != "mock" else None


def _embedder(settings: Settings) -> Embedder | None:
    return HttpEmbedder(settings.embed_url, settings.embed_model, settings.embed_form) if settings.embed_url else None


def evaluate(spark: SparkSession, folder: str, model: Model | None) -> list[dict]:
    """Scores of extraction for each text of an evaluation folder that has a truth, and over all."""
    from ..operators import concepts as C
    from ..operators import extraction, parsing

    files, expected, relations = storage.load_corpus(spark, folder)
    turns = parsing.parse_turns(files.where("has_truth"), "fixture")
    chunks = graph.stored(parsing.chunk_turns(turns.where("role = 'assistant'")))
    raw, _ = extraction.extract_concepts(parsing.batch_chunks(chunks), chunks, model)
    found = graph.stored(knowledge.distilled(raw, F.current_timestamp()).select("source_files", "slug", "name", "definition", "insights", "relationships").withColumn("fixture", F.col("source_files")[0]))
    names = [r[0] for r in expected.select("fixture").distinct().collect()]  # one per file of the folder
    out = []
    for name in sorted(names):
        e, a = expected.where(F.col("fixture") == name), found.where(F.col("fixture") == name)
        told = evaluation.concept_scores(e, a, evaluation.match_concepts(e, a)).head().asDict()
        edges = relations.where(F.col("fixture") == name).select("source", "target", "type")
        told["relationships"] = evaluation.relationship_scores(edges, C.links_of(a).select("source", "target", "type")).head().asDict()
        out.append({"fixture": name, **told})
    return out


def _kb(spark: SparkSession, settings: Settings) -> knowledge.KnowledgeBase:
    registry = Registry(spark, settings.root)
    registry.create(settings.kb)  # says so if it is there already
    return registry.open(settings.kb)


TOOLS = {
    "search": lambda kb, m, e, **a: tools.search(kb, embedder=e, **a),
    "get_concept": lambda kb, m, e, **a: tools.get_concept(kb, **a),
    "list_concepts": lambda kb, m, e, **a: [r.asDict() for r in tools.list_concepts(kb.live(), **a).collect()],
    "get_neighbors": lambda kb, m, e, **a: tools.get_neighbors(kb, **a),
    "get_stats": lambda kb, m, e, **a: tools.get_stats(kb, **a),
    "get_subgraph": lambda kb, m, e, **a: tools.get_subgraph(kb, **a),
    "path_between": lambda kb, m, e, **a: tools.path_between(kb, model=m, **a),
    "explain_concept": lambda kb, m, e, **a: tools.explain_concept(kb, model=m, **a),
    "compare_concepts": lambda kb, m, e, **a: tools.compare_concepts(kb, model=m, **a),
    "summarize_query": lambda kb, m, e, **a: tools.summarize_query(kb, model=m, **a),
    "list_review_queue": lambda kb, m, e, **a: tools.review_queue(kb, F.current_timestamp()),
}


#: Tools over several knowledge bases.
REGISTRY_TOOLS = {
    "search_all": lambda r, e, **a: tools.search_all(r, **a),
    "search_selected": lambda r, e, **a: tools.search_selected(r, embedder=e, **a),
    **{f"kb_{name}": lambda r, e, name=name, **a: getattr(r, name)(**a) for name in ("list", "create", "select", "delete", "rename")},
    "kb_get_current": lambda r, e, **a: r.current(),
}


def run(spark: SparkSession, args: argparse.Namespace) -> object:
    """What a command answers."""
    settings = merged({k: v for k, v in vars(args).items() if k not in ("command", "config")}, load(args.config))
    if args.command == "config":
        return asdict(settings)
    if args.command == "kb":
        registry = Registry(spark, settings.root)
        return getattr(registry, args.action)(*args.names)
    model, embedder = _model(settings), _embedder(settings)
    if args.command == "eval":
        told = evaluate(spark, args.folder, model)
        if args.report:
            out = storage.Storage(spark, args.report)
            out.write_text("report.json", json.dumps(told, indent=2, default=str))
            out.write_text("report.md", evaluation.markdown_report(told))
        return told
    if args.command == "tool" and args.name in REGISTRY_TOOLS:
        return REGISTRY_TOOLS[args.name](Registry(spark, settings.root), embedder, **json.loads(args.arguments))
    kb = _kb(spark, settings)
    if args.command == "ingest":
        return knowledge.ingest(kb, args.source, settings.provider, model, dry_run=args.dry_run, embedder=embedder)
    if args.command == "query":
        return tools.search(kb, args.question, settings.top_k, settings.mode, embedder, tag=args.tag, min_confidence=args.min_confidence, since=args.since, include_deleted=args.include_deleted)
    if args.command == "stats":
        return tools.get_stats(kb)
    if args.command == "show":
        told = tools.get_concept(kb, args.name)
        return told if args.sources else {k: v for k, v in told.items() if k != "source_files"}
    if args.command == "list":
        return [r.asDict() for r in tools.list_concepts(kb.live(), args.tag, args.limit).collect()]
    if args.command == "diff":
        times = buckets.times_compared(kb.history(), args.since)
        return [] if times is None else [r.asDict() for r in buckets.changed_between(kb.changes(), *map(F.lit, times)).orderBy("slug").collect()]
    if args.command == "prune":
        return {"pruned": knowledge.pruned(kb, args.older_than_days, provider=settings.provider)}
    if args.command == "review":
        if not args.decide:
            return tools.review_queue(kb, F.current_timestamp())
        rows = spark.createDataFrame([tuple(d.split("=", 1)) for d in args.decide], "slug string, action string")
        kb.save(graph.stored(hygiene.apply_decisions(kb.concepts(), rows, F.lit(datetime.now(timezone.utc).replace(tzinfo=None)))))
        return {"decided": len(args.decide)}
    return TOOLS[args.name](kb, model, embedder, **json.loads(args.arguments))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("thoughtloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    client = merged({"client": args.client}, load(args.config)).client
    print(tools.for_client(client, args.command, run(spark, args)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
