"""A knowledge base in a folder: versions of its tables, and the run that brings it up to date."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import concepts as C
from ..operators import dedup, extraction, graph, hygiene, lifecycle, linking, parsing
from ..operators.cells import VectorCells
from ..operators.embedding import Embedder, embed_concepts
from ..sources import files, storage
from ..sources.buckets import BUCKETS, BucketStore

#: The tables of a version of a knowledge base.
CONCEPTS = f"""name string, slug string, definition string, explanation string, insights array<string>, examples array<string>, tags array<string>, source_files array<string>,
 confidence double, links array<string>, relationships array<struct<source:string,target:string,type:string,confidence:double>>, sources array<{C.SOURCE}>, conflicts array<struct<a:string,b:string>>, status string, deleted_at timestamp, last_reinforced_at timestamp, last_reviewed_at timestamp, hash string"""


@dataclass
class KnowledgeBase:
    """Tables of one version; ``root`` also holds the concepts of all versions, in buckets, runs and file hashes."""

    spark: SparkSession
    root: str
    buckets: int = BUCKETS

    def version(self) -> int:
        """The highest version that was finished; each has a file of its own, so none is ever replaced."""
        return max((int(name) for name in storage.Storage(self.spark, self.root).names("finished")), default=0)

    def folder(self, version: int | None = None) -> str:
        return f"{self.root.rstrip('/')}/v{self.version() if version is None else version}"

    def store(self) -> BucketStore:
        """The concepts of all versions; a version rewrites the buckets in which one differs."""
        return BucketStore(self.spark, f"{self.root.rstrip('/')}/concepts", CONCEPTS, buckets=self.buckets, told="hash")

    def concepts(self, version: int | None = None) -> DataFrame:
        """All concepts of a version (the current one), deleted ones included; none before the first run."""
        return self.store().rows(self.version() if version is None else version)

    def live(self) -> DataFrame:
        return self.concepts().where("status <> 'deleted'")

    def edges(self) -> DataFrame:
        empty = "source string, target string, type string, confidence double"
        return self.spark.createDataFrame([], empty) if not self.version() else files.read_graph(self.spark, self.folder())[1]

    def vectors(self) -> DataFrame | None:
        return storage.load_vectors(self.spark, self.folder()) if self.version() else None

    def cells(self) -> VectorCells | None:
        """The vectors of the current version, stored for search; None without any."""
        there = self.version() and storage.read_or_none(self.spark, f"{self.folder()}/cells/centres") is not None
        return VectorCells(self.spark, f"{self.folder()}/cells") if there else None

    def history(self) -> DataFrame:
        """(ts, provider) of the runs that wrote a version."""
        rows = storage.read_or_none(self.spark, f"{self.root}/runs")
        return rows if rows is not None else self.spark.createDataFrame([], "ts timestamp, provider string")

    def changes(self) -> DataFrame:
        """(slug, change, hash, ts): what each version added, modified or deleted."""
        return self.store().changes(self.version())

    def links(self) -> DataFrame | None:
        """The scored links of the current version, without those that a model named; None if there are none stored."""
        return storage.read_or_none(self.spark, f"{self.folder()}/links") if self.version() else None

    def save(self, concepts: DataFrame, embedder: Embedder | None = None, now: Column | None = None) -> None:
        """Writes the buckets of concepts that differ, their links, graph and Markdown as a new version, and then makes it the current one.

        Only links with a changed end are scored. Edges are those links and the relations that concepts name.
        Vectors of concepts whose text is the same go along.
        """
        last, version = self.version(), self.version() + 1
        folder, before, links = self.folder(version), self.live(), self.links()
        self.store().replace(_shaped(concepts), _now() if now is None else now, version)
        rows = self.concepts(version)
        live = rows.where("status <> 'deleted'")
        columns = ["source", "target", "type", "confidence"]
        changed = graph.stored(linking.changed_concepts(before, live))
        new = linking.score_links(live) if links is None else linking.relink(links, live, changed)
        new.select(*columns).write.mode("overwrite").parquet(f"{folder}/links")
        links = self.spark.read.parquet(f"{folder}/links")
        nodes, edges = graph.build(rows, links.unionByName(C.links_of(live).select(*columns)))
        files.write_graph(nodes.select("slug", "name"), edges, folder)
        storage.write_markdown_files(rows, folder)
        files.write_provenance(live, folder)
        old = storage.load_vectors(self.spark, self.folder(last)) if last else None
        kept = None if old is None else old.join(changed, "slug", "left_anti").join(live.select("slug"), "slug", "left_semi")
        if embedder is not None:
            new = live if kept is None else live.join(kept.select("slug"), "slug", "left_anti")
            made = embed_concepts(new, embedder).select("slug", "vector", F.lit(str(getattr(embedder, "model", ""))).alias("model"), F.size("vector").alias("width"))
            kept = made if kept is None else kept.select(*made.columns).unionByName(made)
        if kept is not None:
            storage.keep_vectors(kept, folder)
            VectorCells(self.spark, f"{folder}/cells").build(storage.load_vectors(self.spark, folder).select(F.col("slug").alias("key"), "vector"))
        storage.Storage(self.spark, self.root).write_text(f"finished/{version:09d}", "")


def _now() -> Column:
    return F.lit(datetime.now(timezone.utc).replace(tzinfo=None)).cast("timestamp")


def _fields() -> list:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(CONCEPTS).fields


def _shaped(concepts: DataFrame) -> DataFrame:
    """``concepts`` with all columns of a store; missing ones are null."""
    have = set(concepts.columns)
    return concepts.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in _fields()))


def distilled(raw: DataFrame, now: Column, chunks: DataFrame | None = None, hashes: DataFrame | None = None) -> DataFrame:
    """Raw concepts as concepts of a store, with the places in ``chunks`` where they were named."""
    def by_rule(rows: DataFrame) -> DataFrame:
        text = C.remove_fluff(F.col("raw_content"))
        parts = rows.withColumn("clean", text).withColumn("parts", C.sentences(F.col("clean")))
        parts = parts.withColumn("definition", C.build_definition(F.col("name"), F.col("parts")))
        parts = parts.withColumn("explanation", C.build_explanation(F.col("parts"), F.col("definition"))).withColumn("insights", C.insights(F.col("clean"), F.col("definition")))
        return parts.withColumn("examples", C.examples(F.col("clean"))).withColumn("tags", C.short_keywords(F.col("clean"))).drop("clean", "parts")

    rows = extraction.distill(raw, by_rule).withColumn("slug", C.slugify(F.col("name"))).where("slug <> ''")
    rows = rows.withColumn("status", F.lit("active")).withColumn("last_reinforced_at", now).withColumn("hash", C.concept_hash(F.col("name"), F.col("definition")))
    if chunks is not None:
        rows = graph.stored(rows)
        rows = rows.join(C.source_refs(rows, chunks, hashes, now), "slug", "left")
    return _shaped(rows)


def ingest(kb: KnowledgeBase, source: str, provider: str = "mock", model: extraction.Model | None = None, now: datetime | None = None, dry_run: bool = False, extensions: tuple[str, ...] = ("md", "txt"), embedder: Embedder | None = None) -> dict:
    """Brings ``kb`` up to the transcripts in ``source``; only new and changed files are read into concepts.

    Concepts lose the files that changed or went, and are deleted when none is left; what the new
    texts say is merged into them. A dry run only counts. File hashes are saved last, so a run that
    ends early is done again. With an ``embedder`` the concepts without a vector get one.
    """
    spark, time = kb.spark, F.lit(now or datetime.now(timezone.utc).replace(tzinfo=None)).cast("timestamp")
    last = kb.history().groupBy("provider").agg(F.max("ts").alias("ts"))
    if last.head(1) and lifecycle.provider_conflict(last, provider).head()["conflict"]:
        raise ValueError("mock and real results must not mix in one knowledge base")
    texts = None
    for extension in extensions:
        more = files.reader_for(extension)(spark, source)
        texts = more if texts is None else texts.unionByName(more)
    hashes = graph.stored(lifecycle.file_hashes(texts.select(F.col("source_file").alias("path"), F.col("text").alias("content"))))
    states = graph.stored(lifecycle.detect_changes(storage.load_hashes(spark, kb.root), hashes))
    counts = {r["state"]: r["n"] for r in states.groupBy("state").agg(F.count("*").alias("n")).collect()}
    files_told = {s: counts.get(s, 0) for s in ("new", "modified", "unchanged", "deleted")}
    if not any(files_told[s] for s in ("new", "modified", "deleted")):
        return {"skipped": True, "files": files_told}
    before = kb.concepts()
    gone = states.where("state in ('modified', 'deleted')").select("path")
    kept = lifecycle.drop_sources(before, gone, time)
    fresh = texts.join(states.where("state in ('new', 'modified')").select(F.col("path").alias("source_file")), "source_file", "left_semi")
    chunks = graph.stored(parsing.chunk_turns(parsing.parse_turns(fresh).where("role = 'assistant'")))
    raw, counters = extraction.extract_concepts(parsing.batch_chunks(chunks), chunks, model, f"{kb.root}/replies" if model else None)
    raw = raw.withColumn("ord", F.struct("source_file", "batch", "rank"))
    found = graph.stored(distilled(dedup.deduplicate(graph.stored(raw)), time, chunks, hashes))
    versions = _shaped(kept).withColumn("o", F.lit(1)).unionByName(found.withColumn("o", F.lit(2)))
    merged = hygiene.with_conflicts(C.merge_concepts(versions, "o")).withColumn("hash", C.concept_hash(F.col("name"), F.col("definition")))
    after = graph.stored(_shaped(merged))
    told = lifecycle.diff_counts(before.where("status <> 'deleted'"), after.where("status <> 'deleted'")).head().asDict()
    result = {"skipped": False, "files": files_told, "concepts": told, "extraction": counters.head().asDict()}
    if dry_run:
        return result
    kb.save(after, embedder, time)
    files.append_run(spark, kb.root, provider, time)
    storage.save_hashes(hashes, kb.root)
    return result


def pruned(kb: KnowledgeBase, older_than_days: float | None = None, now: datetime | None = None, provider: str = "mock") -> int:
    """Removes deleted concepts, writes a version; returns how many went."""
    time = F.lit(now or datetime.now(timezone.utc).replace(tzinfo=None)).cast("timestamp")
    rows = kb.concepts()
    left = graph.stored(lifecycle.prune(rows, older_than_days, time))
    n = rows.count() - left.count()
    if n:
        kb.save(left, now=time)
        files.append_run(kb.spark, kb.root, provider, time)
    return n
