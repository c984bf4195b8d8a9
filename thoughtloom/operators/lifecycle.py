"""Incremental ingestion: change detection, soft deletes, snapshots, pruning, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def file_hashes(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    return files.select(F.col(path).alias("path"), F.sha2(F.col(content).cast("binary"), 256).alias("hash"))


def detect_changes(known: DataFrame, current: DataFrame) -> DataFrame:
    """(path, state) of the union of two (path, hash) tables: new, modified, unchanged or deleted."""
    old, now = known.select("path", F.col("hash").alias("old")), current.select("path", F.col("hash").alias("now"))
    state = F.when(F.col("old").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("old") == F.col("now"), "unchanged").otherwise("modified")
    return old.join(now, "path", "full").select("path", state.alias("state"))


def diff_snapshots(before: DataFrame, after: DataFrame) -> DataFrame:
    """(slug, change): added, modified or deleted between two (slug, hash) snapshots."""
    rows = detect_changes(before.select(F.col("slug").alias("path"), "hash"), after.select(F.col("slug").alias("path"), "hash"))
    names = F.create_map(*(F.lit(x) for x in ("new", "added", "modified", "modified", "deleted", "deleted")))
    return rows.where("state <> 'unchanged'").select(F.col("path").alias("slug"), F.element_at(names, F.col("state")).alias("change"))


def snapshots_between(history: DataFrame, since: str | None = None) -> DataFrame:
    """The diff of the latest snapshot of (ts, slug, hash) against the last one up to ``since``, or the one before."""
    times = history.select("ts").distinct()
    latest = times.agg(F.max("ts")).head()[0]
    earlier = times.where(F.col("ts") < latest if since is None else F.col("ts") <= F.lit(since).cast("timestamp")).agg(F.max("ts")).head()[0]
    return diff_snapshots(history.where(F.col("ts") == earlier), history.where(F.col("ts") == latest))


def diff_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: how many slugs a run would add, update, leave and remove."""
    rows = detect_changes(before.select(F.col("slug").alias("path"), "hash"), after.select(F.col("slug").alias("path"), "hash"))
    named = (("new", "added"), ("modified", "updated"), ("unchanged", "unchanged"), ("deleted", "removed"))
    return rows.agg(*(F.count_if(F.col("state") == s).alias(n) for s, n in named))


def drop_sources(concepts: DataFrame, changed: DataFrame, now: Column) -> DataFrame:
    """Concepts without the changed files among their sources; those left without any are deleted."""
    listed = concepts.select("slug", F.posexplode("source_files").alias("at", "path"))
    kept = listed.join(changed.select("path"), "path", "left_anti").groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("at", "path"))).alias("_k"))
    rows = concepts.join(kept, "slug", "left").withColumn("_left", F.coalesce(F.transform("_k", lambda x: x["path"]), F.array().cast("array<string>")))
    dies = (F.size("_left") == 0) & (F.size("source_files") > 0)
    out = rows.withColumn("status", F.when(dies, "deleted").otherwise(F.col("status"))).withColumn("deleted_at", F.when(dies, F.coalesce("deleted_at", now)).otherwise(F.col("deleted_at")))
    if "sources" in concepts.columns:  # where they were named goes with them
        out = out.withColumn("sources", F.filter("sources", lambda s: F.array_contains("_left", s["transcript_path"])))
    return out.withColumn("source_files", F.col("_left")).drop("_k", "_left")


def prune(concepts: DataFrame, older_than_days: float | None = None, now: Column | None = None) -> DataFrame:
    """Concepts without the deleted ones, or without those deleted for so many days."""
    gone = F.col("status") == "deleted"
    if older_than_days is not None:
        gone = gone & (F.unix_micros(now) - F.unix_micros("deleted_at") >= older_than_days * 86_400_000_000)
    return concepts.where(~F.coalesce(gone, F.lit(False)))


def provider_conflict(history: DataFrame, provider: str) -> DataFrame:
    """One row: whether mock and real results would mix; a history without a name counts as real."""
    last = F.max_by(F.coalesce("provider", F.lit("real")), "ts")
    return history.agg((F.coalesce(last == "mock", F.lit(provider == "mock")) != F.lit(provider == "mock")).alias("conflict"))


def kb_stats(concepts: DataFrame) -> DataFrame:
    """One row of totals over the concepts that are not deleted."""
    live = concepts.where("status <> 'deleted'") if "status" in concepts.columns else concepts
    size = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0)) if c in concepts.columns else F.lit(0)
    return live.agg(F.count("*").alias("concepts"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 6).alias("mean_confidence"), size("insights").alias("insights"), size("tags").alias("tags"), size("source_files").alias("sources"))
