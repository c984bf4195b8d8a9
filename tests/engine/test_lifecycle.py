import math

from pyspark.sql import functions as F

from thoughtloom.operators import hygiene as H
from thoughtloom.operators import lifecycle as L
from thoughtloom.sources import files as S
from thoughtloom.streaming import events as V

NOW = "2024-06-01 00:00:00"


def test_age_and_decay(spark):
    rows = [("2024-05-02 00:00:00", 0.8, 0), ("2024-05-31T00:00:00Z", 0.8, 3), (None, 0.5, 15), ("not a time", 0.5, 0), ("2030-01-01 00:00:00", 1.0, 0)]
    df = spark.createDataFrame(rows, "t string, base double, n int")
    age = H.age_days(F.col("t"), F.lit(NOW))
    got = [(round(r.age, 6), r.adj) for r in df.select(age.alias("age"), H.adjusted_confidence(F.col("base"), age, F.col("n")).alias("adj")).collect()]
    assert [a for a, _ in got] == [30.0, 1.0, 3650.0, 3650.0, 0.0]
    assert got[0][1] == round(0.8 * (0.5 + 0.5 * math.exp(-30 / 62)), 3)
    assert got[2][1] == 0.5 and got[3][1] == 0.25 and got[4][1] == 1.0


def test_conflicts(spark):
    df = spark.createDataFrame([("s", ["It always works", "It sometimes works", "small bytes", "a bit, some bits"])], "slug string, insights array<string>")
    assert sorted((r.i, r.j) for r in H.insight_conflicts(df).collect()) == [(0, 1), (2, 3)]
    assert (1, 2) in {(r.i, r.j) for r in H.insight_conflicts(df, whole_words=False).collect()}
    pairs = spark.createDataFrame([("same text here", "same text here"), ("one thing", "zzzz"), ("", "x")], "a string, b string")
    assert [r.a for r in H.definition_conflicts(pairs).collect()] == ["one thing"]


def test_review(spark):
    rows = [("a", "A", "conflicted", ["f"], 0.1, None), ("b", "B", "active", [], 0.9, NOW), ("c", "C", "active", ["f"], 0.2, "2023-01-01 00:00:00"), ("d", "D", "active", ["f"], 0.9, NOW)]
    df = spark.createDataFrame(rows, "slug string, name string, status string, source_files array<string>, confidence double, last_reinforced_at string")
    assert {r.slug: r.reason for r in H.review_queue(df, F.lit(NOW)).collect()} == {"a": "conflicted", "b": "orphaned", "c": "stale"}
    decided = H.apply_decisions(df, spark.createDataFrame([("a", "delete"), ("b", "skip")], "slug string, action string"), F.lit(NOW).cast("timestamp"))
    assert {r.slug: r.status for r in decided.collect()} == {"a": "deleted", "b": "active", "c": "active", "d": "active"}


def test_changes_and_diffs(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "slug string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "slug string, hash string")
    assert sorted(tuple(r) for r in L.diff_snapshots(old, new).collect()) == [("b", "modified"), ("c", "deleted"), ("d", "added")]
    assert L.diff_snapshots(old, old).count() == 0
    assert L.diff_counts(old, new).head().asDict() == {"added": 1, "updated": 1, "unchanged": 1, "removed": 1}


def test_soft_delete_and_prune(spark):
    rows = [("a", ["x", "y"], "active", None), ("b", ["x"], "active", None), ("c", [], "active", None)]
    df = spark.createDataFrame(rows, "slug string, source_files array<string>, status string, deleted_at timestamp")
    out = L.drop_sources(df, spark.createDataFrame([("x",)], "path string"), F.lit(NOW).cast("timestamp"))
    assert {r.slug: (r.source_files, r.status) for r in out.collect()} == {"a": (["y"], "active"), "b": ([], "deleted"), "c": ([], "active")}
    assert L.prune(out).count() == 2
    assert L.prune(out, 30, F.lit("2024-06-10").cast("timestamp")).count() == 3


def test_store_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("KV Cache", "kv-cache", "Def.", ["t"], ["f"], 0.9, "active", "h1")], "name string, slug string, definition string, tags array<string>, source_files array<string>, confidence double, status string, hash string")
    folder = str(tmp_path)
    S.write_store(df, folder)
    assert S.read_store(spark, folder).collect() == df.collect()
    S.write_markdown(df, folder)
    text = spark.read.json(f"{folder}/markdown").head()["markdown"]
    assert text == '---\ntitle: "KV Cache"\nslug: "kv-cache"\ntags: [t]\nconfidence: 0.90\nsources:\n  - "f"\n---\n\n# KV Cache\n\n## Definition\n\nDef.\n'
    S.append_snapshot(df, folder, "mock", F.lit("2024-01-01").cast("timestamp"))
    S.append_snapshot(df.withColumn("hash", F.lit("h2")), folder, "mock", F.lit("2024-01-02").cast("timestamp"))
    history = S.read_snapshots(spark, folder)
    assert [tuple(r) for r in L.snapshots_between(history).collect()] == [("kv-cache", "modified")]
    assert L.provider_conflict(history, "real").head()["conflict"] is True
    assert L.provider_conflict(history.limit(0), "real").head()["conflict"] is False


def test_late_events_are_dropped_in_a_stream(spark, tmp_path):
    schema = "ts timestamp, user_id int, event_type string, value double"
    for k, rows in enumerate(([("2024-01-01 00:10:00", 1, "x", 1.0)], [("2024-01-01 05:00:00", 1, "x", 2.0)], [("2024-01-01 06:00:00", 1, "x", 2.0)], [("2024-01-01 00:20:00", 1, "x", 9.0), ("2024-01-01 09:00:00", 2, "x", 3.0)], [("2024-01-01 20:00:00", 2, "x", 1.0)])):
        spark.createDataFrame(rows, "ts string, user_id int, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = V.tumbling_counts(stream).writeStream.format("memory").queryName("tumbled").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sum(r.n for r in spark.table("tumbled").collect() if r.start.hour == 0) == 1


def test_ingestion_in_batches(spark, tmp_path):
    spark.createDataFrame([("a", "x")], "path string, content string").write.parquet(f"{tmp_path}/in")
    seen = []
    stream = spark.readStream.schema("path string, content string").parquet(f"{tmp_path}/in")
    V.ingest_stream(stream, lambda df, n: seen.append((n, df.count())), f"{tmp_path}/cp").awaitTermination(60)
    assert seen == [(0, 1)]
