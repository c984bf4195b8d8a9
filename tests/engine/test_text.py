from pyspark.sql import functions as F

from thoughtloom.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("x")).head()["x"]


def test_slugs(spark):
    for given, slug in (("KV Cache", "kv-cache"), ("  A_b  c--d!", "a-b-c-d"), ("Ünïcode Wörd", "ünïcode-wörd"), ("***", ""), ("-x-", "x")):
        assert one(spark, T.slugify(F.col("t")), t=given) == slug


def test_hash_and_space(spark):
    assert one(spark, T.content_hash(F.col("t")), t="abc") == "ba7816bf8f01"
    assert one(spark, T.normalize_whitespace(F.col("t")), t=" a \n\t b ") == "a b"
    assert one(spark, T.strip_hidden(F.col("t")), t="a​b﻿\U000e0041c") == "abc"


def test_sentences(spark):
    assert one(spark, T.sentences(F.col("t")), t="One. Two!  Three? Four") == ["One.", "Two!", "Three?", "Four"]
    assert one(spark, T.sentences(F.col("t")), t="  ") == []


def test_keywords(spark):
    text = "Cache the cache: latency, latency and throughput of the cache x"
    assert one(spark, T.short_keywords(F.col("t"), 3), t=text) == ["cache", "latency", "throughput"]
    rows = T.keywords(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t", 2).orderBy("rank").collect()
    assert [(r.word, r.n) for r in rows] == [("cache", 3), ("latency", 2)]


def test_jaccard(spark):
    sim = T.jaccard(T.word_set(F.col("a")), T.word_set(F.col("b")))
    assert one(spark, sim, a="a b c", b="B c d") == 0.5
    assert one(spark, sim, a="", b="x") == 0.0


def test_only_texts_of_repeated_keys_are_brought_together(spark, monkeypatch):
    said = [(1, "Alpha beta alpha gamma"), (2, "delta Delta delta"), (2, "gamma gamma delta"), (3, None), (None, "omega"), (None, "omega psi_1")]
    rows = spark.createDataFrame(said, "k int, t string")
    want = sorted([(1, 1, "alpha", 2), (1, 2, "beta", 1), (2, 1, "delta", 4), (2, 2, "gamma", 2), (None, 1, "omega", 2), (None, 2, "psi_1", 1)], key=str)
    assert sorted(map(tuple, T.keywords(rows, "k", "t", 2).collect()), key=str) == want
    one = T.keywords(rows.where("k = 1"), "k", "t", 2)
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString() and one.count() == 2
    monkeypatch.setattr(T, "REPEATED", 1)  # more keys repeat than are sent to the tasks
    assert sorted(map(tuple, T.keywords(rows, "k", "t", 2).collect()), key=str) == want
