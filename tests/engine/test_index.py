"""The stored index and the vector cells against scans, also after updates, and what they open."""

import random

import numpy as np
from pyspark.sql import functions as F

from thoughtloom.operators.cells import VectorCells
from thoughtloom.operators.index import KeywordIndex
from thoughtloom.operators.retrieval import keyword_scores, vector_scores
from thoughtloom.sources.storage import scratch

ASKED = "w3 w3 w40 rare and w7 unknown"


def texts(seed, n, first=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(first, first + n):
        size = rng.choice((0, 2, 5, 30, 200)) if i % 9 else rng.randint(1, 6)
        rows.append((f"k{i}", " ".join(rng.choices(words, weights=[1 / (1 + j) for j in range(80)], k=size)) + (" rare" if i % 50 == 3 else "")))
    return rows


def scanned(spark, rows, k):
    scores = keyword_scores(spark.createDataFrame(rows, "key string, text string"), "key", F.col("text"), ASKED)
    best = sorted(((-round(r.score, 9), r.key) for r in scores.collect()))[:k]
    return [(key, -s) for s, key in best]


def found(index, k):
    return sorted(((r.key, round(r.score, 9)) for r in index.search(ASKED, k).collect()), key=lambda x: (-x[1], x[0]))


def test_the_index_gives_the_best_of_a_scan_and_opens_few_blocks(spark):
    rows = texts(1, 3000)
    index = KeywordIndex(spark, scratch(spark, "index"))
    index.build(spark.createDataFrame(rows, "key string, text string"))
    for k in (1, 10):
        assert found(index, k) == scanned(spark, rows, k)
    every = spark.read.parquet(f"{index.root}/postings").where(F.col("token").isin(ASKED.split())).select("block").distinct().count()
    _, opened = index._search(ASKED, 10, 12)
    assert opened.count() < every / 2
    assert index.search("", 5).count() == 0 and index.search("nowhere at_all", 5).where("key = 'k1'").count() == 0


def test_updates_replace_add_and_remove(spark):
    now = dict(texts(2, 300))
    index = KeywordIndex(spark, scratch(spark, "index"))
    index.build(spark.createDataFrame(list(now.items()), "key string, text string"))
    for turn in (1, 2):
        new = dict(texts(10 + turn, 40, first=turn * 20)) | dict(texts(20 + turn, 30, first=1000 * turn))
        gone = [f"k{i}" for i in range(100 * turn, 100 * turn + 25)]
        index.update(spark.createDataFrame(list(new.items()), "key string, text string"), spark.createDataFrame([(g,) for g in [*gone, "nobody"]], "key string"))
        now = {k: v for k, v in now.items() if k not in gone} | new
        assert found(index, 12) == scanned(spark, list(now.items()), 12)
    assert index._read("sizes", "n bigint, segment int").agg(F.sum("n")).head()[0] == len(now)


def test_cells_give_the_nearest_of_a_scan_and_few_are_opened(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 12))
    near = [[float(x) for x in centres[i % 30] + 0.15 * rng.normal(size=12)] for i in range(1500)]
    rows = [(f"v{i:05}", v) for i, v in enumerate(near)] + [("zero", [0.0] * 12), ("null", None), ("part", [None] * 12), ("twin", near[0])]
    df = spark.createDataFrame(rows, "key string, vector array<double>")
    cells = VectorCells(spark, scratch(spark, "cells"))
    cells.build(df.where("key < 'v01200' or key > 'v99'"), cells=40)
    cells.add(df.where("key >= 'v01200' and key < 'v99'"))
    for asked in (near[0], near[1300], [1.0] * 12):
        usable = df.where("key not in ('null', 'part')")
        want = vector_scores(usable, "key", "vector", F.array(*map(F.lit, asked)), top=20)
        assert sorted(map(tuple, cells.nearest(asked, 20).collect())) == sorted(map(tuple, want.collect()))
    _, opened = cells._nearest(near[0], 20, 12)
    assert len(opened) <= 12
    assert cells.nearest([0.0] * 12, 3).count() == 3


def test_runs_part_words_as_a_scan_does_and_a_build_moves_nothing(spark):
    import pyarrow as pa

    from thoughtloom.operators import index as I

    rows = [("a", "end"), ("b", "start Ünder_x"), ("c", None), ("d", ""), ("e", "  two  two end"), ("f", "É9z")]
    low = pa.array([(t or "").lower().encode() for _, t in rows], pa.binary())
    for some in (low, low.slice(1), low.slice(2, 2)):
        text, said = I._words(some)
        got = [[] for _ in range(len(some))]
        for t, w in zip(text.tolist(), said.to_pylist()):
            got[t].append(w)
        want = [bytes(int(x) for x in I._SIGNS[list(t)]).decode().split() if t else [] for t in some.to_pylist()]
        assert got == want
    # runs of a few texts each find what a scan finds, and no text or posting is moved
    many = texts(7, 900) + [(f"x{k}", t) for k, t in rows]
    df = spark.createDataFrame(many, "key string, text string")
    index = KeywordIndex(spark, scratch(spark, "index"), run=3000)
    index.build(df)
    assert found(index, 15) == scanned(spark, many, 15)
    assert "Exchange" not in index._rows(df, 0)._jdf.queryExecution().executedPlan().toString()
    index.update(df.where("key < 'k2'"), spark.createDataFrame([("x",), ("k5",)], "key string"))
    assert found(index, 15) == scanned(spark, [r for r in many if r[0] != "k5"], 15)
