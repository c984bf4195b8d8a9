"""Turns and batches of long files against those of whole texts and of a fold."""

import random

import pytest
from pyspark.sql import functions as F

from thoughtloom.operators import parsing as P
from thoughtloom.operators import scans as Z

LINES = ["Human: hi", "Assistant:", "## User", "System: be kind", "---", " --- ", "text", "", "more text", "  ", "bot: 1", "user : x"]


def test_turns_of_lines_equal_those_of_whole_texts(spark, tmp_path):
    rng, rows, files = random.Random(2), [], []
    for f in range(60):
        lines = rng.choices(LINES, k=rng.randint(1, 40)) if f % 5 else rng.choices(["text", "---", "", "  more"], k=rng.randint(1, 9))
        files.append((f"f{f}", "\n".join(lines)))
        cuts = sorted(rng.sample(range(len(lines) + 1), min(len(lines), 3)))
        rows += [(f"f{f}", sum(c <= i for c in cuts), i, line) for i, line in enumerate(lines)]
    want = P.parse_turns(spark.createDataFrame(files, "source_file string, text string"))
    got = Z.turns_of_lines(spark.createDataFrame(rows, "source_file string, block int, at int, line string"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_lines_of_files_that_are_read_in_parts(spark, tmp_path):
    text = "lost\n" + "".join(f"Human: ask {i}\nmore {i}\n---\nanswer {i}\n\n" for i in range(3000))
    (tmp_path / "long.md").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = Z.line_rows(spark, str(tmp_path))
        assert lines.select("block").distinct().count() > 3
        got = Z.turns_of_lines(lines).orderBy("idx").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.idx, r.role, r.content) for r in got] == [(2 * i + k, *x) for i in range(3000) for k, x in enumerate((("human", f"ask {i}\nmore {i}"), ("assistant", f"answer {i}")))]


def folded(lengths, limit):
    out, batch, used = [], 0, 0
    for n in lengths:
        if used > 0 and used + n > limit:
            batch, used = batch + 1, 0
        used += n
        out.append(batch)
    return out


@pytest.mark.parametrize("rows, limit, longest", [(2000, 100, 40), (300, 10, 2000), (1, 10, 5), (3000, 10**6, 9)])
def test_batches_of_long_files_equal_a_fold(spark, monkeypatch, rows, limit, longest):
    monkeypatch.setattr(Z, "ROWS", 64)
    rng = random.Random(rows)
    table, want = [], {}
    for f in range(3):
        places = sorted({(rng.randrange(200), rng.randrange(400)) for _ in range(rows)})
        lengths = [rng.randint(1, longest) for _ in places]
        table += [(f"f{f}", t, c, f"{f}:{t}:{c}", n) for (t, c), n in zip(places, lengths)]
        want |= {f"{f}:{t}:{c}": b for (t, c), b in zip(places, folded(lengths, limit))}
    got = Z.batch_numbers(spark.createDataFrame(table, "source_file string, turn_index int, chunk_index int, chunk_id string, n int"), limit)
    assert {r.chunk_id: r.batch for r in got.collect()} == want


def test_files_of_either_kind_are_batched_alike(spark, monkeypatch):
    rng = random.Random(9)
    rows = [("short", 0, i, f"s{i}", "x" * rng.randint(1, 60)) for i in range(20)] + [("long", i % 9, i, f"l{i}", "y" * rng.randint(1, 60)) for i in range(300)]
    chunks = spark.createDataFrame(rows, "source_file string, turn_index int, chunk_index int, chunk_id string, content string")
    want = sorted(map(str, P.batch_chunks(chunks, 100).collect()))
    monkeypatch.setattr(P, "FOLDED", 50)
    assert sorted(map(str, P.batch_chunks(chunks, 100).collect())) == want


def test_a_file_of_a_million_chunks(spark):
    chunks = spark.range(1_000_000).select(F.lit("f").alias("source_file"), F.floor(F.col("id") / 100).alias("turn_index"), (F.col("id") % 100).alias("chunk_index"), F.col("id").cast("string").alias("chunk_id"), F.lit(60).alias("n"))
    got = Z.batch_numbers(chunks).groupBy("batch").count().agg(F.count("*"), F.min("count"), F.max("count")).head()
    assert tuple(got) == (10_000, 100, 100)
